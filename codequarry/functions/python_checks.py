"""Checks of single nodes of Python's syntax tree that ask for more than attributes: each yields rule keys."""

from __future__ import annotations

import ast
import re

_F = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Names that the checks know. Fixed values.
TEXT_FIELDS = frozenset("CharField TextField SlugField EmailField URLField UUIDField FilePathField FileField ImageField".split())
OLD_SOUP = frozenset("findAll findAllNext findAllPrevious findChild findChildren findNext findNextSibling findNextSiblings findParent findParents findPrevious findPreviousSibling findPreviousSiblings nextSibling previousSibling replaceWith".split())
LOG_LEVELS = frozenset("debug info warning warn error critical exception".split())
LIMITS = {"month": (1, 12), "day": (1, 31), "hour": (0, 23), "minute": (0, 59), "second": (0, 59), "microsecond": (0, 999999)}
PARTS = {"datetime": ("year", "month", "day", "hour", "minute", "second", "microsecond"), "date": ("year", "month", "day"), "time": ("hour", "minute", "second", "microsecond")}


def dotted(n: ast.AST) -> str:
    parts = []
    while isinstance(n, ast.Attribute):
        parts.append(n.attr)
        n = n.value
    return ".".join([n.id, *reversed(parts)]) if isinstance(n, ast.Name) else ""


def _call(n, *names: str) -> bool:
    return isinstance(n, ast.Call) and dotted(n.func) in names


def _value(n):
    return n.value if isinstance(n, ast.Constant) else None


def _keyword(n: ast.Call, name: str):
    return next((k.value for k in n.keywords if k.arg == name), None)


def _same(a: ast.AST, b: ast.AST) -> bool:
    return ast.dump(a) == ast.dump(b)


def _literal_kind(n: ast.AST) -> str:
    """The kind of a literal, or an empty text."""
    if isinstance(n, ast.Constant) and n.value is not None and not isinstance(n.value, (bool, type(...))):
        return "number" if isinstance(n.value, (int, float, complex)) else type(n.value).__name__
    return {"List": "list", "Tuple": "tuple", "Dict": "dict", "Set": "set"}.get(type(n).__name__, "")


#: Fields that hold no nodes, or only contexts and operators.
_BARE = frozenset("ctx op ops kind type_comment id attr arg level simple is_async conversion".split())
_FIELDS: dict[type, tuple[str, ...]] = {ast.Constant: (), ast.Name: ()}


def child_fields(kind: type) -> tuple[str, ...]:
    """The fields of a kind of node that may hold nodes with children or places of their own."""
    if kind not in _FIELDS:
        _FIELDS[kind] = tuple(f for f in kind._fields if f not in _BARE)
    return _FIELDS[kind]


def children(n: ast.AST) -> list[ast.AST]:
    """The nodes right below, without contexts and operators."""
    out = []
    for f in child_fields(type(n)):
        v = getattr(n, f, None)
        if type(v) is list:
            out += [x for x in v if isinstance(x, ast.AST)]
        elif isinstance(v, ast.AST):
            out.append(v)
    return out


#: The nodes inside of functions and other nodes of the file at hand, walked once.
WALKED: dict[int, list[ast.AST]] = {}


def inside(n: ast.AST) -> list[ast.AST]:
    """Nodes of a function but not of functions and classes inside it."""
    if id(n) not in WALKED:
        every, todo = [], children(n)
        while todo:
            x = todo.pop()
            every.append(x)
            if not isinstance(x, (*_F, ast.Lambda, ast.ClassDef)):
                todo += children(x)
        WALKED[id(n)] = every
    return WALKED[id(n)]


def _on_call(n: ast.Call):
    name, args = dotted(n.func), n.args
    first = args[0] if args else None
    last = name.rsplit(".", 1)[-1]
    if name in ("re.sub",) and isinstance(_value(first), str) and first.value and not re.search(r"[\\.^$*+?{}\[\]|()]", first.value) and not n.keywords and len(args) == 3:
        yield "S5361"
    if re.fullmatch(r"(?:self|cls)\.assert(?:Not)?Equals?", name) and len(args) >= 2 and _literal_kind(args[0]) and _literal_kind(args[1]) and _literal_kind(args[0]) != _literal_kind(args[1]):
        yield "S5845"
    if last in TEXT_FIELDS and name.startswith("models.") and _value(_keyword(n, "null")) is True:
        yield "S6553"
    if name == "render" and any(_call(a, "locals") for a in (*args, *(k.value for k in n.keywords))):
        yield "S6556"
    if last == "JsonResponse" and isinstance(first, (ast.List, ast.ListComp, ast.Tuple)) and _keyword(n, "safe") is None:
        yield "S6560"
    if name in ("np.array", "numpy.array") and isinstance(first, ast.GeneratorExp):
        yield "S6714"
    if last in PARTS and name in (last, f"datetime.{last}", f"dt.{last}", f"datetime.datetime.{last}"):
        given = {**dict(zip(PARTS[last], args)), **{k.arg: k.value for k in n.keywords}}
        for part, (low, high) in LIMITS.items():
            v = given.get(part)
            if isinstance(v, ast.UnaryOp) and isinstance(v.op, ast.USub) and isinstance(_value(v.operand), int):
                yield "S6882"
            elif isinstance(_value(v), int) and not isinstance(v.value, bool) and not low <= v.value <= high:
                yield "S6882"
        if _call(_keyword(n, "tzinfo"), "pytz.timezone"):
            yield "S6887"
    if last in ("strftime", "strptime"):
        for a in args:
            if isinstance(_value(a), str) and ("%H" in a.value and "%p" in a.value or "%I" in a.value and "%p" not in a.value):
                yield "S6883"
    if name == "pytz.timezone":
        yield "S6890"
    if name in ("sorted", "set") and _call(first, "reversed") or name == "set" and _call(first, "sorted"):
        yield "S7511"
    if _value(_keyword(n, "host")) == "0.0.0.0" and last in ("run", "serve", "create_server", "start_server"):
        yield "S8392"
    if name == "TypeVar" and _value(_keyword(n, "covariant")) is True and _value(_keyword(n, "contravariant")) is True:
        yield "S8515"
    if name == "sum" and (len(args) == 2 and isinstance(args[1], ast.List) and not args[1].elts or isinstance(_keyword(n, "start"), ast.List) and not _keyword(n, "start").elts):
        yield "S8520"
    if last in LOG_LEVELS and re.fullmatch(r"(?:logging|logger|log|self\.logger|self\.log|_logger)\.\w+", name) and first is not None:
        formatted = isinstance(first, ast.Call) and isinstance(first.func, ast.Attribute) and first.func.attr == "format" and isinstance(_value(first.func.value), str)
        if isinstance(first, ast.JoinedStr) and any(isinstance(v, ast.FormattedValue) for v in first.values) or isinstance(first, ast.BinOp) and isinstance(first.op, (ast.Mod, ast.Add)) and isinstance(_value(first.left), str) or formatted:
            yield "S8554"
    if isinstance(n.func, ast.Attribute) and n.func.attr in OLD_SOUP:
        yield "S8900"


def _on_function(n):
    decorators = [(dotted(d.func if isinstance(d, ast.Call) else d), d) for d in n.decorator_list]
    names = [d for d, _ in decorators]
    own = inside(n)
    returns = [x for x in own if isinstance(x, ast.Return) and x.value is not None]
    yields = any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in own)
    params = [*n.args.posonlyargs, *n.args.args]
    star = n.args.vararg or n.args.kwarg or n.args.kwonlyargs
    if yields and returns:
        yield "S2712"
    if yields and any(isinstance(x, ast.Raise) and x.exc is not None and dotted(x.exc.func if isinstance(x.exc, ast.Call) else x.exc) == "StopIteration" for x in own):
        yield "S8493"
    if "property" in names:
        if len(params) != 1 or star:
            yield "S5724"
        plain = [s for s in n.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant)) and not isinstance(s, ast.Pass)]
        if plain and not returns and not yields and not any(isinstance(x, ast.Raise) for x in own) and not any("abstract" in d for d in names):
            yield "S8504"
    if any(d.endswith(".setter") for d in names) and (len(params) != 2 or star) or any(d.endswith(".deleter") for d in names) and (len(params) != 1 or star):
        yield "S5724"
    if n.name == "__exit__":
        given = {p.arg for p in params[1:]}
        if any(isinstance(x, ast.Raise) and isinstance(x.exc, ast.Name) and x.exc.id in given for x in own):
            yield "S5706"
    for name, d in decorators:
        if name == "pytest.yield_fixture":
            yield "S9076"
        if name == "pytest.mark.xfail" and not (isinstance(d, ast.Call) and (_keyword(d, "reason") is not None)):
            yield "S9001"
        if isinstance(d, ast.Call) and not d.args and not d.keywords and (name == "pytest.fixture" or name.startswith("pytest.mark.")):
            yield "S9083"
        if isinstance(d, ast.Call) and re.fullmatch(r"(?:app|router)\.api_route", name) and isinstance(_keyword(d, "methods"), ast.List) and len(_keyword(d, "methods").elts) == 1:
            yield "S8412"


def _on_class(n: ast.ClassDef):
    names = [dotted(d.func if isinstance(d, ast.Call) else d) for d in n.decorator_list]
    data = any(d in ("dataclass", "dataclasses.dataclass") for d in names)
    bases = [dotted(b) for b in n.bases if dotted(b)]
    if len(set(bases)) < len(bases):
        yield "S8509"
    fields = [s.targets[0].id for s in n.body if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name)]
    if len(set(fields)) < len(fields):
        yield "S8512"
    if data and any(isinstance(s, _F) and s.name in ("__init__", "__repr__", "__eq__") for s in n.body):
        yield "S8490"
    if data and any(isinstance(s, ast.AnnAssign) and isinstance(s.value, ast.Call) and dotted(s.value.func) not in ("field", "dataclasses.field") for s in n.body):
        yield "S8685"
    if n.name == "Meta" and any(isinstance(s, ast.Assign) and dotted(s.targets[0]) == "fields" and _value(s.value) == "__all__" or isinstance(s, ast.Assign) and dotted(s.targets[0]) == "exclude" for s in n.body):
        yield "S6559"


def _on_compare(n: ast.Compare):
    if len(n.ops) != 1 or not isinstance(n.ops[0], (ast.In, ast.NotIn)):
        return
    right = n.comparators[0]
    if isinstance(right, ast.Constant) and (right.value is None or isinstance(right.value, (int, float, complex))):
        yield "S5642"
    if isinstance(right, (ast.List, ast.Tuple)) and not right.elts or isinstance(right, ast.Dict) and not right.keys:
        yield "S8503"
    if isinstance(right, ast.Call) and isinstance(right.func, ast.Attribute) and right.func.attr == "keys" and not right.args:
        yield "S8521"


def _on_loop(n: ast.For | ast.AsyncFor):
    if isinstance(n.iter, ast.Constant) and (n.iter.value is None or isinstance(n.iter.value, (int, float))):
        yield "S3862"
    pair = n.target.elts if isinstance(n.target, ast.Tuple) and len(n.target.elts) == 2 and all(isinstance(e, ast.Name) for e in n.target.elts) else []
    if pair and isinstance(n.iter, ast.Call) and isinstance(n.iter.func, ast.Attribute) and n.iter.func.attr == "items" and not n.iter.args and pair[1].id == "_":
        yield "S7512"
    if pair and _call(n.iter, "enumerate") and len(n.iter.args) == 1 and isinstance(n.iter.args[0], ast.Name):
        for x in (y for s in n.body for y in ast.walk(s)):
            if isinstance(x, ast.Subscript) and isinstance(x.ctx, ast.Load) and dotted(x.value) == n.iter.args[0].id and dotted(x.slice) == pair[0].id:
                yield "S8518"
                break
    mine = {x.id for x in ast.walk(n.target) if isinstance(x, ast.Name)} - {"_"}
    for x in (y for s in n.body for y in (s, *inside(s))):
        if isinstance(x, (ast.For, ast.AsyncFor)) and mine & {y.id for y in ast.walk(x.target) if isinstance(y, ast.Name)}:
            yield "S8510"
            break


def _suites(n: ast.AST):
    for name in ("body", "orelse", "finalbody"):
        s = getattr(n, name, None)
        if isinstance(s, list) and s and isinstance(s[0], ast.stmt):
            yield s


def _on_operator(n: ast.BinOp):
    kinds = _literal_kind(n.left), _literal_kind(n.right)
    if isinstance(n.op, (ast.Add, ast.Sub)) and all(kinds) and kinds[0] != kinds[1]:
        yield "S5607"
    if isinstance(n.op, ast.Mod) and isinstance(_value(n.left), str) and isinstance(n.right, ast.Tuple) and not any(isinstance(e, ast.Starred) for e in n.right.elts):
        marks = re.findall(r"%(?:%|(\([^)]*\))?[-#0 +]*(\*|\d+)?(?:\.(\*|\d+))?[hlL]?([diouxXeEfFgGcrsa]))", n.left.value)
        used = [m for m in marks if m[3]]
        if not any(m[0] for m in used) and sum(1 + (m[1] == "*") + (m[2] == "*") for m in used) != len(n.right.elts):
            yield "S2275"


def _on_condition(n: ast.BoolOp):
    calls = [v for v in n.values if isinstance(v, ast.Call) and isinstance(v.func, ast.Attribute) and v.func.attr in ("startswith", "endswith") and len(v.args) == 1]
    if isinstance(n.op, ast.Or) and any(a.func.attr == b.func.attr and _same(a.func.value, b.func.value) for i, a in enumerate(calls) for b in calls[:i]):
        yield "S8513"


def _on_subscript(n: ast.Subscript):
    if not isinstance(n.ctx, ast.Load):
        return
    if isinstance(n.value, ast.Constant) and not isinstance(n.value.value, (str, bytes)):
        yield "S5644"
    negative = isinstance(n.slice, ast.UnaryOp)
    index = _value(n.slice.operand if negative else n.slice)
    if isinstance(index, float):
        yield "S6663"
    if _call(n.value, "sorted") and len(n.value.args) == 1 and index == int(negative):
        yield "S8517"
    if _call(n.value, "list") and len(n.value.args) == 1 and index == 0 and not negative:
        yield "S8519"


def _on_groups(n: ast.TryStar):
    if any(h.type is not None and dotted(h.type) in ("ExceptionGroup", "BaseExceptionGroup") for h in n.handlers):
        yield "S6468"


def _on_assert(n: ast.Assert):
    if isinstance(n.test, ast.Constant) and n.test.value is False and n.msg is None:
        yield "S9077"


def _on_import(n: ast.ImportFrom):
    if n.module == "pytest" and not n.level:
        yield "S9084"


def _on_with(n: ast.With | ast.AsyncWith):
    if any(_call(i.context_expr, "pytest.raises", "self.assertRaises") for i in n.items) and len(n.body) > 1 and isinstance(n.body[-1], ast.Assert):
        yield "S5915"


def _on_if(n: ast.If):
    if len(n.body) != 1 or n.orelse or not isinstance(n.test, ast.Compare) or len(n.test.ops) != 1 or not isinstance(n.test.ops[0], ast.In):
        return
    s = n.body[0].value if isinstance(n.body[0], ast.Expr) else None
    if isinstance(s, ast.Call) and isinstance(s.func, ast.Attribute) and s.func.attr == "remove" and len(s.args) == 1 and _same(s.func.value, n.test.comparators[0]) and _same(s.args[0], n.test.left):
        yield "S8492"


def _on_suite(suite: list[ast.stmt]):
    """An item that is written and written again by the next statement, which doesn't read it."""
    for a, b in zip(suite, suite[1:]):
        if all(isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Subscript) for x in (a, b)) and _same(a.targets[0], b.targets[0]):
            read = ast.dump(ast.Subscript(a.targets[0].value, a.targets[0].slice, ast.Load()))
            if not any(isinstance(x, ast.Subscript) and ast.dump(x) == read for x in ast.walk(b.value)):
                yield "S4143"


_BY_KIND = {
    ast.Call: _on_call,
    ast.FunctionDef: _on_function,
    ast.AsyncFunctionDef: _on_function,
    ast.ClassDef: _on_class,
    ast.Compare: _on_compare,
    ast.For: _on_loop,
    ast.AsyncFor: _on_loop,
    ast.BinOp: _on_operator,
    ast.BoolOp: _on_condition,
    ast.Subscript: _on_subscript,
    ast.TryStar: _on_groups,
    ast.Assert: _on_assert,
    ast.ImportFrom: _on_import,
    ast.With: _on_with,
    ast.AsyncWith: _on_with,
    ast.If: _on_if,
}
_WITH_SUITES = (ast.Module, *_F, ast.ClassDef, ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.TryStar)


def checks(n: ast.AST) -> list[str]:
    """Keys of the rules that the node breaks, sorted."""
    kind = type(n)
    check = _BY_KIND.get(kind)
    found = set(check(n)) if check else set()
    if kind in _WITH_SUITES:
        for suite in _suites(n):
            found.update(_on_suite(suite))
    return sorted(found) if found else []


#: Key, kinds of nodes, message.
CHECKED = (
    ("S2275", "BinOp", "Format and values don't fit."),
    ("S2712", "FunctionDef AsyncFunctionDef", "Generator returns a value."),
    ("S3862", "For AsyncFor", "This can't be iterated."),
    ("S4143", "Module FunctionDef AsyncFunctionDef ClassDef If For While With Try", "Item is written twice."),
    ("S5361", "Call", "Use replace."),
    ("S5607", "BinOp", "Operands don't fit."),
    ("S5642", "Compare", "This has no members."),
    ("S5644", "Subscript", "This has no items."),
    ("S5706", "FunctionDef", "__exit__ shouldn't raise what it was given."),
    ("S5724", "FunctionDef", "Accessor has a wrong number of parameters."),
    ("S5845", "Call", "Literals of different kinds are never equal."),
    ("S5915", "With AsyncWith", "Assertion is never reached."),
    ("S6468", "TryStar", "Catch what the group holds."),
    ("S6553", "Call", "Use the empty text for nothing."),
    ("S6556", "Call", "Name what the template gets."),
    ("S6559", "ClassDef", "Name the fields."),
    ("S6560", "Call", "Lists need safe=False."),
    ("S6663", "Subscript", "Index isn't whole."),
    ("S6714", "Call", "Pass a list."),
    ("S6882", "Call", "Part of a date or time is out of range."),
    ("S6883", "Call", "Hours and half of the day don't fit."),
    ("S6887", "Call", "Localise the time instead."),
    ("S6890", "Call", "Use zoneinfo."),
    ("S7511", "Call", "Order is lost or made anew."),
    ("S7512", "For AsyncFor", "Iterate over the keys."),
    ("S8392", "Call", "Everyone can reach this address."),
    ("S8412", "FunctionDef AsyncFunctionDef", "Use the method's decorator."),
    ("S8490", "ClassDef", "The decorator writes this method."),
    ("S8492", "If", "Use discard."),
    ("S8493", "FunctionDef AsyncFunctionDef", "Return instead."),
    ("S8503", "Compare", "Nothing is in an empty collection."),
    ("S8504", "FunctionDef", "Property returns nothing."),
    ("S8509", "ClassDef", "Base class is listed twice."),
    ("S8510", "For AsyncFor", "Inner loop takes the outer loop's variable."),
    ("S8512", "ClassDef", "Field is assigned twice."),
    ("S8513", "BoolOp", "Pass a tuple."),
    ("S8515", "Call", "A type variable can't be both."),
    ("S8517", "Subscript", "Use min or max."),
    ("S8518", "For AsyncFor", "The loop has this value already."),
    ("S8519", "Subscript", "Use next and iter."),
    ("S8520", "Call", "Use chain."),
    ("S8521", "Compare", "Ask the mapping itself."),
    ("S8554", "Call", "Leave formatting to the logger."),
    ("S8685", "ClassDef", "Default is made once for all."),
    ("S8900", "Call", "Use the new name."),
    ("S9001", "FunctionDef AsyncFunctionDef", "Say why this fails."),
    ("S9076", "FunctionDef AsyncFunctionDef", "Use pytest.fixture."),
    ("S9077", "Assert", "Say why."),
    ("S9083", "FunctionDef AsyncFunctionDef", "Parentheses aren't needed."),
    ("S9084", "ImportFrom", "Import pytest as a module."),
)
