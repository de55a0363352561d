"""Facts of Python sources: one parse per file, then rows.

``nodes`` gives a row per syntax node, comment-free: kind, position, place in the tree, a digest that
equal code shares, and attributes that rules ask for. Files that don't parse give one row of kind
``ParseError``. Null texts count as empty.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
import symtable
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame

from .python_checks import WALKED, checks, child_fields, children, inside
from .regex_facts import regex_rules

NODES = """path string, id int, parent int, kind string, parent_kind string, field string, at int, last int, depth int, nesting int, fn int, cls int,
    name string, digest string, sl int, sc int, el int, ec int, attrs map<string,string>"""
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_FRAMES = frozenset((*_FUNCTIONS, ast.Lambda))
#: Methods that answer NotImplemented. Fixed names.
_SPECIAL = frozenset(f"__{n}__" for n in "eq lt le gt ge ne add sub mul getitem iter len contains".split())
#: Calls whose first argument is a pattern. Fixed names.
_REGEX_CALLS = frozenset(f"re.{n}" for n in "compile match search fullmatch split findall finditer sub subn".split())
_JUMPS = (ast.Return, ast.Raise, ast.Break, ast.Continue)
_LOOPS = frozenset((ast.For, ast.AsyncFor, ast.While))
_BRANCHING = frozenset((ast.If, *_LOOPS, ast.ExceptHandler, ast.IfExp))


def dotted(node: ast.AST) -> str:
    """a.b.c of names and attributes; the last attribute with a leading dot where the rest is an expression."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        return ".".join([node.id, *reversed(parts)])
    return "." + parts[0] if parts else ""


def _own(fn: ast.AST, kinds) -> list[ast.AST]:
    """Nodes of these kinds in a function but not in functions inside it."""
    return [n for n in inside(fn) if isinstance(n, kinds)]


def complexity(fn: ast.AST) -> int:
    """Cyclomatic: one, and one for each branch, loop, handler, condition of a comprehension and boolean operator."""
    total = 1
    for n in inside(fn):
        kind = type(n)
        if kind in _BRANCHING:
            total += 1
        elif kind is ast.BoolOp:
            total += len(n.values) - 1
        elif kind is ast.comprehension:
            total += 1 + len(n.ifs)
    return total


def cognitive(fn: ast.AST) -> int:
    """Cognitive complexity: structures cost one and their nesting; else, elif and runs of one boolean operator cost one."""
    total = 0
    todo: list[tuple[ast.AST, int, bool]] = [(n, 0, False) for n in fn.body]
    while todo:
        n, nest, chained = todo.pop()
        deeper, kind = nest, type(n)
        if kind is ast.If:
            total += 1 if chained else 1 + nest
            only = len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If)
            if n.orelse and not only:
                total += 1
            todo += [(n.test, nest, False), *((c, nest + 1, False) for c in n.body)]
            todo += [(n.orelse[0], nest, True)] if only else [(c, nest + 1, False) for c in n.orelse]
            continue
        if kind in _BRANCHING:
            total += 1 + nest
            deeper = nest + 1
        elif kind in _FRAMES:
            deeper = nest + 1
        elif kind is ast.BoolOp:
            total += 1
        todo += [(c, deeper, False) for c in children(n)]
        if kind in _LOOPS and n.orelse:
            total += 1
    return total


def _params(fn: ast.AST) -> list[str]:
    a = fn.args
    return [p.arg for p in (*a.posonlyargs, *a.args, *a.kwonlyargs)]


def _size(fn: ast.AST) -> int:
    return (fn.end_lineno or fn.lineno) - fn.body[0].lineno + 1


#: Measures of a function that need no other node's digest.
_MEASURES = {"params": lambda fn: len(_params(fn)), "lines": _size, "complexity": complexity, "cognitive": cognitive}


#: Nodes without a name or attributes, of those that there are most of.
_PLAIN = (ast.Return, ast.AugAssign, ast.Module, ast.arguments, ast.arg, ast.Pass, ast.keyword, ast.Subscript, ast.List, ast.Tuple)


def _plain(suite: list[ast.stmt]) -> bool:
    return all(isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and s.value.value is ... for s in suite)


def _ends(suite: list[ast.stmt]) -> str:
    return type(suite[-1]).__name__ if suite else ""


class _Digests:
    """Digests of a file's nodes, made when they are asked for: from kind, values and children; positions and contexts don't count."""

    def __init__(self):
        self.known: dict[int, str] = {}

    def __call__(self, n: ast.AST) -> str:
        known = self.known
        if id(n) in known:
            return known[id(n)]
        order, todo = [], [n]
        while todo:
            x = todo.pop()
            if id(x) not in known:
                order.append(x)
                todo.extend(ast.iter_child_nodes(x))
        for x in reversed(order):
            parts = [type(x).__name__]
            for name, value in ast.iter_fields(x):
                if name in ("ctx", "type_comment", "kind"):
                    continue
                for v in value if isinstance(value, list) else [value]:
                    parts.append(known[id(v)] if isinstance(v, ast.AST) else repr(v))
                parts.append(";")
            known[id(x)] = hashlib.blake2b("|".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
        return known[id(n)]

    def same(self, a: ast.AST, b: ast.AST) -> bool:
        """Whether two nodes are equal code; a target equals what reads it."""
        return type(a) is type(b) and (a.id == b.id if isinstance(a, ast.Name) else self(a) == self(b))


def _digests() -> _Digests:
    """Digests of a file, none made yet."""
    return _Digests()


def _attributes(n: ast.AST, d: _Digests, told: frozenset[str]) -> tuple[str, dict[str, object]]:
    """Name and attributes of a node."""
    if isinstance(n, ast.Constant):
        return "", {"type": type(n.value).__name__, "value": n.value if isinstance(n.value, str) else ""}
    if isinstance(n, (ast.Name, ast.Attribute)):
        return dotted(n), {"store": isinstance(n.ctx, ast.Store)}
    if isinstance(n, _PLAIN):
        return "", {}
    suite = lambda s: "".join(map(d, s))
    if isinstance(n, _FUNCTIONS):
        a = n.args
        params = _params(n)
        own: dict[type, list] = {}
        for x in inside(n):
            own.setdefault(type(x), []).append(x)
        count = lambda *kinds: sum(len(own.get(k, ())) for k in kinds)
        returns, yields = own.get(ast.Return, []), count(ast.Yield, ast.YieldFrom)
        defaults = [x for x in (*a.defaults, *a.kw_defaults) if x is not None]
        body = [s for s in n.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str))]
        return n.name, {
            **{k: f(n) for k, f in _MEASURES.items()},
            "positional": len(a.posonlyargs) + len(a.args),
            "first": (params or [""])[0],
            "star": bool(a.vararg or a.kwarg),
            "same_param": len(set(params)) < len(params),
            "returns": len(returns),
            "valued": sum(r.value is not None and not (isinstance(r.value, ast.Constant) and r.value.value is None) for r in returns),
            "bare": sum(r.value is None for r in returns),
            "falls": _ends(n.body) not in ("Return", "Raise", "While", "If", "Try", "With", "Match"),
            "invariant": len(returns) > 1 and all(isinstance(r.value, ast.Constant) for r in returns) and len({d(r.value) for r in returns}) == 1,
            "yields": yields,
            "awaits": count(ast.Await, ast.AsyncFor, ast.AsyncWith) + yields,
            "doc": ast.get_docstring(n, clean=False) is not None,
            "empty": _plain(n.body),
            "trivial": len(body) <= 1,
            **({"body": suite(body)} if not told or "body" in told else {}),
            "mutable_default": any(isinstance(x, (ast.List, ast.Dict, ast.Set, ast.ListComp, ast.DictComp, ast.SetComp)) or isinstance(x, ast.Call) and dotted(x.func) in ("list", "dict", "set") for x in defaults),
            "decorators": ",".join(dotted(x.func if isinstance(x, ast.Call) else x) for x in n.decorator_list),
            "hint": n.returns is not None,
            "timeout": "timeout" in params,
            "self_call": any(dotted(c.func) == n.name for c in own.get(ast.Call, ())) and not count(ast.If, ast.IfExp, ast.For, ast.While, ast.Try, ast.BoolOp, ast.Match),
        }
    if isinstance(n, ast.ClassDef):
        return n.name, {"bases": ",".join(map(dotted, n.bases)), "doc": ast.get_docstring(n, clean=False) is not None, "empty": _plain(n.body), "methods": sum(isinstance(s, _FUNCTIONS) for s in n.body)}
    if isinstance(n, ast.Call):
        keys = {k.arg: k.value for k in n.keywords if k.arg}
        first = n.args[0] if n.args else None
        literal = {k: json.dumps(v.value) if isinstance(v, ast.Constant) and isinstance(v.value, (str, int, float, bool, type(None))) else dotted(v) for k, v in keys.items()}
        return dotted(n.func), {
            "args": len(n.args),
            "keywords": "," + ",".join(sorted(keys)) + ",",
            "first_kind": type(first).__name__ if first else "",
            "first_name": dotted(first.func) if isinstance(first, ast.Call) else dotted(first) if first is not None else "",
            "first_value": first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else "",
            "first_number": first.value if isinstance(first, ast.Constant) and type(first.value) in (int, float) else "",
            "second_value": n.args[1].value if len(n.args) > 1 and isinstance(n.args[1], ast.Constant) and isinstance(n.args[1].value, str) else "",
            "second_number": n.args[1].value if len(n.args) > 1 and isinstance(n.args[1], ast.Constant) and type(n.args[1].value) is int else "",
            "same_args": len(n.args) > 1 and d.same(n.args[0], n.args[1]),
            "starred": any(isinstance(x, ast.Starred) for x in n.args),
            **{"kw_" + k: v for k, v in literal.items()},
        }
    if isinstance(n, ast.Compare):
        left, right = n.left, n.comparators[0]
        return type(n.ops[0]).__name__, {
            "ops": len(n.ops),
            "same": len(n.ops) == 1 and d.same(left, right),
            "float": any(isinstance(x, ast.Constant) and isinstance(x.value, float) for x in (left, right)),
            "left": dotted(left.func) if isinstance(left, ast.Call) else dotted(left),
            "right": dotted(right.func) if isinstance(right, ast.Call) else dotted(right),
            "left_kind": type(left).__name__,
            "right_kind": type(right).__name__,
            "right_value": json.dumps(right.value) if isinstance(right, ast.Constant) and isinstance(right.value, (str, int, float, bool, type(None))) else "",
            "left_slice": isinstance(left, ast.Subscript) and isinstance(left.slice, ast.Slice),
        }
    if isinstance(n, ast.BinOp):
        return type(n.op).__name__, {"same": d.same(n.left, n.right), "left_kind": type(n.left).__name__, "left_string": isinstance(n.left, ast.Constant) and isinstance(n.left.value, str), "right_string": isinstance(n.right, ast.Constant) and isinstance(n.right.value, str), "right_number": isinstance(n.right, ast.Constant) and type(n.right.value) in (int, float), "number": isinstance(n.left, ast.Constant) and type(n.left.value) in (int, float)}
    if isinstance(n, ast.BoolOp):
        return type(n.op).__name__, {"same": any(map(d.same, n.values, n.values[1:])), "operands": len(n.values), "constant": any(isinstance(v, ast.Constant) for v in n.values)}
    if isinstance(n, ast.UnaryOp):
        return type(n.op).__name__, {"operand": type(n.operand).__name__, "operand_ops": len(n.operand.ops) if isinstance(n.operand, ast.Compare) else 0, "same_op": isinstance(n.operand, ast.UnaryOp) and type(n.operand.op) is type(n.op)}
    if isinstance(n, (ast.If, ast.IfExp)):
        b, o = (n.body, n.orelse) if isinstance(n, ast.If) else ([n.body], [n.orelse])
        tests, branches, x = [n.test], [b], n
        while isinstance(x, ast.If) and len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If):
            x = x.orelse[0]
            tests.append(x.test)
            branches.append(x.body)
        closing = x.orelse if isinstance(x, ast.If) else o
        if closing or len(branches) > 1:
            tests, branches, closing = list(map(d, tests)), list(map(suite, branches)), suite(closing)
        else:
            branches = []  # one branch alone equals none
        alone = len(b) == 1 and isinstance(b[0], ast.If) and not b[0].orelse and not o
        return "", {"test": type(n.test).__name__, "constant": isinstance(n.test, (ast.Constant, ast.List, ast.Dict, ast.Tuple, ast.Lambda)), "repeated_test": len(set(tests)) < len(tests), "repeated_branch": any(p == q for p, q in zip(branches, branches[1:] + [closing])) and not all(p == closing for p in branches), "all_same": bool(closing) and all(p == closing for p in branches), "only_if": alone, "empty": isinstance(n, ast.If) and _plain(b), "walrus": isinstance(n.test, ast.NamedExpr)}
    if isinstance(n, (ast.For, ast.AsyncFor, ast.While)):
        breaks = [x for s in n.body for x in (s, *_own(s, ast.Break)) if isinstance(x, ast.Break)]
        jumps = [x for s in n.body for x in (s, *_own(s, ast.Continue)) if isinstance(x, ast.Continue)]
        iterated = dotted(n.iter.func) if not isinstance(n, ast.While) and isinstance(n.iter, ast.Call) else ""
        return iterated, {"else_without_break": bool(n.orelse) and not breaks, "once": _ends(n.body) in ("Break", "Return", "Raise") and not jumps, "empty": _plain(n.body), "iter_kind": "" if isinstance(n, ast.While) else type(n.iter).__name__, "last": _ends(n.body)}
    if isinstance(n, ast.Try):
        return "", {"handlers": len(n.handlers), "empty": _plain(n.body), "jump_in_finally": any(isinstance(x, (ast.Return, ast.Break, ast.Continue)) for s in n.finalbody for x in (s, *_own(s, (ast.Return, ast.Break, ast.Continue)))), "caught": ",".join(dotted(h.type) if h.type is not None else "*" for h in n.handlers), "assert_last": _ends(n.body) == "Assert"}
    if isinstance(n, ast.ExceptHandler):
        raises = [x for s in n.body for x in (s, *_own(s, ast.Raise)) if isinstance(x, ast.Raise)]
        kinds = [dotted(e) for e in n.type.elts] if isinstance(n.type, ast.Tuple) else []
        return dotted(n.type) if n.type is not None else "", {"bare": n.type is None, "type": type(n.type).__name__ if n.type is not None else "", "kinds": ",".join(kinds), "repeated": len(set(kinds)) < len(kinds), "only_reraise": len(n.body) == 1 and isinstance(n.body[0], ast.Raise) and (n.body[0].exc is None or dotted(n.body[0].exc) == n.name), "raises": len(raises), "empty": _plain(n.body)}
    if isinstance(n, ast.Raise):
        e = n.exc.func if isinstance(n.exc, ast.Call) else n.exc
        return dotted(e) if e is not None else "", {"bare": n.exc is None, "type": type(n.exc).__name__ if n.exc is not None else "", "cause": type(n.cause).__name__ if n.cause is not None else ""}
    if isinstance(n, ast.Expr):
        v = n.value
        return dotted(v.func) if isinstance(v, ast.Call) else "", {"value": type(v).__name__, "text": isinstance(v, ast.Constant) and (isinstance(v.value, str) or v.value is ...)}
    if isinstance(n, ast.Assign):
        t = n.targets[0]
        return dotted(t), {"same": any(d.same(x, n.value) for x in n.targets), "value": type(n.value).__name__, "value_name": dotted(n.value.func) if isinstance(n.value, ast.Call) else "", "text": n.value.value if isinstance(n.value, ast.Constant) and isinstance(n.value.value, str) else "", "unary": type(n.value.op).__name__ if isinstance(n.value, ast.UnaryOp) else "", "gap": n.value.col_offset - t.end_col_offset if n.value.lineno == t.end_lineno else -1, "non_strings": isinstance(n.value, (ast.List, ast.Tuple)) and any(not (isinstance(e, ast.Constant) and isinstance(e.value, str)) for e in n.value.elts)}
    if isinstance(n, ast.Dict):
        keys = [d(k) for k in n.keys if isinstance(k, ast.Constant)]
        return "", {"repeated": len(set(keys)) < len(keys), "unhashable": any(isinstance(k, (ast.List, ast.Dict, ast.Set)) for k in n.keys)}
    if isinstance(n, ast.Set):
        keys = [d(k) for k in n.elts if isinstance(k, ast.Constant)]
        return "", {"repeated": len(set(keys)) < len(keys), "unhashable": any(isinstance(k, (ast.List, ast.Dict, ast.Set)) for k in n.elts)}
    if isinstance(n, ast.Assert):
        return "", {"test": type(n.test).__name__, "filled": isinstance(n.test, ast.Tuple) and bool(n.test.elts), "constant": isinstance(n.test, ast.Constant)}
    if isinstance(n, ast.ImportFrom):
        return n.module or "", {"star": any(x.name == "*" for x in n.names)}
    if isinstance(n, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)):
        g = n.generators
        target = d.same(n.elt, g[0].target) if not isinstance(n, ast.DictComp) else False
        return "", {"copy": len(g) == 1 and not g[0].ifs and target, "constant_value": isinstance(n, ast.DictComp) and isinstance(n.value, ast.Constant)}
    if isinstance(n, ast.NamedExpr):
        return dotted(n.target), {}
    if isinstance(n, ast.Delete):
        return dotted(n.targets[0]), {}
    return "", {}


def _parsed(text: str) -> ast.AST:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text)


def functions(path: str, text: str | None) -> list[tuple]:
    """(path, name, sl, params, lines, complexity, cognitive) of the functions of one file; none of one that doesn't parse."""
    text = text or ""
    WALKED.clear()
    try:
        tree = _parsed(text)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            symtable.symtable(text, path, "exec")  # refuses some texts that parse
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found, todo = [], [tree]
    while todo:
        n = todo.pop()
        if isinstance(n, _FUNCTIONS):
            found.append((path, n.name, n.lineno, *(f(n) for f in _MEASURES.values())))
        if not isinstance(n, ast.expr):  # no function stands within an expression
            todo += children(n)
    return found


def _symbols(path: str, text: str):
    """(scope kind, scope, name, flags) of each name of each scope."""
    todo = [symtable.symtable(text, path, "exec")]
    while todo:
        scope = todo.pop()
        todo.extend(scope.get_children())
        for s in scope.get_symbols():
            free = any(s.get_name() in [x.get_name() for x in c.get_symbols() if x.is_free() or x.is_global()] for c in scope.get_children())
            yield scope, s, free


_TOLD = {True: "true", False: "false"}
_HIDDEN = (*_FUNCTIONS, ast.ClassDef)


def facts(path: str, text: str | None, kinds: frozenset[str] = frozenset(), told: frozenset[str] = frozenset()) -> list[tuple]:
    """The rows of one file, or only those of some kinds; parse errors come always.

    Where the attributes that are asked for are ``told``, no others come, digests are empty, and constants other than texts
    and returns inside of functions without anything to tell are left out.
    """
    text = text or ""
    WALKED.clear()
    named = not kinds or "Symbol" in kinds
    try:
        tree = _parsed(text)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            symbols = list(_symbols(path, text)) if named else []
            if not named:
                symtable.symtable(text, path, "exec")  # refuses some texts that parse
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        line = getattr(e, "lineno", 0) or 0
        return [(path, 0, -1, "ParseError", "", "", 0, 0, 0, 0, -1, -1, type(e).__name__, "", line, 0, line, 0, [])]
    rows = _rows(path, (tree, -1, "", "", 0, 0, 0, -1, -1, ()), kinds, told)
    for scope, s, free in symbols:
        kind = str(scope.get_type()).rsplit(".", 1)[-1].lower()
        flags = {"scope": kind, "where": scope.get_name(), "parameter": s.is_parameter(), "imported": s.is_imported(), "assigned": s.is_assigned(), "used": s.is_referenced() or free, "free": s.is_free(), "global": s.is_global(), "local": s.is_local()}
        line = scope.get_lineno()
        rows.append([path, len(rows), -1, "Symbol", "", "", 0, len(rows), 0, 0, -1, -1, s.get_name(), "", line, 0, line, 0, [(k, str(v).lower()) for k, v in flags.items()]])
    return [tuple(r) for r in rows if r is not None]


def _rows(path: str, root: tuple, kinds: frozenset[str], told: frozenset[str]) -> list[list | None]:
    """The rows of a node and all below it; ``root`` is the node and its place."""
    digest = _digests()
    rows: list[list | None] = []
    parents: list[int] = []
    todo: list[tuple] = [root]
    while todo:
        n, parent, parent_kind, field, at, depth, nesting, fn, cls, around = todo.pop()
        me, kind = len(rows), type(n).__name__
        inner = nesting + isinstance(n, _NESTING)
        parents.append(parent)
        idle = told and (kind == "Return" and fn >= 0 and field != "unreachable" or kind == "Constant" and not (n.value and isinstance(n.value, str)))
        if idle or kinds and kind not in kinds:
            rows.append(None)
        else:
            name, attrs = _attributes(n, digest, told)
            if isinstance(n, ast.Call) and name in _REGEX_CALLS and n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str):
                attrs["regex"] = f",{','.join(sorted(regex_rules(n.args[0].value)))},"
            broken = checks(n)
            if broken:
                attrs["checks"] = f",{','.join(broken)},"
            shown = [(k, _TOLD[v] if v is True or v is False else str(v)) for k, v in attrs.items() if not told or k in told] + [(k, "true") for k in around]
            rows.append([path, me, parent, kind, parent_kind, field, at, me, depth, inner, fn, cls, name, "" if told else digest(n), getattr(n, "lineno", 0), getattr(n, "col_offset", 0), getattr(n, "end_lineno", 0) or 0, getattr(n, "end_col_offset", 0) or 0, shown])
        fields = child_fields(type(n))
        if not fields:
            continue
        function = isinstance(n, (*_FUNCTIONS, ast.Lambda))
        own_fn, own_cls = (me, -1) if function else (fn, me) if isinstance(n, ast.ClassDef) else (fn, cls)
        inner = 0 if isinstance(n, _HIDDEN) else inner
        below = []
        inherited = tuple(k for k in around if k in ("in_async", "special_method", "in_handler")) if around else ()
        if function:
            inherited = tuple(k for k in inherited if k == "in_handler") + ("in_async",) * isinstance(n, ast.AsyncFunctionDef) + ("special_method",) * (getattr(n, "name", "") in _SPECIAL)
        if isinstance(n, ast.ExceptHandler) and "in_handler" not in inherited:
            inherited += ("in_handler",)
        for name in fields:
            value = getattr(n, name, None)
            if type(value) is not list:
                if isinstance(value, ast.AST):
                    below.append((value, me, kind, name, 0, depth + 1, inner, own_fn, own_cls, inherited))
                continue
            seen_jump = unreachable = False
            for i, v in enumerate(value):
                if isinstance(v, ast.stmt):
                    elif_ = isinstance(n, ast.If) and name == "orelse" and len(value) == 1 and isinstance(v, ast.If)
                    place = inherited + ("prior_unreachable",) * unreachable + ("last_in_suite",) * (i == len(value) - 1)
                    below.append((v, me, kind, "unreachable" if seen_jump else "elif" if elif_ else name, i, depth + 1, inner - elif_, own_fn, own_cls, place))
                    unreachable, seen_jump = seen_jump, isinstance(v, _JUMPS)
                elif isinstance(v, ast.AST):
                    below.append((v, me, kind, name, i, depth + 1, inner, own_fn, own_cls, inherited))
        todo += below[::-1]
    last = list(range(len(rows)))
    for i in range(len(rows) - 1, 0, -1):  # the last descendant, in preorder
        if last[i] > last[parents[i]]:
            last[parents[i]] = last[i]
    for i, r in enumerate(rows):
        if r is not None:
            r[7] = last[i]
    return rows


#: Words and signs of what the compiler's symbol tables may refuse though it parses, besides equal parameters. Long statements, which may be deep, are left to them, too.
_REFUSABLE = re.compile(r"\b(?:global|nonlocal|yield|await|async|type|lambda|__debug__)\b|:=|\b(?:def|class)\s+\w+\s*[\[\\]|\bimport\b[^\n]*\*|\bimport\s*\\")
_LONG = 2_000


def _refusable(statement: ast.stmt, text: str | None) -> bool:
    """Whether a statement has something in it for which symbol tables might be refused."""
    if text is None or len(text) > _LONG or not text.isascii() or _REFUSABLE.search(text):
        return True
    todo = [statement]
    while todo:
        n = todo.pop()
        if isinstance(n, _FUNCTIONS):
            a = n.args
            given = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if x is not None]
            if len(set(given)) < len(given):
                return True
        for suite in ("body", "orelse", "finalbody", "handlers", "cases"):
            todo += getattr(n, suite, ())
    return False


class EqualStatements:
    """Nodes of files by statements: what stands in a file's outermost statements is worked out once for equal statements.

    A node's row depends on nothing outside of its outermost statement but on the statement's own place, so that equal
    lines at equal columns have equal rows, some lines further down. Rows are kept for as many statements as ``most``.
    """

    def __init__(self, kinds: frozenset[str], told: frozenset[str], most: int = 5_000):
        self.kinds, self.told, self.most = kinds, told, most
        self.known: dict[tuple, tuple[list[tuple], bool]] = {}

    def of_file(self, path: str, text: str | None):
        """(key, rows, line) of the file's parts: rows with lines from the part's first one, and how many lines stand before it."""
        text = text or ""
        WALKED.clear()
        try:
            tree = _parsed(text)
            parts, refusable = self._parts(tree, text)
            if refusable:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    symtable.symtable(text, path, "exec")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            rows = facts(path, text, self.kinds, self.told)
            return [(("error", path), [("", *r[1:]) for r in rows], 0)]
        return parts

    def _parts(self, tree: ast.Module, text: str):
        lines = None if "\r" in text else text.split("\n")
        parts, refusable, unreachable, jumped = [], False, False, False
        broken = checks(tree)
        if broken and "Module" in self.kinds and (not self.told or "checks" in self.told):
            attrs = [("checks", f",{','.join(broken)},")]
            parts.append((("module", *broken), [("", 0, -1, "Module", "", "", 0, 0, 0, 0, -1, -1, "", "", 0, 0, 0, 0, attrs)], 0))
        for i, n in enumerate(tree.body):
            place = ("prior_unreachable",) * unreachable + ("last_in_suite",) * (i == len(tree.body) - 1)
            field = "unreachable" if jumped else "body"
            unreachable, jumped = jumped, isinstance(n, _JUMPS)
            first = min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", ()))])
            own = "\n".join(lines[first - 1 : n.end_lineno]) if lines else None
            key = (field, place, n.lineno - first, n.col_offset, n.end_col_offset, own) if lines else None
            known = self.known.get(key)
            if known is None:
                rows = _rows("", (n, 0, "Module", field, i, 1, 0, -1, -1, place), self.kinds, self.told)
                rows = [(*r[:14], r[14] - first + 1, r[15], r[16] - first + 1, *r[17:]) for r in rows if r is not None]
                known = rows, _refusable(n, own)
                if key:
                    if len(self.known) >= self.most:
                        self.known.clear()
                    self.known[key] = known
            refusable |= known[1]
            if known[0]:
                parts.append((key or object(), known[0], first - 1))
        return parts, refusable


#: Rows of one record batch, about.
_ROWS = 20_000


def nodes(files: DataFrame, kinds: tuple[str, ...] = (), told: tuple[str, ...] = ()) -> DataFrame:
    """The facts of files (path, text), or only the nodes of some kinds and parse errors, and only the attributes that are told."""
    names = [c.split()[0] for c in NODES.split(",") if c.strip() and not c.strip().startswith("string>")]
    types = [pa.string(), *[pa.int32()] * 2, pa.string(), pa.string(), pa.string(), *[pa.int32()] * 6, pa.string(), pa.string(), *[pa.int32()] * 4, pa.map_(pa.string(), pa.string())]

    wanted, asked = frozenset(kinds), frozenset(told)

    def run(batches):
        rows: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += facts(path, text, wanted, asked)
                if len(rows) >= _ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()

    return files.select("path", "text").mapInArrow(run, NODES)


def placed_nodes(files: DataFrame, kinds: tuple[str, ...], told: tuple[str, ...]) -> DataFrame:
    """The nodes of ``nodes`` with the ``places`` (path, line: how many lines stand before) where they occur in a batch: nodes of
    equal outermost statements come once. Lines are counted from the statement's first one; paths are empty."""
    names = [c.split()[0] for c in NODES.split(",") if c.strip() and not c.strip().startswith("string>")]
    types = [pa.string(), *[pa.int32()] * 2, pa.string(), pa.string(), pa.string(), *[pa.int32()] * 6, pa.string(), pa.string(), *[pa.int32()] * 4, pa.map_(pa.string(), pa.string())]
    place = pa.list_(pa.struct([("path", pa.string()), ("line", pa.int32())]))
    wanted, asked = frozenset(kinds), frozenset(told)

    def run(batches):
        statements = EqualStatements(wanted, asked)
        found: dict = {}
        size = copies = 0

        def batch():
            rows = [r for rows, _ in found.values() for r in rows]
            places = pa.array([p for _, p in found.values()], place).take(pa.array([i for i, (rows, _) in enumerate(found.values()) for _ in rows], pa.int32()))
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), types)), places], names=[*names, "places"])

        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for key, rows, line in statements.of_file(path, text):
                    if key not in found:
                        found[key] = rows, []
                        size += len(rows)
                    found[key][1].append((path, line))
                    copies += len(rows)
                if size >= _ROWS or copies >= 10 * _ROWS:
                    yield batch()
                    found.clear()
                    size = copies = 0
        if found:
            yield batch()

    return files.select("path", "text").mapInArrow(run, NODES + ", places array<struct<path:string,line:int>>")


def function_measures(files: DataFrame) -> DataFrame:
    """path, name, sl, params, lines, complexity, cognitive of each function of the files (path, text), without digests
    or the other attributes of ``nodes``."""
    schema = "path string, name string, sl int, params int, lines int, complexity int, cognitive int"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), pa.string(), *[pa.int32()] * 5]

    def run(batches):
        rows: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            for path, text in zip(b.column(0), b.column(1)):
                rows += functions(path.as_py(), text.as_py())
                if len(rows) >= _ROWS:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()

    return files.select("path", "text").mapInArrow(run, schema)
