"""Rules on Python facts.

Most rules look at one node and its attributes: a kind and an SQL predicate. They run in one pass
over the nodes, each kind through its own rules only. Others group or join nodes within a file.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.python_checks import CHECKED

#: Limits. Fixed values.
LIMITS = {"params": 13, "returns": 3, "lines": 100, "nesting": 4, "cognitive": 15, "complexity": 15, "literals": 3, "operators": 3}
_FN = "FunctionDef AsyncFunctionDef"
_LOOP = "For AsyncFor While"
_BUILTINS = "'" + "','".join("abs all any bool bytes callable chr dict dir enumerate eval exec filter float format frozenset getattr hash help hex id input int iter len list map max min next object oct open ord pow print property range repr reversed round set sorted str sum super tuple type vars zip".split()) + "'"
_CASTS = "'list','tuple','set','sorted'"
_EXCEPTIONS = "[A-Z][A-Za-z]*(Error|Exception|Warning)"
_TEST = "path rlike '(^|/)(test_[^/]*|[^/]*_test)[.]py$'"

#: key, kinds, predicate over the node's columns and attrs (written a.x), message.
NODE_RULES = (
    ("S100", _FN, "cls >= 0 and not name rlike '^_*[a-z][a-z0-9_]*$' and not name rlike '^__[a-z0-9_]+__$'", "Method name should be in snake case."),
    ("S1542", _FN, "cls < 0 and not name rlike '^_*[a-z][a-z0-9_]*$'", "Function name should be in snake case."),
    ("S101", "ClassDef", "not name rlike '^_*([A-Z][a-zA-Z0-9]*|[a-z][a-z0-9_]*)$'", "Class name should be in Pascal case."),
    ("S107", _FN, "int(a.params) > {params}", "Too many parameters."),
    ("S108", f"If {_LOOP} Try ExceptHandler", "a.empty = 'true' and kind <> 'ExceptHandler'", "Fill in or remove this empty block."),
    ("S112", "Raise", "name in ('Exception','BaseException')", "Raise a more specific exception."),
    ("S134", f"If {_LOOP} Try With AsyncWith", "nesting = {nesting} + 1 and field <> 'elif'", "Control flow is nested too deeply."),
    ("S138", _FN, "int(a.lines) > {lines}", "Function is too long."),
    ("S905", "Expr", "a.value in ('Compare','Name','BinOp','UnaryOp','BoolOp','Attribute','List','Tuple','Set','Lambda','Subscript') or (a.value = 'Constant' and a.text = 'false')", "Statement has no effect."),
    ("S1045", "Try", "exists(slice(split(a.caught, ','), 1, size(split(a.caught, ',')) - 1), c -> c in ('*','Exception','BaseException'))", "An earlier handler catches everything."),
    ("S1066", "If", "a.only_if = 'true'", "Merge this if with the one inside."),
    ("S1067", "BoolOp", "int(a.operands) - 1 > {operators}", "Expression has too many conditional operators."),
    ("S1142", _FN, "int(a.returns) > {returns}", "Too many return statements."),
    ("S1143", "Try", "a.jump_in_finally = 'true'", "A jump in finally hides exceptions."),
    ("S1186", _FN, "a.empty = 'true' and not a.decorators rlike 'abstractmethod|overload'", "Fill in or explain this empty function."),
    ("S1244", "Compare", "name in ('Eq','NotEq') and a.float = 'true'", "Don't compare floats for equality."),
    ("S1313", "Constant", "a.value rlike '^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$' and not a.value rlike '^(127[.]|0[.]0[.]0[.]0|255[.]255[.]255[.]255)'", "Make this address configurable."),
    ("S1523", "Call", "name in ('eval','exec') and a.first_kind <> 'Constant'", "Dynamic execution of code."),
    ("S1541", _FN, "int(a.complexity) > {complexity}", "Function is too complex."),
    ("S1607", _FN, "a.decorators rlike '(unittest|pytest[.]mark)[.]skip(,|$)'", "Give a reason for skipping this test."),
    ("S1656", "Assign", "a.same = 'true'", "Variable is assigned to itself."),
    ("S1720", f"{_FN} ClassDef", "a.doc = 'false' and not name like '!_%' escape '!' and fn < 0 and not a.empty = 'true'", "Add a docstring."),
    ("S1751", _LOOP, "a.once = 'true'", "Loop runs once at most."),
    ("S1764", "Compare", "a.same = 'true'", "Both sides are the same."),
    ("S1764", "BinOp", "a.same = 'true' and name in ('Sub','Div','FloorDiv','Mod','BitOr','BitAnd','BitXor')", "Both sides are the same."),
    ("S1764", "BoolOp", "a.same = 'true'", "Both sides are the same."),
    ("S1862", "If", "a.repeated_test = 'true' and field <> 'elif'", "A condition of this chain repeats an earlier one."),
    ("S1871", "If", "a.repeated_branch = 'true' and field <> 'elif'", "Two branches are the same."),
    ("S3923", "If IfExp", "a.all_same = 'true' and field <> 'elif'", "All branches are the same."),
    ("S1940", "UnaryOp", "name = 'Not' and a.operand = 'Compare' and a.operand_ops = '1'", "Use the opposite operator."),
    ("S2190", _FN, "a.self_call = 'true'", "Recursion has no way out."),
    ("S2201", "Expr", "a.value = 'Call' and name in ('len','sorted','abs','round','str','int','float','sum','min','max','isinstance','repr','tuple','list')", "The result of this call is not used."),
    ("S2208", "ImportFrom", "a.star = 'true'", "Import only what is needed."),
    ("S2245", "Call", "name rlike '^random[.](random|randint|randrange|choice|choices|sample|shuffle|uniform|getrandbits)$'", "Pseudorandom numbers are predictable."),
    ("S2612", "Call", "name in ('os.chmod','os.fchmod','os.lchmod') and int(coalesce(nullif(a.second_number, ''), '0')) % 8 in (2,3,6,7)", "Others shouldn't get write permission."),
    ("S2710", _FN, "cls >= 0 and a.decorators rlike '(^|,)classmethod(,|$)' and a.first not in ('cls','_cls','mcs','metacls')", "The first parameter should be cls."),
    ("S2711", "Return Yield YieldFrom", "fn < 0", "Return or yield outside a function."),
    ("S2733", _FN, "cls >= 0 and name = '__exit__' and a.star = 'false' and a.positional <> '4'", "__exit__ takes type, value and traceback."),
    ("S2734", _FN, "cls >= 0 and name = '__init__' and int(a.valued) > 0", "__init__ should return nothing."),
    ("S2737", "ExceptHandler", "a.only_reraise = 'true'", "This handler only raises again."),
    ("S2757", "Assign", "a.gap = '2' and a.unary in ('UAdd','USub')", "Was an augmented assignment meant?"),
    ("S2761", "UnaryOp", "a.same_op = 'true' and name in ('Not','Invert')", "The operators cancel out."),
    ("S2823", "Assign", "name = '__all__' and a.non_strings = 'true'", "__all__ should hold strings only."),
    ("S2836", _LOOP, "a.else_without_break = 'true'", "Loop has an else but no break."),
    ("S3403", "Compare", "name in ('Is','IsNot') and (a.left_kind in ('List','Dict','Set','Tuple') or a.right_kind in ('List','Dict','Set','Tuple'))", "Identity with a new object is always false."),
    ("S3457", "BinOp", "name = 'Mod' and a.left_string = 'true' and a.right_string = 'true'", "Format and value don't fit."),
    ("S3516", _FN, "a.invariant = 'true'", "All returns give the same value."),
    ("S3626", "Continue Return", "field = 'body' and parent_kind in ('For','While','AsyncFor') and kind = 'Continue' and last_in_suite", "Jump is redundant."),
    ("S3776", _FN, "int(a.cognitive) > {cognitive}", "Function is too hard to follow."),
    ("S3801", _FN, "int(a.valued) > 0 and (int(a.bare) > 0 or a.falls = 'true') and int(a.yields) = 0", "Some paths return a value, others don't."),
    ("S3981", "Compare", "a.left = 'len' and ((name = 'GtE' and a.right_value = '0') or (name = 'Lt' and a.right_value = '0'))", "A size is never negative."),
    ("S3984", "Expr", f"a.value = 'Call' and name rlike '^{_EXCEPTIONS}$'", "Exception is created but not raised."),
    ("S4423", "Attribute", "name rlike '^ssl[.]PROTOCOL_(SSLv2|SSLv3|TLSv1|TLSv1_1)$'", "Use a stronger protocol."),
    ("S4426", "Call", "name rlike 'generate_private_key$' and int(coalesce(nullif(a.kw_key_size, ''), '4096')) < 2048", "Use a longer key."),
    ("S4507", "Call", "a.kw_debug = 'true' and name rlike '(^|[.])(run|Flask)$'", "Turn debugging off."),
    ("S4507", "Assign", "name in ('DEBUG','DEBUG_PROPAGATE_EXCEPTIONS') and path rlike 'settings[.]py$' and a.value = 'Constant'", "Turn debugging off."),
    ("S4721", "Call", "a.kw_shell = 'true' or name in ('os.system','os.popen','commands.getoutput')", "Commands run through a shell."),
    ("S4784", "Call", "name rlike '^re[.](compile|match|search|fullmatch|split|findall|finditer|sub|subn)$' and a.first_value rlike '[+*}][^+*}]*[+*}]'", "Check this regular expression for catastrophic cost."),
    ("S4790", "Call", "name rlike '^hashlib[.](md5|sha1)$' or (name = 'hashlib.new' and lower(a.first_value) in ('md5','sha1'))", "Weak hash."),
    ("S4792", "Call", "name rlike '^logging[.](basicConfig|disable|setLoggerClass|config[.](fileConfig|dictConfig))$'", "Check this logger's configuration."),
    ("S4823", "Attribute", "name = 'sys.argv'", "Check the use of arguments."),
    ("S4829", "Attribute", "name = 'sys.stdin'", "Check the use of standard input."),
    ("S4830", "Call", "a.kw_verify = 'false' and name rlike '^(requests|httpx)[.]' or name = 'ssl._create_unverified_context'", "Verify certificates."),
    ("S5042", "Call", "name rlike '[.](extractall)$' or name = 'shutil.unpack_archive'", "Extraction has no bound."),
    ("S5122", "Constant", "a.value = 'Access-Control-Allow-Origin'", "Check which origins are allowed."),
    ("S5247", "Call", "a.kw_autoescape = 'false'", "Escape output."),
    ("S5300", "Call", "name in ('smtplib.SMTP','smtplib.SMTP_SSL','django.core.mail.send_mail')", "Check this mail."),
    ("S5332", "Constant", "a.value rlike '^(http|ftp|telnet)://' and not a.value rlike '^[a-z]+://(localhost|127[.]|[:]:1|[^/]*[.](example|test)([/:]|$)|www[.]w3[.]org)'", "Use an encrypted protocol."),
    ("S5443", "Constant", "a.value rlike '^(/tmp|/var/tmp|/usr/tmp|/dev/shm)(/|$)'", "Folder is writable for all."),
    ("S5445", "Call", "name in ('tempfile.mktemp','os.tempnam','os.tmpnam')", "Insecure temporary file."),
    ("S5527", "Call", "name rlike 'ssl[.]_create_stdlib_context$' or a.kw_check_hostname = 'false'", "Check the host name."),
    ("S5542", "Attribute", "name rlike '(^|[.])(AES|DES|DES3)[.]MODE_ECB$' or name rlike '(^|[.])modes[.]ECB$'", "Use an authenticated mode."),
    ("S5547", "Call", "name rlike '(^|[.])(DES|DES3|ARC2|ARC4|Blowfish|TripleDES)([.]new)?$'", "Use a strong cipher."),
    ("S5549", _FN, "a.same_param = 'true'", "Parameter occurs twice."),
    ("S5632", "Raise", "a.type in ('Constant','List','Dict','Tuple','Set','JoinedStr')", "Raise an exception."),
    ("S5685", "NamedExpr", "parent_kind in ('Expr','Call','keyword')", "Use a plain assignment."),
    ("S5704", "Raise", "a.bare = 'true' and not in_handler", "Nothing to raise again here."),
    ("S5707", "Raise", "a.cause in ('List','Dict','Tuple','Set','JoinedStr')", "A cause is an exception or None."),
    ("S5708", "ExceptHandler", "a.type in ('Constant','List','Dict','Set')", "Catch exceptions only."),
    ("S5709", "ClassDef", "a.bases rlike '(^|,)BaseException(,|$)'", "Derive from Exception."),
    ("S5712", "Raise", "name = 'NotImplementedError' and special_method", "Return NotImplemented instead."),
    ("S5713", "ExceptHandler", "a.repeated = 'true' or (size(split(a.kinds, ',')) > 1 and a.kinds rlike '(^|,)(Exception|BaseException)(,|$)')", "One caught type covers another."),
    ("S5714", "ExceptHandler", "a.type = 'BoolOp'", "Use a tuple of types."),
    ("S5717", _FN, "a.mutable_default = 'true'", "Default value is shared between calls."),
    ("S5719", _FN, "cls >= 0 and a.positional = '0' and a.star = 'false' and not a.decorators rlike 'staticmethod|overload'", "Method takes no self."),
    ("S5720", _FN, "cls >= 0 and int(a.positional) > 0 and a.first not in ('self','_','cls','mcs','metacls') and not a.first like '!_%' escape '!' and a.decorators = '' and name <> '__new__'", "The first parameter should be self."),
    ("S5722", _FN, "cls >= 0 and a.star = 'false' and ((name in ('__len__','__str__','__repr__','__iter__','__next__','__hash__','__bool__','__enter__','__del__') and a.positional <> '1') or (name in ('__eq__','__lt__','__add__','__contains__','__getitem__','__delitem__','__getattr__') and a.positional <> '2') or (name in ('__setitem__','__setattr__') and a.positional <> '3'))", "Special method has another number of parameters."),
    ("S5727", "Compare", "name in ('Is','IsNot') and a.right_value = 'null' and a.left_kind in ('Constant','List','Dict','Tuple','Set','JoinedStr','Lambda')", "Comparison to None is constant."),
    ("S5754", "ExceptHandler", "(a.bare = 'true' or name in ('SystemExit','BaseException')) and a.raises = '0'", "Raise SystemExit again."),
    ("S5780", "Dict", "a.repeated = 'true'", "Key occurs twice."),
    ("S5781", "Set", "a.repeated = 'true'", "Value occurs twice."),
    ("S5795", "Compare", "name in ('Is','IsNot') and (a.left_kind = 'Constant' or (a.right_kind = 'Constant' and not a.right_value in ('null','true','false')))", "Identity of cached values isn't reliable."),
    ("S5796", "Compare", "name in ('Is','IsNot') and a.right in ('dict','list','set','tuple','object')  and a.right_kind = 'Call'", "Identity with a new object is always false."),
    ("S5797", "If IfExp", "a.constant = 'true'", "Condition is constant."),
    ("S5806", "Assign", f"name in ({_BUILTINS}) and fn >= 0", "Name hides a builtin."),
    ("S5828", "Call", "name = 'open' and a.second_value <> '' and not a.second_value rlike '^(?=[^rwax]*[rwax][^rwax]*$)(?!.*b.*t|.*t.*b)[rwaxbt+U]+$'", "Mode isn't valid."),
    ("S5842", "Call", "contains(a.regex, ',S5842,')", "Repeated part matches the empty string."),
    ("S5843", "Call", "contains(a.regex, ',S5843,')", "Regular expression is too complex."),
    ("S5850", "Call", "contains(a.regex, ',S5850,')", "Anchor holds for one alternative only."),
    ("S5856", "Call", "contains(a.regex, ',S5856,')", "Regular expression isn't valid."),
    ("S5869", "Call", "contains(a.regex, ',S5869,')", "Character class has a member twice."),
    ("S5996", "Call", "contains(a.regex, ',S5996,')", "Boundary can't be matched."),
    ("S6019", "Call", "contains(a.regex, ',S6019,')", "Reluctant repeat at the end takes the least."),
    ("S6323", "Call", "contains(a.regex, ',S6323,')", "Alternative is empty."),
    ("S6326", "Call", "contains(a.regex, ',S6326,')", "Count the spaces."),
    ("S6331", "Call", "contains(a.regex, ',S6331,')", "Group is empty."),
    ("S6353", "Call", "contains(a.regex, ',S6353,')", "A shorter form says the same."),
    ("S6396", "Call", "contains(a.regex, ',S6396,')", "Quantifier says nothing."),
    ("S6397", "Call", "contains(a.regex, ',S6397,')", "Class has one member."),
    ("S5863", "Call", "name rlike '^self[.]assert[A-Z]' and a.same_args = 'true'", "Assertion has the same argument twice."),
    ("S5905", "Assert", "a.filled = 'true'", "Assertion on a tuple always holds."),
    ("S5914", "Assert", "a.constant = 'true'", "Assertion is constant."),
    ("S5906", "Call", "name in ('self.assertTrue','self.assertFalse') and a.first_kind = 'Compare'", "Use a more specific assertion."),
    ("S6659", "Compare", "name in ('Eq','NotEq') and a.left_slice = 'true' and a.right_value like '\"%'", "Use startswith or endswith."),
    ("S6660", "Compare", "name in ('Eq','NotEq','Is','IsNot') and a.left = 'type' and a.left_kind = 'Call'", "Use isinstance."),
    ("S6661", "Assign", "a.value = 'Lambda' and not name like '%.%'", "Define a function."),
    ("S6662", "Dict Set", "a.unhashable = 'true'", "Element isn't hashable."),
    ("S6709", "Call", "name in ('np.random.default_rng','numpy.random.default_rng') and a.args = '0' and a.keywords = ',,'", "Give a seed."),
    ("S6711", "Call", "name rlike '^(np|numpy)[.]random[.](RandomState|seed|rand|randn|randint)$'", "Use a Generator."),
    ("S6725", "Compare", "name in ('Eq','NotEq') and (a.right rlike '^(np|numpy)[.]nan$' or a.left rlike '^(np|numpy)[.]nan$')", "Use isnan."),
    ("S6727", "Call", "name = 'math.isclose' and not contains(a.keywords, ',abs_tol,') and a.second_number = '0'", "Give abs_tol for zero."),
    ("S6729", "Call", "name in ('np.where','numpy.where') and a.args = '1' and a.keywords = ',,'", "Use nonzero."),
    ("S6730", "Attribute", "name rlike '^(np|numpy)[.](bool|int|float|complex|object|str)$'", "Alias is gone from NumPy."),
    ("S6734", "Call", "a.kw_inplace = 'true'", "Assign the result instead."),
    ("S6735", "Call", "name rlike '[.]merge$' and not contains(a.keywords, ',how,') and contains(a.keywords, ',on,')", "Say how to merge."),
    ("S6740", "Call", "name rlike '^(pd|pandas)[.]read_(csv|table)$' and not contains(a.keywords, ',dtype,')", "Give column types."),
    ("S6741", "Attribute", "name rlike '^df[.]values$'", "Use to_numpy."),
    ("S6900", "Call", "name rlike '^(np|numpy)[.]busday' and a.kw_weekmask rlike '^\"[01]*\"$' and length(a.kw_weekmask) <> 9", "Week mask isn't valid."),
    ("S6903", "Call", "name rlike '(^|[.])datetime[.](utcnow|utcfromtimestamp)$'", "Use an aware date and time."),
    ("S7483", "AsyncFunctionDef", "a.timeout = 'true'", "Use a timeout context."),
    ("S7486", "Call", "name rlike '^(asyncio|trio|anyio)[.]sleep$' and double(coalesce(nullif(a.first_number, ''), '0')) > 86400", "Sleep forever instead."),
    ("S7491", "Call", "name in ('trio.sleep','anyio.sleep') and a.first_number = '0'", "Use a checkpoint."),
    ("S7492", "Call", "name in ('any','all') and a.first_kind = 'ListComp'", "Pass a generator."),
    ("S7494", "Call", "name in ('set','list','dict') and a.first_kind = 'GeneratorExp' and a.args = '1'", "Use a comprehension."),
    ("S7496", "Call", "((name = 'list' and a.first_kind in ('List','ListComp')) or (name = 'tuple' and a.first_kind in ('Tuple','List')) or (name = 'set' and a.first_kind in ('Set','List','SetComp'))) and a.args = '1'", "Use a literal."),
    ("S7498", "Call", "name in ('dict','list','tuple') and a.args = '0' and a.keywords = ',,'", "Use an empty literal."),
    ("S7500", "ListComp SetComp", "a.copy = 'true'", "Use the constructor to copy."),
    ("S7501", "Call", "name = 'input' and in_async", "Input blocks the loop."),
    ("S7499", "Call", "name rlike '^requests[.](get|post|put|delete|head|patch|request)$' and in_async", "Call blocks the loop."),
    ("S7488", "Call", "name = 'time.sleep' and in_async", "Sleep blocks the loop."),
    ("S7493", "Call", "name = 'open' and in_async", "File access blocks the loop."),
    ("S7487", "Call", "name rlike '^subprocess[.](run|call|check_call|check_output)$' and in_async", "Process blocks the loop."),
    ("S7503", "AsyncFunctionDef", "int(a.awaits) = 0 and a.empty = 'false' and a.trivial = 'false'", "Function waits for nothing."),
    ("S7504", "For AsyncFor", "name = 'list'", "Iterate over the value itself."),
    ("S7505", "Call", "name in ('map','filter') and a.first_kind = 'Lambda'", "Use a comprehension."),
    ("S7506", "DictComp", "a.constant_value = 'true'", "Use dict.fromkeys."),
    ("S7507", "Call", "name rlike '(^|[.])defaultdict$' and contains(a.keywords, ',default_factory,')", "Pass the factory by position."),
    ("S7508", "Call", f"name in ({_CASTS}) and a.first_name = name and a.first_kind = 'Call' and a.args = '1'", "Constructor is repeated."),
    ("S7510", "Call", "name = 'reversed' and a.first_name = 'sorted'", "Sort in reverse."),
    ("S7516", "Call", "name in ('list','tuple','sorted') and a.first_name = 'sorted' and name <> 'sorted'", "sorted gives a list already."),
    ("S1763", "Expr Assign AugAssign Return If For While With Try Pass Raise Assert Import ImportFrom FunctionDef ClassDef Delete", "field = 'unreachable' and not prior_unreachable", "Code can't be reached."),
    ("S2187", "ClassDef", f"{_TEST} and name rlike '^Test' and a.methods = '0' and a.bases = ''", "Test class has no tests."),
    ("S2260", "ParseError", "true", "File can't be parsed."),
)


NODE_RULES = (*NODE_RULES, *((key, kinds, f"contains(a.checks, ',{key},')", message) for key, kinds, message in CHECKED), ("S8572", "Call", "name in ('logging.error','logger.error') and in_handler", "Use exception."))


def node_rule_keys() -> list[str]:
    return sorted({r[0] for r in NODE_RULES})


def node_kinds(keys: set[str] | None = None) -> tuple[str, ...]:
    """The kinds of nodes that the rules on single nodes look at."""
    return tuple(sorted({k for key, kinds, *_ in NODE_RULES if keys is None or key in keys for k in kinds.split()}))


def node_attributes(keys: set[str] | None = None) -> tuple[str, ...]:
    """The attributes that the rules on single nodes ask for."""
    return tuple(sorted({a for key, _, predicate, _ in NODE_RULES if keys is None or key in keys for a in re.findall(r"(?<![\w.])a\.([a-z_]+)", predicate)}))


def _context(nodes: DataFrame) -> DataFrame:
    """The nodes with what some rules ask of the surroundings; the parser has seen it all."""
    told = lambda c: F.coalesce(F.col("attrs")[c] == "true", F.lit(False)).alias(c)
    return nodes.select("*", *map(told, ("last_in_suite", "prior_unreachable", "in_async", "special_method", "in_handler")))


def _expression(predicate: str, limits: dict[str, int]) -> Column:
    for name, n in limits.items():
        predicate = predicate.replace("{" + name + "}", str(n))
    return F.coalesce(F.expr(re.sub(r"(?<![\w.])a\.([a-z_]+)", r"attrs['\1']", predicate)), F.lit(False))


def _finding(key: str, message: str, **at: str) -> list[Column]:
    return ["path", F.lit(key).alias("rule_key"), F.lit(message).alias("message"), *(F.col(at.get(c, c)).cast("int").alias(c) for c in ("sl", "sc", "el", "ec"))]


def node_findings(nodes: DataFrame, keys: set[str] | None = None, limits: dict[str, int] | None = None, *more: str) -> DataFrame:
    """Findings of the rules on single nodes in one pass, with ``more`` columns; a node's kind chooses the rules that are tried."""
    limits = {**LIMITS, **(limits or {})}
    by_kind: dict[str, list[Column]] = {}
    for key, kinds, predicate, message in NODE_RULES:
        if keys is None or key in keys:
            hit = F.when(_expression(predicate, limits), F.struct(F.lit(key).alias("rule_key"), F.lit(message).alias("message")))
            for kind in kinds.split():
                by_kind.setdefault(kind, []).append(hit)
    if not by_kind:
        return nodes.limit(0).select(*_finding("", ""), *more)
    hits = reduce(lambda rest, item: rest.when(F.col("kind") == item[0], F.array(*item[1])), by_kind.items(), F.when(F.lit(False), F.array().cast("array<struct<rule_key:string,message:string>>")))
    rows = _context(nodes).where(F.col("kind").isin(*by_kind)).withColumn("h", F.explode(F.array_compact(hits)))
    return rows.select("path", "h.rule_key", "h.message", "sl", "sc", "el", "ec", *more)


def placed_findings(nodes: DataFrame, keys: set[str] | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """The findings of ``node_findings`` on nodes that stand in several places (``python_facts.placed_nodes``): rules that don't
    ask for the path are tried once for all of them."""
    by_path = {kind for key, kinds, predicate, _ in NODE_RULES if re.search(r"(?<![\w.'])path\b", predicate) for kind in kinds.split()}
    groups = F.when(F.col("kind").isin(*by_path), F.transform("places", lambda p: F.array(p))).otherwise(F.array("places"))
    rows = nodes.withColumn("places", F.explode(groups)).withColumn("path", F.col("places")[0]["path"])
    found = node_findings(rows, keys, limits, "places").withColumn("place", F.explode("places"))
    return found.select(F.col("place.path").alias("path"), "rule_key", "message", *((F.col(c) + F.col("place.line")).alias(c) if c in ("sl", "el") else c for c in ("sl", "sc", "el", "ec")))


def group_findings(nodes: DataFrame, literals: int = LIMITS["literals"]) -> DataFrame:
    """Rules on repeats inside a file: S1192 literals, S4144 equal functions, S1845 names that differ in case only, S4143 items written twice."""
    text = nodes.where("kind = 'Constant' and attrs['type'] = 'str' and length(attrs['value']) >= 5 and parent_kind <> 'Expr'").withColumn("value", F.col("attrs")["value"])
    spot = F.struct("sl", "sc", "el", "ec")
    repeated = text.groupBy("path", "value").agg(F.count("*").alias("n"), F.min(spot).alias("p")).where(F.col("n") >= literals).select("path", "p.*")
    functions = nodes.where("kind in ('FunctionDef','AsyncFunctionDef') and int(attrs['lines']) >= 3").withColumn("body", F.col("attrs")["body"])
    order = Window.partitionBy("path", "parent", "body").orderBy("id")
    equal = functions.withColumn("n", F.row_number().over(order)).where("n > 1")
    members = nodes.where("kind = 'FunctionDef' and cls >= 0").withColumn("low", F.lower("name"))
    case = members.withColumn("other", F.min("name").over(Window.partitionBy("path", "cls", "low"))).where("other <> name")
    parts = [(repeated, "S1192", "Define a constant for this literal."), (equal, "S4144", "Function equals an earlier one."), (case, "S1845", "Name differs from another in case only.")]
    return reduce(DataFrame.unionByName, [d.select(*_finding(k, m)) for d, k, m in parts])


def scope_findings(nodes: DataFrame) -> DataFrame:
    """Rules on names: S1128 unused imports, S1481 unused locals, S1172 unused parameters, S1144 and S4487 unused private members."""
    s = nodes.where("kind = 'Symbol'").select("path", "name", "sl", *(F.col("attrs")[c].alias(c) for c in ("scope", "where", "parameter", "imported", "assigned", "used")))
    exported = nodes.where("kind = 'Constant' and attrs['type'] = 'str'").select("path", F.col("attrs")["value"].alias("name")).distinct()
    imports = s.where("imported = 'true' and used = 'false' and name not like '!_%' escape '!' and not path rlike '(^|/)__init__[.]py$'").join(exported, ["path", "name"], "left_anti")
    unused = s.where("scope = 'function' and assigned = 'true' and used = 'false' and parameter = 'false' and imported = 'false' and name not like '!_%' escape '!'")
    trivial = nodes.where("kind in ('FunctionDef','AsyncFunctionDef') and (attrs['trivial'] = 'true' or cls >= 0 or attrs['decorators'] <> '')").select("path", F.col("name").alias("where"), "sl")
    params = s.where("scope = 'function' and parameter = 'true' and used = 'false' and assigned = 'false' and name not like '!_%' escape '!' and name not in ('self','cls')").join(trivial, ["path", "where", "sl"], "left_anti")
    private = nodes.where("kind = 'FunctionDef' and cls >= 0 and name rlike '^__[a-z0-9_]*[a-z0-9]$' and not name rlike '__$'").select("path", "name", "sl", "sc", "el", "ec")
    reads = nodes.where("kind = 'Attribute' and attrs['store'] = 'false'").select("path", F.regexp_extract("name", "([^.]+)$", 1).alias("name")).distinct()
    methods = private.join(reads, ["path", "name"], "left_anti")
    stores = nodes.where("kind = 'Attribute' and attrs['store'] = 'true' and name rlike '^self[.]__[a-z0-9_]*[a-z0-9]$'").select("path", F.regexp_extract("name", "([^.]+)$", 1).alias("name"), "sl", "sc", "el", "ec")
    fields = stores.join(reads, ["path", "name"], "left_anti").groupBy("path", "name").agg(F.min(F.struct("sl", "sc", "el", "ec")).alias("p")).select("path", "p.*")
    on_line = lambda d: d.select("path", "sl", F.lit(0).alias("sc"), F.col("sl").alias("el"), F.lit(0).alias("ec"))
    parts = [
        (on_line(imports), "S1128", "Import isn't used."),
        (on_line(unused), "S1481", "Local variable isn't used."),
        (on_line(params), "S1172", "Parameter isn't used."),
        (methods, "S1144", "Private method isn't used."),
        (fields, "S4487", "Private attribute isn't read."),
    ]
    return reduce(DataFrame.unionByName, [d.select(*_finding(k, m)) for d, k, m in parts])


def python_findings(nodes: DataFrame) -> DataFrame:
    """All findings; ``nodes`` should be persisted, so that files are parsed once."""
    return node_findings(nodes).unionByName(group_findings(nodes)).unionByName(scope_findings(nodes))
