"""Nodes that equal statements share give the same findings, statement by statement, as the nodes of each file."""

import ast
import pathlib

import pytest

from codequarry.functions import python_facts
from codequarry.operators import python_rules
from test_told_attributes import SOURCE

KINDS, TOLD = python_rules.node_kinds(), python_rules.node_attributes()
MORE = [
    SOURCE, None, "x = (", "", "\n\n" + SOURCE, SOURCE.replace("\n", "\r\n"), SOURCE + "raise Exception\nprint(1)\nprint(2)\n", "print(1)\nprint(2)\n", "DEBUG = True\n",
    "@d\n@e(1)\ndef f(a=[]):\n    pass\n", "# c\n\n@d\n\n@e(1)\ndef f(a=[]):\n    pass\n", "a[1] = 2\na[1] = 3\n", "a == b; a == b\nif 1: a == b\n", "class TestA:\n    pass\n",
    "s = '''\x0c\n\u2028''' is 5\n len(x)\n", "s = '''\x0c\n\u2028'''; s is 5\nlen(x)\n",
]
REFUSED = ["def f(a, a): pass", "def f(): x = 1; global x", "nonlocal x", "def f():\n    from a import *", "[i := 0 for i in x]", "class A:\n    [y := 0 for i in x]", "[(yield) for i in x]", "def f[T, T](): pass", "type A = (yield)", "def f(x): global x", "lambda a, *a: 1", "x: (yield) = 1\ndef f(): global x; x: int"]


def rows(text):
    """What rules ask of the nodes, in both forms."""
    told, kinds = frozenset(TOLD), frozenset(KINDS)
    spots = lambda r, line: (r[3], r[4], r[5], r[9], r[10] < 0, r[11] < 0, r[12], r[14] + line, r[15], r[16] + line, r[17], tuple(map(tuple, r[18])))
    want = sorted(spots(r, 0) for r in python_facts.facts("p", text, kinds, told) if r[3] != "Module" or r[18])
    return want, sorted(spots(r, line) for _, rows, line in STATEMENTS.of_file("p", text) for r in rows)


STATEMENTS = python_facts.EqualStatements(frozenset(KINDS), frozenset(TOLD), 200)


@pytest.mark.parametrize("text", [*MORE, *REFUSED])
def test_rows(text):
    want, got = rows(text)
    assert want == got
    assert text not in REFUSED or [r[0] for r in want] == ["ParseError"] or not _refused(text)


def _refused(text):
    import symtable

    try:
        symtable.symtable(text, "p", "exec")
    except SyntaxError:
        return True


def test_library():
    for p in sorted(pathlib.Path(ast.__file__).parent.glob("*.py"))[:60]:
        want, got = rows(p.read_text(errors="replace"))
        assert want == got, p


def test_findings(spark):
    files = spark.createDataFrame([(f"d{i}/{name}", t) for i, t in enumerate([*MORE, *REFUSED]) for name in ("a.py", "settings.py", "test_b.py")], "path string, text string").repartition(2)
    every = lambda d: sorted(map(tuple, d.collect()))
    want = every(python_rules.node_findings(python_facts.nodes(files, KINDS, TOLD)))
    assert want == every(python_rules.placed_findings(python_facts.placed_nodes(files, KINDS, TOLD)))
    assert {"S4507", "S2187", "S4143", "S2260"} <= {r[1] for r in want}


def test_equal_statements_are_worked_out_once(monkeypatch):
    walked = []
    own = python_facts._rows
    monkeypatch.setattr(python_facts, "_rows", lambda *a: walked.append(a) or own(*a))
    statements = python_facts.EqualStatements(frozenset(KINDS), frozenset(TOLD))
    parts = [p for i in range(20) for p in statements.of_file(f"{i}.py", f"x{i} = 1\ndef f(a=[]):\n    return a == a\ny = 1\n")]
    assert len(walked) == 22 and len({key for key, *_ in parts}) == 22
