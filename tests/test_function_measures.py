"""Measures of functions are those of their nodes, without digests of the whole tree."""

from codequarry.functions import python_facts
from codequarry.program_queries import FUNCTIONS

NESTED = "class A:\n    async def f(self, *, a=lambda: 1):\n        if a:\n            def g(x):\n                return x and a or 1\n    try:\n        pass\n    except E:\n        def h(): pass\nmatch A:\n    case 1:\n        def i(): pass\n"


def test_measures_are_those_of_the_nodes(monkeypatch):
    text = "\n\n".join([f[0] for f in FUNCTIONS] + [NESTED])
    kinds = frozenset(("FunctionDef", "AsyncFunctionDef"))
    want = [(r[0], r[12], r[14], *(int(dict(r[18])[c]) for c in ("params", "lines", "complexity", "cognitive"))) for r in python_facts.facts("p", text, kinds)]
    monkeypatch.setattr(python_facts, "_digests", None)
    assert sorted(python_facts.functions("p", text)) == sorted(want)
    assert len(want) == len(FUNCTIONS) + 4
    for bad in ("def (", "def f():\n    x = 1\n    global x\n", "\x00"):
        assert python_facts.functions("p", bad) == []
    assert python_facts.functions("p", None) == []
