"""Functions that store no local variable that they read get no graph; what others give is what it was."""

from codequarry.operators import flow

PLAIN = "def f(a, b=1):\n    '''Doc.'''\n    if a and b:\n        return a\n    print(a)\n    return b\n\n" * 3
STORES = "def g(n):\n    x = 1\n    x = n\n    with n as y:\n        y = (z := 2)\n    def h(x2):\n        w = x2\n        w = 1\n        return w\n    return x, y, z, h\n"


def test_no_graph_without_stores(monkeypatch):
    made = []
    lower = flow.Lowering
    monkeypatch.setattr(flow, "Lowering", lambda body: made.append(1) or lower(body))
    assert flow.dead_stores("p", PLAIN) == [] and not made
    assert sorted(flow.dead_stores("p", PLAIN + STORES)) == [("p", 23, "x"), ("p", 28, "w")] and len(made) == 2
    assert flow.dead_stores("p", None) == [] and flow.dead_stores("p", "def (") == []
