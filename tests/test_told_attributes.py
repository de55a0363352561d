"""Nodes with only the attributes that rules ask for give the same findings, and make no digests on the way."""

from codequarry.functions import python_facts
from codequarry.operators import python_rules

SOURCE = """import ssl, time
return 1
async def f(a, b=[], *c):
    if a == a and b is 'x':
        return 1
        print('late')
        return 2
    elif a == a and b is 'x':
        time.sleep(1)
    else:
        time.sleep(1)
    try:
        x = x
        host = 'http://a.b/c'
    except Exception:
        raise Exception('/tmp/x')
    return None
class C(BaseException):
    def __exit__(self):
        return 5
        return '10.1.2.3'
    def One(this):
        return 1
    def Two(self):
        while True:
            return [i for i in self]
open('/tmp/a', 'rz')
y = {1: 2, 1: 3}; z = {1, 1}
"""


def test_told_attributes(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", "x = ("), ("c.py", None)], "path string, text string")
    kinds, told = python_rules.node_kinds(), python_rules.node_attributes()
    rows = lambda nodes: sorted(map(tuple, python_rules.node_findings(nodes).collect()))
    want = rows(python_facts.nodes(files, kinds))
    assert want == rows(python_facts.nodes(files, kinds, told))
    assert {"S1763", "S2711", "S5443", "S5332", "S1313", "S1656", "S1764", "S1862", "S2260", "S5780", "S5781"} <= {r[1] for r in want}


def test_only_what_is_told():
    told = frozenset(python_rules.node_attributes())
    rows = python_facts.facts("a.py", SOURCE, frozenset(python_rules.node_kinds()), told)
    every = python_facts.facts("a.py", SOURCE)
    assert {k for r in rows for k, _ in r[-1]} <= told | {"last_in_suite", "prior_unreachable", "in_async", "special_method", "in_handler"}
    assert not any(r[13] for r in rows) and all(r[13] for r in every if r[3] != "Symbol")
    by_id = {r[1]: r for r in every}
    assert len(rows) < len(every)
    assert all(r[:13] == by_id[r[1]][:13] and set(r[-1]) <= set(by_id[r[1]][-1]) for r in rows if r[3] != "Symbol")
