"""Graph facts of many graphs: they share batches, and no graph costs a Python call of its own group."""

import random

from codequarry.operators import flow


def test_many_graphs_in_few_batches(spark, monkeypatch):
    rng = random.Random(8)
    graphs = {f"f{i}": {(rng.randrange(6), rng.randrange(6)) for _ in range(7)} for i in range(300)}
    edges = spark.createDataFrame([(f, a, b) for f, e in graphs.items() for a, b in e] * 2, "fn_id string, src int, dst int")
    df = flow.graph_facts(edges)
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
    rows = {(r.fn_id, r.block): r for r in df.collect()}
    assert len(rows) == sum(len({0, *(b for x in e for b in x)}) for e in graphs.values())
    for f, e in graphs.items():
        blocks = sorted({0, *(b for x in e for b in x)})

        def reach(start, e=e, without=None):
            seen, todo = set(), [start]
            while todo:
                a = todo.pop()
                new = {b for x, b in e if x == a and b != without} - seen
                seen |= new
                todo += new
            return seen

        for b in blocks:
            r = rows[f, b]
            assert r.reachable == (b == 0 or b in reach(0)) and r.in_cycle == (b in reach(b))
            assert r.component == min(x for x in blocks if x == b or x in reach(b) and b in reach(x))
            if b == 0 or not r.reachable:
                assert r.idom is None
            else:
                over = [d for d in blocks if d != b and (d == 0 or d in reach(0)) and (d == 0 or b not in reach(0, without=d))]
                assert r.idom == max(over, key=lambda d: d > 0 and len([x for x in over if x == 0 or d not in reach(0, without=x)]))
