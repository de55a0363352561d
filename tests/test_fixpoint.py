"""Dataflow as fixpoints over rows, and match statements in the control flow."""

import random

from codequarry.operators import fixpoint, flow


def test_reaching_definitions_and_taint_against_the_solver(spark):
    rng = random.Random(8)
    edges, definitions, steps, want, stained = [], [], [], set(), set()
    for fn in map(str, range(25)):
        n = rng.randrange(2, 9)
        own = {(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)} | {(i, i + 1) for i in range(n - 1)}
        defs = [{rng.choice("xy")} if rng.random() < 0.5 else set() for _ in range(n)]
        kinds = [[(rng.choice(["source", "assign", "clean", "assign"]), rng.choice("xyz"), tuple(rng.sample("xyz", 2)))] if rng.random() < 0.7 else [] for _ in range(n)]
        g = flow.Graph(n, own)
        before, _ = flow.reaching(g, defs)
        want |= {(fn, b, v, d) for b in range(n) for v, d in before[b] or ()}
        _, after = flow.taint(g, kinds)
        stained |= {(fn, b, v, o) for b in range(n) for v, o in after[b] or ()}
        edges += [(fn, *e) for e in own] + [(fn, None, 1)]
        definitions += [(fn, b, v) for b in range(n) for v in defs[b]]
        steps += [(fn, b, *s[0]) for b, s in enumerate(kinds) if s]
    e = spark.createDataFrame(edges, "fn_id string, src long, dst long")
    found = fixpoint.reaching_definitions(e, spark.createDataFrame(definitions, "fn_id string, block long, variable string"))
    assert {(r.fn_id, r.block, r.variable, r.site) for r in found.collect()} == want and found.count() == len(want) > 50
    found = fixpoint.tainted(e, spark.createDataFrame(steps, "fn_id string, block long, kind string, target string, read array<string>"))
    assert {(r.fn_id, r.block, r.variable, r.origin) for r in found.collect()} == stained and found.count() == len(stained) > 50


def test_a_later_definition_stops_an_earlier_one(spark):
    e = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 2, 3)], "fn_id string, src long, dst long")
    d = spark.createDataFrame([("f", 0, "x"), ("f", 2, "x")], "fn_id string, block long, variable string")
    assert sorted((r.block, r.site) for r in fixpoint.reaching_definitions(e, d).collect()) == [(1, 0), (2, 0), (3, 2)]
    assert fixpoint.reaching_definitions(e, d.limit(0)).count() == 0 and fixpoint.reaching_definitions(e.limit(0), d).count() == 0


def _dead(body):
    return [(line, name) for _, line, name in flow.dead_stores("p", "def f(a, b):\n" + "".join(f"    {x}\n" for x in body.split("\n")))]


def test_stores_before_and_in_match():
    assert _dead("x = 1\nmatch a:\n    case 1:\n        x = 2\n    case _:\n        pass\nreturn x") == []
    assert _dead("x = 1\nmatch a:\n    case 1:\n        x = 2\n    case _:\n        x = 3\nreturn x") == [(2, "x")]
    assert _dead("x = 1\nmatch a:\n    case 1:\n        x = 2\n        x = 4\n    case [y, *z] if y:\n        x = z\nreturn x") == [(5, "x")]
    assert _dead("x = 1\nmatch a:\n    case x if x:\n        return x\n    case {'k': v, **rest}:\n        return rest, v\nreturn x") == [(2, "x")]
    assert _dead("for x in a:\n    y = 1\n    match x:\n        case 1:\n            break\n        case _:\n            continue\nelse:\n    y = 2\nreturn y") == []
    assert _dead("x = 1\nmatch a:\n    case b.C if b:\n        x = 2\nprint(x)") == []
