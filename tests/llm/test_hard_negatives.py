"""Hard negatives against plain Python, with small blocks, ties, repeated rows and values beyond float64."""

import math
import random

import pytest

from codequarry.llm import hard_negatives as module

SCHEMA = "vec_id long, embedding array<double>, label int, score string, no string"


def slow(rows, positives=5, negatives=5, scale=256):
    good = []
    for k, v, label in rows:
        if k is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((k, [math.floor(scale * x) for x in v], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, v, label in good:
        if k % 100:
            continue
        scored = sorted((-dot(v, w), o, other) for o, w, other in good)
        for s, p, _ in [x for x in scored if x[2] == label and x[1] != k][:positives]:
            inside = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(k, p, i + 1, n, -s, -t) for i, (t, n, _) in enumerate(inside)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    found = module.hard_negatives(df, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    hot = vector()
    out = [(i, hot if i % 3 == 0 else vector(), rng.randrange(3)) for i in range(900)]
    out += [(None, vector(), 1), (901, None, 1), (902, vector(), None), (903, [1.0, None, 0.0], 1), (904, [math.nan] * 6, 1), (905, [math.inf] * 6, 1)]
    out += [(906, [], 1), (907, [0.5], 2), (908, vector() + [3.0], 0), (-100, vector(), 1), (100, out[100][1], out[100][2]), (7, hot, 1), (7, hot, 1)]
    return out


def test_ties_and_repeated_rows(spark, rows):
    want = slow(rows)
    assert len(want) > 50 and run(spark, rows) == want


def test_many_blocks_of_anchors(spark, rows):
    assert run(spark, rows, block_values=20) == slow(rows)


def test_small_products(spark, rows, monkeypatch):
    monkeypatch.setattr(module, "ROWS", 3)
    assert run(spark, rows) == slow(rows)
    best = module._Best(2, 2)
    for ids in ([5, 9, 11], [1, 3, 4]):
        import numpy as np

        scores = np.array([[7, 7, 7], [1, 2, 3]]) + (1 << 61)
        best.add(0, scores, module._ranks(scores), np.ones_like(scores, dtype=bool), np.array(ids))
    assert best.id.tolist() == [[1, 3], [4, 11]]


def test_values_beyond_float64(spark):
    rows = [(100, [1e6, 3.0], 0), (1, [1e6 + 1 / 256, 2.0], 0), (2, [1e6 - 1 / 256, 7.0], 1), (3, [1e6, 1.0], 1)]
    assert run(spark, rows) == slow(rows) and slow(rows)
    with pytest.raises(Exception, match="62 bits"):
        run(spark, [(100, [1e30], 0), (1, [1e30], 0)])


def test_nothing_to_find(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0], 0)]) == [] and run(spark, [(0, [1.0], 0), (1, [1.0], 1)]) == []
