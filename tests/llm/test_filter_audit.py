"""The filter audit against plain Python, and against DuckDB on the given tables."""

import itertools
import random
import re
from collections import Counter
from pathlib import Path

import pytest

from codequarry.llm import filter_audit as module
from codequarry.llm import queries

SMALL = "/root/testdata/sf0.001"


def slow(documents, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    smallest = {}
    for d, t, _ in documents:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    fails = []
    for d, t, part in documents:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        first = smallest.get(t)
        own = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), first is not None and (d is None or first < d)]
        fails.append((part or "", {x for x, f in zip("ABCDE", own) if f}, d in good, d in toxic))
    out = []
    for part in {f[0] for f in fails}:
        every = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            for i, x in enumerate(order):
                gone, left = [f for f in left if x in f[1]], [f for f in left if x not in f[1]]
                failing = [f for f in fails if f[0] == part and x in f[1]]
                every[x] += len(gone)
                out.append([part, order, i + 1, len(left), len(gone), len(failing) - len(gone), sum(f[1] == {x} for f in failing), sum(f[2] for f in gone), sum(f[3] for f in gone)])
        for row in out:
            if row[0] == part:
                row.append(every[row[1][row[2] - 1]])
    return Counter(map(tuple, out))


def test_against_plain_python(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(90)] + ["Big", "A", "é ü", "#x", "50%", "a b"]
    texts = [" ".join(rng.choice(words[: rng.choice([5, 60, 96])]) for _ in range(rng.choice([3, 49, 50, 51, 80]))) for _ in range(40)]
    texts += [None, "", " \t\n\x0b\f\r", "x " * 50, "\x1cY\x1c" * 20, "w1\x00w2 " * 60, "long" * 30000]
    documents = [(rng.choice([None, *range(200)]) if i % 9 == 0 else i, rng.choice(texts[: 1 + i % len(texts)]), rng.choice([None, "", "a", "a", "b"])) for i in range(260)]
    documents += documents[:7] + [(500 + i, texts[1], "a") for i in range(60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 260, 2)] * 2 + [(2, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*d, "z", 1) for d in documents], "doc_id long, text string, source string, name string, n int").repartition(4)
    judged = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = module.filter_audit(docs, judged)
    assert Counter(tuple(r) for r in found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()) == slow(documents, labels)
    assert module.filter_audit(docs.limit(0), judged).count() == 0
    assert module.filter_audit(docs, judged.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_words_are_counted_without_another_shuffle(spark):
    texts = spark.createDataFrame([("n", 1, "a b a")], "name string, doc_id long, t string").repartition(3, "name")
    plan = module.word_counts(texts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_duckdb(spark, name):
    import oracle

    assert oracle.differences(spark, SMALL, queries.QUERIES[name], queries.ORACLE_SQL[name]) is None
