"""MinHash near-duplicates against brute force, the guarantee of the join, leaders, blocks and odd tables."""

import random

import numpy as np
import pytest

from codequarry.llm import minhash, set_links


def shingle_set(text, n=2):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])


def slow(rows, similarity=80):
    """{(key, text): (size, component)} by all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and group[i] != group[j] and 100 * both >= similarity * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (k, _), g in zip(rows, group):
        if k is not None:
            least[g] = min(k, least.get(g, k))
    return sorted([(k, len(s), least.get(g) if s else k) for (k, _), s, g in zip(rows, sets, group)], key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 3, None) for r in rows], "doc_id long, text string, name string, size int, k string").repartition(5)
    out = minhash.near_duplicates(df, **options)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    out = out.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in out], key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\x0b", "one", "ONE", "one two", "two", "a b a b a b", "b a", "long " * 20000, "x" * 100000]
    for n in (6, 11, 25, 60, 140) * 6:
        base = [rng.choice(words) for _ in range(n)]
        for changes in (0, 0, 1, 2, n // 20, n // 12, n // 10, n // 8):
            w = list(base)
            for at in rng.sample(range(n), changes):
                w[at] = f"changed{rng.randrange(10**9)}"
            texts.append(" ".join(w))
    out = list(enumerate(texts))
    return out + [(None, texts[20]), (None, texts[20]), (None, "alone here"), (3, texts[30]), (15, texts[15]), (15, texts[15])]


def test_all_pairs(spark, rows):
    assert run(spark, rows) == slow(rows)


def test_large_group_with_leaders_and_blocks(spark, rows, monkeypatch):
    rng = random.Random(22)
    base = [f"v{i}" for i in range(100)]
    group = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(100), rng.choice([0, 1, 1, 2, 3, 5, 6, 8])):
            w[at] = f"c{rng.randrange(10**9)}"
        group.append((1000 + i, " ".join(w)))
    every = rows + group
    texts = spark.createDataFrame([(t or "",) for _, t in every], "t string").selectExpr("t", "xxhash64(t) AS th")
    leaders = set_links.find_leaders(texts, 2, 0.8)
    assert len(leaders.names) >= 1
    want = slow(every)
    assert run(spark, every) == want
    monkeypatch.setattr(set_links, "BLOCK_SHINGLES", 300)  # blocks of three texts
    assert run(spark, every) == want
    monkeypatch.setattr(set_links, "LEADERS", 0)  # without leaders the join finds the group
    monkeypatch.setattr(minhash, "KEY_BLOCK", 20)  # whose keys are cut into blocks
    assert run(spark, every) == want


def test_leaders_compare_exactly():
    rng = np.random.default_rng(3)
    members = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in (50, 400, 1000)]
    leaders = set_links.Leaders(members, 0.8)
    for x in [*members, members[1][:350], np.unique(np.concatenate([members[2][:800], members[0]])), np.zeros(0, np.uint64)]:
        links, near, near_j = leaders.compare(x)
        j = [len(np.intersect1d(x, m)) / max(1, len(np.union1d(x, m))) for m in members]
        assert sorted(links) == [i for i, v in enumerate(j) if v >= 0.8] and near == [i for i, v in enumerate(j) if 0.6 <= v < 0.8]
        assert near_j == pytest.approx([j[i] for i in near])
        if links:
            assert leaders.best(x, links) == pytest.approx(max(j))


def test_join_finds_every_pair_within_the_radius():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = rng.integers(0, 1 << 63, (1, minhash.HASHES)).astype(np.uint64)
        b = a.copy()
        at = rng.choice(minhash.HASHES, minhash.RADIUS, replace=False)
        b[0, at] = rng.integers(0, 1 << 63, minhash.RADIUS)
        assert (minhash.keys(a) == minhash.keys(b)).any()
        assert minhash.distance(minhash.two_bits(a), minhash.two_bits(b))[0] <= (a != b).sum()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    differ = []
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
        b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100).astype(np.uint64)])  # 800 of 1,000 shared
        s = minhash.signatures([a, b])
        differ.append(int((s[0] != s[1]).sum()))
    assert abs(np.mean(differ) - 0.2 * minhash.HASHES) < 1.2 and max(differ) <= minhash.RADIUS and 3 < np.std(differ) < 5


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (None, "")]) == [(1, 0, 1), (None, 0, None)]
