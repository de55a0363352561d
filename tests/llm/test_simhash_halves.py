"""Links by halves of fingerprints against every pair, and the pipeline's near-dedup stage against the fingerprints' components."""

import random

import corpus_pipeline
import numpy as np
import pytest

from codequarry.llm import simhash


def components(prints):
    """Of each of a list of fingerprints the least index that links of three bits reach."""
    prints = np.array(prints, dtype=np.uint64)
    of = np.full(len(prints), -1)
    for i in range(len(prints)):
        todo = [i] if of[i] < 0 else []
        while todo:
            j = todo.pop()
            of[j] = i
            new = np.flatnonzero((of < 0) & (np.bitwise_count(prints ^ prints[j]) <= 3))
            of[new] = i
            todo += new.tolist()
    return of.tolist()


@pytest.mark.parametrize("shared", [4096, 20])
def test_every_link_is_found_by_halves(spark, monkeypatch, shared):
    monkeypatch.setattr(simhash, "_SHARED", shared)
    rng = random.Random(5)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        prints.add(base)
        for bits in (1, 2, 3, 3, 3, 4, 5):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), bits)))
    half = rng.getrandbits(32)
    prints |= {rng.getrandbits(32) << 32 | half ^ (1 << rng.randrange(32)) for _ in range(200)}  # one key, few links
    prints |= {half << 32 | 7 << i for i in range(25)}
    prints = sorted(prints)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    # workers don't see the patched limit, so that the entries are compared here
    import pyarrow as pa

    if shared == 4096:
        found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()]
    else:
        fps = np.array(prints, dtype=np.uint64)
        how = np.arange(66, dtype=np.uint8)
        group = pa.table({"fp": [np.repeat(fps, 66).tobytes()], "how": [np.tile(how, len(fps)).tobytes()]})
        both = simhash._compare(group)
        every = list(zip(both.column("a").to_pylist(), both.column("b").to_pylist()))
        many = [(a,) for a, b in every if a == b]
        assert len(many) > 200
        ball = simhash._ball_links(spark.createDataFrame(many, "fp long"), len(many)).collect()
        found = [p for p in every if p[0] != p[1]] + [(r.a, r.b) for r in ball]
    where = {p[0]: i for i, p in enumerate(signed)}
    group = list(range(len(signed)))
    for a, b in found:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
        old, new = sorted((group[where[a]], group[where[b]]))
        group = [old if g == new else g for g in group]
    assert group == components(prints)


def test_the_stage_keeps_one_of_each_component(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(400)]
        for changes in (0, 0, 1, 2, 60):
            w = list(base)
            for at in rng.sample(range(400), changes):
                w[at] = "new" + str(rng.random())
            texts.append(" ".join(w))
    rng.shuffle(texts)
    texts += [None, "", "  ", "one", "ONE"]
    found = components([simhash.fingerprint(t) for t in texts])
    want = sorted(set(found))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, other string").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == want and 50 < len(want) < 110
