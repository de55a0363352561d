"""Benchmark passages, changed in many ways, against a search of every window."""

import random

import numpy as np
import pytest

from codequarry.llm import decontamination
from codequarry.llm.decontamination import NON_WORD, RADIUS, SIMILARITY, ItemIndex, Words, _grams, _packed, _signs

VOCABULARY = [f"w{i}" for i in range(400)]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def brute(items, texts):
    """{(text, item): (best similarity, start)} over every window, and the same over those within the radius."""
    index = ItemIndex(list(enumerate(items)))
    every, reached = {}, {}
    for t, text in enumerate(texts):
        w = Words([(text or "").encode().lower()], NON_WORD)
        for i, item in enumerate(index.ids):
            size = int(index.sizes[i])
            step, n = min(5, size), min(size, len(w.hash))
            if n < step:
                continue
            for s in range(len(w.hash) - n + 1):
                grams = _grams(w.hash[s : s + n], step)
                value = index.similarity(i, *np.unique(grams, return_counts=True))
                if value < SIMILARITY:
                    continue
                fp = _packed(_signs(grams, index.rarity(grams)).sum(axis=0, keepdims=True))[0]
                for found in (every, reached) if int(fp ^ index.index.prints[i]).bit_count() <= RADIUS else (every,):
                    if (t, item) not in found or value > found[t, item][0]:
                        found[t, item] = value, s
    return every, reached


def cases(seed):
    rng = random.Random(seed)
    items = [words(rng, rng.choice([30, 44, 58, 58, 75])) for _ in range(16)] + [["a"], ["b", "c", "d"], [], words(rng, 6)]
    items.append(items[0][:20] + words(rng, 20))
    texts = []
    for x in items[:16]:
        half = len(x) // 2
        changed = list(x)
        changed[half] = "other"
        inserted = [*x[:half], "new", *x[half:]]
        cut = x[: half - 1] + x[half:]
        ends = ["other", *x[1:-1], "other"]
        for y in (x, x[half:] + x[:half], changed, inserted, cut, ends):
            texts.append(" ".join(words(rng, 40) + y + words(rng, 40)))
        texts.append(" ".join(x[: len(x) - 3]))
    texts += ["", None, "A", "x b, C d.", " ".join(words(rng, 200)), " ".join(items[0][half:] + words(rng, 60) + items[0][:half])]
    return [" ".join(x) for x in items], texts


@pytest.mark.parametrize("seed", [5, 6])
def test_every_window_is_tried(seed):
    items, texts = cases(seed)
    every, reached = brute(items, texts)
    index = ItemIndex(list(enumerate(items)))
    found = {(t, index.ids[i]): (s, start) for t, row in enumerate(index.matches([(x or "").encode() for x in texts])) for i, start, s in row}
    assert found == reached
    # what the radius loses, of cases of which many lie just at the limit
    assert len(every) > 80 and len(found) >= 0.97 * len(every)


def test_blocks_find_every_item_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    queries = prints[:60].copy()
    for i in range(60):
        for bit in rng.choice(64, i % 20, replace=False):
            queries[i] ^= np.uint64(1 << int(bit))
    query, entry = decontamination.HammingIndex(prints).near(queries)
    want = np.nonzero(np.bitwise_count(queries[:, None] ^ prints[None, :]) <= RADIUS)
    assert list(zip(query.tolist(), entry.tolist())) == list(zip(*(x.tolist() for x in want)))


def test_result_depends_on_neither_blocks_nor_order(spark, monkeypatch):
    items, texts = cases(7)
    many = [(i, x) for i, x in enumerate(items)] + [(100 + i, " ".join(words(random.Random(i), 30))) for i in range(5200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    found = []
    for shingles, rows in ((2_000_000, many), (20_000, many), (20_000, many[::-1])):
        monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", shingles)
        benchmark = spark.createDataFrame(rows, "item_id long, text string").coalesce(1)
        found.append(sorted(map(tuple, decontamination.contamination(docs, benchmark).collect())))
    assert len(found[0]) > 60
    assert found[0] == found[1] == found[2]
    clean = {r.doc_id for r in decontamination.without_contaminated(docs, benchmark).collect()}
    assert clean == set(range(len(texts))) - {r[0] for r in found[0]}
