"""Near copies of ordinary length against brute force."""

import random

from codequarry.llm import near_copies


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_copies_of_similarity_four_fifths(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    texts, bases = [None, "", "one two", "ONE two", "one three"], []
    for n in (40, 90, 150, 300) * 8:
        base = [rng.choice(vocabulary) for _ in range(n)]
        bases.append(base)
        for changes in (0, 0, 1, 1, 2, 3, 4, 6):
            w = list(base)
            for at in rng.sample(range(n), changes * n // 90):
                w[at] = "changed" + str(rng.random())
            texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    want = {group.index(g) for g in set(group)}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = near_copies.without_copies(rows)
    assert kept.columns == rows.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and 40 < len(want) < 200


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(12)
    a, b, c, d = (" ".join(f"w{rng.randrange(500)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a), (1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (None, d), (3, d), (None, "x y"), (None, "X y")]
    kept = near_copies.without_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept) == sorted([(1, a), (1, b), (0, c), (3, d), (0, "x y")])
