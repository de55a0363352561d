"""Alignment by pairs of equal lines: against the band and a table, and on files far too long for a band."""

import random
import time

import numpy as np

from codequarry.operators import line_pairs


def by_table(a, b):
    """Lines of ``a`` that aren't in every longest common subsequence, by chains before and after each place."""
    before = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    after = before.copy()
    for i in range(len(a)):
        for j in range(len(b)):
            before[i + 1, j + 1] = before[i, j] + 1 if a[i] == b[j] else max(before[i, j + 1], before[i + 1, j])
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            after[i, j] = after[i + 1, j + 1] + 1 if a[i] == b[j] else max(after[i + 1, j], after[i, j + 1])
    longest = before[-1, -1]
    free = [i + 1 for i in range(len(a)) if any(before[i, j] + after[i + 1, j] == longest for j in range(len(b) + 1))]
    on = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j] and before[i, j] + 1 + after[i + 1, j + 1] == longest]
    return free, len(on) > longest


def test_both_ways_give_the_same(monkeypatch):
    rng = random.Random(4)
    for trial in range(600):
        letters = "ab" if trial % 3 == 0 else "abcdefgh"
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(14))] for _ in "xy")
        want = by_table(a, b)
        monkeypatch.setattr(line_pairs, "_PAIRS_A_LINE", 10**6)
        assert line_pairs.aligned(a, b) == want, (a, b)
        monkeypatch.setattr(line_pairs, "_PAIRS_A_LINE", -1)
        monkeypatch.setattr(line_pairs, "_PAIRS", -1)
        assert line_pairs.aligned(a, b) == want, (a, b)
        monkeypatch.undo()


def test_long_files_of_different_lines():
    old = [f"order {i}" for i in range(100_000)]
    now = [x for i in range(100_000) for x in (["new " + str(i)] if i % 2 else []) + [old[i]] * (2 if i % 10 == 0 else 1)]
    began = time.perf_counter()
    new, uncertain = line_pairs.aligned(now, old)
    assert len(new) == 50_000 + 20_000 and uncertain
    assert time.perf_counter() - began < 20
