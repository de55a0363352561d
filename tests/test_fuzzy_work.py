"""Fuzzy pairs of files compare few pairs and move numbers of lines; results equal those of every pair."""

import random

import pytest

from codequarry.operators import line_pairs


def _shape(spark, d):
    return spark.createDataFrame([(k, "\n".join(v), v) for k, v in d.items()], "path string, digest string, lines array<string>")


def _want(new, old):
    score = {(n, o): line_pairs.common_lines(new[n], old[o]) for n in new for o in old if new[n] != old[o]}
    best, top = ({k: max((s for p, s in score.items() if p[side] == k), default=0) for k in d} for side, d in ((0, new), (1, old)))
    want, used = {}, set()
    for n in sorted(new):
        mine = [o for o in old if best[n] and score.get((n, o)) == best[n]]
        if mine:
            rivals = sum(score.get((m, mine[0])) == top[mine[0]] for m in new)
            clear = len(mine) == 1 and rivals == 1 and mine[0] not in used
            want[n] = (mine[0], "fuzzy") if clear else (None, "ambiguous")
            used.update(mine if clear else [])
    return want


def _found(spark, new, old, **kw):
    pairs = line_pairs.fuzzy_pairs(line_pairs.fuzzy_candidates(_shape(spark, new), _shape(spark, old), **kw))
    return {r.path: (r.reference_path, r.pairing) for r in pairs.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_fuzzy_pairs_with_frequent_and_long_lines(spark, seed):
    """Lines of 43 to 45 characters and more bytes, repeated lines, copies and equal files; a line of two files is frequent."""
    rng = random.Random(seed)
    lines = ["{", "}", "", *("é" * k for k in (21, 22, 23)), *(f"{i}" + "x" * k for i in range(9) for k in (42, 43, 44, 300))]
    weights = [8] * 6 + [1] * (len(lines) - 6)
    old = {f"o{i:02}": rng.choices(lines, weights, k=rng.randrange(1, 9)) for i in range(50)}
    old |= {f"p{i}": old["o03"] for i in range(3)}
    new = {f"n{i:02}": [x for x in rng.choice(list(old.values())) if rng.random() < 0.8] + rng.choices(lines, k=rng.randrange(2)) for i in range(50)}
    new |= {"m0": old["o05"], "m1": old["o06"][1:], "m2": old["o06"][1:], "m3": ["nowhere"]}
    want = _want(new, old)
    assert _found(spark, new, old, rare=1) == want == _found(spark, new, old)
    assert {p for _, p in want.values()} == {"fuzzy", "ambiguous"}


def test_a_line_that_half_of_the_files_hold_makes_few_pairs(spark, monkeypatch):
    n, seen, scored = 150, [], line_pairs._scored

    def counted(pairs, classes, *more):
        seen.append(pairs.count())
        assert dict(classes.dtypes)["kept"] == "array<bigint>"
        return scored(pairs, classes, *more)

    monkeypatch.setattr(line_pairs, "_scored", counted)
    text = "a long line " * 9
    old = {f"o{i:03}": ["all", f"{text}{i}"] for i in range(n)} | {f"p{i:03}": [f"only {i}", "}"] for i in range(n)}
    new = {f"n{i:03}": [f"{text}{i}"] for i in range(n)} | {f"m{i:03}": ["all", f"only {i}"] for i in range(n)}
    assert _found(spark, new, old) == _want(new, old)
    assert sum(seen) < 8 * n


def test_renamed_files_writes_lines_once_and_then_numbers(spark, monkeypatch):
    from codequarry import project_queries

    texts, durable = [], line_pairs.durable

    def seen(df):
        texts.append({name for name, kind in df.dtypes if "string" in kind})
        return durable(df)

    monkeypatch.setattr(line_pairs, "durable", seen)
    assert project_queries.renamed_files(spark, "/root/testdata/sf0.001").count() > 0
    assert texts[:2] == [{"path", "digest", "keys"}, {"key"}]
    assert all(t <= {"path", "digest"} for t in texts[2:])
