import random
from pathlib import Path

import pytest

from codequarry import program_queries, project_queries, queries, scope_queries  # noqa: F401
from codequarry.operators import assessment, clones, history, line_pairs, lines
from codequarry.plans import reports
from codequarry.sources import reports as imports

from oracle import differences

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, SMALL, queries.QUERIES[name], queries.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for i, y in enumerate(b):
            before, row[i + 1] = row[i + 1], before + 1 if x == y else max(row[i + 1], row[i])
    return row[-1]


def test_fuzzy_pairs_against_every_pair(spark):
    rng = random.Random(3)
    line = lambda: rng.choice("abcdefgh")
    old = {f"o{i}": [line() for _ in range(rng.randrange(1, 9))] for i in range(12)}
    new = {f"n{i}": ([line()] + old[f"o{i}"][1:] if i % 2 and i < 12 else [line() for _ in range(5)]) for i in range(14)}
    for a in (*new.values(), *old.values()):
        for b in (*new.values(), *old.values()):
            assert line_pairs.common_lines(a, b) == _lcs(a, b)
    shape = lambda d: spark.createDataFrame([(k, "".join(v), v) for k, v in d.items()], "path string, digest string, lines array<string>")
    score = {(n, o): _lcs(new[n], old[o]) for n in new for o in old if new[n] != old[o] and _lcs(new[n], old[o])}
    want, used = {}, set()
    for n in sorted(new):
        mine = {o: s for (m, o), s in score.items() if m == n}
        if not mine:
            continue
        best = [o for o, s in mine.items() if s == max(mine.values())]
        rivals = [s for (m, o), s in score.items() if o == best[0]]
        clear = len(best) == 1 and rivals.count(max(rivals)) == 1 and best[0] not in used
        want[n] = (best[0], "fuzzy") if clear else (None, "ambiguous")
        used.update(best if clear else [])
    found = line_pairs.fuzzy_pairs(line_pairs.fuzzy_candidates(shape(new), shape(old))).collect()
    assert {r.path: (r.reference_path, r.pairing) for r in found} == want
    assert {p for _, p in want.values()} == {"fuzzy", "ambiguous"}


def test_fuzzy_pairs_of_files_with_two_common_lines(spark):
    """All files have two lines in common, many lack any other, and some have equal kept lines or equal contents."""
    rng = random.Random(4)
    old = {f"o{i:03}": ["{", *(f"own {i} {j}" for j in range(i % 7)), "}"] for i in range(230)}
    new = {f"n{i:03}": [x for x in old[f"o{i:03}"] if rng.random() < 0.8] + ["}"] * (i % 11 == 0) for i in range(230)}
    new.update({f"m{i}": ["nothing", f"in common {i}"] for i in range(3)})
    shape = lambda d: spark.createDataFrame([(k, "\n".join(v), v) for k, v in d.items()], "path string, digest string, lines array<string>")
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
    candidates = line_pairs.fuzzy_candidates(shape(new), shape(old), rare=2).persist()
    assert candidates.count() < 8 * (len(new) + len(old))
    assert {r.path: (r.reference_path, r.pairing) for r in line_pairs.fuzzy_pairs(candidates).collect()} == want
    assert {p for _, p in want.values()} == {"fuzzy", "ambiguous"} and len(want) > 200


def test_rivals_for_one_reference_stay_ambiguous(spark):
    c = spark.createDataFrame([("n1", "o1", 5), ("n2", "o1", 5), ("n3", "o2", 4), ("n3", "o3", 4), ("n4", "o4", 2), ("n5", "o4", 3)], "path string, reference_path string, score int")
    found = {r.path: (r.reference_path, r.pairing) for r in line_pairs.fuzzy_pairs(c).collect()}
    assert found == {"n1": (None, "ambiguous"), "n2": (None, "ambiguous"), "n3": (None, "ambiguous"), "n4": ("o4", "fuzzy"), "n5": (None, "ambiguous")}


def test_order_pages_and_coverage_status(spark):
    f = spark.createDataFrame([("b", 2, 0, 2, 1, "r", "m"), ("b", 1, 5, 1, 6, "r", "m"), ("a", 9, 0, 9, 1, "s", "b"), ("a", 9, 0, 9, 1, "s", "a")], "path string, sl int, sc int, el int, ec int, rule_key string, message string")
    assert [(r.path, r.sl, r.message) for r in lines.canonical_order(f).collect()] == [("a", 9, "a"), ("a", 9, "b"), ("b", 1, "m"), ("b", 2, "m")]
    i = spark.createDataFrame([("a", "vendor"), ("b", "source"), ("a", "source"), ("a", "test")], "path string, class string")
    assert [tuple(r) for r in lines.project_order(i).collect()] == [("a", "source"), ("a", "test"), ("a", "vendor"), ("b", "source")]
    g = spark.createDataFrame([("x", 1, 5), ("x", 2, 9), ("w", 1, 5)], "first_path string, first_start int, length int")
    assert [r.length for r in clones.group_order(g).collect()] == [9, 5, 5]
    for size in (0, 501):
        with pytest.raises(ValueError):
            history.page(f, ("path",), size=size)
    e = spark.createDataFrame([(None,), ("bad line",)], "problem string")
    status = lambda d: assessment.coverage_status(d).first().status
    assert [status(e.limit(0)), status(e.where("problem is null")), status(e.where("problem is not null")), status(e)] == ["missing", "complete", "invalid", "incomplete"]
    results = spark.createDataFrame([("pass",), ("fail",)], "status string")
    assert [assessment.exit_code(results, True), assessment.exit_code(results, False), assessment.exit_code(results.where("status = 'pass'"), True)] == [1, 2, 0]


def test_baseline_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("a", 1, 0, 1, 3, "S1", 'say "x"\n')], "path string, sl int, sc int, el int, ec int, rule_key string, message string")
    files = spark.createDataFrame([("a", "go", 3, 2, 1), ("b", "go", 0, 0, 0)], "path string, language string, lines long, code_lines long, comment_lines long")
    documents = reports.native(f, files)
    imports.write_baseline(documents, f"{tmp_path}/base")
    assert [tuple(r) for r in imports.read_baseline(spark, f"{tmp_path}/base").collect()] == [("a", "S1", 'say "x"\n', 1, 0, 1, 3)]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        imports.write_baseline(documents, f"{tmp_path}/base")


def test_edits_that_overlap_or_leave_the_text(spark):
    fixes = spark.createDataFrame([("a", 2, 2, "X"), ("a", 2, 4, "Y"), ("a", 4, 5, "Z"), ("b", 0, 99, "")], "path string, start int, stop int, replacement string")
    chosen = reports.chosen_edits(fixes)
    assert {r.path: (len(r.edits), r.conflicts) for r in chosen.collect()} == {"a": (2, 1), "b": (1, 0)}
    files = spark.createDataFrame([("a", "012345"), ("b", "01"), ("c", "")], "path string, text string")
    assert {r.path: r.fixed for r in reports.applied(files, chosen).collect()} == {"a": "01X23Z5", "b": None, "c": ""}


def test_deleted_and_inventory(spark):
    a = spark.createDataFrame([(1, 1, None), (2, 1, "old")], "id int, project int, deleted_at string")
    now, audit = history.deleted(a, a.project == 1, "me", "why", "t")
    assert {(r.id, r.deleted_at) for r in now.collect()} == {(1, "t"), (2, "old")} and [r.analysis_id for r in audit.collect()] == [1]


def _chains(a, b):
    """All longest common subsequences, as sets of places (i, j)."""
    best, found = 0, [()]
    todo = [((), 0, 0)]
    while todo:
        chain, i, j = todo.pop()
        if len(chain) > best:
            best, found = len(chain), []
        if len(chain) == best:
            found.append(chain)
        todo += [((*chain, (x, y)), x + 1, y + 1) for x in range(i, len(a)) for y in range(j, len(b)) if a[x] == b[y]]
    return set(found)


def test_alignment_of_long_files():
    rng = random.Random(7)
    base = [rng.choice(["", "}"]) if rng.random() < 0.3 else f"line {i}" for i in range(12_000)]
    now = list(base)
    for i in range(50):
        now.insert(rng.randrange(len(now)), f"new {i}")
    new, uncertain = line_pairs.aligned(now, base)
    assert not uncertain and [now[i - 1] for i in new] == [x for x in now if x.startswith("new")]
    twice = next(x for x in base if x.startswith("line"))
    now.insert(now.index(twice), twice)
    assert line_pairs.aligned(now, base)[1] and len(line_pairs.aligned(now, base)[0]) == 52


def test_alignment_against_all_chains(spark):
    rng = random.Random(6)
    rows = [(str(i), [rng.choice("abcd") for _ in range(rng.randrange(6))], [rng.choice("abcd") for _ in range(rng.randrange(6))]) for i in range(120)]
    found = {r.path: r for r in line_pairs.aligned_lines(spark.createDataFrame(rows, "path string, lines array<string>, reference_lines array<string>")).collect()}
    for path, a, b in rows:
        chains = _chains(a, b)
        new, uncertain = [], False
        for i in range(len(a)):
            places = {next((j for x, j in c if x == i), None) for c in chains}
            if None in places:
                new.append(i + 1)
            uncertain |= len(places) > 1
        assert (found[path].new_lines, found[path].status) == (new, "uncertain" if uncertain else "complete"), (a, b)
    assert line_pairs.aligned(["x"] * 3000, ["y"] * 3000) == (list(range(1, 3001)), False)
