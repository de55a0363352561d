"""Fixes of several edits, fixing until nothing is left, and reviews that carry over."""

import random

from codequarry.operators import history, lexical_rules
from codequarry.plans import fixes, reports

EDIT = "array<struct<start:int,stop:int,replacement:string>>"


def _chosen(spark, *found):
    df = spark.createDataFrame([("p", key, [tuple(e) for e in edits]) for key, edits in found], f"path string, rule_key string, edits {EDIT}")
    r = reports.chosen_fixes(df).first()
    return [(e.start, e.stop, e.replacement) for e in r.edits], r.fixes, r.conflicts


def test_fixes_are_taken_whole_or_not_at_all(spark):
    assert _chosen(spark, ("zz", [(0, 5, "A")]), ("aa", [(3, 7, "B")])) == ([(0, 5, "A")], 1, 1)
    assert _chosen(spark, ("B", [(2, 6, "Y")]), ("A", [(2, 4, "X")])) == ([(2, 4, "X")], 1, 1)
    assert _chosen(spark, ("X", [(0, 3, "L")]), ("Y", [(3, 6, "R")])) == ([(0, 3, "L"), (3, 6, "R")], 2, 0)
    assert _chosen(spark, ("pair", [(2, 3, ""), (8, 9, "")]), ("winner", [(0, 5, "W")])) == ([(0, 5, "W")], 1, 1)
    assert _chosen(spark, ("a", [(8, 9, "2"), (0, 1, "1")]), ("b", [(4, 5, "3")]), ("c", [])) == ([(0, 1, "1"), (4, 5, "3"), (8, 9, "2")], 2, 1)
    assert _chosen(spark, ("own", [(0, 4, "1"), (2, 6, "2")]), ("i", [(7, 7, "+")]), ("j", [(7, 7, "-")])) == ([(7, 7, "+")], 1, 2)
    none = spark.createDataFrame([], f"path string, rule_key string, edits {EDIT}")
    assert reports.chosen_fixes(none).count() == 0


def test_fixing_goes_on_until_nothing_is_left(spark):
    rows = [("a.go", "go", "x = x\n"), ("b.js", "javascript", "x.a = x.a == true\ny = 1"), ("c.cs", "csharp", "int a;")]
    files = spark.createDataFrame(rows, "path string, language string, text string")
    done = fixes.replanned(files).persist()
    out = {r.path: (r.text, r.edits, r.rounds) for r in done.collect()}
    assert out == {"a.go": ("\n", 1, 1), "b.js": (" \ny = 1", 2, 2)}
    left = done.select("path", "language", "text")
    assert fixes.planned(left, lexical_rules.lexical_findings(left)).count() == 0
    assert fixes.replanned(files.limit(0)).count() == 0


def test_reviews_of_many_analyses_carry_over(spark):
    rng = random.Random(3)
    analyses = [(i, "p", rng.choice("ab"), rng.randrange(200), rng.choice(["c", "d", None])) for i in range(400)]
    reviews = [(i, rng.choice(["x", "y"]), "finding", f"s{i}") for i in rng.sample(range(400), 120)]
    found = [(i, k, "finding", rng.random() < 0.1) for i in range(400) for k in ("x", "y")]
    at = {a[0]: a[1:] for a in analyses}
    want = {}
    for i, k, _, ambiguous in found:
        old = [((at[j][2], j), s) for j, key, _, s in reviews if key == k and at[j][:2] == at[i][:2] and at[j][3] == at[i][3] is not None and at[j][2] < at[i][2]]
        if old and not ambiguous:
            want[i, k] = max(old)[1]
    a = spark.createDataFrame(analyses, "id long, project string, branch string, analyzed_epoch long, context string")
    r = spark.createDataFrame(reviews, "analysis_id long, identity string, kind string, state string")
    f = spark.createDataFrame(found, "analysis_id long, identity string, kind string, ambiguous boolean")
    for period in (7, 50, 10**9):
        out = history.inherited_reviews(a, r, f, period)
        assert {(x.analysis_id, x.identity): x.state for x in out.collect()} == want and len(want) > 100
