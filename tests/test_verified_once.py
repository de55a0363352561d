"""Verified fixes analyse the files once before and once after they are fixed, and choose fixes once."""

from collections import Counter

from codequarry.operators import lexical_rules
from codequarry.plans import fixes, reports


def test_each_step_once(spark, monkeypatch):
    """Paths are counted as they pass by."""
    seen = {"analysed": spark.sparkContext.accumulator(0), "chosen": spark.sparkContext.accumulator(0)}

    def counted(df, name):
        def run(batches):
            for b in batches:
                seen[name].add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    own, choose = lexical_rules.lexical_findings, reports.chosen_fixes
    monkeypatch.setattr(lexical_rules, "lexical_findings", lambda f, *a: own(counted(f, "analysed"), *a))
    monkeypatch.setattr(reports, "chosen_fixes", lambda f: choose(counted(f, "chosen")))
    texts = ["x.a = x.a;\nconsole.log(a);", "x.a = x.a;", "// nothing", "console.log(a);"]
    files = spark.createDataFrame([(f"{i}.js", "javascript", t) for i, t in enumerate(texts)], "path string, language string, text string")
    rows = Counter(map(tuple, fixes.verified(files).collect()))
    assert rows == {("0.js", True, 2, 1, 1): 1, ("1.js", True, 1, 0, 1): 1}
    # four files before, the two that got fixes after; two findings have a fix
    assert (seen["analysed"].value, seen["chosen"].value) == (6, 2)
