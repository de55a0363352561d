"""A rule's pattern runs once over a file: places come from marks around its matches."""

from codequarry.operators import lexical_rules


def test_pattern_runs_once():
    sql = lexical_rules._matches("code", r"zq+\w", "K", "m")
    assert sql.count("zq+") == 1


def test_places_of_marks(spark):
    mark, other = "\ue000", "\ue001"
    wide = " ".join(["a = Math.random();"] * 70)
    text = f"// {mark}\nx('{mark}{other}'); y = Math.random(\n);\n{wide}\ntry {{ a(); }} catch (e) {{\n  throw e;\n}}\n" + "\n" * 3 + "𝒳 = Math.random();"
    rows = lexical_rules.lexical_findings(spark.createDataFrame([("a", "javascript", text), ("b", "javascript", ""), ("c", "javascript", None), ("d", "cobol", text)], "path string, language string, text string"), {"S2245", "S2737"}).collect()
    got = sorted((r.rule_key, r.sl, r.sc, r.el, r.ec) for r in rows)
    size = len("Math.random(")
    want = [("S2245", 2, 13, 2, 13 + size)] + [("S2245", 4, 4 + 19 * i, 4, 4 + 19 * i + size) for i in range(70)]
    want += [("S2245", 11, 4, 11, 4 + size), ("S2737", 5, 13, 7, 1)]
    assert got == sorted(want) and {r.path for r in rows} == {"a"}
