import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from codequarry.functions import text
from codequarry.operators import assessment, clones, flow
from codequarry.sources import files, reports


def test_lcov(spark):
    body = "TN:\nSF:src/a.py\nDA:1,2\nDA:2,0\nBRDA:2,0,0,1\nBRDA:2,0,1,-\nend_of_record\nDA:9,1\nSF:src/b.py\nDA:x,1\nDA:3,1\nODD:1\nend_of_record\n"
    rows = reports.lcov(spark.createDataFrame([(1, body)], "input_id int, text string")).collect()
    assert sorted((r.path, r.line, r.covered) for r in rows if r.problem is None and r.branch_id is None) == [("src/a.py", 1, True), ("src/a.py", 2, False), ("src/b.py", 3, True)]
    assert sorted((r.branch_id, r.branch_covered) for r in rows if r.branch_id) == [("0,0", True), ("0,1", False)]
    assert sorted(r.problem for r in rows if r.problem) == ["bad line", "outside a record", "unknown tag"]
    merged = {(r.path, r.line): r for r in assessment.merged_coverage(reports.lcov(spark.createDataFrame([(1, body), (2, body.replace("\nDA:2,0", "\nDA:2,5"))], "input_id int, text string")).where("problem is null")).collect()}
    assert merged["src/a.py", 2].covered and merged["src/a.py", 2].contradiction and merged["src/a.py", 2].branches == 2


def test_scan(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "vendor/b.js": b"x", "bad.rb": b"\xff\xfe", "skip.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.scan(spark, str(tmp_path), {"vendor": ["**/vendor/**"]}).collect()}
    assert {k: (r.language, r["class"], r.status) for k, r in rows.items()} == {"a.py": ("python", "source", "complete"), "b.js": ("javascript", "vendor", "complete"), "bad.rb": ("ruby", "source", "failed")}


def test_text_functions(spark):
    row = spark.range(1).select(
        text.normal_path(F.lit("a/./b//../c")).alias("p"),
        text.normal_path(F.lit("../x")).alias("out"),
        text.utf16_units(F.lit("a🙂")).alias("u"),
        text.line_checksum(F.lit("x")).alias("c"),
        text.length_prefixed_sha256(F.lit("v2"), F.lit("é")).alias("h"),
        text.tenth_percent(F.lit(1), F.lit(3)).alias("t"),
        text.tenth_percent(F.lit(1), F.lit(0)).alias("none"),
        F.size(text.lines_of(F.lit("a\r\nb\rc d"), F.lit("javascript"))).alias("js"),
        F.size(text.lines_of(F.lit("a\r\nb\rc"), F.lit("python"))).alias("py"),
    ).first()
    assert (row.p, row.out, row.u, row.t, row.none, row.js, row.py) == ("a/c", None, 3, 33.3, None, 4, 2)
    assert row.c == base64.b64encode(hashlib.md5(b"x").digest()).decode().rstrip("=")
    assert row.h == hashlib.sha256(b"".join(len(b).to_bytes(8, "big") + b for b in (b"v2", "é".encode()))).hexdigest()


def test_gate_states(spark):
    conditions = spark.createDataFrame([("overall", "lines", "lt", 10.0, "full"), ("overall", "issues", "eq", 0.0, "full"), ("overall", "line_coverage", "gte", 80.1, "one_decimal")], "scope string, metric string, op string, threshold double, precision string")
    measures = spark.createDataFrame([("overall", "lines", 10.0), ("overall", "line_coverage", 80.05)], "scope string, metric string, value double")
    results = assessment.gate_results(conditions, measures)
    assert {r.metric: r.status for r in results.collect()} == {"lines": "fail", "issues": "unavailable", "line_coverage": "pass"}
    assert assessment.exit_code(results, True) == 2 and assessment.exit_code(results.where("metric = 'lines'"), True) == 1


def test_gate_settings_and_catalog(spark, tmp_path):
    (tmp_path / "gate.json").write_text('{"schema_version": 1, "conditions": [{"scope": "overall", "metric": "issues", "operator": "lte", "threshold": 5, "precision": "full"}]}')
    assert [(r.condition_no, r.metric, r.threshold) for r in reports.gate_settings(spark, f"{tmp_path}/gate.json").collect()] == [(0, "issues", 5.0)]
    (tmp_path / "old.json").write_text('{"schema_version": 2, "conditions": []}')
    with pytest.raises(Exception, match="another version"):
        reports.gate_settings(spark, f"{tmp_path}/old.json").collect()
    (tmp_path / "bad.json").write_text('{"schema_version": "x", "conditions": 3}')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        reports.gate_settings(spark, f"{tmp_path}/bad.json").collect()
    (tmp_path / "rules.json").write_text('{"rules": [{"external_key": "S1", "language": "go", "sys_tags": ["bug"]}, {"external_key": "S2", "language": "go"}]}')
    assert [(r.external_key, r.sys_tags) for r in reports.catalog(spark, f"{tmp_path}/rules.json").collect()] == [("S1", ["bug"]), ("S2", None)]


def test_compiled_sources_and_incremental_runs(spark, tmp_path):
    (tmp_path / "a.cshtml").write_text("@page")
    (tmp_path / "b.cs").write_text("class B { }")
    assert {(r.language, r.status) for r in files.scan(spark, str(tmp_path)).collect()} == {("razor", "needs compiler"), ("csharp", "complete")}
    spark.createDataFrame([("b.cs", "class", "B", "B", 1, 6, 1, 7)], files.FACTS).write.parquet(f"{tmp_path}/facts")
    assert [r.name for r in files.compiler_facts(spark, f"{tmp_path}/facts").collect()] == ["B"]
    shape = "path string, rule_key string"
    fresh, cached = spark.createDataFrame([("a", "new")], shape), spark.createDataFrame([("a", "old"), ("b", "kept")], shape)
    assert sorted(map(tuple, files.merged_results(fresh, cached, fresh).collect())) == [("a", "new"), ("b", "kept")]


def test_large_files_fail_but_stay(spark):
    rows = [("a", bytearray(b"x\n" * 4)), ("b", bytearray(b"x" * 40)), ("c", bytearray(b"")), ("d", bytearray(b"\xff"))]
    found = files.bounded(spark.createDataFrame(rows, "path string, content binary"), max_bytes=20, max_lines=4).collect()
    assert {(r.path, r.status, r.text) for r in found} == {("a", "failed", None), ("b", "failed", None), ("c", "complete", ""), ("d", "failed", None)}


def test_token_clones_need_tokens_and_lines(spark):
    def tokens(path, symbols, per_line):
        return [("go", path, i, s, 1 + i // per_line, 1 + i // per_line) for i, s in enumerate(symbols)]

    common = [f"t{i}" for i in range(30)]
    rows = tokens("a", ["x", *common], 3) + tokens("b", [*common, "y"], 3) + tokens("c", [*common[:10], "z"], 3)
    table = spark.createDataFrame(rows, "language string, path string, ord int, symbol string, sl int, el int")
    found = clones.token_clones(table, min_tokens=20, min_lines=8).collect()
    assert {(r.path, r.first_ord, r.last_ord) for r in found} == {("a", 1, 30), ("b", 0, 29)}
    assert clones.token_clones(table, min_tokens=20, min_lines=12).count() == 0


def test_pruned_graph():
    graph, old = flow.pruned(flow.Graph(5, {(0, 3), (3, 0), (1, 2), (4, 0)}))
    assert (graph.n, graph.edges, old) == (2, {(0, 1), (1, 0)}, [0, 3])
