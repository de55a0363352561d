"""Readers of coverage reports, rule catalogs, earlier reports and gate settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG = """rules array<struct<external_key string, language string, status string, severity string, rule_type string, scope string,
    impacts array<struct<software_quality string, severity string>>, parameters array<struct<key string, default_value string, parameter_type string>>,
    sys_tags array<string>, tags array<string>>>"""
GATE = "schema_version int, conditions array<struct<scope string, metric string, operator string, threshold double, precision string>>"
_KNOWN = "TN|SF|DA|BRDA|LF|LH|BRF|BRH|FN|FNDA|FNF|FNH|end_of_record"


def lcov(reports: DataFrame, key: str = "input_id", text: str = "text") -> DataFrame:
    """key, path, line, covered, checksum, branch_id, branch_covered, problem per DA or BRDA entry.

    The path is the last SF before; an entry outside a record, an unknown tag or a bad number is a problem row.
    """
    rows = reports.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n")).alias("at", "row")).where(F.trim("row") != "")
    tag, rest = F.regexp_extract("row", f"^({_KNOWN})(?::|$)", 1), F.regexp_extract("row", "^[A-Za-z_]+:(.*)$", 1)
    rows = rows.select(key, "at", tag.alias("tag"), rest.alias("rest"))
    order = Window.partitionBy(key).orderBy("at")
    rows = rows.withColumn("record", F.sum((F.col("tag") == "SF").cast("int") + (F.col("tag") == "end_of_record").cast("int")).over(order))
    within = Window.partitionBy(key, "record").orderBy("at")
    rows = rows.withColumn("path", F.first(F.when(F.col("tag") == "SF", F.col("rest"))).over(within))
    parts = F.split("rest", ",")
    line, hits = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("long")
    taken = F.try_element_at(parts, F.lit(4))
    problem = (
        F.when(F.col("tag") == "", "unknown tag")
        .when(F.col("tag").isin("DA", "BRDA") & F.col("path").isNull(), "outside a record")
        .when(F.col("tag").isin("DA", "BRDA") & (line.isNull() | (line < 1)), "bad line")
        .when((F.col("tag") == "DA") & (hits.isNull() | (hits < 0)), "bad count")
        .when((F.col("tag") == "BRDA") & ~taken.rlike("^([0-9]+|-)$"), "bad branch")
    )
    out = rows.withColumn("problem", problem).where(F.col("tag").isin("DA", "BRDA", "") | F.col("problem").isNotNull())
    da = F.col("tag") == "DA"
    return out.select(
        key,
        "path",
        line.alias("line"),
        F.when(da, hits > 0).alias("covered"),
        F.when(da, F.try_element_at(parts, F.lit(3))).alias("checksum"),
        F.when(F.col("tag") == "BRDA", F.concat_ws(",", F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3)))).alias("branch_id"),
        F.when(F.col("tag") == "BRDA", F.coalesce(taken.try_cast("long"), F.lit(0)) > 0).alias("branch_covered"),
        "problem",
    )


def opencover(reports: DataFrame, key: str = "input_id", text: str = "text") -> DataFrame:
    """The same columns as ``lcov`` from OpenCover XML: sequence points as lines, branch points as branches."""
    points = "SequencePoints: struct<SequencePoint: array<struct<_vc: long, _sl: int, _fileid: string>>>, BranchPoints: struct<BranchPoint: array<struct<_vc: long, _sl: int, _fileid: string, _path: string, _offset: string>>>"
    classes = f"Classes: struct<Class: array<struct<Methods: struct<Method: array<struct<{points}>>>>>>"
    shape = f"Modules struct<Module: array<struct<Files: struct<File: array<struct<_uid: string, _fullPath: string>>>, {classes}>>>"
    doc = reports.select(key, F.from_xml(text, shape).alias("x"))
    module = doc.select(key, F.posexplode("x.Modules.Module").alias("m", "mod"))
    files = module.select(key, "m", F.explode("mod.Files.File").alias("f")).select(key, "m", F.col("f._uid").alias("uid"), F.col("f._fullPath").alias("path"))
    method = module.select(key, "m", F.explode("mod.Classes.Class").alias("c")).select(key, "m", F.explode("c.Methods.Method").alias("d"))
    points = method.select(key, "m", F.explode("d.SequencePoints.SequencePoint").alias("p")).select(
        key, "m", F.col("p._fileid").alias("uid"), F.col("p._sl").alias("line"), (F.col("p._vc") > 0).alias("covered"), F.lit(None).cast("string").alias("branch_id"), F.lit(None).cast("boolean").alias("branch_covered")
    )
    branches = method.select(key, "m", F.explode("d.BranchPoints.BranchPoint").alias("p")).select(
        key, "m", F.col("p._fileid").alias("uid"), F.col("p._sl").alias("line"), F.lit(None).cast("boolean").alias("covered"), F.concat_ws(",", "p._offset", "p._path").alias("branch_id"), (F.col("p._vc") > 0).alias("branch_covered")
    )
    both = points.unionByName(branches).join(files, [key, "m", "uid"], "left")
    return both.select(key, "path", "line", "covered", F.lit(None).cast("string").alias("checksum"), "branch_id", "branch_covered", F.when(F.col("path").isNull(), "unknown file").alias("problem"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).option("multiLine", True).json(path).select(F.inline("rules"))


def gate_settings(spark: SparkSession, path: str) -> DataFrame:
    """Conditions of version 1 settings; malformed documents fail."""
    read = spark.read.schema(GATE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = read.withColumn("ok", F.assert_true(F.col("schema_version") == 1, F.lit("gate settings have another version")))
    return checked.where(F.col("ok").isNull()).select(F.posexplode("conditions").alias("condition_no", "c")).select("condition_no", "c.*")


NATIVE = """schema_version int, path string, language string, metrics struct<lines:long,code_lines:long,comment_lines:long>,
    issues array<struct<sl:int,sc:int,el:int,ec:int,rule_key:string,message:string>>"""


def native_findings(documents: DataFrame, column: str = "document") -> DataFrame:
    """path, rule_key, message, sl, sc, el, ec of earlier native reports, one JSON document a file; version 1 only."""
    d = documents.select(F.from_json(column, NATIVE, {"mode": "FAILFAST"}).alias("d")).select("d.*").where("schema_version = 1")
    return d.select("path", F.explode("issues").alias("i")).select("path", "i.rule_key", "i.message", "i.sl", "i.sc", "i.el", "i.ec")


def write_baseline(documents: DataFrame, path: str) -> None:
    """Writes native documents as a baseline, all or nothing; an existing one is an error."""
    documents.select("document").write.mode("errorifexists").text(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return native_findings(spark.read.text(path), "value")
