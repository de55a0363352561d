"""Finding identities, comparison with a baseline, coverage, quality gates, and bag differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import length_prefixed_sha256, line_checksum, tenth_percent

# ---------------------------------------------------------------- identities


def with_context(findings: DataFrame, files: DataFrame, context: int = 2) -> DataFrame:
    """The findings with ``source``, the lines of the range, and ``context``, some lines more on either side; ``files`` has path and the array ``lines``.

    Findings that were made from their file's lines carry both already and need no join.
    """
    f = findings.join(files.select("path", "lines"), "path")
    start = F.greatest(F.col("sl"), F.lit(1))
    stop = F.greatest(F.col("el"), start)
    low = F.greatest(start - context, F.lit(1))
    cut = lambda a, b: F.when(F.col("sl") == 0, "").otherwise(F.array_join(F.slice("lines", a, F.greatest(b - a + 1, F.lit(0))), "\n"))
    return f.withColumns({"source": cut(start, stop), "context": cut(low, stop + context)}).drop("lines")


def identities(findings: DataFrame) -> DataFrame:
    """The findings with source and context digest, occurrence, content identity (path-free), identity and ambiguity.

    The occurrence counts distinct ranges in order among findings of a file that share rule and
    digests. ``findings`` has ``source`` and ``context``.
    """
    f = findings.withColumns({"source_digest": F.sha2("source", 256), "context_digest": F.sha2("context", 256)}).drop("source", "context")
    alike = Window.partitionBy("path", "rule_key", "source_digest", "context_digest").orderBy("sl", "sc", "el", "ec")
    f = f.withColumn("occurrence", F.dense_rank().over(alike) - 1)
    f = f.withColumn("content_identity", length_prefixed_sha256(F.col("rule_key"), F.col("source_digest"), F.col("context_digest"), F.col("occurrence")))
    f = f.withColumn("identity", length_prefixed_sha256(F.col("path"), F.col("content_identity")))
    return f.withColumn("ambiguous", F.count("*").over(Window.partitionBy("identity")) > 1)


# ---------------------------------------------------------------- baseline


def paired_files(current: DataFrame, reference: DataFrame) -> DataFrame:
    """path, reference_path, pairing of two snapshots of (path, digest): by equal path, else by a digest that is unique on both sides.

    Files left over have a null reference; a digest shared by several leftovers is ``ambiguous``.
    """
    same = current.join(reference.select("path").distinct(), "path", "left_semi").select("path", F.col("path").alias("reference_path"), F.lit("path").alias("pairing"))
    left = current.join(reference.select("path"), "path", "left_anti").select("path", "digest")
    right = reference.join(current.select("path"), "path", "left_anti").select(F.col("path").alias("reference_path"), "digest")
    ones = left.groupBy("digest").agg(F.count("*").alias("n"))
    others = right.groupBy("digest").agg(F.count("*").alias("m"), F.min("reference_path").alias("reference_path"))
    moved = left.join(ones, "digest").join(others, "digest", "left")
    unique = (F.col("n") == 1) & (F.col("m") == 1)
    moved = moved.select("path", F.when(unique, F.col("reference_path")).alias("reference_path"), F.when(unique, "digest").when(F.col("m").isNotNull(), "ambiguous").otherwise("none").alias("pairing"))
    return same.unionByName(moved)


def compare_findings(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Each current finding with status new, existing or uncertain.

    No match in its file: new, or uncertain where the content is elsewhere in the reference. Just one
    unambiguous match: existing. Anything else is uncertain. Files must have their paired path.
    """
    local = reference.groupBy("path", "content_identity").agg(F.count("*").alias("matches"), F.bool_or("ambiguous").alias("unclear"))
    anywhere = reference.select("content_identity", F.lit(True).alias("elsewhere")).distinct()
    f = current.join(local, ["path", "content_identity"], "left").join(anywhere, "content_identity", "left")
    status = F.when(F.col("matches").isNull(), F.when(F.col("elsewhere"), "uncertain").otherwise("new")).when((F.col("matches") == 1) & ~F.col("unclear") & ~F.col("ambiguous"), "existing").otherwise("uncertain")
    return f.withColumn("status", status).drop("matches", "unclear", "elsewhere")


def resolved_findings(current: DataFrame, reference: DataFrame) -> DataFrame:
    return reference.join(current.select("content_identity"), "content_identity", "left_anti")


def new_lines(current: DataFrame, reference: DataFrame) -> DataFrame:
    """path, line, n: lines that a file has more often than its reference (a bag difference per path)."""
    c = current.groupBy("path", "line").agg(F.count("*").alias("n"))
    r = reference.groupBy("path", "line").agg(F.count("*").alias("m"))
    return c.join(r, ["path", "line"], "left").select("path", "line", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")


def bag_difference(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """keys, kind (missing or extra), n: what the right bag lacks and has besides the left one."""
    both = left.select(*keys, F.lit(1).alias("d")).unionByName(right.select(*keys, F.lit(-1).alias("d")))
    net = both.groupBy(*keys).agg(F.sum("d").alias("d")).where("d <> 0")
    return net.select(*keys, F.when(F.col("d") > 0, "missing").otherwise("extra").alias("kind"), F.abs("d").alias("n"))


# ---------------------------------------------------------------- coverage


def checked_coverage(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """The entries with the problems that the sources show: unknown file, line beyond its end, another checksum."""
    size = lines.groupBy("path").agg(F.max("line_no").alias("last"))
    own = lines.select("path", F.col("line_no").alias("line"), line_checksum(F.col("line")).alias("own"))
    e = entries.join(size, "path", "left").join(own, ["path", "line"], "left")
    problem = F.coalesce("problem", F.when(F.col("last").isNull(), "unknown file").when(F.col("line") > F.col("last"), "line out of range").when(F.col("checksum").isNotNull() & (F.col("checksum") != F.col("own")), "stale checksum"))
    return e.withColumn("problem", problem).drop("last", "own")


def merged_coverage(entries: DataFrame) -> DataFrame:
    """path, line, covered, branches, covered_branches, contradiction: runs are merged by OR per line and per branch.

    A line known by its branches only has a null ``covered``.
    """
    branch = entries.where("branch_id is not null").groupBy("path", "line", "branch_id").agg(F.bool_or("branch_covered").alias("hit"))
    branches = branch.groupBy("path", "line").agg(F.count("*").alias("branches"), F.count_if("hit").alias("covered_branches"))
    own = entries.groupBy("path", "line").agg(F.bool_or("covered").alias("covered"), F.coalesce(F.bool_or("covered") != F.bool_and("covered"), F.lit(False)).alias("contradiction"))
    out = own.join(branches, ["path", "line"], "left")
    return out.na.fill(0, ["branches", "covered_branches"]).select("path", "line", "covered", "branches", "covered_branches", "contradiction")


def coverage_counters(merged: DataFrame, *keys: str) -> DataFrame:
    """keys, eligible, covered, percent, branches, covered_branches, branch_percent (null without a denominator)."""
    out = merged.groupBy(*keys).agg(F.count("covered").alias("eligible"), F.count_if("covered").alias("covered"), F.sum("branches").alias("branches"), F.sum("covered_branches").alias("covered_branches"))
    return out.select(*keys, "eligible", "covered", tenth_percent(F.col("covered"), F.col("eligible")).alias("percent"), "branches", "covered_branches", tenth_percent(F.col("covered_branches"), F.col("branches")).alias("branch_percent"))


# ---------------------------------------------------------------- gates

#: Metrics and operators of conditions. Fixed values.
METRICS = ("files", "lines", "code_lines", "comment_lines", "issues", "duplicated_lines", "duplicated_blocks", "duplicated_files", "duplicated_lines_density", "line_coverage", "branch_coverage")
#: Not measured for new code.
OVERALL_ONLY = ("code_lines", "comment_lines")


def _holds(op: Column, value: Column, threshold: Column) -> Column:
    return F.when(op == "lt", value < threshold).when(op == "lte", value <= threshold).when(op == "eq", value == threshold).when(op == "gte", value >= threshold).when(op == "gt", value > threshold)


def gate_results(conditions: DataFrame, measures: DataFrame) -> DataFrame:
    """Each condition (scope, metric, op, threshold, precision) with its actual value and status pass, fail or unavailable.

    A missing measure never counts as zero; precision ``one_decimal`` compares percentages rounded
    half up to tenths. ``measures`` has scope, metric, value.
    """
    c = conditions.join(measures, ["scope", "metric"], "left")
    tenth = F.floor(F.col("value").cast("decimal(30,12)") * 10 + F.lit(0.5).cast("decimal(2,1)")).cast("double") / 10
    c = c.withColumn("actual", F.when(F.col("precision") == "one_decimal", tenth).otherwise(F.col("value")))
    supported = F.col("metric").isin(*METRICS) & ~((F.col("scope") == "new_code") & F.col("metric").isin(*OVERALL_ONLY))
    ok = _holds(F.col("op"), F.col("actual"), F.col("threshold"))
    return c.withColumn("status", F.when(~supported | ok.isNull(), "unavailable").when(ok, "pass").otherwise("fail")).drop("value")


def gate_status(results: DataFrame, *keys: str) -> DataFrame:
    """keys, status: unavailable dominates fail, which dominates pass."""
    rank = F.when(F.col("status") == "pass", 0).when(F.col("status") == "fail", 1).otherwise(2)
    return results.groupBy(*keys).agg(F.max(rank).alias("r")).select(*keys, F.element_at(F.array(F.lit("pass"), F.lit("fail"), F.lit("unavailable")), F.col("r") + 1).alias("status"))


def exit_code(results: DataFrame, complete: bool) -> int:
    """0 for pass, 1 for fail, 2 for incomplete or unavailable."""
    row = gate_status(results).first()
    status = row.status if row and row.status else "pass"
    return 2 if not complete or status == "unavailable" else int(status == "fail")


def lines_in_regions(changed: DataFrame, regions: DataFrame, span: int = 64) -> DataFrame:
    """Changed lines (path, line) inside a region (path, start, stop): regions are cut at multiples of ``span``, so
    that the range join is an equality on path and cut with a bounded rest."""
    cut = regions.select("path", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor(F.col("stop") / span))).alias("cut"))
    keyed = changed.withColumn("cut", F.floor(F.col("line") / span))
    on = (keyed.path == cut.path) & (keyed.cut == cut.cut) & keyed.line.between(cut.start, cut.stop)
    return keyed.join(cut, on, "left_semi").drop("cut")


def new_code_coverage(changed: DataFrame, merged: DataFrame) -> DataFrame:
    """path and coverage counters of the changed lines (path, line)."""
    return coverage_counters(merged.join(changed.select("path", "line").distinct(), ["path", "line"], "left_semi"), "path")


def coverage_status(entries: DataFrame) -> DataFrame:
    """One row: missing (no entry), invalid (none usable), incomplete (some with a problem), or complete."""
    n = entries.agg(F.count("*").alias("n"), F.count("problem").alias("bad"))
    return n.select(F.when(F.col("n") == 0, "missing").when(F.col("n") == F.col("bad"), "invalid").when(F.col("bad") > 0, "incomplete").otherwise("complete").alias("status"))


def assessment(findings: DataFrame, coverage: DataFrame, gate: DataFrame) -> DataFrame:
    """One row: findings by status, ambiguous ones, covered and eligible lines, the gate's status, and whether counts add up.

    ``findings`` has status and ambiguous, ``coverage`` counters, ``gate`` results of conditions.
    """
    f = findings.agg(F.count("*").alias("findings"), *(F.count_if(F.col("status") == s).alias(s) for s in ("new", "existing", "uncertain")), F.count_if("ambiguous").alias("ambiguous"))
    c = coverage.agg(F.coalesce(F.sum("eligible"), F.lit(0)).alias("eligible"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"))
    out = f.join(c).join(gate_status(gate).withColumnRenamed("status", "gate"))  # three tables of one row each
    return out.withColumn("consistent", (F.col("new") + F.col("existing") + F.col("uncertain") == F.col("findings")) & (F.col("covered") <= F.col("eligible")))
