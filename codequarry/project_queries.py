"""Queries of clones, fixes, reviews, coverage and the history service, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import program_queries as programs
from . import queries as core
from .functions.text import line_checksum, rfc3339
from .operators import assessment, clones, history, lexical_rules, line_pairs, lines
from .plans import reports
from .registry import ORACLE_SQL, query, table, values
from .sources import files as sources
from .sources import reports as imports

# ---------------------------------------------------------------- clones of tokens

TOKENS = clones.MIN_TOKENS


def _words(spark, sf_dir: str) -> DataFrame:
    f = core._files(spark, sf_dir)
    return f.select("language", "path", F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n\r]+"), lambda w: w != "").alias("items"))


def _maximal(spark, sf_dir: str, k: int) -> DataFrame:
    """Maximal clones of the documents' words."""
    return clones.maximal_clones(_words(spark, sf_dir), k)


#: Every pair of equal windows, its runs along diagonals, and the ranges of one text: no window is left out for another.
_TOKEN_SQL = f"""{core._FILES_SQL}, i AS (SELECT language, path, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '') AS items FROM f),
    w AS (SELECT language, path, start::INT AS start, md5(array_to_string(items[start:start + {TOKENS - 1}], ' ')) AS digest FROM (SELECT *, unnest(range(1, len(items) - {TOKENS - 2})) AS start FROM i)),
    q AS (SELECT a.language, a.path, a.start, b.path AS other, b.start - a.start AS shift FROM w AS a JOIN w AS b USING (language, digest) WHERE (a.path, a.start) < (b.path, b.start)),
    r AS (SELECT *, start - row_number() OVER (PARTITION BY language, path, other, shift ORDER BY start) AS run FROM q),
    m AS (SELECT language, path, other, shift, min(start) AS start, max(start) + {TOKENS - 1} AS stop FROM r GROUP BY language, path, other, shift, run),
    o AS (SELECT language, path, start, stop FROM m UNION SELECT language, other, start + shift, stop + shift FROM m),
    members AS (SELECT o.language, o.path, o.start::INT AS start, o.stop::INT AS stop, (o.stop - o.start + 1)::INT AS length, md5(array_to_string(i.items[o.start:o.stop], ' ')) AS digest FROM o JOIN i USING (language, path)),
    matches AS MATERIALIZED (SELECT language, path, start, stop, length, digest, first_value(path) OVER g AS first_path, first_value(start) OVER g AS first_start FROM members WINDOW g AS (PARTITION BY language, length, digest ORDER BY path, start))"""


@query(f"WITH {_TOKEN_SQL} SELECT language, path, start, stop, first_path, first_start FROM matches")
def token_clones(spark, sf_dir):
    """Maximal ranges of 100 words and more that occur again, each with the first range of its group."""
    return clones.with_first(_maximal(spark, sf_dir, TOKENS))


@query(
    f"""WITH {_TOKEN_SQL}, ranges AS (SELECT DISTINCT language, path, start, stop FROM matches),
    covered AS (SELECT DISTINCT a.* FROM ranges AS a JOIN ranges AS b ON b.language = a.language AND b.path = a.path AND b.start <= a.start AND b.stop >= a.stop AND b.stop - b.start > a.stop - a.start),
    free AS (SELECT DISTINCT language, length, digest FROM matches ANTI JOIN covered USING (language, path, start, stop))
    SELECT language, first_path, first_start, length, count(*) AS members, count(DISTINCT path) AS files FROM matches SEMI JOIN free USING (language, length, digest) GROUP BY ALL"""
)
def token_clone_groups(spark, sf_dir):
    """Groups of equal maximal ranges of words that no longer ones suppress: first place, length, members, files."""
    m = clones.with_first(clones.unsuppressed(_maximal(spark, sf_dir, TOKENS)))
    return m.groupBy("language", "first_path", "first_start", (F.col("stop") - F.col("start") + 1).alias("length")).agg(F.count("*").alias("members"), F.count_distinct("path").alias("files"))


_RANGES_SQL = "r AS (SELECT DISTINCT l_orderkey AS path, (l_partkey % 90)::INT AS start, (l_partkey % 90 + l_quantity)::INT AS stop FROM lineitem)"


def _ranges(spark, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem")
    return f.select(F.col("l_orderkey").alias("path"), (F.col("l_partkey") % 90).cast("int").alias("start"), (F.col("l_partkey") % 90 + F.col("l_quantity")).cast("int").alias("stop"))


@query(f"WITH {_RANGES_SQL} SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r AS o WHERE o.path = r.path AND o.start <= r.start AND o.stop >= r.stop AND (o.start, o.stop) <> (r.start, r.stop))")
def uncontained_ranges(spark, sf_dir):
    """Ranges that no other one of their file contains."""
    return clones.uncontained(_ranges(spark, sf_dir))


@query(
    """SELECT user_id AS path, event_id AS ord, event_type AS symbol FROM (SELECT *, lag(event_type) OVER w AS p, lead(event_type) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    WHERE p IS DISTINCT FROM event_type OR n IS DISTINCT FROM event_type"""
)
def collapsed_runs(spark, sf_dir):
    """Runs of equal events keep their ends."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("ord"), F.col("event_type").alias("symbol"))
    return clones.collapsed(e)


# ---------------------------------------------------------------- coverage and gates


@query(f"WITH {core._COVERAGE_SQL}, k AS (SELECT m.* FROM m WHERE EXISTS (SELECT 1 FROM events WHERE event_id % 3 = 0 AND 'src/' || user_id = m.path AND minute(ts) + 1 = m.line)), c AS (SELECT path, count(covered) AS eligible, count(*) FILTER (covered) AS covered, sum(branches)::BIGINT AS branches, sum(covered_branches)::BIGINT AS covered_branches FROM k GROUP BY path) SELECT path, eligible, covered, {core._PERCENT.format('covered', 'eligible')} AS percent, branches, covered_branches, {core._PERCENT.format('covered_branches', 'branches')} AS branch_percent FROM c")
def new_code_coverage(spark, sf_dir):
    """Coverage of the changed lines, here those of every third event."""
    changed = table(spark, sf_dir, "events").where("event_id % 3 = 0").select(F.concat(F.lit("src/"), F.col("user_id").cast("string")).alias("path"), (F.minute("ts") + 1).alias("line"))
    return assessment.new_code_coverage(changed, assessment.merged_coverage(core._coverage(spark, sf_dir)))


@query("""WITH c AS (SELECT o_custkey % 200 AS path, o_orderkey % 5000 AS line FROM orders), r AS (SELECT l_partkey % 200 AS path, l_suppkey * 40 AS start, l_suppkey * 40 + l_quantity AS stop FROM lineitem)
    SELECT path, line FROM c WHERE EXISTS (SELECT 1 FROM r WHERE r.path = c.path AND c.line BETWEEN start AND stop)""")
def duplicated_new_lines(spark, sf_dir):
    """Changed lines inside of clone regions."""
    c = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("path"), (F.col("o_orderkey") % 5000).alias("line"))
    r = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("path"), (F.col("l_suppkey") * 40).alias("start"), (F.col("l_suppkey") * 40 + F.col("l_quantity").cast("long")).alias("stop"))
    return assessment.lines_in_regions(c, r).select("path", "line")


@query(
    f"""WITH {core._LINES_SQL}, e AS (SELECT CASE WHEN line_no % 7 = 0 THEN 'gone' ELSE path END AS path, CASE WHEN line_no % 5 = 0 THEN line_no + 100000 ELSE line_no END AS line, rtrim(to_base64(unhex(md5(CASE WHEN line_no % 3 = 0 THEN 'x' ELSE line END))), '=') AS checksum FROM l),
    s AS (SELECT path, max(line_no) AS last FROM l GROUP BY path)
    SELECT coalesce(CASE WHEN last IS NULL THEN 'unknown file' WHEN e.line > last THEN 'line out of range' WHEN checksum <> rtrim(to_base64(unhex(md5(l.line))), '=') THEN 'stale checksum' END, 'none') AS problem, count(*) AS n
    FROM e LEFT JOIN s USING (path) LEFT JOIN l ON l.path = e.path AND l.line_no = e.line GROUP BY 1"""
)
def checked_coverage(spark, sf_dir):
    """Coverage entries against the sources: unknown files, lines beyond the end, other checksums."""
    t = lines.line_table(core._files(spark, sf_dir))
    no = F.col("line_no")
    e = t.select(F.when(no % 7 == 0, "gone").otherwise(F.col("path")).alias("path"), F.when(no % 5 == 0, no + 100000).otherwise(no).alias("line"), line_checksum(F.when(no % 3 == 0, "x").otherwise(F.col("line"))).alias("checksum"), F.lit(None).cast("string").alias("problem"))
    return assessment.checked_coverage(e, t).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query(
    f"""WITH v AS (SELECT user_id, (minute(ts) + 1)::INT AS line, event_type, value > 50 AS hit, second(ts) AS branch FROM events WHERE event_type IN ('view', 'click')),
    h AS (SELECT user_id, line, count(*) AS branches, count(*) FILTER (hit) AS covered_branches FROM (SELECT user_id, line, branch, bool_or(hit) AS hit FROM v WHERE event_type = 'click' GROUP BY ALL) GROUP BY ALL)
    SELECT 'src/' || user_id || '.cs' AS path, line, bool_or(hit) FILTER (event_type = 'view') AS covered, coalesce(min(branches), 0) AS branches, coalesce(min(covered_branches), 0) AS covered_branches,
        coalesce(bool_or(hit) FILTER (event_type = 'view') <> bool_and(hit) FILTER (event_type = 'view'), false) AS contradiction FROM v LEFT JOIN h USING (user_id, line) GROUP BY user_id, line"""
)
def opencover_import(spark, sf_dir):
    """Coverage reports in XML, parsed and merged: views are sequence points, clicks branch points."""
    v = table(spark, sf_dir, "events").where("event_type in ('view', 'click')").select("user_id", "event_id", "event_type", (F.minute("ts") + 1).alias("line"), F.when(F.col("value") > 50, "2").otherwise("0").alias("vc"), F.second("ts").alias("branch"))
    view, click = F.col("event_type") == "view", F.col("event_type") == "click"
    point = F.when(view, F.format_string('<SequencePoint vc="%s" sl="%d" fileid="1"/>', "vc", "line")).otherwise(F.format_string('<BranchPoint vc="%s" sl="%d" fileid="1" path="%d" offset="0"/>', "vc", "line", "branch"))
    gather = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("event_id", point.alias("point"))))), lambda x: x["point"]), "")
    per_user = v.groupBy("user_id").agg(gather(view).alias("s"), gather(click).alias("b"))
    xml = F.concat(
        F.lit('<CoverageSession><Modules><Module><Files><File uid="1" fullPath="src/'), F.col("user_id").cast("string"), F.lit('.cs"/></Files><Classes><Class><Methods><Method><SequencePoints>'), "s",
        F.lit("</SequencePoints><BranchPoints>"), "b", F.lit("</BranchPoints></Method></Methods></Class></Classes></Module></Modules></CoverageSession>"),
    )
    return assessment.merged_coverage(imports.opencover(per_user.select(F.col("user_id").alias("input_id"), xml.alias("text"))).where("problem is null"))


_GATE = ORACLE_SQL["quality_gate"]


@query(f"SELECT scope, CASE max(CASE status WHEN 'pass' THEN 0 WHEN 'fail' THEN 1 ELSE 2 END) WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'unavailable' END AS status FROM ({_GATE}) GROUP BY scope")
def gate_status(spark, sf_dir):
    """The gate's status in each scope: unavailable dominates fail, which dominates pass."""
    return assessment.gate_status(core.quality_gate(spark, sf_dir), "scope")


@query(
    f"""SELECT f.*, e.*, gate, new + existing + uncertain = findings AND covered <= eligible AS consistent FROM
    (SELECT coalesce(sum(findings) FILTER (status <> 'resolved'), 0)::BIGINT AS findings, coalesce(sum(findings) FILTER (status = 'new'), 0)::BIGINT AS new, coalesce(sum(findings) FILTER (status = 'existing'), 0)::BIGINT AS existing, coalesce(sum(findings) FILTER (status = 'uncertain'), 0)::BIGINT AS uncertain FROM ({ORACLE_SQL["baseline_findings"]})) f,
    (WITH {core._COVERAGE_SQL} SELECT count(covered) AS eligible, count(*) FILTER (covered) AS covered FROM m) e,
    (SELECT CASE max(CASE status WHEN 'pass' THEN 0 WHEN 'fail' THEN 1 ELSE 2 END) WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'unavailable' END AS gate FROM ({_GATE})) g"""
)
def project_assessment(spark, sf_dir):
    """Findings against the baseline, coverage and the gate in one row that checks itself."""
    found = core.compared_findings(spark, sf_dir)
    counters = assessment.coverage_counters(assessment.merged_coverage(core._coverage(spark, sf_dir)), "path")
    return assessment.assessment(found, counters, core.quality_gate(spark, sf_dir)).drop("ambiguous")


# ---------------------------------------------------------------- baseline


@query(f"WITH {core._FINDINGS_SQL} SELECT path, rule_key, 'rule ' || rule_key AS message, sl, sc, el, ec FROM x")
def baseline_reading(spark, sf_dir):
    """Native reports read back as findings."""
    return imports.native_findings(core.native_report(spark, sf_dir))


@query()
def fuzzy_pairs(spark, sf_dir):
    """All files under other names and without their first line, paired by common lines (no SQL: longest common subsequences)."""
    f = core._files(spark, sf_dir).select("path", F.coalesce("text", F.lit("")).alias("text"))
    cut = f.select(F.concat(F.lit("new/"), "path").alias("path"), F.regexp_replace("text", "^[^\n]*\n", "").alias("text"))
    shape = lambda d: d.select("path", F.md5("text").alias("digest"), F.split("text", "\n", -1).alias("lines"))
    return line_pairs.fuzzy_pairs(line_pairs.fuzzy_candidates(shape(cut), shape(f)))


@query(
    """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderpriority AS p FROM orders), old AS (SELECT 'old/' || c AS reference_path, k FROM o),
    new AS (SELECT 'new/' || c AS path, k FROM o WHERE p <> '1-URGENT' UNION SELECT 'new/' || (c + 1), k FROM o WHERE k % 3 = 0),
    ta AS (SELECT path, string_agg(k, ',' ORDER BY k) AS t FROM new GROUP BY path), tb AS (SELECT reference_path, string_agg(k, ',' ORDER BY k) AS t FROM old GROUP BY reference_path),
    a AS (SELECT path FROM ta ANTI JOIN tb USING (t)), b AS (SELECT reference_path FROM tb ANTI JOIN ta USING (t)),
    s AS (SELECT path, reference_path, count(*) AS score FROM new JOIN old USING (k) JOIN a USING (path) JOIN b USING (reference_path) GROUP BY ALL),
    m AS (SELECT *, max(score) OVER (PARTITION BY path) AS best, max(score) OVER (PARTITION BY reference_path) AS top FROM s),
    n AS (SELECT *, count(*) FILTER (score = best) OVER (PARTITION BY path) AS ties, count(*) FILTER (score = top) OVER (PARTITION BY reference_path) AS rivals FROM m),
    k AS (SELECT path, min(reference_path) AS reference_path, bool_or(ties > 1 OR rivals > 1) AS tied FROM n WHERE score = best GROUP BY path),
    f AS (SELECT reference_path, min(path) AS first FROM k WHERE NOT tied GROUP BY reference_path)
    SELECT a.path, CASE WHEN NOT tied AND first = a.path THEN k.reference_path END AS reference_path, CASE WHEN NOT tied AND first = a.path THEN 'fuzzy' ELSE 'ambiguous' END AS pairing
    FROM a LEFT JOIN k USING (path) LEFT JOIN f ON f.reference_path = k.reference_path"""
)
def renamed_files(spark, sf_dir):
    """Customers' files of order numbers, of which some went and some came from a neighbour: which file became which, of those that aren't as they were. All have a last line in common."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))

    def shape(rows: DataFrame) -> DataFrame:
        keys = F.transform(F.array_sort(F.collect_set("k")), lambda k: k.cast("string"))
        files = rows.groupBy("path").agg(F.concat(keys, F.array(F.lit("}"))).alias("lines"))
        return files.select("path", F.md5(F.array_join("lines", "\n")).alias("digest"), "lines")

    named = lambda d, folder, c: d.select(F.concat(F.lit(folder), c.cast("string")).alias("path"), "k")
    new = named(o.where("p <> '1-URGENT'"), "new/", F.col("c")).union(named(o.where("k % 3 = 0"), "new/", F.col("c") + 1))
    before, after = shape(named(o, "old/", F.col("c"))), shape(new)
    left = lambda d, other: d.join(other.select("digest"), "digest", "left_anti")
    return line_pairs.fuzzy_pairs(line_pairs.fuzzy_candidates(left(after, before), left(before, after)))


@query(
    """WITH o AS (SELECT (o_custkey % 100)::VARCHAR AS path, o_orderkey AS k, o_orderstatus = 'F' AS fresh, o_orderstatus <> 'F' AND o_orderpriority = '5-LOW' AS twice FROM orders),
    l AS (SELECT path, fresh, twice, row_number() OVER (PARTITION BY path ORDER BY k, copy)::INT AS n FROM (SELECT *, unnest(CASE WHEN twice THEN [1, 2] ELSE [1] END) AS copy FROM o))
    SELECT path, coalesce(string_agg(n, ',' ORDER BY n) FILTER (fresh OR twice), '') AS new_lines, CASE WHEN bool_or(twice) THEN 'uncertain' ELSE 'complete' END AS status FROM l GROUP BY path"""
)
def aligned_lines(spark, sf_dir):
    """New lines of files of orders against an earlier snapshot: some orders are new, some lines stand twice where one stood."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).cast("string").alias("path"), F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("fresh"), ((F.col("o_orderstatus") != "F") & (F.col("o_orderpriority") == "5-LOW")).alias("twice"))
    now = o.groupBy("path").agg(F.array_sort(F.collect_list("k")).alias("once"), F.array_sort(F.collect_list(F.when(F.col("twice"), F.col("k")))).alias("again"), F.array_sort(F.collect_list(F.when(~F.col("fresh"), F.col("k")))).alias("old"))
    lines_of = lambda k: F.transform(k, lambda x: F.concat(F.lit("order "), x.cast("string")))
    out = line_pairs.aligned_lines(now.select("path", lines_of(F.array_sort(F.concat("once", "again"))).alias("lines"), lines_of(F.col("old")).alias("reference_lines")))
    return out.withColumn("new_lines", F.array_join(F.col("new_lines").cast("array<string>"), ","))


# ---------------------------------------------------------------- findings, rules, fixes


@query("SELECT language, path, rule_key FROM (SELECT DISTINCT l_linestatus AS language, l_suppkey AS path, l_partkey % 40 AS rule_key FROM lineitem WHERE l_linestatus <> 'F') UNION ALL SELECT l_linestatus, l_suppkey, l_partkey % 40 FROM lineitem WHERE l_linestatus = 'F'")
def deduplicated_findings(spark, sf_dir):
    """Equal findings once, but for an exempt language."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("language"), F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 40).alias("rule_key"))
    return lines.deduplicated(f, exempt=("F",))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7')")
def isolated_profile(spark, sf_dir):
    """Findings of rules of another registry."""
    registry = table(spark, sf_dir, "part").where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("rule_key"))
    return history.registered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("rule_key")), registry).withColumnRenamed("rule_key", "l_partkey")


@query("SELECT p_partkey AS id, p_name AS name, p_type AS severity, p_brand AS type FROM part WHERE p_partkey IN (SELECT l_partkey * 2 FROM lineitem)")
def generic_rules(spark, sf_dir):
    """The rules block of the generic issue import."""
    catalog = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_key"), F.col("p_name").alias("name"), F.col("p_type").alias("severity"), F.col("p_brand").alias("type"))
    return reports.generic_rules(table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("rule_key")), catalog)


@query(
    """WITH c AS (SELECT p_partkey % 5 AS language, p_partkey AS rule_key FROM part), l AS (SELECT l_partkey + 1000 * (l_suppkey % 3) AS k, l_returnflag = 'R' AS returned FROM lineitem),
    i AS (SELECT DISTINCT k % 5 AS language, k AS rule_key FROM l), t AS (SELECT DISTINCT k AS rule_key FROM l WHERE returned), j AS (SELECT coalesce(c.language, i.language) AS language, c.rule_key AS c, i.rule_key AS i, t.rule_key AS t FROM c FULL JOIN i USING (language, rule_key) LEFT JOIN t ON t.rule_key = coalesce(c.rule_key, i.rule_key))
    SELECT language, count(c) AS keys, count(*) FILTER (c IS NOT NULL AND i IS NOT NULL) AS implemented, count(*) FILTER (c IS NOT NULL AND i IS NOT NULL AND t IS NOT NULL) AS tested, count(*) FILTER (c IS NOT NULL AND i IS NULL) AS missing, count(*) FILTER (c IS NULL) AS unknown FROM j GROUP BY language"""
)
def coverage_audit(spark, sf_dir):
    """Catalog keys against implemented and tested ones."""
    key = lambda c: [(c % 5).alias("language"), c.alias("rule_key")]
    f = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 1000 * (F.col("l_suppkey") % 3)).alias("k"), (F.col("l_returnflag") == "R").alias("returned"))
    return history.coverage_audit(table(spark, sf_dir, "part").select(*key(F.col("p_partkey"))), f.select(*key(F.col("k"))), f.where("returned").select(*key(F.col("k"))))


@query(
    """WITH RECURSIVE x AS (SELECT o_custkey AS path, (o_orderkey % 50)::INT AS start, (o_orderkey % 50 + o_orderkey % 4)::INT AS stop, o_orderstatus AS replacement, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 50, o_orderkey % 4, o_orderstatus) AS i FROM orders),
    g(path, i, last_start, last_stop, kept, grown) AS (SELECT DISTINCT path, 0::BIGINT, -1, -1, 0, 0 FROM x
        UNION ALL SELECT g.path, x.i, CASE WHEN take THEN x.start ELSE last_start END, CASE WHEN take THEN x.stop ELSE last_stop END, kept + take::INT, grown + CASE WHEN take THEN 1 - (x.stop - x.start) ELSE 0 END
        FROM g JOIN (SELECT * FROM x) x ON x.path = g.path AND x.i = g.i + 1, LATERAL (SELECT last_start < 0 OR x.start >= last_stop AND x.start <> last_start AS take) t)
    SELECT path, kept::INT AS edits, i - kept AS conflicts, (60 + grown)::INT AS size FROM g QUALIFY row_number() OVER (PARTITION BY path ORDER BY i DESC) = 1"""
)
def fix_edits(spark, sf_dir):
    """Edits of each file without conflicts, applied: how many, how many conflict, and the size after."""
    o = table(spark, sf_dir, "orders")
    start = (F.col("o_orderkey") % 50).cast("int")
    fixes = o.select(F.col("o_custkey").cast("string").alias("path"), start.alias("start"), (start + F.col("o_orderkey") % 4).cast("int").alias("stop"), F.col("o_orderstatus").alias("replacement"))
    chosen = reports.chosen_edits(fixes)
    done = reports.applied(o.select(F.col("o_custkey").cast("string").alias("path"), F.lit("0123456789" * 6).alias("text")).distinct(), chosen)
    return chosen.join(done, "path").select(F.col("path").cast("long").alias("path"), F.size("edits").alias("edits"), "conflicts", F.length("fixed").alias("size"))


@query(
    """WITH b AS (SELECT l_partkey % 100 AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY k), a AS (SELECT l_partkey % 100 AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY k), t AS (SELECT l_partkey % 100 AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY k)
    SELECT coalesce(b.k, a.k) AS rule_key, greatest(least(coalesce(b.n, 0) - coalesce(a.n, 0), coalesce(t.n, 0)), 0) AS resolved, coalesce(a.n, 0) > coalesce(b.n, 0) AS regressed FROM b FULL JOIN a ON a.k = b.k LEFT JOIN t ON t.k = coalesce(b.k, a.k)"""
)
def fix_outcomes(spark, sf_dir):
    """Per rule what a fix run resolved, and whether it made things worse."""
    f = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("rule_key"), "l_returnflag")
    of = lambda flag: f.where(F.col("l_returnflag") == flag)
    return reports.fix_outcome(of("A"), of("N"), of("R"))


@query("SELECT l_orderkey, l_linenumber, 'S' || l_partkey AS rule_key FROM lineitem WHERE starts_with('S' || l_partkey, 'S12') OR starts_with('S' || l_partkey, 'S77')")
def selected_fixes(spark, sf_dir):
    """Fixes of rules by key or prefix."""
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("S"), F.col("l_partkey").cast("string")).alias("rule_key"))
    return reports.selected_fixes(f, ["S12", "S77"])


@query(
    """WITH p AS (SELECT p_partkey::VARCHAR AS path, p_partkey % 6 AS n, p_name AS a, p_type AS b FROM part),
    l AS (SELECT path, list_transform(range(1, n + 1), lambda i: 'line ' || i) AS head, a, b, ['one', 'two', 'three', 'four', 'five'] AS tail, n FROM p)
    SELECT path, '--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -' || (n - least(n, 3) + 1) || ',' || (least(n, 3) + 4) || ' +' || (n - least(n, 3) + 1) || ',' || (least(n, 3) + 5) || ' @@' || chr(10)
        || coalesce(array_to_string(list_transform(head[n - least(n, 3) + 1:], lambda x: ' ' || x), chr(10)) || CASE WHEN n > 0 THEN chr(10) ELSE '' END, '') || '-' || a || chr(10) || '+' || b || chr(10) || '+more' || chr(10) || ' one' || chr(10) || ' two' || chr(10) || ' three' AS diff FROM l"""
)
def fix_diffs(spark, sf_dir):
    """Unified diffs of files in which one line became two."""
    p = table(spark, sf_dir, "part")
    n = (F.col("p_partkey") % 6).cast("int")
    head = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("line "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    tail = F.array(*map(F.lit, ("one", "two", "three", "four", "five")))
    text = lambda *mid: F.array_join(F.concat(head, F.array(*mid), tail), "\n")
    return reports.unified_diff(p.select(F.col("p_partkey").cast("string").alias("path"), text(F.col("p_name")).alias("before"), text(F.col("p_type"), F.lit("more")).alias("after")))


# ---------------------------------------------------------------- reviews, history, hierarchies, dates, files

STATES = ("open", "accepted", "safe", "fixed", "nonsense")
_STATE_SQL = "(list_value(" + ", ".join(f"'{s}'" for s in STATES) + "))"


@query(
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN NOT (CASE WHEN kind = 'hotspot' THEN new_state IN ('to_review', 'acknowledged', 'safe', 'fixed') ELSE new_state IN ('open', 'confirmed', 'false_positive', 'accepted', 'fixed') END) THEN 'invalid'
        WHEN coalesce(version, 0) <> expected THEN 'stale' ELSE 'accepted' END AS outcome
    FROM (SELECT l_orderkey, l_linenumber, l_orderkey AS identity, CASE WHEN l_returnflag = 'R' THEN 'hotspot' ELSE 'finding' END AS kind, l_suppkey % 3 AS expected, {_STATE_SQL}[l_partkey % {len(STATES)} + 1] AS new_state FROM lineitem) q
    LEFT JOIN (SELECT o_orderkey AS identity, CASE WHEN o_orderstatus = 'P' THEN 'hotspot' ELSE 'finding' END AS kind, o_custkey % 3 AS version FROM orders) r USING (identity, kind)"""
)
def review_outcomes(spark, sf_dir):
    """Requested reviews: accepted, stale, or no such state for the kind."""
    o = table(spark, sf_dir, "orders")
    known = o.select(F.col("o_orderkey").alias("identity"), F.when(F.col("o_orderstatus") == "P", "hotspot").otherwise("finding").alias("kind"), F.lit("open").alias("state"), (F.col("o_custkey") % 3).alias("version"))
    f = table(spark, sf_dir, "lineitem")
    wanted = F.element_at(F.array(*map(F.lit, STATES)), (F.col("l_partkey") % len(STATES)).cast("int") + 1)
    asked = f.select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("identity"), F.when(F.col("l_returnflag") == "R", "hotspot").otherwise("finding").alias("kind"), (F.col("l_suppkey") % 3).alias("expected_version"), wanted.alias("new_state"))
    return history.reviewed(known, asked).select("l_orderkey", "l_linenumber", "outcome")


@query(
    f"""WITH {core._ANALYSES_SQL}, o AS (SELECT id AS old_id, project, branch, content_hash, analyzed_epoch AS old_epoch, (id % 4)::VARCHAR AS identity, 's' || id AS state FROM a WHERE id % 3 = 0)
    SELECT id AS analysis_id, identity, arg_max(state, (old_epoch, old_id)) AS state FROM (SELECT *, (id % 4)::VARCHAR AS identity FROM a WHERE id % 10 <> 0) n JOIN o USING (project, branch, content_hash, identity) WHERE old_epoch < analyzed_epoch GROUP BY ALL"""
)
def inherited_reviews(spark, sf_dir):
    """Reviews that carry over from earlier analyses of the branch."""
    a = core._analyses(spark, sf_dir).withColumnRenamed("content_hash", "context")
    identity = (F.col("id") % 4).cast("string").alias("identity")
    reviews = a.where("id % 3 = 0").select(F.col("id").alias("analysis_id"), identity, F.lit("finding").alias("kind"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("state"))
    found = a.select(F.col("id").alias("analysis_id"), identity, F.lit("finding").alias("kind"), (F.col("id") % 10 == 0).alias("ambiguous"))
    return history.inherited_reviews(a, reviews, found).select("analysis_id", "identity", "state")


def _service(spark, sf_dir: str):
    projects = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("project"))
    return projects, {"analyses": core._analyses(spark, sf_dir).select("project", "id", "branch")}


@query("SELECT o_custkey AS project, o_orderkey AS id, o_orderpriority AS branch FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 5")
def service_backup(spark, sf_dir):
    """The analyses of some projects."""
    return history.backup(*_service(spark, sf_dir))["analyses"]


@query(
    """SELECT 'analyses' AS "table", 'unknown project' AS problem, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) HAVING count(*) > 0
    UNION ALL SELECT 'analyses', 'repeated key', count(*) FROM (SELECT o_custkey, o_orderpriority FROM orders GROUP BY ALL HAVING count(*) > 1) HAVING count(*) > 0"""
)
def restore_problems(spark, sf_dir):
    """What keeps a backup from being restored."""
    projects, tables = _service(spark, sf_dir)
    return history.restore_problems({"projects": projects, **tables}, {"analyses": ("project", "branch")})


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0 UNION SELECT 0, max(p_partkey) FROM part WHERE p_partkey < 30),
    w(child, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION SELECT w.child, e.parent, w.depth + 1 FROM w JOIN e ON e.child = w.ancestor WHERE w.depth < 40)
    SELECT child, ancestor, min(depth)::INT AS depth FROM w GROUP BY ALL"""
)
def type_ancestors(spark, sf_dir):
    """All ancestors in a hierarchy with a cycle, and how far they are."""
    p = table(spark, sf_dir, "part")
    e = p.where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    back = p.where("p_partkey < 30").agg(F.max("p_partkey").alias("parent")).select(F.lit(0).cast("long").alias("child"), "parent")
    return history.ancestors(e.unionByName(back))


@query(
    """WITH RECURSIVE f AS (SELECT l_orderkey AS path, 'S' || (l_suppkey % 4) AS rule_key, (l_partkey % 60)::INT AS a, (l_quantity % 6)::INT AS w, 1 + (l_partkey % 3)::INT AS n FROM lineitem),
    g AS (SELECT path, rule_key, [{'a': a + 15 * i, 'b': a + 15 * i + w} FOR i IN range(n)] AS edits FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY edits[1].a, rule_key, edits) AS i FROM g),
    s(path, i, kept, fixes) AS (SELECT DISTINCT path, 0::BIGINT, []::STRUCT(a BIGINT, b BIGINT)[], 0 FROM r
        UNION ALL SELECT s.path, r.i, CASE WHEN clash THEN kept ELSE list_concat(kept, edits) END, fixes + (NOT clash)::INT FROM s JOIN r ON r.path = s.path AND r.i = s.i + 1,
            LATERAL (SELECT len([1 FOR k IN kept IF len([1 FOR e IN edits IF k.a = e.a OR k.a < e.b AND e.a < k.b]) > 0]) > 0 AS clash)),
    l AS (SELECT path, kept, fixes, i - fixes AS conflicts FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY i DESC) = 1)
    SELECT path::VARCHAR AS path, fixes::BIGINT AS fixes, conflicts::BIGINT AS conflicts, array_to_string([k.a || '-' || k.b FOR k IN list_sort(kept)], ',') AS edits FROM l"""
)
def atomic_fixes(spark, sf_dir):
    """Which fixes of one to three edits are taken where they overlap: by the first edit, then by rule, whole or not at all."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.concat(F.lit("S"), (F.col("l_suppkey") % 4).cast("string")).alias("rule_key"), (F.col("l_partkey") % 60).alias("a"), (F.col("l_quantity") % 6).cast("int").alias("w"), (F.col("l_partkey") % 3).cast("int").alias("n"))
    edit = lambda i: F.struct((F.col("a") + 15 * i).cast("int").alias("start"), (F.col("a") + 15 * i + F.col("w")).cast("int").alias("stop"), F.lit("x").alias("replacement"))
    chosen = reports.chosen_fixes(f.select("path", "rule_key", F.transform(F.sequence(F.lit(0), F.col("n")), edit).alias("edits")))
    return chosen.select("path", "fixes", "conflicts", F.array_join(F.transform("edits", lambda e: F.concat(e.start.cast("string"), F.lit("-"), e.stop.cast("string"))), ",").alias("edits"))


ZONES = ("Z", "+02:00", "-05:30", "z", "+2:00")


@query(
    f"""WITH t AS (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - (list_value(0, 7200, -19800, 0, 0))[event_id % {len(ZONES)} + 1] AS e FROM events WHERE event_id % {len(ZONES)} <> 4)
    SELECT event_id, strftime(make_timestamp(e * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS text, e AS epoch FROM t"""
)
def normal_dates(spark, sf_dir):
    """Dates with offsets in UTC; malformed ones are left out."""
    zone = F.element_at(F.array(*map(F.lit, ZONES)), (F.col("event_id") % len(ZONES)).cast("int") + 1)
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, ".123456").otherwise(""), zone)
    return table(spark, sf_dir, "events").select("event_id", rfc3339(text).alias("d")).where("d is not null").select("event_id", "d.text", "d.epoch")


PATHS = (("a/x.py", "python"), ("b.TSX", "typescript"), ("c/d.mjs", "javascript"), ("e.go", "go"), ("f.tar.gz", None), ("Makefile", None), ("g.rb", "ruby"), ("h.cs", "csharp"), ("i.htm", "html"), ("j.rs", "rust"), ("k.java", "java"))


@query(f"WITH {values('paths', 'i, path, language', [(i, *p) for i, p in enumerate(PATHS)])} SELECT event_id, language FROM events JOIN paths ON i = event_id % {len(PATHS)}")
def languages(spark, sf_dir):
    """Languages by extension."""
    path = F.element_at(F.array(*(F.lit(p) for p, _ in PATHS)), (F.col("event_id") % len(PATHS)).cast("int") + 1)
    return table(spark, sf_dir, "events").select("event_id", sources.language(path).alias("language"))


@query("SELECT concat_ws('/', source, doc_id::VARCHAR) AS path, CASE source WHEN 'src1' THEN 'src1/tsconfig.json' WHEN 'src2' THEN 'tsconfig.json' ELSE 'tsconfig.json' END AS config FROM documents")
def nearest_configs(spark, sf_dir):
    """The configuration in the nearest folder above each file."""
    configs = spark.createDataFrame([("tsconfig.json",), ("src1/tsconfig.json",), ("src1/deep/tsconfig.json",)], "path string")
    return sources.nearest_config(core._files(spark, sf_dir).select("path"), configs).select("path", "config")


IGNORES = (("", "# all\nsrc3/\n*7\n!src1/*7\n\nsrc0/?\n"), ("src2", "1*\n!12*\n/5?\n"))


@query(
    """SELECT path FROM (SELECT concat_ws('/', source, doc_id::VARCHAR) AS path, source, doc_id::VARCHAR AS id FROM documents) WHERE NOT CASE
        WHEN source = 'src2' AND regexp_matches(id, '^5.$') THEN true WHEN source = 'src2' AND starts_with(id, '12') THEN false WHEN source = 'src2' AND starts_with(id, '1') THEN true
        WHEN source = 'src0' AND length(id) = 1 THEN true WHEN source = 'src1' AND ends_with(id, '7') THEN false WHEN ends_with(id, '7') THEN true ELSE source = 'src3' END"""
)
def walked_files(spark, sf_dir):
    """The files that ignore files leave."""
    f = core._files(spark, sf_dir).select("path")
    return sources.walked(f.unionByName(f), spark.createDataFrame([(f"{folder}/.gitignore".lstrip("/"), text) for folder, text in IGNORES], "path string, text string"))


NATIVE_SQL = "regexp_matches(rule_key, '^(G[0-9]|SA[0-9]|CA[0-9])|-')"


@query(f"SELECT rule_key, CASE WHEN {NATIVE_SQL} THEN 'independent' ELSE 'base' END AS origin, count(*) AS findings FROM ({ORACLE_SQL['lexical_findings']}) GROUP BY ALL")
def findings_by_origin(spark, sf_dir):
    """Base findings together with those of independent rules, by rule."""
    both = lexical_rules.with_origin(lexical_rules.lexical_findings(programs._programs(spark, sf_dir)))
    return both.groupBy("rule_key", "origin").agg(F.count("*").alias("findings"))
