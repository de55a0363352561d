"""The queries over the driver's tables and their SQL.

Documents play source files, lineitem findings, orders analyses, events coverage, part the rule
catalog, conversations review histories, pages templates with scripts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import assessment, clones, flow, history, lexical_rules, lines
from .plans import reports
from .registry import ORACLE_SQL, QUERIES, table
from .registry import query as _query
from .sources import files as sources

GLOBS = {"test": ["src1/**"], "generated": ["src2/**"], "vendor": ["src3/**"], "excluded": ["src4/*"]}


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, class, status, text."""
    d = table(spark, sf_dir, "documents")
    out = d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), "text")
    return out.select("path", "language", sources.file_class(F.col("path"), GLOBS).alias("class"), F.lit("complete").alias("status"), "text")


#: SQL: the files with their class, and their lines.
_FILES_SQL = """f AS (SELECT concat_ws('/', source, doc_id::VARCHAR) AS path, lang AS language, source,
    CASE WHEN source = 'src4' THEN 'excluded' WHEN source = 'src3' THEN 'vendor' WHEN source = 'src2' THEN 'generated' WHEN source = 'src1' THEN 'test' ELSE 'source' END AS class,
    coalesce(text, '') AS text FROM documents)"""
_LINES_SQL = _FILES_SQL + """, l AS (SELECT path, language, class, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no FROM f)"""


@_query(f"WITH {_FILES_SQL} SELECT language, class, count(*) AS files FROM f GROUP BY ALL")
def inventory(spark, sf_dir):
    """Files per language and class."""
    return _files(spark, sf_dir).groupBy("language", "class").agg(F.count("*").alias("files"))


_METRICS_SQL = (
    _LINES_SQL
    + r""", m AS (SELECT path, language, class, count(*) AS lines, count(*) FILTER (NOT regexp_matches(line, '^\s*(//.*)?$')) AS code_lines,
    count(*) FILTER (regexp_matches(line, '^\s*//')) AS comment_lines FROM l GROUP BY ALL)"""
)


@_query(f"WITH {_METRICS_SQL} SELECT path, language, lines, code_lines, comment_lines FROM m")
def file_metrics(spark, sf_dir):
    """Lines, code lines and comment lines of each file."""
    return lines.file_metrics(_files(spark, sf_dir))


@_query(
    f"""WITH {_METRICS_SQL} SELECT language, count(*) FILTER (class = 'source') AS files, coalesce(sum(lines) FILTER (class = 'source'), 0)::BIGINT AS lines,
    coalesce(sum(code_lines) FILTER (class = 'source'), 0)::BIGINT AS code_lines, coalesce(sum(comment_lines) FILTER (class = 'source'), 0)::BIGINT AS comment_lines, true AS complete FROM m GROUP BY language"""
)
def project_totals(spark, sf_dir):
    """Totals of source files; the other classes are inventoried only."""
    return lines.project_totals(lines.file_metrics(_files(spark, sf_dir), keep=("class", "status")))


_FINDINGS_SQL = (
    _LINES_SQL
    + r""", x AS (
    SELECT path, language, 'S103' AS rule_key, line_no AS sl, 0 AS sc, line_no AS el, length(line)::INT AS ec FROM l WHERE length(line) > 120
    UNION ALL SELECT path, language, 'S105', line_no, (strpos(line, chr(9)) - 1)::INT, line_no, strpos(line, chr(9))::INT FROM l WHERE contains(line, chr(9))
    UNION ALL SELECT path, language, 'S1131', line_no, length(rtrim(line))::INT, line_no, length(line)::INT FROM l WHERE rtrim(line) <> line
    UNION ALL SELECT path, language, 'S1134', line_no, (strpos(lower(line), 'fixme') - 1)::INT, line_no, (strpos(lower(line), 'fixme') + 4)::INT FROM l WHERE regexp_matches(line, '(?i)(^|[^A-Za-z0-9_])fixme([^A-Za-z0-9_]|$)')
    UNION ALL SELECT path, language, 'S1135', line_no, (strpos(lower(line), 'todo') - 1)::INT, line_no, (strpos(lower(line), 'todo') + 3)::INT FROM l WHERE regexp_matches(line, '(?i)(^|[^A-Za-z0-9_])todo([^A-Za-z0-9_]|$)')
    UNION ALL SELECT path, language, 'S104', 0, 0, 0, 0 FROM f WHERE len(string_split(text, chr(10))) > 1000
    UNION ALL SELECT path, language, 'S113', 0, 0, 0, 0 FROM f WHERE text <> '' AND right(text, 1) <> chr(10))"""
)


@_query(f"WITH {_FINDINGS_SQL} SELECT path, rule_key, sl, sc, el, ec FROM x")
def line_findings(spark, sf_dir):
    """Findings of the rules on lines."""
    return lines.line_findings(_files(spark, sf_dir))


@_query(f"WITH {_FINDINGS_SQL} SELECT rule_key, count(*) AS findings, count(DISTINCT path) AS files FROM x GROUP BY rule_key")
def rule_histogram(spark, sf_dir):
    return lines.histogram(lines.line_findings(_files(spark, sf_dir)))


@_query(
    f"""WITH {_FILES_SQL}, w AS (SELECT path, unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS literal FROM f)
    SELECT path, literal, count(*) AS n FROM w WHERE length(literal) >= 10 GROUP BY ALL HAVING count(*) >= 3"""
)
def duplicate_literals(spark, sf_dir):
    """Rule S1192 over words."""
    return lines.repeated_words(_files(spark, sf_dir))


K = 3
_WINDOWS_SQL = (
    _LINES_SQL
    + """, w0 AS (SELECT language, path, line_no AS start, line || chr(10) || lead(line, 1) OVER p || chr(10) || lead(line, 2) OVER p AS content FROM l WINDOW p AS (PARTITION BY path ORDER BY line_no)),
    w AS (SELECT * FROM w0 WHERE content IS NOT NULL AND regexp_replace(content, '\\s', '', 'g') <> '')"""
)
_REGIONS_SQL = (
    _WINDOWS_SQL
    + """, r AS (SELECT language, path, start FROM (SELECT *, count(*) OVER (PARTITION BY language, content) AS n FROM w) WHERE n > 1),
    g AS (SELECT *, CASE WHEN start <= lag(start + 2) OVER p + 1 THEN 0 ELSE 1 END AS new FROM r WINDOW p AS (PARTITION BY path ORDER BY start)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY start) AS island FROM g),
    regions AS (SELECT language, path, min(start)::INT AS start, (max(start) + 2)::INT AS stop FROM i GROUP BY language, path, island)"""
)


def _windows(spark, sf_dir):
    f = _files(spark, sf_dir)
    return clones.line_windows(f.select("language", "path", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("items")), K)


@_query(
    f"""WITH {_WINDOWS_SQL} SELECT language, content, count(*) AS occurrences, count(DISTINCT path) AS files, min(path) AS first_path
    FROM w GROUP BY language, content HAVING count(*) > 1"""
)
def clone_groups(spark, sf_dir):
    """Groups of equal three-line windows."""
    g = clones.clone_groups(_windows(spark, sf_dir))
    return g.select("language", "content", "occurrences", "files", F.col("first.path").alias("first_path"))


@_query(f"WITH {_REGIONS_SQL} SELECT language, path, start, stop FROM regions")
def clone_regions(spark, sf_dir):
    """Maximal regions of repeated windows."""
    return clones.clone_regions(_windows(spark, sf_dir), K)


@_query(
    f"""WITH {_REGIONS_SQL}, n AS (SELECT language, count(*) AS lines FROM l GROUP BY language),
    d AS (SELECT language, sum(stop - start + 1)::BIGINT AS duplicated_lines, count(*) AS duplicated_blocks, count(DISTINCT path) AS duplicated_files FROM regions GROUP BY language)
    SELECT n.language, lines, coalesce(duplicated_lines, 0) AS duplicated_lines, coalesce(duplicated_blocks, 0) AS duplicated_blocks, coalesce(duplicated_files, 0) AS duplicated_files,
    coalesce(duplicated_lines, 0) * 100.0::DOUBLE / lines AS density FROM n LEFT JOIN d USING (language)"""
)
def clone_density(spark, sf_dir):
    """Duplicated lines, blocks, files and density per language."""
    f = _files(spark, sf_dir)
    return clones.clone_measures(clones.clone_regions(_windows(spark, sf_dir), K), lines.file_metrics(f))


@_query(
    f"""WITH {_FINDINGS_SQL}, s AS (SELECT x.*, CASE WHEN sl = 0 THEN '' ELSE array_to_string(list_slice(string_split(f.text, chr(10)), sl, el), chr(10)) END AS src,
        CASE WHEN sl = 0 THEN '' ELSE array_to_string(list_slice(string_split(f.text, chr(10)), greatest(sl - 2, 1), el + 2), chr(10)) END AS ctx FROM x JOIN f USING (path))
    SELECT path, rule_key, sl, sc, el, ec, sha256(src) AS source_digest, sha256(ctx) AS context_digest,
        (dense_rank() OVER (PARTITION BY path, rule_key, sha256(src), sha256(ctx) ORDER BY sl, sc, el, ec) - 1)::INT AS occurrence FROM s"""
)
def finding_identities(spark, sf_dir):
    """Digests of source and context, and the occurrence among equal ones."""
    found = assessment.identities(lines.line_findings(_files(spark, sf_dir), details=True))
    return found.select("path", "rule_key", "sl", "sc", "el", "ec", "source_digest", "context_digest", "occurrence")


def _snapshots(spark, sf_dir):
    """The documents as they are, and a reference in which French files have other names and German ones lack their first line."""
    f = _files(spark, sf_dir).select("path", "language", F.coalesce("text", F.lit("")).alias("text"))
    old = f.select(
        F.when(F.col("language") == "fr", F.concat(F.lit("old/"), F.col("path"))).otherwise(F.col("path")).alias("path"),
        "language",
        F.when(F.col("language") == "de", F.regexp_replace("text", "^[^\n]*\n", "")).otherwise(F.col("text")).alias("text"),
    )
    return f, old


_SNAP_SQL = (
    _FILES_SQL
    + """, o AS (SELECT CASE WHEN language = 'fr' THEN 'old/' || path ELSE path END AS path, language,
    CASE WHEN language = 'de' THEN regexp_replace(text, '^[^\\n]*\\n', '') ELSE text END AS text FROM f)"""
)


@_query(
    f"""WITH {_SNAP_SQL}, c AS (SELECT path, sha256(text) AS digest FROM f), r AS (SELECT path, sha256(text) AS digest FROM o),
    lc AS (SELECT * FROM c WHERE path NOT IN (SELECT path FROM r)), lr AS (SELECT * FROM r WHERE path NOT IN (SELECT path FROM c)),
    a AS (SELECT digest, count(*) AS n FROM lc GROUP BY digest), b AS (SELECT digest, count(*) AS m, min(path) AS reference_path FROM lr GROUP BY digest)
    SELECT path, path AS reference_path, 'path' AS pairing FROM c WHERE path IN (SELECT path FROM r)
    UNION ALL SELECT lc.path, CASE WHEN n = 1 AND m = 1 THEN b.reference_path END, CASE WHEN n = 1 AND m = 1 THEN 'digest' WHEN m IS NOT NULL THEN 'ambiguous' ELSE 'none' END
    FROM lc JOIN a USING (digest) LEFT JOIN b USING (digest)"""
)
def baseline_pairs(spark, sf_dir):
    """Files paired by path or by unique content."""
    new, old = (d.select("path", F.sha2("text", 256).alias("digest")) for d in _snapshots(spark, sf_dir))
    return assessment.paired_files(new, old)


@_query(
    f"""WITH {_SNAP_SQL}, c AS (SELECT path, line, count(*) AS n FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM f) GROUP BY ALL),
    r AS (SELECT path, line, count(*) AS m FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM o) GROUP BY ALL)
    SELECT path, line, n - coalesce(m, 0) AS n FROM c LEFT JOIN r USING (path, line) WHERE n > coalesce(m, 0)"""
)
def new_code_lines(spark, sf_dir):
    """Lines that a file has more often than its reference."""
    new, old = (d.select("path", F.explode(F.split("text", "\n", -1)).alias("line")) for d in _snapshots(spark, sf_dir))
    return assessment.new_lines(new, old)


@_query(
    f"""WITH {_SNAP_SQL}, c AS (SELECT path, line, sha256(line) AS k, count(*) OVER (PARTITION BY path, line) > 1 AS amb FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM f) WHERE length(line) > 120),
    r AS (SELECT path, line, sha256(line) AS k, count(*) OVER (PARTITION BY path, line) > 1 AS amb FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM o) WHERE length(line) > 120),
    p AS (SELECT path, k, count(*) AS m, bool_or(amb) AS u FROM r GROUP BY ALL), e AS (SELECT DISTINCT k FROM r)
    SELECT status, count(*) AS findings FROM (SELECT CASE WHEN m IS NULL THEN CASE WHEN e.k IS NOT NULL THEN 'uncertain' ELSE 'new' END WHEN m = 1 AND NOT u AND NOT amb THEN 'existing' ELSE 'uncertain' END AS status
        FROM c LEFT JOIN p ON c.path = p.path AND c.k = p.k LEFT JOIN e ON c.k = e.k) GROUP BY status
    UNION ALL SELECT 'resolved', count(*) FROM r WHERE k NOT IN (SELECT k FROM c)"""
)
def baseline_findings(spark, sf_dir):
    """Long-line findings by status: new, existing, uncertain, resolved."""
    new, old = _long_lines(spark, sf_dir)
    status = assessment.compare_findings(new, old).groupBy("status").agg(F.count("*").alias("findings"))
    gone = assessment.resolved_findings(new, old).agg(F.count("*").alias("findings")).select(F.lit("resolved").alias("status"), "findings")
    return status.unionByName(gone)


def _long_lines(spark, sf_dir):
    def found(d: DataFrame) -> DataFrame:
        rows = d.select("path", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.length("line") > lines.LINE_LENGTH)
        return rows.select("path", F.sha2("line", 256).alias("content_identity"), (F.count("*").over(Window.partitionBy("path", "line")) > 1).alias("ambiguous"))

    return tuple(map(found, _snapshots(spark, sf_dir)))


def compared_findings(spark, sf_dir):
    """The current findings with status and ambiguity."""
    return assessment.compare_findings(*_long_lines(spark, sf_dir))


def _coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("src/"), F.col("user_id").cast("string")).alias("path"),
        (F.minute("ts") + 1).alias("line"),
        F.when(F.col("event_type") != "click", F.col("value") > 50).alias("covered"),
        F.when(F.col("event_type") == "click", F.second("ts").cast("string")).alias("branch_id"),
        F.when(F.col("event_type") == "click", F.col("value") > 50).alias("branch_covered"),
    )


_COVERAGE_SQL = """e AS (SELECT 'src/' || user_id AS path, (minute(ts) + 1)::INT AS line, CASE WHEN event_type <> 'click' THEN value > 50 END AS covered,
    CASE WHEN event_type = 'click' THEN second(ts)::VARCHAR END AS branch_id, CASE WHEN event_type = 'click' THEN value > 50 END AS branch_covered FROM events),
    b AS (SELECT path, line, count(*) AS branches, count(*) FILTER (hit) AS covered_branches FROM (SELECT path, line, branch_id, bool_or(branch_covered) AS hit FROM e WHERE branch_id IS NOT NULL GROUP BY ALL) GROUP BY ALL),
    o AS (SELECT path, line, bool_or(covered) AS covered, coalesce(bool_or(covered) <> bool_and(covered), false) AS contradiction FROM e GROUP BY ALL),
    m AS (SELECT path, line, covered, coalesce(branches, 0) AS branches, coalesce(covered_branches, 0) AS covered_branches, contradiction FROM o LEFT JOIN b USING (path, line))"""


@_query(f"WITH {_COVERAGE_SQL} SELECT * FROM m")
def coverage_merge(spark, sf_dir):
    """Runs merged by OR per line and branch, with contradictions."""
    return assessment.merged_coverage(_coverage(spark, sf_dir))


_PERCENT = "CASE WHEN {1} > 0 THEN (({0} * 1000 + {1} // 2) // {1})::DOUBLE / 10 END"
_COUNTERS_SQL = (
    _COVERAGE_SQL
    + f""", c AS (SELECT path, count(covered) AS eligible, count(*) FILTER (covered) AS covered, sum(branches)::BIGINT AS branches, sum(covered_branches)::BIGINT AS covered_branches FROM m GROUP BY path),
    k AS (SELECT path, eligible, covered, {_PERCENT.format("covered", "eligible")} AS percent, branches, covered_branches, {_PERCENT.format("covered_branches", "branches")} AS branch_percent FROM c)"""
)


@_query(f"WITH {_COUNTERS_SQL} SELECT * FROM k")
def coverage_counters(spark, sf_dir):
    """Eligible and covered lines and branches per file; no denominator is not zero per cent."""
    return assessment.coverage_counters(assessment.merged_coverage(_coverage(spark, sf_dir)), "path")


CONDITIONS = [
    ("overall", "files", "gt", 10.0, "full"),
    ("overall", "lines", "lt", 100.0, "full"),
    ("overall", "duplicated_lines_density", "lte", 90.0, "one_decimal"),
    ("overall", "line_coverage", "gte", 0.5, "one_decimal"),
    ("overall", "branch_coverage", "gte", 99.9, "full"),
    ("new_code", "code_lines", "lt", 10.0, "full"),
    ("new_code", "issues", "eq", 0.0, "full"),
]
_CONDITIONS_SQL = "conditions(scope, metric, op, threshold, precision) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{o}', {t}::DOUBLE, '{p}')" for a, b, o, t, p in CONDITIONS) + ")"


@_query(
    f"""WITH {_CONDITIONS_SQL}, {_COUNTERS_SQL}, v AS (SELECT 'overall' AS scope, 'line_coverage' AS metric, sum(covered) * 100.0::DOUBLE / sum(eligible) AS value FROM k
        UNION ALL SELECT 'overall', 'branch_coverage', sum(covered_branches) * 100.0::DOUBLE / sum(branches) FROM k
        UNION ALL SELECT 'overall', 'files', count(*)::DOUBLE FROM documents
        UNION ALL SELECT 'overall', 'lines', sum(len(string_split(coalesce(text, ''), chr(10))))::DOUBLE FROM documents),
    a AS (SELECT conditions.*, CASE WHEN precision = 'one_decimal' THEN floor(value::DECIMAL(30,12) * 10 + 0.5)::DOUBLE / 10 ELSE value END AS actual FROM conditions LEFT JOIN v USING (scope, metric))
    SELECT scope, metric, op, threshold, precision, actual, CASE WHEN actual IS NULL OR (scope = 'new_code' AND metric = 'code_lines') THEN 'unavailable'
        WHEN CASE op WHEN 'lt' THEN actual < threshold WHEN 'lte' THEN actual <= threshold WHEN 'eq' THEN actual = threshold WHEN 'gte' THEN actual >= threshold ELSE actual > threshold END THEN 'pass' ELSE 'fail' END AS status FROM a"""
)
def quality_gate(spark, sf_dir):
    """Three-valued results of the conditions."""
    k = assessment.coverage_counters(assessment.merged_coverage(_coverage(spark, sf_dir)), "path")
    d = table(spark, sf_dir, "documents")
    rate = lambda a, b: F.sum(a) * 100.0 / F.sum(b)
    rates = k.agg(rate("covered", "eligible").alias("line_coverage"), rate("covered_branches", "branches").alias("branch_coverage"))
    sizes = d.agg(F.count("*").cast("double").alias("files"), F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))).cast("double").alias("lines"))
    measures = rates.unpivot([], ["line_coverage", "branch_coverage"], "metric", "value").unionByName(sizes.unpivot([], ["files", "lines"], "metric", "value"))
    conditions = spark.createDataFrame(CONDITIONS, "scope string, metric string, op string, threshold double, precision string")
    return assessment.gate_results(conditions, measures.withColumn("scope", F.lit("overall"))).select("scope", "metric", "op", "threshold", "precision", "actual", "status")


def _analyses(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("branch"), F.unix_timestamp("o_orderdate").alias("analyzed_epoch"), F.col("o_orderstatus").alias("content_hash"))


_ANALYSES_SQL = "a AS (SELECT o_orderkey AS id, o_custkey AS project, o_orderpriority AS branch, epoch(o_orderdate)::BIGINT AS analyzed_epoch, o_orderstatus AS content_hash FROM orders)"


@_query(f"WITH {_ANALYSES_SQL} SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY project, branch ORDER BY analyzed_epoch DESC, id DESC) = 1")
def latest_analyses(spark, sf_dir):
    return history.latest(_analyses(spark, sf_dir), "project", "branch")


@_query(f"WITH {_ANALYSES_SQL} SELECT project, branch, count(*) AS analyses, max(analyzed_epoch) AS last_epoch, arg_max(id, (analyzed_epoch, id)) AS last_id FROM a GROUP BY ALL")
def branch_summary(spark, sf_dir):
    return history.branch_summary(_analyses(spark, sf_dir), "project", "branch")


@_query(f"WITH {_ANALYSES_SQL} SELECT id, project, branch, analyzed_epoch, content_hash, row_number() OVER (PARTITION BY project ORDER BY analyzed_epoch DESC, id DESC) > 5 AS expired FROM a")
def retention(spark, sf_dir):
    """Analyses that five later ones of the project replace."""
    return history.retained(_analyses(spark, sf_dir), "project", keep=5)


@_query(
    f"""WITH {_ANALYSES_SQL}, k AS (SELECT project, branch, min(id) AS id, arg_min(content_hash, id) AS h FROM a GROUP BY ALL)
    SELECT a.id, a.project, a.branch, CASE WHEN a.branch LIKE '1%' THEN 'stored' WHEN a.branch LIKE '2%' THEN 'conflict' WHEN k.h = content_hash THEN 'replayed' ELSE 'conflict' END AS outcome FROM a JOIN k USING (project, branch)"""
)
def ingest_outcomes(spark, sf_dir):
    """Every analysis against the first of its branch; urgent branches are not known yet, those after them are deleted."""
    a = _analyses(spark, sf_dir)
    known = a.where("branch not like '1%'").groupBy("project", "branch").agg(F.min_by("content_hash", "id").alias("content_hash")).withColumn("deleted_at", F.when(F.col("branch").startswith("2"), "2024-01-01"))
    return history.ingested(known, a, "project", "branch").select("id", "project", "branch", "outcome")


ORDER = ("l_orderkey", "l_linenumber", "l_partkey")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_orderkey, l_linenumber, l_partkey) > (100, 3, 0) ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 101")
def findings_page(spark, sf_dir):
    """The page after a key, with one row more to tell that there is a further page."""
    f = table(spark, sf_dir, "lineitem").select(*ORDER, "l_suppkey")
    return history.page(f, ORDER, after=(100, 3, 0))


@_query(
    """SELECT doc_id, lang, CASE WHEN n > 1 THEN NULL WHEN quality = 1 THEN 'accepted' WHEN quality = 0 THEN 'confirmed' END AS state
    FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY text) AS n FROM documents) d LEFT JOIN labels USING (doc_id)"""
)
def review_states(spark, sf_dir):
    """Labels as reviews of documents; texts that occur again are ambiguous and take none."""
    d = table(spark, sf_dir, "documents")
    copies = d.groupBy(F.md5("text").alias("m")).agg(F.count("*").alias("n"))
    f = d.select("doc_id", "lang", F.md5("text").alias("m")).join(copies, "m", "left")
    f = f.select("doc_id", "lang", F.col("doc_id").cast("string").alias("identity"), F.lit("finding").alias("kind"), (F.coalesce("n", F.lit(1)) > 1).alias("ambiguous"))
    reviews = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("identity"), F.lit("finding").alias("kind"), F.when(F.col("quality") == 1, "accepted").otherwise("confirmed").alias("state"), F.lit(1).cast("long").alias("version"))
    return history.with_reviews(f, reviews).select("doc_id", "lang", "state")


@_query(
    """SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER w AS p, lag(turn) OVER w AS q FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE q IS NOT NULL AND (turn <> q + 1 OR p IS DISTINCT FROM CASE role WHEN 'user' THEN 'assistant' ELSE 'user' END)"""
)
def broken_histories(spark, sf_dir):
    """Turns that don't follow the one before: a gap, or the same speaker again."""
    c = table(spark, sf_dir, "conversations").withColumn("before", F.when(F.col("role") == "user", "assistant").otherwise("user"))
    return history.broken_chains(c, "conv_id", order="turn", old="before", new="role").select("conv_id", "turn", "role")


@_query(
    """WITH b AS (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM benchmark), d AS (SELECT unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM documents),
    n AS (SELECT word, sum(x)::BIGINT AS d FROM (SELECT word, 1 AS x FROM b UNION ALL SELECT word, -1 FROM d) GROUP BY word)
    SELECT word, CASE WHEN d > 0 THEN 'missing' ELSE 'extra' END AS kind, abs(d) AS n FROM n WHERE d <> 0"""
)
def parity_difference(spark, sf_dir):
    """Bag difference between two sets of issues, here words."""
    bag = lambda name: table(spark, sf_dir, name).select(F.explode(F.split("text", "[ \n]+")).alias("word"))
    return assessment.bag_difference(bag("benchmark"), bag("documents"), "word")


@_query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'econ')")
def rule_search(spark, sf_dir):
    """Catalog rows that hold a word in any case."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return history.search_rules(p, "RING", "p_name").unionByName(history.search_rules(p, "econ", "p_type")).dropDuplicates(["p_partkey"])


@_query(
    """SELECT l_orderkey, l_linenumber, p_type AS rule_type FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE p_size <= 25 AND NOT (p_brand = 'Brand#11' AND p_type LIKE '%PROMO%') AND (p_size > 5 OR l_returnflag <> 'R')"""
)
def active_findings(spark, sf_dir):
    """Findings of rules in the profile: size is the least profile, small parts are MAIN-only, returned lines are tests."""
    p = table(spark, sf_dir, "part")
    promo = (F.col("p_brand") == "Brand#11") & F.col("p_type").contains("PROMO")
    rules = p.select(F.col("p_partkey").alias("rule_key"), F.col("p_size").alias("profile"), F.when(promo, "DEPRECATED").otherwise("READY").alias("status"), F.when(promo, "SECURITY_HOTSPOT").otherwise("CODE_SMELL").alias("rule_type"), F.when(F.col("p_size") <= 5, "MAIN").otherwise("ALL").alias("scope"))
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("rule_key"), F.when(F.col("l_returnflag") == "R", "test").otherwise("source").alias("class"))
    kinds = p.select(F.col("p_partkey").alias("rule_key"), F.col("p_type").alias("rule_type"))
    return lines.active(f, rules, 25).join(kinds, "rule_key").select("l_orderkey", "l_linenumber", "rule_type")


@_query("SELECT l_partkey AS rule_key, count(*) AS findings, count(DISTINCT l_orderkey) AS files FROM lineitem GROUP BY l_partkey")
def issue_histogram(spark, sf_dir):
    return lines.histogram(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("rule_key"), F.col("l_orderkey").alias("path")))


@_query(
    r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1)) AS script FROM pages)
    SELECT page_id, count(*) AS scripts, sum(length(script))::BIGINT AS chars FROM s WHERE trim(script) <> '' GROUP BY page_id"""
)
def embedded_scripts(spark, sf_dir):
    """Inline scripts of pages."""
    s = sources.embedded_scripts(table(spark, sf_dir, "pages"), "page_id")
    return s.groupBy("page_id").agg(F.count("*").alias("scripts"), F.sum(F.length("script")).alias("chars"))


@_query(
    r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1)) AS script FROM pages)
    SELECT page_id, 'S122' AS rule_key, 1 AS sl, 0 AS sc, 1 AS el, length(script)::INT AS ec FROM s WHERE regexp_matches(script, '^[a-z][^;\n]*;[ \t]*[a-z][^;\n]*;$')"""
)
def script_findings(spark, sf_dir):
    """Lexical rules over the inline scripts of pages, as JavaScript."""
    s = sources.embedded_scripts(table(spark, sf_dir, "pages"), "page_id")
    found = lexical_rules.lexical_findings(s.select(F.col("page_id").alias("path"), F.lit("javascript").alias("language"), F.col("script").alias("text")))
    return found.select(F.col("path").alias("page_id"), "rule_key", "sl", "sc", "el", "ec")


def _messages(spark, sf_dir):
    return lines.line_findings(_files(spark, sf_dir), details=True).withColumns({"message": F.concat(F.lit("rule "), F.col("rule_key")), "severity": F.lit("MAJOR"), "family": F.col("rule_key")})


@_query(f"WITH {_FINDINGS_SQL} SELECT path, sl, path || ':' || sl || ':' || sc || ': ' || rule_key || ' rule ' || rule_key AS row FROM x")
def text_report(spark, sf_dir):
    return reports.text_lines(_messages(spark, sf_dir))


def _hex_length(field: str) -> str:
    return f"lpad(hex(strlen({field})), 16, '0') || hex(encode({field}))"


@_query(
    f"""WITH {_FINDINGS_SQL}, y AS (SELECT *, 'rule ' || rule_key AS message, sl || ':' || sc || '-' || el || ':' || ec AS spot FROM x)
    SELECT message AS description, rule_key AS check_name, sha256(unhex({" || ".join(map(_hex_length, ("'v2'", "path", "rule_key", "message", "spot")))})) AS fingerprint, 'major' AS severity, path, greatest(sl, 1) AS begin FROM y"""
)
def gitlab_report(spark, sf_dir):
    """Code quality entries with fingerprints over length-prefixed fields."""
    return reports.gitlab(_messages(spark, sf_dir)).select("description", "check_name", "fingerprint", "severity", F.col("location.path").alias("path"), F.col("location.lines.begin").alias("begin"))


_JSON_ORDER = "ORDER BY sl, sc, el, ec, rule_key"


@_query(
    f"""WITH {_FINDINGS_SQL} SELECT rule_key AS family, path, '[' || string_agg('{{"ruleId":"' || rule_key || '","level":"warning","message":{{"text":"rule ' || rule_key || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || path || '"}}'
        || CASE WHEN sl > 0 THEN ',"region":{{"startLine":' || sl || ',"startColumn":' || sc + 1 || ',"endLine":' || el || ',"endColumn":' || ec + 1 || '}}' ELSE '' END || '}}}}]}}', ',' {_JSON_ORDER}) || ']' AS results FROM x GROUP BY rule_key, path"""
)
def sarif_report(spark, sf_dir):
    """SARIF results by rule family and file."""
    return reports.sarif(_messages(spark, sf_dir))


@_query(
    f"""WITH {_FINDINGS_SQL} SELECT rule_key AS family, '{{"driver":{{"name":"codequarry-' || rule_key || '","rules":[{{"id":"' || rule_key || '"}}]}}}}' AS tool FROM x GROUP BY rule_key"""
)
def sarif_tools(spark, sf_dir):
    """The driver of each SARIF run."""
    return reports.sarif_tools(_messages(spark, sf_dir))


@_query(
    f"""WITH {_METRICS_SQL}, {_FINDINGS_SQL.split(_LINES_SQL + ", ")[1]}, i AS (SELECT path, string_agg('{{"sl":' || sl || ',"sc":' || sc || ',"el":' || el || ',"ec":' || ec || ',"rule_key":"' || rule_key || '","message":"rule ' || rule_key || '"}}', ',' {_JSON_ORDER}) AS issues FROM x GROUP BY path)
    SELECT path, '{{"schema_version":1,"path":"' || path || '","language":"' || language || '","metrics":{{"lines":' || lines || ',"code_lines":' || code_lines || ',"comment_lines":' || comment_lines || '}},"issues":[' || coalesce(issues, '') || ']}}' AS document FROM m LEFT JOIN i USING (path)"""
)
def native_report(spark, sf_dir):
    """One JSON document a file."""
    return reports.native(_messages(spark, sf_dir), lines.file_metrics(_files(spark, sf_dir)))


@_query(
    f"""WITH {_FINDINGS_SQL} SELECT rule_key AS "ruleId", path, sl AS "startLine", el AS "endLine", sc AS "startColumn", ec AS "endColumn" FROM x WHERE sl > 0
    UNION ALL SELECT rule_key, path, NULL, NULL, NULL, NULL FROM x WHERE sl = 0"""
)
def generic_report(spark, sf_dir):
    """Generic issues; the documents hold no character beyond 16 bits, so that units are characters."""
    out = reports.generic_issues(_messages(spark, sf_dir))
    return out.select("ruleId", "path", *(F.col(f"textRange.{c}").alias(c) for c in ("startLine", "endLine", "startColumn", "endColumn")))


@_query(f"WITH {_FILES_SQL} SELECT path, sha256(text) AS digest FROM f WHERE class <> 'vendor'")
def changed_files(spark, sf_dir):
    """Files whose content the cache doesn't have; it holds the vendor files as they are, and the rest with other text."""
    f = _files(spark, sf_dir)
    cache = f.select("path", F.sha2(F.when(F.col("class") == "vendor", F.coalesce("text", F.lit(""))).otherwise("other"), 256).alias("digest"))
    return sources.changed_files(f, cache).select("path", "digest")


@_query(
    f"""WITH {_FILES_SQL}, e AS (SELECT path, text FROM f) SELECT path, CASE WHEN text = '' THEN 0 WHEN right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS added, sha256(text || CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN chr(10) ELSE '' END) AS digest FROM e"""
)
def final_newline_fix(spark, sf_dir):
    """The mechanical fix: a final line break where it is missing, as an insertion at the end."""
    f = _files(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    at = F.length("text")
    fixes = f.where((F.col("text") != "") & ~F.col("text").endswith("\n")).select("path", at.alias("start"), at.alias("stop"), F.lit("\n").alias("replacement"))
    done = reports.applied(f, reports.chosen_edits(fixes))
    return done.select("path", (F.length("fixed") - F.length("text")).alias("added"), F.sha2("fixed", 256).alias("digest"))
