"""How five text filters interact: what each order of them removes, part by part.

Words travel as rows: every distinct text is exploded under its first document, counted by (document,
word) and then by document for words and distinct words. These counts meet the other flags in an outer
join, since a text without words has no rows, and one aggregate of 32 conditional counts a part (one for
each set of failing filters) is all that the 120 orders need.

Copies are taken together before any shuffle by text, so that a text of a third of all rows costs one
row a task. Texts are told apart by SHA-256. Null texts are empty, null parts are the empty string. A
null id counts as larger than all others; rows that repeat an id and text don't make each other copies;
of several labels of one id any 1 counts. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import whole_text

FILTERS = "ABCDE"
#: What splits words, and the limits of the filters.
SPACE, WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SYMBOLS = "[ \\t-\\r]+", 50, 65, 5, "[#$%&*|]"
_MASKS = 1 << len(FILTERS)


def word_counts(texts: DataFrame) -> DataFrame:
    """(name, doc_id, words, different) of the texts (name, doc_id, t) that have words."""
    words = texts.select("name", "doc_id", F.explode(F.split("t", SPACE)).alias("word")).where("word <> ''")
    by_word = words.groupBy("name", "doc_id", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("name", "doc_id").agg(F.sum("n").alias("words"), F.count("*").alias("different"))


def failures(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents fail just the filters whose bits are set in mask (A: 1 to E: 16)."""
    judged = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    named = documents.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole_text(text).alias("t")).withColumn("name", F.unhex(F.sha2("t", 256)))
    counted = word_counts(named.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("t").alias("t")))
    capitals = F.length(F.regexp_replace("t", "[^A-Z]+", ""))
    flags = named.select("doc_id", "part", "name", (100 * capitals > CAPITALS_PERCENT * F.length("t")).alias("c"), F.col("t").rlike(SYMBOLS).alias("d"))
    flags = flags.join(judged, "doc_id", "left").na.fill(0, ["good", "toxic"])
    alike = ["name", "part", "good", "toxic", "c", "d"]
    ids = flags.groupBy(*alike, "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n"))
    groups = ids.groupBy(*alike).agg(F.sum("n").alias("n"), least.alias("least"))
    first = F.min(F.struct("least.none", "least.doc_id")).over(Window.partitionBy("name"))
    groups = groups.withColumn("originals", F.when(F.struct("least.none", "least.doc_id").eqNullSafe(first), F.col("least.n")).otherwise(0))
    joined = groups.join(counted.select("name", "words", "different"), "name", "left").na.fill(0, ["words", "different"])
    fails = [F.col("words") < WORDS, 100 * F.col("different") < DISTINCT_PERCENT * F.col("words"), F.col("c"), F.col("d")]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    both = F.array(F.struct(mask.alias("mask"), F.col("originals").alias("n")), F.struct((mask + 16).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))
    return joined.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", "good", "toxic", "x.n").where("n > 0")


def filter_audit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step of it (see the module): counts of documents that are
    kept after the step, removed by it, fail its filter but were removed earlier, fail its filter only, are
    removed with quality 1 or toxic 1, and what its filter removes over all orders."""
    found = failures(documents, labels, key, text, part)
    count = lambda m, which: F.sum(F.when(F.col("mask") == m, F.col("n") * which).otherwise(0))
    kinds = {"every": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = found.groupBy("part").agg(*(count(m, which).alias(f"{kind}_{m}") for kind, which in kinds.items() for m in range(_MASKS)))
    wide = counts.select("part", *(F.array(*(f"{kind}_{m}" for m in range(_MASKS))).alias(kind) for kind in kinds))
    orders = ",".join("".join(p) for p in permutations(FILTERS))
    steps = wide.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda at: f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {at}, 1)) - 1)"
    steps = steps.withColumn("own", F.expr(bit("step"))).withColumn("before", F.expr(f"aggregate(sequence(1, step), 0, (s, i) -> s + IF(i < step, {bit('i')}, 0))"))
    total = lambda of, where, times="": F.expr(f"aggregate(sequence(0, {_MASKS - 1}), 0L, (s, m) -> s + IF({where}, {of}[m]{times}, 0L))")
    removed = "(m & before) = 0 AND (m & own) <> 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("every", "(m & (before | own)) = 0").alias("kept"),
        total("every", removed).alias("removed"),
        total("every", "(m & before) <> 0 AND (m & own) <> 0").alias("redundant"),
        total("every", "m = own").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        # of the orders, those in which the filter comes before all others that the document fails
        total("every", "(m & own) <> 0", " * (120 DIV bit_count(m))").alias("shapley"),
    )


ORACLE_SQL = r"""
WITH judged AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS t, coalesce(j.good, 0) AS good, coalesce(j.toxic, 0) AS toxic
  FROM documents d LEFT JOIN judged j USING (doc_id)
), words AS (
  SELECT *, [x FOR x IN string_split_regex(t, '[ \t-\r]+') IF x <> ''] AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM docs
), fails AS (
  SELECT part, good, toxic,
    len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e
  FROM words
), masks AS (
  SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask FROM fails
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, s AS step, 1 << (instr('ABCDE', filter_order[s]) - 1) AS own,
    list_sum([CASE WHEN i < s THEN 1 << (instr('ABCDE', filter_order[i]) - 1) ELSE 0 END FOR i IN range(1, 6)])::INT AS before
  FROM orders, range(1, 6) r(s)
), counted AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL
), rows AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counted, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM rows
"""
