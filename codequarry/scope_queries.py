"""Queries of scopes, complexity and names across files, over Python programs made of the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import scopes
from .registry import query, table


def _tree(rows: DataFrame, part) -> DataFrame:
    """The trees of files whose parts (path, o_orderkey) stand one below the other; files are dealt over all partitions."""
    files = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("part")))).alias("p"))
    return scopes.trees_by_path(files.select("path", F.array_join("p.part", "\n").alias("text")))


@query(
    """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, left(o_orderpriority, 1)::INT AS p FROM orders), g AS (SELECT *, count(*) FILTER (p = 4) OVER (PARTITION BY c ORDER BY k) AS block FROM o),
    d AS (SELECT *, coalesce(count(*) FILTER (p < 3) OVER (PARTITION BY c, block ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM g)
    SELECT 'c' || c || '.py' AS path, 'f' || c AS name, (1 + count(*) FILTER (p <= 3) + 2 * count(*) FILTER (p = 5))::INT AS complexity,
        (coalesce(sum(1 + depth) FILTER (p < 3), 0) + count(*) FILTER (p = 3))::INT AS cognitive FROM d GROUP BY c"""
)
def function_complexity(spark, sf_dir):
    """Cyclomatic and cognitive complexity by prefix sums: a function a customer, in which orders open blocks, end all of them, or stand in them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("p"))
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = o.withColumn("block", F.count_if(F.col("p") == 4).over(own))
    before = Window.partitionBy("o_custkey", "block").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    pad = F.repeat(F.lit("    "), (1 + F.coalesce(F.count_if(F.col("p") < 3).over(before), F.lit(0))).cast("int"))
    opened = F.concat(pad, F.when(F.col("p") == 1, "if a:\n").otherwise("for i in a:\n"), pad, F.lit("    x = a"))
    line = F.when(F.col("p") < 3, opened).otherwise(F.concat(pad, F.when(F.col("p") == 3, "x = a and i").when(F.col("p") == 4, "x = i").otherwise("y = [i for i in a if i]")))
    head = o.groupBy("o_custkey").agg(F.lit(-1).cast("long").alias("o_orderkey"), F.concat(F.lit("def f"), F.col("o_custkey").cast("string"), F.lit("(a):")).alias("line"))
    rows = o.select("o_custkey", "o_orderkey", line.alias("line")).unionByName(head)
    path = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".py"))
    return scopes.function_complexity(_tree(rows.withColumn("path", path), F.col("line"))).select("path", "name", "complexity", "cognitive")


#: Lines of a function an order; what stands from the fourth line on is in a function inside.
_SCOPE_SQL = """l AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus = 'F' AS top, l_linenumber AS n, l_returnflag = 'R' AS binds, l_partkey % 6 AS v, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, binds, v, s) AS i, count(*) OVER (PARTITION BY k) AS size FROM l),
    o AS (SELECT k, c, sum(1 + top::INT + size + (size > 3)::INT) OVER (PARTITION BY c ORDER BY k) - (1 + size + (size > 3)::INT) AS line FROM (SELECT DISTINCT k, c, top, size FROM r)),
    x AS (SELECT c, k, binds, 'v' || v AS name, CASE WHEN i > 3 THEN 2 ELSE 1 END AS level, (line + 1 + i + (i > 3)::INT)::INT AS line FROM r JOIN o USING (k, c)),
    b AS (SELECT k, level, name, min(line) AS line FROM x WHERE binds GROUP BY ALL), m AS (SELECT DISTINCT c, 'v' || (k % 6) AS name FROM l WHERE top),
    u AS (SELECT x.c, x.k, x.line, x.name, CASE WHEN own.k IS NOT NULL THEN x.level WHEN outer_.k IS NOT NULL THEN 1 WHEN m.c IS NOT NULL THEN 0 END AS level
        FROM x LEFT JOIN b AS own ON own.k = x.k AND own.level = x.level AND own.name = x.name LEFT JOIN b AS outer_ ON outer_.k = x.k AND outer_.level = 1 AND outer_.name = x.name AND x.level = 2
        LEFT JOIN m ON m.c = x.c AND m.name = x.name WHERE NOT x.binds)"""


def _scopes(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The trees of a file a customer, with a function an order and its lines in it; bindings and resolved names."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("top"))
    item = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", F.when(F.col("l_returnflag") == "R", "R").otherwise("").alias("flag"), (F.col("l_partkey") % 6).cast("string").alias("v"), "l_suppkey").alias("l"))
    lines = o.join(item.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("l")).alias("l")), "o_orderkey")
    text = lambda pad: lambda x: F.when(x.flag == "R", F.concat(F.lit(pad + "v"), x.v, F.lit(" = p"))).otherwise(F.concat(F.lit(pad + "print(v"), x.v, F.lit(")")))
    body = F.concat(F.transform(F.slice("l", 1, 3), text("    ")), F.when(F.size("l") > 3, F.concat(F.array(F.lit("    def g():")), F.transform(F.slice("l", 4, 1000), text("        ")))).otherwise(F.array()))
    head = F.concat(F.when(F.col("top"), F.concat(F.lit("v"), (F.col("o_orderkey") % 6).cast("string"), F.lit(" = 1\n"))).otherwise(""), F.lit("def f"), F.col("o_orderkey").cast("string"), F.lit("(p):\n"))
    tree = _tree(lines.withColumn("path", F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".py"))), F.concat(head, F.array_join(body, "\n")))
    bound = scopes.bindings(tree).persist()
    return tree, bound, scopes.resolved(tree, None, bound)


@query(f"WITH {_SCOPE_SQL} SELECT 'c' || c || '.py' AS path, line, name, level FROM u")
def resolved_names(spark, sf_dir):
    """Which function, or the module, binds the names that functions of lines read; level tells how deep it lies."""
    tree, _, uses = _scopes(spark, sf_dir)
    depth = tree.where("kind = 'FunctionDef'").select("path", F.col("pre").alias("scope"), F.when(F.col("name") == "g", 2).otherwise(1).alias("depth"))
    named = uses.where("name like 'v%'").join(depth, ["path", "scope"], "left")
    return named.select("path", F.col("sl").alias("line"), "name", F.when(F.col("scope").isNotNull(), F.coalesce("depth", F.lit(0))).alias("level"))


@query(f"WITH {_SCOPE_SQL} SELECT 'c' || c || '.py' AS path, b.line, b.name FROM b JOIN (SELECT DISTINCT k, c FROM l) USING (k) WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.k = b.k AND u.level = b.level AND u.name = b.name)")
def unused_locals(spark, sf_dir):
    """Rule S1481 over functions of lines: local variables that nothing reads."""
    _, bound, uses = _scopes(spark, sf_dir)
    return scopes.unused_locals(bound, uses).select("path", F.col("sl").alias("line"), "name")


@query(
    """WITH c AS (SELECT c_custkey AS c, c_nationkey AS n FROM customer), o AS (SELECT c, n, o_orderkey % 5 AS given, 1 + row_number() OVER (PARTITION BY c ORDER BY o_orderkey) AS sl FROM orders JOIN c ON c = o_custkey)
    SELECT 'app/c' || c || '.py' AS path, 'S930' AS rule_key, '''lib.n' || n || '.f' || n || ''' takes another number of arguments.' AS message, sl::INT AS sl FROM o WHERE given <> n % 4"""
)
def argument_counts(spark, sf_dir):
    """Rule S930 across files: customers' orders call their nation's function, which their region's module passes on under another name."""
    n = F.col("n").cast("string")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").cast("string").alias("r"))
    parameters = F.array_join(F.transform(F.slice(F.array(*map(F.lit, range(4))), 1, F.col("n") % 4), lambda i: F.concat(F.lit("a"), i.cast("string"))), ", ")
    library = nation.select(F.concat(F.lit("lib/n"), n, F.lit(".py")).alias("path"), F.col("n").cast("long").alias("o_orderkey"), F.concat(F.lit("def f"), n, F.lit("("), parameters, F.lit("):\n    pass")).alias("line"))
    region = nation.select(F.concat(F.lit("pkg/r"), "r", F.lit(".py")).alias("path"), F.col("n").cast("long").alias("o_orderkey"), F.concat(F.lit("from lib.n"), n, F.lit(" import f"), n, F.lit(" as g"), n).alias("line"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n")).join(nation, "n").withColumn("path", F.concat(F.lit("app/c"), F.col("o_custkey").cast("string"), F.lit(".py")))
    head = customer.select("path", F.lit(-1).cast("long").alias("o_orderkey"), F.concat(F.lit("from pkg.r"), "r", F.lit(" import g"), n).alias("line"))
    given = F.array_join(F.array_repeat(F.lit("0"), (F.col("o_orderkey") % 5).cast("int")), ", ")
    calls = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, "o_custkey").select("path", "o_orderkey", F.concat(F.lit("g"), n, F.lit("("), given, F.lit(")")).alias("line"))
    tree = _tree(library.unionByName(region).unionByName(head).unionByName(calls), F.col("line"))
    return scopes.argument_findings(scopes.calls_of_other_files(tree)).select("path", "rule_key", "message", "sl")
