"""Types that many have above them: their rows are dealt over salts, with the same ancestors."""

from pyspark.sql import functions as F

from codequarry.operators import history


def _edges(spark):
    return spark.range(1, 400).select(F.col("id").alias("child"), F.floor(F.col("id") / 3).alias("parent")).union(spark.sql("select 0L, 399L"))


def test_no_key_takes_all_rows(spark):
    paths = _edges(spark).union(spark.range(1, 400).select("id", F.lit(0))).select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    below, above = history._spread(paths, 50, 16)
    assert below.count() == paths.count()
    assert below.groupBy("key", "salt").count().agg(F.max("count")).first()[0] < 60
    assert below.join(above, ["key", "salt"]).count() == paths.alias("a").join(paths.alias("b"), F.expr("a.ancestor = b.child")).count()


def test_same_ancestors(spark):
    rows = lambda d: sorted(map(tuple, d.collect()))
    got = rows(history.ancestors(_edges(spark), hot=20, salts=5))
    up = {r[0]: r[1] for r in _edges(spark).collect()}
    want = []
    for c in up:
        x, depth, seen = up[c], 1, {}
        while x not in seen:
            seen[x] = depth
            x, depth = up[x], depth + 1
        want += [(c, a, d) for a, d in seen.items()]
    assert got == sorted(want)
