"""Trees kept by path: the same nodes as rows made one by one, and joins within files that move nothing."""

from codequarry.functions import python_tree
from codequarry.operators import scopes

SOURCES = [
    ("a.py", "import os as o\n\n\ndef f(p, *, q=1):\n    v = [x for x in p if (y := x)]\n    return v, y, q\n"),
    ("b.py", "class C:\n    z = 1\n\n    def g(self):\n        global t\n        t = self.z\n        w = '''\n'''\n"),
    ("c.py", "def broken(:\n"),
    ("d.py", None),
    ("e.py", "match a:\n    case {'k': 1, **r}:\n        print(r)\n"),
]


def test_nodes_are_the_same(spark):
    files = spark.createDataFrame(SOURCES, "path string, text string")
    placed, rows = python_tree.placed_tree(files, 3), python_tree.tree(files)
    assert [(c.name, c.dataType) for c in placed.schema] == [(c.name, c.dataType) for c in rows.schema]
    assert sorted(map(tuple, placed.collect()), key=lambda r: r[:2]) == sorted(map(tuple, rows.collect()), key=lambda r: r[:2])


def test_joins_within_files_move_nothing(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        tree = scopes.trees_by_path(spark.createDataFrame(SOURCES, "path string, text string"))
        intervals = scopes.scope_intervals(tree)
        bound = scopes.bindings(tree, intervals)
        for df in (scopes.resolved(tree, intervals, bound), scopes.function_complexity(tree)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            outside = [x for x in plan.splitlines() if "Exchange" in x and "REPARTITION_BY_NUM" not in x]
            assert "SortMergeJoin" in plan and outside == []
        tree.unpersist()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
