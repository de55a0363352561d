"""Queries over program sources, and their SQL.

The tables hold no programs, so that files are made of them: an order is a line (or a function) of its
customer's file, chosen by its key from a list of lines whose findings are known. Every row of the
table is used, and the SQL knows what each line should give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import python_facts
from .operators import assessment, fixpoint, flow, lexical_rules, lines, python_rules
from .plans import fixes
from .registry import query, table, values
from .sources import reports as imports

#: Lines by language, each with (rule, part of the line where the finding is).
LINES = {
    "javascript": (
        ("console.log(a);", ("S106", "console.log(")),
        ("x = Math.random();", ("S2245", "Math.random(")),
        ("a(); b();", ("S122", "a(); b();")),
        ("var h = createHash('md5');", ("S4790", "createHash('md5'")),
        ("// x = y;", ("S125", "// x = y;")),
        ("if (a == true) { c(); }", ("S1125", "== true")),
        ("k = { secure: false };", ("S2092", "secure: false")),
        ("x.a = x.a;", ("S1656", "x.a = x.a")),
        ("go(); // NOSONAR", ("S1291", "// NOSONAR")),
        ("p = new Promise(async () => run());", ("no-async-promise-executor", "async")),
        ("open('/tmp/x');", ("S5443", "'/tmp/x'")),
        ("connect('10.2.3.4');", ("S1313", "'10.2.3.4'")),
        ("let z = 'console.log(1)';",),
        ("",),
    ),
    "go": (
        ("os.Create(p)", ("G307", "os.Create")),
        ("os.MkdirAll(p, 0755)", ("G301", "0755"), ("S1314", "0755")),
        ("time.Sleep(100)", ("SA1004", "100")),
        ("http.ListenAndServe(a, nil)", ("G114", "http.ListenAndServe")),
        ("x = x", ("S1656", "x = x")),
        ("if a == true { y() }", ("S1125", "== true")),
        ("c := tls.Config{InsecureSkipVerify: true}", ("G402", "InsecureSkipVerify")),
        ('import "crypto/md5"', ("G401", '"crypto/md5"')),
        ("rsa.GenerateKey(r, 1024)", ("G403", "1024")),
        ("os.WriteFile(p, d, 0o644)", ("G306", "0o644")),
        ('os.Create("/tmp/x")', ("G307", "os.Create"), ("G303", '"/tmp/x"')),
        ('s := "os.Create(p)"',),
    ),
    "rust": (
        ('println!("x");', ("S106", "println!(")),
        ("use a::b::*;", ("S2208", "use a::b::*;")),
        ("x.a = x.a;", ("S1656", "x.a = x.a")),
        ("a();;", ("S1116", ";;")),
        ("p.set_readonly(false);", ("permissions-set-readonly-false", "set_readonly")),
        ("// println!(1)",),
    ),
    "csharp": (
        ('if (a) { throw new Exception("x"); }', ("S112", "throw new Exception(")),
        ("c.Secure = false;", ("S2092", "Secure = false")),
        ("p = SslProtocols.Tls11;", ("S4423", "SslProtocols.Tls11")),
        ("a.Mode = CipherMode.ECB;", ("S5542", "CipherMode.ECB")),
        ("var r = new Random();", ("S2245", "new Random(")),
        ("Console.WriteLine(a);", ("S106", "Console.WriteLine(")),
        ("var e = JsonDocument.Parse(s).RootElement;", ("CA2026", "RootElement")),
        ("a(); b();", ("S122", "a(); b();")),
    ),
    "java": (
        ("// FixMe later", ("S1134", "// FixMe later")),
        ("int a; // todo", ("S1135", "int a; // todo")),
        ("run((a, b, c) -> a);", ("S2211", "a, b, c")),
        ("import java.util.Date;",),
        ("Date d;", ("S2143", None)),
        ("run(a -> { go(); });", ("S2211", "a")),
    ),
    "ruby": (
        ("x # fixme", ("S1134", "fixme")),
        ("return a.b == a.b", ("S1764", "a.b == a.b")),
        ("x if a && b && c && d && e", ("S1067", "x if a && b && c && d && e")),
        ("y # TODO: a TODO", ("S1135", "TODO")),
        ("s = '# todo'",),
    ),
    "python": (
        ("import a  # noqa: F401", ("S1309", "# noqa: F401")),
        ("run(x)  # why # NoSec B602", ("S1309", "# why # NoSec B602")),
        ("s = '# noqa'",),
        ("x = 1  # note",),
    ),
}
LANGUAGES = tuple(LINES)
#: Lines that are code, comments or blank, by the state of the block comment before them.
MEASURED = ("x();", "// note", "/* open", "within", "end */ y();", "/* a */ // b", "/* a */ z();", "  ", "v(); /* no block", "*/", "# note")


def _pick(options, index):
    return F.element_at(F.array(*map(F.lit, options)), index + 1)


def _numbered(spark, sf_dir: str, least: int = 1) -> DataFrame:
    """The orders with the language and path of their customer's file."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    language = _pick(LANGUAGES, (F.col("o_custkey") % len(LANGUAGES)).cast("int"))
    return o.withColumn("language", language).withColumn("path", F.concat("language", F.lit("/"), F.col("o_custkey").cast("string")))


def _files(rows: DataFrame, part) -> DataFrame:
    """path, language, text: the parts of each file in the order of their keys.

    The files are dealt over all partitions, since rules cost far more than their few bytes suggest.
    """
    whole = F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("part"))))
    files = rows.groupBy("path", "language").agg(whole.alias("p")).select("path", "language", F.array_join("p.part", "\n").alias("text"))
    return files.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def _programs(spark, sf_dir: str) -> DataFrame:
    line = F.lit("")
    for name, options in LINES.items():
        line = F.when(F.col("language") == name, _pick([o[0] for o in options], (F.col("o_orderkey") % len(options)).cast("int"))).otherwise(line)
    return _files(_numbered(spark, sf_dir), line)


_OPTIONS = [(name, i, o[0]) for name, options in LINES.items() for i, o in enumerate(options)]
_EXPECTED = [(name, i, key, part) for name, options in LINES.items() for i, o in enumerate(options) for key, part in o[1:]]
_LANGUAGE_SQL = values("languages", "language, rank, options", [(name, i, len(LINES[name])) for i, name in enumerate(LANGUAGES)])
_ROWS_SQL = f"""{_LANGUAGE_SQL}, o AS (SELECT language || '/' || o_custkey AS path, language, o_orderkey, (o_orderkey % options)::INT AS pick,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS sl FROM orders JOIN languages ON rank = o_custkey % {len(LANGUAGES)})"""
_EXPECTED_SQL = f"""{_ROWS_SQL}, {values("texts", "language, pick, line", _OPTIONS)}, {values("expected", "language, pick, rule_key, part", _EXPECTED)}"""


@query(
    f"""WITH {_EXPECTED_SQL} SELECT path, rule_key, sl, (strpos(line, part) - 1)::INT AS sc, sl AS el, (strpos(line, part) - 1 + length(part))::INT AS ec
    FROM o JOIN texts USING (language, pick) JOIN expected USING (language, pick) WHERE part IS NOT NULL
    UNION ALL SELECT DISTINCT path, rule_key, 0, 0, 0, 0 FROM o JOIN expected USING (language, pick) WHERE part IS NULL"""
)
def lexical_findings(spark, sf_dir):
    """Rules on tokens, literals and comments of seven languages."""
    return lexical_rules.lexical_findings(_programs(spark, sf_dir)).select("path", "rule_key", "sl", "sc", "el", "ec")


@query(
    f"""WITH m AS (SELECT o_custkey, o_orderkey, o_custkey % 2 = 1 AS hashed, list_value({", ".join(f"'{x}'" for x in MEASURED)})[o_orderkey % {len(MEASURED)} + 1] AS line FROM orders),
    t AS (SELECT *, trim(line) AS t, regexp_replace(trim(line), '^(/[*].*?[*]/\\s*)+', '') AS free,
        CASE WHEN contains(line, '*/') THEN regexp_replace(ltrim(line[strpos(line, '*/') + 2:]), '^(/[*].*?[*]/\\s*)+', '') END AS rest FROM m),
    c AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN coalesce(starts_with(rest, '/*'), true) = starts_with(free, '/*') THEN starts_with(free, '/*') END AS after FROM t),
    s AS (SELECT *, coalesce(last_value(after IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM c),
    k AS (SELECT *, CASE WHEN t = '' THEN NULL WHEN hashed THEN NOT starts_with(t, '#') ELSE coalesce(CASE WHEN inside THEN rest ELSE free END, '') <> ''
        AND NOT starts_with(CASE WHEN inside THEN rest ELSE free END, '/*') AND NOT starts_with(CASE WHEN inside THEN rest ELSE free END, '//') END AS code FROM s)
    SELECT o_custkey::VARCHAR AS path, CASE WHEN hashed THEN 'python' ELSE 'rust' END AS language, count(*) AS lines, count(*) FILTER (code) AS code_lines, count(*) FILTER (NOT code) AS comment_lines FROM k GROUP BY o_custkey, hashed"""
)
def program_metrics(spark, sf_dir):
    """Lines, code and comment lines with block comments, of files in two languages."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("path"), F.when(F.col("o_custkey") % 2 == 1, "python").otherwise("rust").alias("language"))
    return lines.file_metrics(_files(o, _pick(MEASURED, (F.col("o_orderkey") % len(MEASURED)).cast("int"))))


#: Python functions: text, parameters, code lines without the docstring, cyclomatic and cognitive complexity, dead stores (line, name), findings (rule, line, column, end column).
FUNCTIONS = (
    ("def add_all(a, b):\n    \"\"\"Sum.\"\"\"\n    return a + b", 2, 2, 1, 0, (), ()),
    ("def Pick(a, b=[]):\n    \"\"\"Pick.\"\"\"\n    if a and b:\n        return a\n    return b", 2, 4, 3, 2, (), (("S1542", 1), ("S5717", 1))),
    ("def walk(n):\n    \"\"\"Walk.\"\"\"\n    for i in n:\n        if i:\n            print(i)\n        else:\n            print(n)", 1, 6, 3, 4, (), ()),
    ("def last(n):\n    \"\"\"Last.\"\"\"\n    x = 1\n    x = n\n    return x", 1, 4, 1, 0, ((3, "x"),), (("S1854", 3),)),
    ("def check(a):\n    \"\"\"Check.\"\"\"\n    if not a == 1:\n        raise Exception('x')\n    return len(a) >= 0", 1, 4, 2, 1, (), (("S1940", 3), ("S112", 4), ("S3981", 5))),
    ("def choose(a):\n    \"\"\"Choose.\"\"\"\n    x = 1\n    match a:\n        case 1:\n            x = 2\n        case _:\n            print(a)\n    return x", 1, 8, 1, 0, (), ()),
    ("def fork(a):\n    \"\"\"Fork.\"\"\"\n    x = 1\n    match a:\n        case [y, *_]:\n            x = y\n        case _:\n            x = 3\n    return x", 1, 8, 1, 0, ((3, "x"),), (("S1854", 3),)),
    ("def deep(a, b):\n    \"\"\"Deep.\"\"\"\n    total = 0\n    while a:\n        for i in b:\n            if i and a or b:\n                total += i if a else 1\n        else:\n            total = -total\n        a -= 1\n    return [x for x in b if x], total", 2, 10, 9, 13, (), (("S2836", 5),)),
    ("def guard(a):\n    \"\"\"Guard.\"\"\"\n    try:\n        value = int(a)\n    except ValueError:\n        value = 0\n    except (TypeError, OverflowError):\n        return None\n    return value", 1, 8, 3, 2, (), ()),
)


def _python(spark, sf_dir: str) -> DataFrame:
    """Files of functions, an empty line after each."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), F.col("o_custkey").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"))
    return _files(o, F.concat(_pick([f[0] for f in FUNCTIONS], (F.col("o_orderkey") % len(FUNCTIONS)).cast("int")), F.lit("\n")))


_FUNCTION_SQL = f"""{values("functions", "pick, name, rows, params, lines, complexity, cognitive", [(i, f[0][4 : f[0].index("(")], f[0].count("\n") + 1, *f[1:5]) for i, f in enumerate(FUNCTIONS)])},
    p AS (SELECT 'f' || o_custkey || '.py' AS path, functions.*, (1 + coalesce(sum(rows + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS sl
        FROM orders JOIN functions ON pick = o_orderkey % {len(FUNCTIONS)})"""


@query(f"WITH {_FUNCTION_SQL} SELECT path, name, sl, params, lines, complexity, cognitive FROM p")
def python_functions(spark, sf_dir):
    """Parameters, lines, cyclomatic and cognitive complexity of each function."""
    return python_facts.function_measures(_python(spark, sf_dir))


@query(
    f"""WITH {_FUNCTION_SQL}, {values("expected", "pick, rule_key, line", [(i, key, line) for i, f in enumerate(FUNCTIONS) for key, line in f[6] if key != "S1854"])}
    SELECT path, rule_key, (p.sl + line - 1)::INT AS sl FROM p JOIN expected USING (pick)"""
)
def python_findings(spark, sf_dir):
    """Rules on nodes of Python's syntax tree; files are parsed once."""
    return python_rules.placed_findings(python_facts.placed_nodes(_python(spark, sf_dir), python_rules.node_kinds(), python_rules.node_attributes())).select("path", "rule_key", "sl")


@query(f"""WITH {_FUNCTION_SQL}, {values("dead", "pick, line, name", [(i, line, name) for i, f in enumerate(FUNCTIONS) for line, name in f[5]])} SELECT path, (p.sl + dead.line - 1)::INT AS line, dead.name FROM p JOIN dead USING (pick)""")
def dead_stores(spark, sf_dir):
    """Rule S1854 by liveness over each function's control flow."""
    return flow.dead_store_findings(_python(spark, sf_dir))


BLOCKS = 12
_GRAPH_SQL = f"""e AS (SELECT DISTINCT 'f' || o_custkey AS fn_id, (o_orderkey % {BLOCKS})::INT AS src, ((o_orderkey // {BLOCKS}) % {BLOCKS})::INT AS dst FROM orders),
    n AS (SELECT fn_id, block FROM (SELECT fn_id, src AS block FROM e UNION SELECT fn_id, dst FROM e UNION SELECT fn_id, 0 FROM e)),
    r(fn_id, block) AS (SELECT DISTINCT fn_id, 0 FROM e UNION SELECT e.fn_id, e.dst FROM e JOIN r ON e.fn_id = r.fn_id AND e.src = r.block),
    w(fn_id, start, block) AS (SELECT fn_id, src, dst FROM e UNION SELECT e.fn_id, start, e.dst FROM e JOIN w ON e.fn_id = w.fn_id AND e.src = w.block),
    a(fn_id, without, block) AS (SELECT DISTINCT fn_id, block, 0 FROM n WHERE block <> 0 UNION SELECT e.fn_id, without, e.dst FROM e JOIN a ON e.fn_id = a.fn_id AND e.src = a.block AND e.dst <> without),
    d AS (SELECT r.fn_id, r.block, x.block AS dominator FROM r JOIN r AS x ON x.fn_id = r.fn_id AND x.block <> r.block WHERE x.block = 0 OR NOT EXISTS (SELECT 1 FROM a WHERE a.fn_id = r.fn_id AND without = x.block AND a.block = r.block)),
    k AS (SELECT d.fn_id, d.block, d.dominator, (SELECT count(*) FROM d AS o WHERE o.fn_id = d.fn_id AND o.block = d.dominator) AS depth FROM d)"""


@query(
    f"""WITH RECURSIVE {_GRAPH_SQL} SELECT n.fn_id, n.block::BIGINT AS block, r.block IS NOT NULL AS reachable, EXISTS (SELECT 1 FROM w WHERE w.fn_id = n.fn_id AND w.start = n.block AND w.block = n.block) AS in_cycle,
    (SELECT min(b.block) FROM n AS b WHERE b.fn_id = n.fn_id AND (b.block = n.block OR EXISTS (SELECT 1 FROM w WHERE w.fn_id = n.fn_id AND w.start = n.block AND w.block = b.block) AND EXISTS (SELECT 1 FROM w WHERE w.fn_id = n.fn_id AND w.start = b.block AND w.block = n.block)))::BIGINT AS component,
    (SELECT arg_max(dominator, depth) FROM k WHERE k.fn_id = n.fn_id AND k.block = n.block)::BIGINT AS idom FROM n LEFT JOIN r ON r.fn_id = n.fn_id AND r.block = n.block"""
)
def graph_facts(spark, sf_dir):
    """Reachability, strongly connected components, cycles and immediate dominators of graphs made of orders."""
    o = table(spark, sf_dir, "orders")
    e = o.select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("fn_id"), (F.col("o_orderkey") % BLOCKS).cast("int").alias("src"), (F.floor(F.col("o_orderkey") / BLOCKS) % BLOCKS).cast("int").alias("dst")).distinct()
    return flow.graph_facts(e).select("fn_id", "block", "reachable", "in_cycle", "component", "idom")


#: Variables of the blocks, and what a block does, by the number of an order of its.
_FLOW_SQL = f"""o AS (SELECT o_orderpriority || (o_orderkey % 40) AS fn_id, (o_custkey % {BLOCKS})::BIGINT AS src, ((o_orderkey // 40) % {BLOCKS})::BIGINT AS dst, o_orderkey AS k FROM orders),
    e AS (SELECT DISTINCT fn_id, src, dst FROM o WHERE k % 3 = 0), b AS (SELECT fn_id, src AS block, min(k) AS k FROM o GROUP BY ALL),
    d AS (SELECT fn_id, block, chr(97 + (k % 4)::INT) AS variable FROM b WHERE k % 5 < 2),
    s AS (SELECT fn_id, block, CASE k % 5 WHEN 0 THEN 'source' WHEN 1 THEN 'clean' ELSE 'assign' END AS kind, chr(97 + (k % 4)::INT) AS target, [chr(97 + ((k + 1) % 4)::INT), chr(97 + ((k + 2) % 4)::INT)] AS read FROM b WHERE k % 5 < 4)"""


def _flow(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges and blocks (fn_id, block, k) of graphs made of all orders."""
    o = table(spark, sf_dir, "orders").select(
        F.concat("o_orderpriority", (F.col("o_orderkey") % 40).cast("string")).alias("fn_id"), (F.col("o_custkey") % BLOCKS).alias("src"), (F.floor(F.col("o_orderkey") / 40) % BLOCKS).alias("dst"), F.col("o_orderkey").alias("k")
    )
    return o.where("k % 3 = 0").select("fn_id", "src", "dst"), o.groupBy("fn_id", F.col("src").alias("block")).agg(F.min("k").alias("k"))


def _letter(k):
    return F.char((F.lit(97) + k % 4).cast("int"))


@query(
    f"""WITH RECURSIVE {_FLOW_SQL}, r(fn_id, block, variable, site) AS (SELECT d.fn_id, e.dst, variable, block FROM d JOIN e ON e.fn_id = d.fn_id AND e.src = d.block
        UNION SELECT r.fn_id, e.dst, r.variable, r.site FROM r JOIN e ON e.fn_id = r.fn_id AND e.src = r.block WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.fn_id = r.fn_id AND d.block = r.block AND d.variable = r.variable))
    SELECT * FROM r"""
)
def reaching_definitions(spark, sf_dir):
    """Definitions that reach the blocks of graphs made of orders."""
    edges, blocks = _flow(spark, sf_dir)
    return fixpoint.reaching_definitions(edges, blocks.where("k % 5 < 2").withColumn("variable", _letter(F.col("k"))))


@query(
    f"""WITH RECURSIVE {_FLOW_SQL}, t(fn_id, block, variable, origin) AS (SELECT fn_id, block, target, block FROM s WHERE kind = 'source'
        UNION SELECT t.fn_id, e.dst, v.variable, t.origin FROM t JOIN e ON e.fn_id = t.fn_id AND e.src = t.block LEFT JOIN s ON s.fn_id = e.fn_id AND s.block = e.dst,
            LATERAL (SELECT t.variable WHERE s.target IS DISTINCT FROM t.variable UNION SELECT s.target WHERE s.kind = 'assign' AND list_contains(s.read, t.variable)) AS v(variable))
    SELECT * FROM t"""
)
def tainted_variables(spark, sf_dir):
    """Tainted variables and their sources at the end of the blocks of graphs made of orders."""
    edges, blocks = _flow(spark, sf_dir)
    k = F.col("k")
    kind = F.when(k % 5 == 0, "source").when(k % 5 == 1, "clean").otherwise("assign")
    steps = blocks.where("k % 5 < 4").select("fn_id", "block", kind.alias("kind"), _letter(k).alias("target"), F.array(_letter(k + 1), _letter(k + 2)).alias("read"))
    return fixpoint.tainted(edges, steps)


_LCOV_SQL = """v AS (SELECT user_id, event_id, (minute(ts) + 1)::INT AS line, event_type, value, second(ts) AS branch FROM events),
    b AS (SELECT user_id, line, branch, bool_or(value > 50) AS hit FROM v WHERE event_type = 'click' GROUP BY ALL),
    h AS (SELECT user_id, line, count(*) AS branches, count(*) FILTER (hit) AS covered_branches FROM b GROUP BY ALL),
    l AS (SELECT user_id, line, bool_or(value > 50) FILTER (event_type = 'view') AS covered, coalesce(bool_or(value > 50) FILTER (event_type = 'view') <> bool_and(value > 50) FILTER (event_type = 'view'), false) AS contradiction
        FROM v WHERE event_type IN ('click', 'view') GROUP BY ALL)"""


def _lcov(spark, sf_dir: str) -> DataFrame:
    """A report a user: views are DA entries, clicks BRDA, purchases bad lines, errors unknown tags; the rest stands outside of the record."""
    v = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.minute("ts") + 1).cast("string").alias("line"), F.when(F.col("value") > 50, "3").otherwise("0").alias("hits"), F.second("ts").cast("string").alias("branch"))
    row = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("DA:"), "line", F.lit(","), "hits"))
        .when(F.col("event_type") == "click", F.concat(F.lit("BRDA:"), "line", F.lit(",0,"), "branch", F.lit(","), F.when(F.col("hits") == "0", "-").otherwise("1")))
        .when(F.col("event_type") == "purchase", "DA:x,1")
        .when(F.col("event_type") == "error", "nonsense")
    )
    per_user = v.withColumn("row", row).where("row is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "row"))).alias("r"))
    text = F.concat(F.lit("TN:\nSF:src/"), F.col("user_id").cast("string"), F.lit(".c\n"), F.array_join("r.row", "\n"), F.lit("\nend_of_record\nDA:9,1\n"))
    return imports.lcov(per_user.select(F.col("user_id").alias("input_id"), text.alias("text")))


@query(f"""WITH {_LCOV_SQL} SELECT 'src/' || user_id || '.c' AS path, line, covered, coalesce(branches, 0) AS branches, coalesce(covered_branches, 0) AS covered_branches, contradiction FROM l LEFT JOIN h USING (user_id, line)""")
def lcov_import(spark, sf_dir):
    """Coverage reports, parsed and merged."""
    return assessment.merged_coverage(_lcov(spark, sf_dir).where("problem is null"))


@query(
    """SELECT user_id AS input_id, problem, count(*) AS n FROM (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'bad line' WHEN 'error' THEN 'unknown tag' END AS problem FROM events) WHERE problem IS NOT NULL GROUP BY ALL
    UNION ALL SELECT DISTINCT user_id, 'outside a record', 1 FROM events WHERE event_type IN ('view', 'click', 'purchase', 'error')"""
)
def lcov_problems(spark, sf_dir):
    """What is wrong with coverage reports."""
    return _lcov(spark, sf_dir).where("problem is not null").groupBy("input_id", "problem").agg(F.count("*").alias("n"))


#: Fixes that the lines above get: language, part of the line, what it becomes.
FIXED = (
    ("javascript", "== true", ""),
    ("javascript", "secure: false", "secure: true"),
    ("javascript", "x.a = x.a", ""),
    ("javascript", "// NOSONAR", ""),
    ("javascript", "async", ""),
    ("go", "0755", "0750"),
    ("go", "x = x", ""),
    ("go", "== true", ""),
    ("go", "1024", "2048"),
    ("go", "0o644", "0o600"),
    ("rust", "x.a = x.a", ""),
    ("rust", ";;", ";"),
    ("csharp", "Secure = false", "Secure = true"),
    ("csharp", "SslProtocols.Tls11", "SslProtocols.Tls12"),
    ("csharp", "CipherMode.ECB", "CipherMode.CBC"),
    ("python", "# noqa: F401", ""),
    ("python", "# why # NoSec B602", ""),
)


@query(
    f"""WITH {_EXPECTED_SQL}, {values("fixes", "language, part, becomes", FIXED)}, l AS (SELECT path, language, sl, max(becomes IS NOT NULL)::INT AS edits, any_value(CASE WHEN becomes IS NULL THEN line ELSE replace(line, part, becomes) END) AS line
        FROM (SELECT o.path, o.language, o.sl, texts.line, fixes.part, becomes FROM o JOIN texts USING (language, pick) LEFT JOIN fixes ON fixes.language = o.language AND contains(texts.line, fixes.part)) GROUP BY path, language, sl)
    SELECT path, language, string_agg(line, chr(10) ORDER BY sl) AS text, sum(edits)::BIGINT AS edits, 0::BIGINT AS conflicts FROM l GROUP BY path, language HAVING sum(edits) > 0"""
)
def fixed_programs(spark, sf_dir):
    """Files with the fixes of their findings applied."""
    f = _programs(spark, sf_dir)
    return fixes.fixed(f, lexical_rules.lexical_findings(f)).withColumn("edits", F.col("edits").cast("long"))


@query(
    f"""WITH {_EXPECTED_SQL}, {values("fixes", "language, part, becomes", FIXED)}, k AS (SELECT o.path, (SELECT count(*) FROM expected e WHERE e.language = o.language AND e.pick = o.pick AND e.part IS NOT NULL) AS before,
        (SELECT count(*) FROM fixes x WHERE x.language = o.language AND contains(texts.line, x.part)) AS edits FROM o JOIN texts USING (language, pick))
    SELECT path, true AS accepted, sum(before)::BIGINT AS before, sum(before - edits)::BIGINT AS after, sum(edits)::BIGINT AS edits FROM k GROUP BY path HAVING sum(edits) > 0"""
)
def verified_fixes(spark, sf_dir):
    """Fixed files, analysed again: accepted where findings became fewer and no rule has more."""
    f = _programs(spark, sf_dir)
    return fixes.verified(f).withColumn("edits", F.col("edits").cast("long"))


#: Seed and lines of a synthetic file.
SEED, FILE_LINES = 42, 50


def synthetic_files(files: DataFrame, seed: int = SEED) -> DataFrame:
    """path, language, text of a seeded file for each ``id``: line j of file i is chosen by a hash of seed, i and j, the same on every cluster."""
    ids = files.select("id", F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("id") % len(LANGUAGES)).cast("int") + 1).alias("language"))
    rows = ids.select("id", "language", F.explode(F.sequence(F.lit(0), F.lit(FILE_LINES - 1))).alias("line"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("line").cast("string"))), 1, 8), 16, 10).cast("long")
    text = F.lit("")
    for name, options in LINES.items():
        text = F.when(F.col("language") == name, _pick([o[0] for o in options], (key % len(options)).cast("int"))).otherwise(text)
    whole = rows.groupBy("id", "language").agg(F.array_sort(F.collect_list(F.struct("line", text.alias("t")))).alias("l"))
    return whole.select(F.concat("language", F.lit("/"), F.col("id").cast("string")).alias("path"), "language", F.array_join("l.t", "\n").alias("text"))


@query(
    f"""WITH {_LANGUAGE_SQL}, i AS (SELECT s_suppkey AS id FROM supplier), l AS (SELECT id, unnest(range({FILE_LINES})) AS line FROM i),
    k AS (SELECT id, language, line, ((('0x' || left(md5('{SEED}:' || id || ':' || line), 8))::BIGINT) % options)::INT AS pick FROM l JOIN languages ON rank = id % {len(LANGUAGES)}),
    {values("texts", "language, pick, text", _OPTIONS)}, t AS (SELECT language, id, string_agg(text, chr(10) ORDER BY line) AS text FROM k JOIN texts USING (language, pick) GROUP BY ALL)
    SELECT language, count(*) AS files, sum(length(text))::BIGINT AS chars, bit_xor(('0x' || left(md5(text), 15))::BIGINT) AS checksum FROM t GROUP BY language"""
)
def synthetic_benchmark(spark, sf_dir):
    """The synthetic workload by language: files, characters, and a checksum that shows that it is the same everywhere."""
    f = synthetic_files(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))
    check = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")
    return f.groupBy("language").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"), F.bit_xor(check).alias("checksum"))
