"""Rules on small sources: each bad text yields its key, each good one doesn't."""

import pytest

from codequarry.functions import python_facts, regex_facts
from codequarry.operators import flow, python_rules

BAD = {
    "S100": "class A:\n    def BadName(self):\n        return 1\n",
    "S1542": "def BadName():\n    return 1\n",
    "S101": "class bad_Name:\n    x = 1\n",
    "S107": "def f(" + ", ".join(f"a{i}" for i in range(14)) + "):\n    return a0\n",
    "S108": "if x:\n    pass\n",
    "S112": "raise Exception('x')\n",
    "S134": "if a:\n  for b in c:\n    while d:\n      with e:\n        if f:\n          g()\n",
    "S905": "x == 1\n",
    "S1045": "try:\n    f()\nexcept Exception:\n    g()\nexcept ValueError:\n    h()\n",
    "S1066": "if a:\n    if b:\n        c()\n",
    "S1067": "x = a and b and c and d and e\n",
    "S1142": "def f(x):\n    if x: return 1\n    if x: return 2\n    if x: return 3\n    return 4\n",
    "S1143": "def f():\n    try:\n        g()\n    finally:\n        return 1\n",
    "S1186": "def f():\n    pass\n",
    "S1244": "x == 1.5\n",
    "S1313": "a = '192.168.12.42'\n",
    "S1523": "eval(x)\n",
    "S1541": "def f(x):\n" + "".join(f"    if x == {i}:\n        g()\n" for i in range(16)),
    "S1607": "import pytest\n@pytest.mark.skip\ndef test_a():\n    assert f()\n",
    "S1656": "x = x\n",
    "S1720": "def public():\n    return 1\n",
    "S1751": "for a in b:\n    f(a)\n    break\n",
    "S1763": "def f():\n    return 1\n    g()\n",
    "S1764": "x = a - a\n",
    "S1862": "if a:\n    f()\nelif a:\n    g()\n",
    "S1871": "if a:\n    f()\nelif b:\n    f()\n",
    "S3923": "if a:\n    f()\nelse:\n    f()\n",
    "S1940": "x = not a == b\n",
    "S2190": "def f():\n    f()\n",
    "S2201": "len(x)\n",
    "S2208": "from a import *\n",
    "S2245": "random.random()\n",
    "S2612": "os.chmod('a', 0o777)\n",
    "S2710": "class A:\n    @classmethod\n    def f(self):\n        return 1\n",
    "S2711": "return 1\n",
    "S2733": "class A:\n    def __exit__(self):\n        return 1\n",
    "S2734": "class A:\n    def __init__(self):\n        return 1\n",
    "S2737": "try:\n    f()\nexcept ValueError:\n    raise\n",
    "S2757": "x =- 1\n",
    "S2761": "x = not not a\n",
    "S2823": "__all__ = [f]\n",
    "S2836": "for a in b:\n    f()\nelse:\n    g()\n",
    "S3403": "x is [1]\n",
    "S3626": "for a in b:\n    f()\n    continue\n",
    "S3776": "def f(a):\n    if a:\n        for b in a:\n            while b:\n                if b:\n                    if a:\n                        if c:\n                            g()\n",
    "S3801": "def f(a):\n    if a:\n        return 1\n    return\n",
    "S3981": "x = len(a) >= 0\n",
    "S3984": "ValueError('x')\n",
    "S4721": "subprocess.run(x, shell=True)\n",
    "S4790": "hashlib.md5(x)\n",
    "S4830": "requests.get(u, verify=False)\n",
    "S5042": "t.extractall()\n",
    "S5332": "u = 'http://a.com'\n",
    "S5443": "p = '/tmp/x'\n",
    "S5445": "tempfile.mktemp()\n",
    "S5632": "raise 'x'\n",
    "S5704": "def f():\n    raise\n",
    "S5709": "class A(BaseException):\n    x = 1\n",
    "S5713": "try:\n    f()\nexcept (ValueError, Exception):\n    g()\n",
    "S5717": "def f(a=[]):\n    return a\n",
    "S5719": "class A:\n    def f():\n        return 1\n",
    "S5720": "class A:\n    def f(this):\n        return this\n",
    "S5722": "class A:\n    def __len__(self, x):\n        return 1\n",
    "S5727": "x = [] is None\n",
    "S5754": "try:\n    f()\nexcept:\n    g()\n",
    "S5780": "x = {'a': 1, 'a': 2}\n",
    "S5781": "x = {1, 1}\n",
    "S5797": "if True:\n    f()\n",
    "S5806": "def f():\n    list = 1\n    return list\n",
    "S5828": "open('a', 'rz')\n",
    "S5905": "assert (a, b)\n",
    "S6659": "x = a[:3] == 'abc'\n",
    "S6660": "x = type(a) == int\n",
    "S6661": "f = lambda x: x\n",
    "S6662": "x = {[1]: 2}\n",
    "S6725": "x = a == np.nan\n",
    "S6734": "df.drop('a', inplace=True)\n",
    "S6903": "datetime.utcnow()\n",
    "S7488": "async def f():\n    time.sleep(1)\n    await g()\n",
    "S7492": "any([x for x in y])\n",
    "S7494": "set(x for x in y)\n",
    "S7496": "list([1])\n",
    "S7498": "x = dict()\n",
    "S7500": "x = [a for a in b]\n",
    "S7503": "async def f(a):\n    g(a)\n    return h(a)\n",
    "S7504": "for a in list(b):\n    f(a)\n",
    "S7505": "map(lambda x: x, y)\n",
    "S7506": "x = {k: 0 for k in y}\n",
    "S7508": "x = sorted(sorted(a))\n",
    "S2260": "def (:\n",
    "S1192": "a = 'literal'\nb = 'literal'\nc = 'literal'\n",
    "S4144": "def f(a):\n    x = a\n    y = x\n    return y\n\ndef g(a):\n    x = a\n    y = x\n    return y\n",
    "S1845": "class A:\n    def ab(self):\n        return 1\n    def aB(self):\n        return 2\n",
    "S1128": "import os\n",
    "S1481": "def f():\n    x = 1\n",
    "S1172": "def f(a):\n    g()\n    return h()\n",
    "S1144": "class A:\n    def __b(self):\n        return 1\n",
    "S4487": "class A:\n    def f(self):\n        self.__x = 1\n",
}
GOOD = '''"""Module."""
import os


class Shape:
    """A shape."""

    def __init__(self, side):
        self.side = side

    def area(self, scale=1):
        """The area."""
        if scale > 1:
            return self.side * scale
        return self.side


def total(shapes):
    """All areas."""
    out = 0
    for s in shapes:
        if s is None:
            continue
        out += s.area()
    try:
        return out + len(os.environ)
    except (KeyError, ValueError) as e:
        raise RuntimeError("failed") from e
'''


@pytest.fixture(scope="module")
def findings(spark):
    rows = [(f"{k}.py", v) for k, v in BAD.items()] + [("good.py", GOOD), ("empty.py", ""), ("null.py", None)]
    nodes = python_facts.nodes(spark.createDataFrame(rows, "path string, text string")).persist()
    return python_rules.python_findings(nodes).collect()


@pytest.mark.parametrize("key", BAD)
def test_bad(findings, key):
    assert key in {r.rule_key for r in findings if r.path == f"{key}.py"}


def test_good(findings):
    assert [r for r in findings if r.path in ("good.py", "empty.py", "null.py")] == []


def test_positions(findings):
    assert {(r.sl, r.sc, r.el, r.ec) for r in findings if r.path == "S1764.py" and r.rule_key == "S1764"} == {(1, 4, 1, 9)}


def naive(n, edges):
    reach = {0}
    while True:
        more = reach | {b for a, b in edges if a in reach}
        if more == reach:
            return reach
        reach = more


def test_graphs_of_three_blocks_against_naive_search():
    pairs = [(a, b) for a in range(3) for b in range(3)]
    for mask in range(1 << 9):
        edges = {p for i, p in enumerate(pairs) if mask >> i & 1}
        g = flow.Graph(3, edges)
        live = naive(3, edges)
        assert flow.reachable(g) == live
        to = {a: {b for b in range(3) if b in naive_from(a, edges)} for a in range(3)}
        label = flow.components(g)
        for a in range(3):
            for b in range(3):
                assert (label[a] == label[b]) == (a == b or (b in to[a] and a in to[b]))
        idom = flow.dominators(g)
        for b in range(3):
            if b in live and b:
                doms = {d for d in live if b not in naive(3, {e for e in edges if d not in e}) or d == 0} - {b}
                assert idom[b] in doms and all(x == idom[b] or x in doms_of(idom[b], live, edges) for x in doms)
        before, after = flow.reaching(g, [{"x"}, {"y"}, {"x"}])
        assert [b for b in range(3) if after[b] is not None] == sorted(live)


def naive_from(a, edges):
    out = {b for x, b in edges if x == a}
    while True:
        more = out | {b for x, b in edges if x in out}
        if more == out:
            return out
        out = more


def doms_of(b, live, edges):
    return {d for d in live if d == 0 or b not in naive(3, {e for e in edges if d not in e})} | {b}


def test_deep_graphs_and_nesting():
    g = flow.Graph(30000, {(i, i + 1) for i in range(29999)} | {(29999, 0)})
    assert len(flow.reachable(g)) == 30000 and set(flow.components(g)) == {0} and flow.dominators(g)[-1] == 29998
    spec = [("stmt", {"x"}, set())]
    for _ in range(20000):
        spec = [("if", set(), spec, [])]
    assert len(flow.reachable(flow.Lowering(spec).graph)) == 20003


def test_liveness_and_taint():
    low = flow.Lowering([("stmt", {"a"}, set()), ("loop", {"i"}, {"a"}, [("if", {"i"}, [("break",)], [("stmt", {"b"}, {"i"})])], []), ("return", {"b"})])
    before, _ = flow.liveness(low.graph, low.uses, low.defs)
    assert before[0] == {"b"}
    g = flow.Graph(3, {(0, 1), (1, 2)})
    _, after = flow.taint(g, [[("source", "a", ())], [("assign", "b", ("a",)), ("clean", "a", ())], [("assign", "c", ("a",))]])
    assert after[2] == {("b", 0)}


def test_dead_stores(spark):
    text = "def f(a):\n    x = 1\n    x = 2\n    for i in a:\n        y = i\n        y = g(y)\n    return x\n\ndef g(b):\n    z = 1\n    if b:\n        z = 2\n    return z\n"
    rows = flow.dead_store_findings(spark.createDataFrame([("a.py", text), ("b.py", None), ("c.py", "def (")], "path string, text string")).collect()
    assert sorted((r.line, r.name) for r in rows) == [(2, "x"), (6, "y")]


def test_graph_facts(spark):
    rows = flow.graph_facts(spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 2, 1), ("f", 3, 2)], "fn_id string, src int, dst int")).orderBy("block").collect()
    assert [(r.reachable, r.component, r.in_cycle, r.idom) for r in rows] == [(True, 0, False, None), (True, 1, True, 0), (True, 1, True, 1), (False, 3, False, None)]


def test_graph_facts_take_any_block_ids(spark):
    rows = flow.graph_facts(spark.createDataFrame([("f", 0, 10**12), ("f", 10**12, 7), ("f", 7, 10**12), ("g", None, 1)], "fn_id string, src long, dst long")).orderBy("block").collect()
    assert [(r.block, r.component, r.idom) for r in rows] == [(0, 0, None), (7, 7, 10**12), (10**12, 7, 0)]


@pytest.mark.parametrize(
    ("key", "bad", "good"),
    [
        ("S5842", "(a*)*b", "(a+)*b"),
        ("S5843", "((a|b)+(c|d)?)+((e|f)*(g|h)+)*(i(j(k|l)+)+)+", "(a|b)+c?"),
        ("S5850", "^a|b", "^(?:a|b)"),
        ("S5850", "a|b$", "^a|^b"),
        ("S5856", "(a", "(a)"),
        ("S5869", "[a-zb]", "[a-z0]"),
        ("S5996", "a$b", "a$"),
        ("S5996", "a^b", "(?m)a^b"),
        ("S6019", "ab*?", "ab*?c"),
        ("S6323", "a||b", "a|b"),
        ("S6326", "a  b", "a b"),
        ("S6331", "a()b", "a(c)b"),
        ("S6353", "[0-9]+", "[1-9]+"),
        ("S6353", "a{0,1}", "a{0,2}"),
        ("S6396", "a{1}", "a{2}"),
        ("S6397", "[a]b", "[.]b"),
    ],
)
def test_regex_rules(key, bad, good):
    assert key in regex_facts.regex_rules(bad)
    assert key not in regex_facts.regex_rules(good)


@pytest.mark.parametrize(
    ("pattern", "text"),
    [("abc|d", ""), (r"x(?:abc)+y", "abc"), (r"(?<=\bos\.Mkdir(?:All)?\()0[0-7]+", "os.Mkdir"), ("(?i)abc", ""), ("a(?i:bcd)e", "a"), (r"ab?c\z", "a"), ("(?!abc)d", "d"), (r"[ab]cde\p{L}", "cde"), ("(a", ""), ("ab(cd)ef", "ab")],
)
def test_needed_texts(pattern, text):
    assert regex_facts.needed(pattern) == text


CHECKED = (
    ("S2275", "x = '%s %d' % (a,)", "x = '%s %%' % (a,)"),
    ("S2712", "def f():\n    yield 1\n    return 2", "def f():\n    yield 1\n    return"),
    ("S3862", "for x in 5:\n    f(x)", "for x in '5':\n    f(x)"),
    ("S4143", "a[1] = 2\na[1] = 3", "a[1] = 2\na[1] = a[1] + 3"),
    ("S5361", "x = re.sub('ab', 'c', y)", "x = re.sub('a.', 'c', y)"),
    ("S5607", "x = 'a' + 1", "x = 2.5 + 1"),
    ("S5642", "x = a in 5", "x = a in '5'"),
    ("S5644", "x = 5[0]", "x = '5'[0]"),
    ("S5706", "class A:\n    def __exit__(self, a, b, c):\n        raise b", "class A:\n    def __exit__(self, a, b, c):\n        raise d"),
    ("S5724", "class A:\n    @property\n    def a(self, b):\n        return b", "class A:\n    @property\n    def a(self):\n        return 1"),
    ("S5845", "self.assertEqual(1, 'a')", "self.assertEqual(1, 2)"),
    ("S5915", "with pytest.raises(A):\n    f()\n    assert b", "with pytest.raises(A):\n    f()\nassert b"),
    ("S6468", "try:\n    f()\nexcept* ExceptionGroup:\n    g()", "try:\n    f()\nexcept* ValueError:\n    g()"),
    ("S6553", "a = models.CharField(null=True)", "a = models.IntegerField(null=True)"),
    ("S6556", "render(a, b, locals())", "render(a, b, {})"),
    ("S6559", "class Meta:\n    fields = '__all__'", "class Meta:\n    fields = ['a']"),
    ("S6560", "x = JsonResponse([1])", "x = JsonResponse([1], safe=False)"),
    ("S6663", "x = a[1.5]", "x = a[1]"),
    ("S6714", "x = np.array(a for a in b)", "x = np.array([a for a in b])"),
    ("S6882", "x = datetime.date(2020, 13, 1)", "x = datetime.date(2020, 12, 1)"),
    ("S6883", "x = a.strftime('%H:%M %p')", "x = a.strftime('%I:%M %p')"),
    ("S6887", "x = datetime.datetime(2020, 1, 1, tzinfo=pytz.timezone('a'))", "x = datetime.datetime(2020, 1, 1, tzinfo=utc)"),
    ("S6890", "x = pytz.timezone('a')", "x = zoneinfo.ZoneInfo('a')"),
    ("S7511", "x = sorted(reversed(a))", "x = sorted(a)"),
    ("S7512", "for a, _ in b.items():\n    f(a)", "for a, c in b.items():\n    f(a)"),
    ("S8392", "app.run(host='0.0.0.0')", "app.run(host='127.0.0.1')"),
    ("S8412", "@app.api_route('/', methods=['GET'])\ndef f():\n    return 1", "@app.get('/')\ndef f():\n    return 1"),
    ("S8490", "@dataclass\nclass A:\n    a: int\n    def __init__(self):\n        f()", "class A:\n    def __init__(self):\n        f()"),
    ("S8492", "if a in b:\n    b.remove(a)", "if a in b:\n    c.remove(a)"),
    ("S8493", "def f():\n    yield 1\n    raise StopIteration", "def f():\n    raise StopIteration"),
    ("S8503", "x = a in []", "x = a in [1]"),
    ("S8504", "class A:\n    @property\n    def a(self):\n        f()", "class A:\n    @property\n    def a(self):\n        return f()"),
    ("S8509", "class A(B, B):\n    x = 1", "class A(B, C):\n    x = 1"),
    ("S8510", "for a in b:\n    for a in c:\n        f(a)", "for a in b:\n    for d in c:\n        f(a)"),
    ("S8512", "class A:\n    x = 1\n    x = 2", "class A:\n    x = 1\n    y = 2"),
    ("S8513", "x = a.startswith('b') or a.startswith('c')", "x = a.startswith('b') or d.startswith('c')"),
    ("S8515", "T = TypeVar('T', covariant=True, contravariant=True)", "T = TypeVar('T', covariant=True)"),
    ("S8517", "x = sorted(a)[-1]", "x = sorted(a)[1]"),
    ("S8518", "for i, v in enumerate(a):\n    f(a[i])", "for i, v in enumerate(a):\n    f(b[i])"),
    ("S8519", "x = list(a)[0]", "x = list(a)[1]"),
    ("S8520", "x = sum(a, [])", "x = sum(a, 0)"),
    ("S8521", "x = a in b.keys()", "x = a in b.values()"),
    ("S8554", "logging.info(f'{a}')", "logging.info('%s', a)"),
    ("S8572", "try:\n    f()\nexcept A:\n    logging.error('x')", "logging.error('x')"),
    ("S8685", "@dataclass\nclass A:\n    a: list = make()", "@dataclass\nclass A:\n    a: list = field(default_factory=list)"),
    ("S8900", "x = a.findAll('b')", "x = a.find_all('b')"),
    ("S9001", "@pytest.mark.xfail\ndef test_a():\n    f()", "@pytest.mark.xfail(reason='b')\ndef test_a():\n    f()"),
    ("S9076", "@pytest.yield_fixture\ndef a():\n    yield 1", "@pytest.fixture\ndef a():\n    yield 1"),
    ("S9077", "assert False", "assert False, 'why'"),
    ("S9083", "@pytest.fixture()\ndef a():\n    return 1", "@pytest.fixture\ndef a():\n    return 1"),
    ("S9084", "from pytest import raises", "import pytest"),
)


def test_checked_rules(spark):
    rows = [(f"{i}{kind}.py", text + "\n") for i, (_, bad, good) in enumerate(CHECKED) for kind, text in (("bad", bad), ("good", good))]
    nodes = python_facts.nodes(spark.createDataFrame(rows, "path string, text string"), kinds=python_rules.node_kinds())
    found = {(r.path, r.rule_key) for r in python_rules.node_findings(nodes).collect()}
    assert [(c[0], c[1]) for i, c in enumerate(CHECKED) if (f"{i}bad.py", c[0]) not in found] == []
    assert [(c[0], c[2]) for i, c in enumerate(CHECKED) if (f"{i}good.py", c[0]) in found] == []
    assert {c[0] for c in CHECKED} == {c[0] for c in python_rules.CHECKED} | {"S8572"}
