"""Pages of many shapes: what their classes say, forms, links, depth; and scoring against a slow version."""

import random
import time

import pytest

from codequarry.llm import html_text

WORDS = "Some plain words of an article, with a comma, which go on for a while and then end."


def page(body):
    return f"<html><head><title>T</title></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "wrapper",
    [
        '<div class="content side-by-side">{}</div>',
        '<div class="main search">{}</div>',
        '<div class="overlay-free">{}</div>',
        '<div class="page-header-wrapper">{}</div>',
        "<form action=x>{}</form>",
        '<form><div id="aspnetForm">{}</div></form>',
        '<section class="legal-story">{}</section>',
    ],
)
def test_classes_and_forms_around_the_article(wrapper):
    menu = "<nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies.</div>"
    assert html_text.main_text(page(menu + wrapper.format(f"<p>{WORDS}</p><p>{WORDS}</p>"))) == f"{WORDS}\n{WORDS}"


def test_parts_that_go():
    article = f"<article><p>{WORDS}</p><p class='follow-up'>Then more, and more of it.</p></article>"
    parts = [
        "<div class='sidebar-left'>Left.</div>",
        "<div class='site-footer'>End.</div>",
        "<div id='ad-slot-3'>Buy it, now.</div>",
        "<div class='newsletter signup box'>Join us.</div>",
        "<form class=login>Name <input></form>",
        f"<div id=comments><p>{'Nice, very nice, indeed it is. ' * 40}</p></div>",
        "<ul class=menu><li><a href=a>A</a></ul>",
        "<div hidden>Unseen.</div>",
    ]
    want = f"{WORDS}\nThen more, and more of it."
    for p in parts:
        assert html_text.main_text(page(p + article + p)) == want, p
        inside = article.replace("</article>", p + "</article>")
        assert html_text.main_text(page(inside)) == want, p


def test_references_stay_and_menus_go():
    references = "<ol>" + "".join(f"<li><a href=r{i}>A. Writer, On the matter of things, volume {i}</a></li>" for i in range(3)) + "</ol>"
    menu = "<ul><li><a href=a>News</a></li><li><a href=b>Sport</a></li></ul>"
    text = html_text.main_text(page(f"<article><p>{WORDS}</p>{menu}{references}</article>"))
    assert text.split("\n")[0] == WORDS and "volume 2" in text and "Sport" not in text


def test_deep_pages_take_time_that_grows_with_their_length():
    took = []
    for n in (4000, 32000):
        began = time.perf_counter()
        assert WORDS in html_text.main_text("<b>" * n + "</i>" * n + f"<p>{WORDS}</p>")
        took.append(time.perf_counter() - began)
    assert took[1] < 3


class Slow:
    """Scoring by recursion over finished trees."""

    def __init__(self, node):
        self.node = node
        self.kids = [Slow(x) if not isinstance(x, str) else x for x in node.items if isinstance(x, str) or not x.drop]

    def texts(self, linked=False):
        linked = linked or self.node.tag == "a"
        for k in self.kids:
            if isinstance(k, str):
                t = " ".join(k.split())
                if t:
                    yield t, linked
            else:
                yield from k.texts(linked)

    def own(self):
        """Texts of the block but not of blocks inside it."""
        for k in self.kids:
            if isinstance(k, str):
                t = " ".join(k.split())
                if t:
                    yield t
            elif k.node.tag not in html_text.BLOCK:
                yield from k.own()

    def density(self):
        every = list(self.texts())
        total = sum(len(t) for t, _ in every)
        return sum(len(t) for t, linked in every if linked) / total if total else 0.0

    def walk(self, above=()):
        yield self, above
        for k in self.kids:
            if not isinstance(k, str):
                yield from k.walk((self, *above))


def slow_best(root):
    tree = Slow(root)
    score = {}
    for s, above in tree.walk():
        own = list(s.own())
        if s.node.tag not in html_text.BLOCK or not own:
            continue
        chars, commas = sum(map(len, own)), sum(t.count(",") for t in own)
        points = (1 + commas + min(chars / 100, 3)) * (1 - s.density()) / (1 + (s.node.doubt > 0))
        takers = above if s.node.tag in ("p", "li", "td", "pre", "h1", "h2", "h3", "h4", "h5", "h6") else (s, *above)
        for level, t in enumerate(takers):
            score[id(t.node)] = score.get(id(t.node), 0.0) + points / (1 if level == 0 else 2 if level == 1 else 3 * level)
    best, top = None, 0.0
    for s, _ in tree.walk():
        n = score.get(id(s.node), 0.0)
        if s.node.tag in ("article", "main") and n:
            n = score[id(s.node)] = n * 2 + 25
        if n * (1 - s.density()) > top + 1e-9:
            best, top = s, n * (1 - s.density())
    if best is None:
        return []
    if best.node.parent is None or best.node.tag in ("body", "html", "main"):
        return [best.node]
    around = next(a[0] for s, a in tree.walk() if s.node is best.node)
    kept = []
    for k in around.kids:
        if isinstance(k, str):
            continue
        words = k.node.tag in html_text.BLOCK and list(k.texts()) and k.density() < 0.25
        if k.node is best.node or score.get(id(k.node), 0.0) * (1 - k.density()) >= max(10.0, top * 0.2) or words:
            kept.append(k.node)
    return kept


def random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        if kind < 0.35:
            out += f"<p>{rng.choice(['', 'Short. ', 'A, b, c. ', WORDS])}{rng.choice(['', '<a href=x>link, text</a>', '<b>bold</b>'])}</p>"
        elif kind < 0.5:
            out += rng.choice(["loose text, here ", "<a href=y>Elsewhere</a> ", "<h2>Head</h2>", "<ul><li>one, two<li><a href=z>three</a></ul>"])
        elif depth < 4:
            tag = rng.choice(["div", "section", "article", "div class='legal-matter'", "div class=sidebar", "td", "main"])
            out += f"<{tag}>{random_page(rng, depth + 1)}</{tag.split()[0]}>"
    return out


def test_scoring_against_a_slow_version():
    rng = random.Random(9)
    several = 0
    for _ in range(400):
        source = page(random_page(rng))
        root = html_text.parse(source)
        found = html_text.best_nodes(root)
        want = slow_best(html_text.parse(source))
        place = lambda nodes: [(n.tag, [x for x in n.items if isinstance(x, str)], len(n.items)) for n in nodes]
        if not want:
            assert not found or found == [root]
            continue
        assert place(found) == place(want), source
        several += len(found) > 1
    assert several > 20


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", page(f"<p>{WORDS}</p>"), "x"), (None, None, None, "y")], "page_id long, url string, html string, __page string")
    assert html_text.extract_main_text(df.limit(0), keep=("page_id", "url")).count() == 0
    rows = html_text.extract_main_text(df, keep=("page_id", "url")).collect()
    assert sorted(((r.page_id or 0), r.text, r.n_chars) for r in rows) == [(0, "", 0), (1, WORDS, len(WORDS))]


ARTICLE = "".join(f"<p>Paragraph {i} of the article, with some words, and more of them here.</p>" for i in range(3))
TEXT = "\n".join(f"Paragraph {i} of the article, with some words, and more of them here." for i in range(3))
LONG = "<p>" + "Other words that go on and on, a lot. " * 60 + "</p>"


def test_parts_go_by_name_whatever_their_size():
    names = "article-comments post-comments user-comments story-comments article-ad google-ad ad_300x250 post-footer entry-sidebar footer cookie-notice sidebar"
    for name in names.split():
        for attribute in ("class", "id"):
            assert html_text.main_text(f"<div class=post>{ARTICLE}</div><div {attribute}='{name}'>{LONG}</div>") == TEXT, name
    assert html_text.main_text(f"<div><p>Only this.</p></div><div class=comments>{LONG}</div>") == "Only this."
    assert html_text.main_text(f"<div>{ARTICLE}</div><article class='comment'>{LONG}</article>") == TEXT


def test_short_parts_titles_and_labels_stay():
    assert html_text.main_text(f"<article><section>{ARTICLE}</section><section><p>The end.</p></section></article>") == TEXT + "\nThe end."
    assert html_text.main_text(f"<div><div>{ARTICLE}</div><div><p>The end.</p></div></div>") == TEXT + "\nThe end."
    assert html_text.main_text(f"<header>Site</header><article><header><h1>Title</h1></header>{ARTICLE}</article>") == "Title\n" + TEXT
    assert html_text.main_text(f"<div>{ARTICLE}<p>Some <label>words</label> here.</p></div>") == TEXT + "\nSome words here."


def test_what_is_around_an_article_stays():
    for page in ("<fieldset><article>{}</article></fieldset>", "<form><div class=nav>x</div><div>{}</div></form>", "<div class='content sidebar-left'><article>{}</article></div><p>Imprint</p>", "<div class='with-sidebar'>{}</div>", "<div class='banner'><div>{}</div></div>"):
        assert html_text.main_text(page.format(ARTICLE)) == TEXT, page
    assert html_text.main_text(f"<div class=comments>{LONG}</div>") == ""


def test_all_white_space_in_a_block_is_one_space():
    assert html_text.main_text("<div><p>\u3000a\u0085b\u2003c\u3000\u2028d&nbsp;&emsp;e </p></div>") == "a b c d e"
