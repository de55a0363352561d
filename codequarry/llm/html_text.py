"""Main text of web pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors, discounted by link density; the
best container and the siblings that score like it, or are plain text, are kept. Before scoring, parts
that are never article text leave the tree: elements and roles made for menus, headers, footers,
sidebars, forms, scripts and the like, what readers wrote, and elements of which a class or id has a word
that says so (paragraphs only go if it says nothing else). Sizes play no part in that: such an element stays only if all of the page's articles
(or main parts) are in it, or if the page has no text elsewhere. The header of an article and labels inside
paragraphs belong to the text.

A null or empty page, or one without text, gives an empty text. Pages of any length and depth take
time that grows with their length; repeated rows give repeated results; other columns, whatever their
names, are left out.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)>?", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe template noembed noframes".split())
#: Elements that hold no article text.
DROPPED = frozenset(
    "script style noscript template head title nav header footer aside form iframe svg math canvas button input select textarea option dialog menu object video audio map figure-menu".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An opening tag ends the open elements on the right, up to the nearest of the barrier.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of class, id and role that mark what isn't article text. Fixed values.
OUTSIDE = frozenset(
    """ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc skip masthead topbar header footer
    sidebar side aside rail widget widgets related recommended recommendations trending popular outbrain taboola
    cookie cookies consent gdpr notice notices banner banners alert popup modal overlay paywall newsletter subscribe
    subscription signup login social share sharing sharebar follow comment comments commentlist disqus respond replies
    complementary contentinfo search form hidden legal copyright disclaimer""".split()
)
_OUTSIDE_HINT = re.compile("|".join(sorted(OUTSIDE, key=lambda w: (-len(w), w))), re.I)
#: Words that only say where or how something stands, and words of what is likely the article. Fixed values.
LAYOUT = frozenset(
    """area bar block bottom box button buttons column container content inner item items left link links list main mobile
    outer page panel primary region right row secondary section site slot small text title top unit wrap wrapper""".split()
)
LIKELY = frozenset("article body content entry main post story text".split())
#: Words after which a class only tells what stands beside. Fixed values.
BESIDE = frozenset("with has have no not without".split())
#: Elements that a class with a telling word among others drops; paragraphs and what is in them stay.
CONTAINERS = frozenset("div section ul ol dl table center figure details".split())
KEPT = frozenset("html body article main".split())
#: Items of a list of links at least this long on average make references rather than a menu.
REFERENCE = 25


class _Node:
    __slots__ = ("tag", "parent", "items", "drop", "doubt", "score", "chars", "linked", "commas")

    def __init__(self, tag: str, parent: _Node | None, doubt: int = 0):
        self.tag, self.parent, self.doubt = tag, parent, doubt
        self.drop = doubt == _CERTAIN
        self.items: list[_Node | str] = []
        self.score = 0.0
        self.chars = self.linked = self.commas = 0


_CERTAIN, _READERS, _NAMED, _MENTIONED, _FORM = 5, 4, 3, 2, 1
#: Words of what readers wrote. Fixed values.
READERS = frozenset("comment comments commentlist disqus respond replies".split())


def _outside(tag: str, attrs: str, parent: _Node) -> int:
    """How sure it is that an element is no part of the article: certain, what readers wrote, named so, named so among
    other things, a form, or 0."""
    if tag in ("form", "fieldset"):
        return _FORM
    if tag == "header" or tag == "label":
        own = ("article", "main") if tag == "header" else ("p", "li", "td", "dd", "blockquote")
        while parent is not None and parent.tag not in own:
            parent = parent.parent
        if parent is None:
            return _CERTAIN
    elif tag in DROPPED:
        return _CERTAIN
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return 0
    doubt = 0
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if tag in ("html", "body"):
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return _CERTAIN
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return _CERTAIN
        if name in ("class", "id", "role", "aria-label") and _OUTSIDE_HINT.search(value):
            tokens = [[w for w in re.split(r"[^a-z]+", t) if w] for t in value.split()]
            words = [w for w in tokens if BESIDE.isdisjoint(w) and not OUTSIDE.isdisjoint(w)]
            if any(not READERS.isdisjoint(w) for w in words):
                doubt = _READERS
            elif words and tag not in KEPT and tag != "header":
                only = any(all(x in OUTSIDE or x in LAYOUT for x in w) for w in words) and not any(w and LIKELY.issuperset(w) for w in tokens)
                doubt = max(doubt, _NAMED if only else _MENTIONED if tag in CONTAINERS else 0)
    return doubt


def parse(page: str) -> _Node:
    """A tolerant tree: unclosed and misnested tags never lose text."""
    root = _Node("#root", None)
    node, at = root, 0
    end = len(page)
    unclosed: dict[str, int] = {}

    def leave(top: _Node) -> _Node:
        """Closes everything up to and with ``top``."""
        here = node
        while here is not top.parent:
            unclosed[here.tag] -= 1
            here = here.parent
        return here

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            break
        if m.start() > at:
            node.items.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[6]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[5], m[3] or m[7] or ""
        if closing:
            if unclosed.get(tag):
                top = node
                while top.tag != tag:
                    top = top.parent
                node = leave(top)
            continue
        if tag in BLOCK and unclosed.get("p"):
            top = node  # a block ends an open paragraph
            while top is not root and top.tag not in BLOCK:
                top = top.parent
            if top.tag == "p":
                node = leave(top)
        if tag in CLOSES and any(map(unclosed.get, CLOSES[tag][0])):
            ends, barrier = CLOSES[tag]
            top, found = node, None
            while top is not root and top.tag not in barrier:
                if top.tag in ends:
                    found = top
                top = top.parent
            if found:
                node = leave(found)
        child = _Node(tag, node, _outside(tag, attrs, node))
        node.items.append(child)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            if tag in ("textarea", "title") and not child.drop:
                child.items.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            node = child
            unclosed[tag] = unclosed.get(tag, 0) + 1
    if at < end:
        node.items.append(page[at:])
    _settle(root)
    return root


def _settle(root: _Node) -> None:
    """Drops what is no part of the article, but for elements that hold all articles of the page. Where there is no text
    elsewhere, forms stay; where there is none in forms either, elements named among other things; and where there is
    none in these, of the rest those that hold paragraphs, or all if none does."""
    order, inside, articles = [], [0] * 6, 0
    found = {_FORM: False, _MENTIONED: False, _NAMED: False}  # whether there is text in nothing of a level or above it
    paragraphs: set[int] = set()
    for node, text, entering in _walk(root):
        if text is not None:
            if not inside[_READERS] and not text.isspace():
                for level in found:
                    found[level] = found[level] or not any(inside[level:_READERS])
            continue
        inside[node.doubt] += 1 if entering else -1
        if entering:
            order.append(node)
            if node.tag in ("article", "main") and not inside[_READERS]:
                articles += 1
                node.chars += 1
            if node.tag == "p" and not inside[_READERS]:
                paragraphs.add(id(node))
    for n in reversed(order):
        if n.parent is not None:
            n.parent.chars += n.chars
            if id(n) in paragraphs:
                paragraphs.add(id(n.parent))
    told = any(n.doubt == _NAMED and id(n) in paragraphs for n in order)
    for n in order:
        elsewhere = n.doubt in found and (found[n.doubt] or any(found[k] for k in found if k < n.doubt) or n.doubt == _NAMED and told and id(n) not in paragraphs)
        n.drop = n.doubt == _READERS or elsewhere and not (articles and n.chars == articles)
    for n in order:
        n.chars = 0


def _walk(root: _Node):
    """(node, entering) pairs and (text, node) pairs in page order, without recursion."""
    stack: list = [(root, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0:
            yield node, None, True
        while i < len(node.items):
            x = node.items[i]
            i += 1
            if isinstance(x, str):
                yield node, x, True
            elif not x.drop:
                stack.append((node, i))
                stack.append((x, 0))
                break
        else:
            yield node, None, False


def _measure(root: _Node) -> list[_Node]:
    """Fills in counts of text; returns the kept elements in page order."""
    order, links = [], 0
    for node, text, entering in _walk(root):
        if text is not None:
            t = _SPACE.sub(" ", text).strip()
            if t:
                node.chars += len(t)
                node.commas += t.count(",") + t.count("、") + t.count("，")
                if links:
                    node.linked += len(t)
        elif entering:
            order.append(node)
            links += node.tag == "a"
        else:
            links -= node.tag == "a"
    return order


def _density(node: _Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def best_nodes(root: _Node) -> list[_Node]:
    """The best container with the siblings to keep, in page order."""
    order = _measure(root)
    own: dict[int, tuple[int, int]] = {id(n): (n.chars, n.commas) for n in order}
    direct: dict[int, list[int]] = {}
    for n in reversed(order):  # children come after their parents
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
            if n.tag not in BLOCK:  # words in inline elements belong to the block around
                a, b = own[id(n)]
                c, d = own[id(n.parent)]
                own[id(n.parent)] = (a + c, b + d)
    for n in order:
        chars, commas = own[id(n)]
        if n.tag in BLOCK and chars:
            points = (1 + commas + min(chars / 100, 3)) * (1 - _density(n)) / (1 + (n.doubt > 0))
            up, level = n if n.tag not in ("p", "li", "td", "pre", "h1", "h2", "h3", "h4", "h5", "h6") else n.parent, 0
            while up is not None:
                up.score += points / (1, 2)[level] if level < 2 else points / (level * 3)
                up, level = up.parent, level + 1
            direct.setdefault(id(n.parent), []).append(chars)
    best, top = None, 0.0
    for n in order:
        if n.tag in ("article", "main") and n.score:
            n.score = n.score * 2 + 25
        score = n.score * (1 - _density(n))
        if score > top:
            best, top = n, score
    if best is None:
        return [root] if root.chars else []
    if best.parent is None or best.tag in ("body", "html", "main"):
        return [best]
    kept, need = [], max(10.0, top * 0.2)
    for x in best.parent.items:
        if isinstance(x, str) or x.drop:
            continue
        good = x.score * (1 - _density(x)) >= need
        words = x.tag in BLOCK and x.chars and _density(x) < 0.25
        if x is best or good or words:
            kept.append(x)
    return kept


def _entries(node: _Node) -> int:
    """How many entries a list or table has."""
    return max(1, sum(1 for x in node.items if not isinstance(x, str) and x.tag in ("li", "dt", "dd", "tr", "tbody")))


def blocks_of(nodes: list[_Node]) -> list[str]:
    """Texts of the blocks in page order; lists and tables that are mostly links are menus and go."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            t = _SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")
            if t:
                out.append(t)
            parts.clear()

    for top in nodes:
        skip = 0
        for node, text, entering in _walk(top):
            if text is not None:
                if not skip:
                    parts.append(text)
                continue
            menu = node.tag in ("ul", "ol", "dl", "table") and node is not top and node.chars and _density(node) > 0.66 and node.chars < REFERENCE * _entries(node)
            if menu:
                skip += 1 if entering else -1
            if node.tag in BLOCK:
                flush()
            elif node.tag in VOID and entering:
                parts.append(" ")
        flush()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks_of(best_nodes(parse(page)))) if page else ""


def extract_main_text(df: DataFrame, page: str = "html", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns with the page's main text and n_chars, its code points."""
    columns = [f for f in df.schema.fields if f.name in keep]
    out = df.select(*keep).withColumns({text: F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*(f.name for f in columns), text, "n_chars"])

    page_column = F.col(page).alias("__page")
    return arrow_map(df.select(page_column, *(F.col(c.name) for c in columns)), run, out)
