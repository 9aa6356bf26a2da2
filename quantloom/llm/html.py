"""HTML main text by composite text density.

A page is read into a tree (unclosed and misnested tags as browsers do, cut-off pages as
far as they go), in time linear in its length. For every node the composite text density is
computed: characters per tag, adjusted by the share of link text. A node's density sum is
that of its children. From the node of the largest sum up to the body, the least density
is the threshold; below each node that reaches it, the subtree of the largest sum is main
text. A selected part within an ``article`` or ``main`` element stands for all of it.

Elements that never hold main text (scripts, styles, controls, menus) are no part of the
tree's text. Elements that may not hold it (forms, asides, page headers and footers, and
those whose class, id or role says so) are left out first, but what density says goes
before names: an element around the node of the largest density sum of the whole page is
left out only if the rest has a main text of its own, of a length beside it. A word that is
only part of a compound name (``share-price-story``) counts where the element's own text is
short or mostly links; words for readers' comments count in compounds, too; after ``has``,
``no``, ``with`` and the like (``has-sidebar``) none counts.

Text: character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined in page order by one space.

Defined cases: null html is an empty page, which gives an empty text; markup of any size
and depth is read by loops, not recursion; a page without a body element is its own body;
repeated rows are extracted alike; extra columns pass through.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# fixed values: elements by their role in HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th"
    " thead tr ul video audio".split()
)
CLOSES_P = BLOCK - frozenset("br body head html caption dd dt button option tbody td tfoot th thead tr legend select video audio".split())
NEVER_TAGS = frozenset(
    "script style noscript template iframe object embed svg canvas button input select textarea nav menu dialog"
    " head title link meta map audio video".split()
)
SELDOM_TAGS = frozenset("aside footer form header".split())
# fixed values: words of classes, ids and roles that mark what is seldom main text
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs consent cookie cookies gdpr"
    " footer foot footnav header masthead topbar menu menus nav navbar navigation navi pagination pager sidebar aside sidenav widget"
    " widgets popup modal overlay newsletter subscribe subscription signup login register search searchbox share sharing social related"
    " recommended recommendations promo promoted promotion sponsor sponsored sponsors notice notices notification notifications alert"
    " disclaimer copyright legal toolbar skip form complementary contentinfo teaser teasers outbrain taboola tracking".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond reactions discussion".split())
NEGATIONS = frozenset("has have no non not with without".split())
#: Shares of link text from which, and plain characters below which, a part of a compound name counts.
LINKED, SHORT = 1 / 3, 200
#: What the rest of a page needs to stand for itself: characters, and share of a named or a half-named element's.
LEAST, BESIDE_NAMED, BESIDE_HALF = 100, 0.05, 0.35
WEAK, STRONG = 1, 2
_SCOPES = frozenset("td th table article main body".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*?)(/?)(?:>|$)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Node:
    __slots__ = ("chars", "children", "density", "gone", "link_chars", "link_tags", "named", "never", "own", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.never, self.named, self.gone = tag, parent, False, 0, False
        self.children: list[Node | str] = []

    def kept(self) -> Iterator[Node]:
        return (c for c in self.children if not isinstance(c, str) and not c.gone)


def _named(tag: str, attributes: str, in_article: bool) -> int:
    """How surely tag and attributes say that an element is no main text: 0, WEAK or STRONG."""
    if tag in SELDOM_TAGS and not (tag == "header" and in_article):
        return STRONG
    if tag in ("html", "body", "article", "main") or not attributes:
        return 0
    found = 0
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return STRONG
        if name not in ("class", "id", "role"):
            continue
        for token in value.split():
            whole, words = token.lower(), {w.lower() for w in _WORD.findall(token)}
            if in_article and "header" in words or words & NEGATIONS:
                continue
            if whole in NOISE_WORDS or words & COMMENT_WORDS:
                return STRONG
            if words & NOISE_WORDS:
                found = WEAK
    return found


def parse(page: str) -> Node:
    """The tree of a page; comments and declarations left out.

    Each scope (table cell, article, ...) counts its open tags, so that a search for an
    open element runs only where there is one; what is searched through is then closed.
    """
    root = node = Node("#root", None)
    at, size = 0, len(page)
    open_tags: dict[str, int] = {}
    scopes: list[dict[str, int]] = [{}]

    def enter(x: Node) -> None:
        open_tags[x.tag] = open_tags.get(x.tag, 0) + 1
        scopes[-1][x.tag] = scopes[-1].get(x.tag, 0) + 1
        if x.tag in _SCOPES:
            scopes.append({})

    def leave(x: Node) -> Node:
        if x.tag in _SCOPES:
            scopes.pop()
        scopes[-1][x.tag] -= 1
        open_tags[x.tag] -= 1
        return x.parent

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end() if m.end() > m.start() else m.start() + 1
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            # an inline end tag closes nothing beyond its scope
            if (open_tags if tag in BLOCK else scopes[-1]).get(tag):
                while node.tag != tag:
                    node = leave(node)
                node = leave(node)
            continue
        # what an opening tag closes by itself
        shut: tuple[str, ...] = ()
        if tag in CLOSES_P:
            shut = ("p",)
        elif tag in ("dd", "dt"):
            shut = ("dd", "dt", "p")
        elif tag in ("td", "th"):
            shut = ("td", "th", "p")
        elif tag in ("tr", "tbody", "thead", "tfoot"):
            shut = ("td", "th", "tr", "p", *(("tbody", "thead", "tfoot") if tag != "tr" else ()))
        elif tag == "option":
            shut = ("option",)
        if tag == "li":
            shut = ("li", "p")
        if any(open_tags.get(t) for t in shut):
            up, target = node, None
            stops = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",)}.get(tag, ()) + ("table", "article", "main", "section", "body", "#root", "button")
            if tag in CLOSES_P and tag != "li":
                stops = (*stops, "td", "th", "li", "div", "blockquote", "dd", "aside", "nav", "form", "header", "footer")
            while up.tag not in stops:
                if up.tag in shut:
                    target = up
                up = up.parent
            if target is not None:
                while node is not target:
                    node = leave(node)
                node = leave(node)
        new = Node(tag, node)
        new.never = tag in NEVER_TAGS
        new.named = 0 if new.never else _named(tag, m[3], bool(open_tags.get("article") or open_tags.get("main")))
        node.children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            new.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not (m[4] and tag in ("svg", "path")):
            node = new
            enter(new)
    return root


def _order(root: Node) -> list[Node]:
    """The nodes that are kept, each before its children."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(x.kept())
    return out


def _measure(nodes: list[Node]) -> None:
    """Characters, tags, link characters and link tags of every subtree, bottom up."""
    for x in reversed(nodes):
        x.chars, x.tags, x.link_chars, x.link_tags = x.own, 0, 0, 0
        for c in x.kept():
            x.chars += c.chars
            x.tags += c.tags + 1
            x.link_chars += c.link_chars
            x.link_tags += c.link_tags
        if x.tag == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1


def _density(x: Node, body: Node) -> float:
    """Composite text density of a node."""
    if not x.chars:
        return 0.0
    plain = max(x.chars - x.link_chars, 1)
    base = math.log(x.chars / plain * x.link_chars + max(body.link_chars, 0) / max(body.chars, 1) * x.chars + math.e)
    ratio = (x.chars / max(x.link_chars, 1)) * (max(x.tags, 1) / max(x.link_tags, 1))
    return x.chars / max(x.tags, 1) * max(math.log(max(ratio, 1.0)) / math.log(max(base, math.e)), 0.0)


def _best(body: Node) -> tuple[list[Node], Node | None]:
    """The kept nodes with densities and density sums, and the one of the largest sum."""
    nodes = _order(body)
    _measure(nodes)
    if not body.chars:
        return nodes, None
    for x in nodes:
        x.density = _density(x, body)
    for x in nodes:
        x.sum = sum(c.density for c in x.kept())
        if x.own and x.tag in BLOCK | {"#root"}:
            x.sum = max(x.sum, x.density * x.own / x.chars)
    return nodes, max(nodes, key=lambda x: x.sum)


def _chosen(body: Node, nodes: list[Node], best: Node | None) -> list[Node]:
    """The subtrees of main text, none inside another."""
    if best is None:
        return []
    threshold, up = best.density, best
    while up is not body:
        up = up.parent
        threshold = min(threshold, up.density)
    # largest sum below each node, bottom up; the first in page order wins a tie
    top: dict[int, Node] = {}
    for x in reversed(nodes):
        found = x
        for c in x.kept():
            if top[id(c)].sum > found.sum:
                found = top[id(c)]
        top[id(x)] = found
    whole: dict[int, Node] = {}  # the outermost article or main element around a node
    for x in nodes:
        above = whole.get(id(x.parent)) if x is not body else None
        if above is not None or x.tag in ("article", "main"):
            whole[id(x)] = above or x
    chosen: set[int] = set()
    stack = [body]
    while stack:
        x = stack.pop()
        if x.density >= threshold and x.chars:
            found = top[id(x)]
            found = whole.get(id(found), found)
            chosen.add(id(found))
            stack.extend(c for c in x.kept() if c is not found)
    out, inside = [], set()
    for x in nodes:
        if id(x.parent) in inside and x is not body:
            inside.add(id(x))
        elif id(x) in chosen:
            inside.add(id(x))
            out.append(x)
    return out


def select(root: Node) -> list[Node]:
    """The subtrees of main text; what is not main text within them is marked as gone."""
    every, stack = [], [root]
    while stack:
        x = stack.pop()
        x.gone = x.never
        if not x.gone:
            x.own = sum(len("".join(_html.unescape(c).split())) for c in x.children if isinstance(c, str))
            every.append(x)
            stack.extend(c for c in x.children if not isinstance(c, str))
    body = next((x for x in every if x.tag == "body"), root)
    nodes, best = _best(body)
    named = [x for x in nodes if x.named == STRONG or x.named == WEAK and (x.chars - x.link_chars < SHORT or x.link_chars >= LINKED * x.chars)]
    if not named or best is None:
        return _chosen(body, nodes, best)
    path, up = set(), best
    while up is not None:
        path.add(id(up))
        up = up.parent
    plain = {id(x): x.chars - x.link_chars for x in named}
    for x in named:
        x.gone = x is not body
    around = [x for x in named if id(x) in path and x is not body]
    now = _chosen(body, *_best(body))
    if around:
        # the densest part of the page stands in an element whose name speaks against it
        outer = max(around, key=lambda x: plain[id(x)])
        share = BESIDE_NAMED if any(x.named == STRONG for x in around) else BESIDE_HALF
        if sum(x.chars - x.link_chars for x in now) < max(LEAST, share * plain[id(outer)]):
            for x in around:
                x.gone = False
            now = _chosen(body, *_best(body))
    return now


def _texts(root: Node, chosen: list[Node]) -> str:
    marks = {id(x) for x in chosen}
    parts: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        x, inside = stack.pop()
        if isinstance(x, str):
            if inside:
                parts.append(x if x == "\n" else _html.unescape(x))
            continue
        if x.gone:
            continue
        now = inside or id(x) in marks
        block = x.tag in BLOCK
        if block:
            stack.append(("\n", now))
        stack.extend((c, now) for c in reversed(x.children))
        if block:
            stack.append(("\n", now))
    return " ".join("".join(parts).split())


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    return _texts(root, select(root))


def extract_main_text(pages: DataFrame, html: str = "html", drop_html: bool = True) -> DataFrame:
    """``pages`` with text and n_chars (code points); columns of these names are replaced."""
    small_batches(pages.sparkSession)
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    kept = [c for c in names if c != html or not drop_html]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept) + ", text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[kept].assign(text=[extract(h) for h in pdf[html]])

    made = pages.select(names).mapInPandas(run, schema)
    return made.withColumn("n_chars", F.length("text").cast("long"))
