"""Main-text extraction by minimum-cut labelling of a page's text blocks.

A page becomes a row of text blocks, each with the path of elements it stands in. A linear
classifier over the path (elements, class and id words, roles), link density and length gives each
block a cost for either label; these are the capacities to the two terminals. On the path the sign nearest to the block
counts: an advert in an article is an advert, an article in a sidebar is no content. Blocks that
follow one another, or stand in the same element, are joined by edges that grow with their
closeness in the tree; a maximum flow finds the cheapest labelling. Where the path says something (STRONG), no
neighbours outweigh it; where it doesn't, as on pages whose class names mean nothing, they decide: a caption among
paragraphs stays, a sentence among links goes.

Everything is per page, in time and memory linear in the page up to the flow itself (what an element hands down is
worked out once, when it opens), so a page is a row and no shuffle takes place.

Defined results: null or empty html gives an empty text; broken markup is closed where browsers close
it; pages are independent, so repeated rows get equal results; other columns pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "script style noscript template svg math head title iframe object canvas audio video select textarea button".split()
)
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("table ul ol dl div article section body html td th form nav aside main header footer".split())

# Classifier weights; positive speaks for content. STRONG outweighs a block's own
# features (2.0 at most) and all its edges (3 * SMOOTHNESS at most).
STRONG, SMOOTHNESS = 7.0, 1.5
TAG_WEIGHT = {
    "article": 5.0, "main": 4.0, "nav": -STRONG, "footer": -STRONG, "aside": -STRONG, "form": -STRONG, "menu": -STRONG,
    "header": -STRONG, "dialog": -STRONG, "fieldset": -STRONG, "address": -4.0, "label": -3.0, "p": 1.0, "blockquote": 1.0,
    "pre": 1.0, "h1": 1.5, "h2": 0.5, "h3": 0.5, "figcaption": 0.5,
}
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices alert popup modal overlay sidebar sidebars rail menu menus nav navbar "
    "navigation breadcrumb breadcrumbs crumbs footer foot header masthead topbar toolbar comment comments reply replies "
    "respond disqus share sharing social follow related recommended recommendations trending newsletter subscribe "
    "subscription signup login register search widget widgets pagination pager copyright legal skip hidden".split()
)
CONTENT_WORDS = frozenset("article content post entry story maincontent articlebody body text prose".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
WORD_WEIGHT, CONTENT_WORD_WEIGHT, ROLE_WEIGHT, LINK_WEIGHT = -STRONG, 2.0, -STRONG, -6.0
BIAS = -0.5
#: Steps in the tree from which on two blocks aren't neighbours.
FAR = 40

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|$)",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    """An open element and what it hands down: signs of its path, the block it stands in, and how it is shown."""

    name: str
    depth: int
    parent: Element | None
    block: Element | None = None
    evidence: float = 0.0
    header_only: bool = False  # the one sign against the path is a header
    in_article: bool = False
    dropped: bool = False
    link: bool = False


def opened(name: str, attrs: str, parent: Element) -> Element:
    """A child of ``parent``; the nearest sign decides: content can't come back below boilerplate."""
    weight = element_weight(name, attrs)
    evidence = parent.evidence
    if weight < 0:
        evidence = max(-STRONG, min(0.0, evidence) + weight)
    elif evidence >= 0:
        evidence = min(STRONG - 1, evidence + weight)
    found = Element(
        name, parent.depth + 1, parent, None, evidence,
        parent.header_only if weight >= 0 else name == "header" and parent.evidence >= 0 and weight == TAG_WEIGHT["header"],
        parent.in_article or name in ("article", "main"), parent.dropped or name in DROPPED, parent.link or name == "a",
    )
    found.block = found if name in BLOCK else parent.block or parent
    return found


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0


def element_weight(name: str, attrs: str) -> float:
    """The classifier's share for standing in this element; the strongest boilerplate sign counts."""
    weight = TAG_WEIGHT.get(name, 0.0)
    if attrs and "=" in attrs or "hidden" in attrs:
        for found in _ATTR.finditer(attrs):
            key, value = found[1].lower(), (found[2] or "").strip("\"'")
            if key == "hidden":
                weight = min(weight, WORD_WEIGHT)
            elif key == "role":
                if value.lower() in BOILERPLATE_ROLES:
                    weight = min(weight, ROLE_WEIGHT)
            else:
                words = {w.lower() for w in _NAME_PART.findall(value)}
                if words & BOILERPLATE_WORDS and name not in ("html", "body", "main") and not words & {"has", "with", "no"}:
                    weight = min(weight, WORD_WEIGHT)
                elif words & CONTENT_WORDS and weight >= 0:
                    weight += CONTENT_WORD_WEIGHT
    return weight


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; inline elements and line breaks don't end a block."""
    root = Element("#root", 0, None)
    here, blocks, current = root, [], None
    open_now: Counter = Counter()  # names on the path, so that what isn't open is never looked for

    def say(text: str) -> None:
        nonlocal current
        if here.dropped or not text:
            return
        if current is None:
            if text.isspace():
                return
            current = Block(here.block or root)
            blocks.append(current)
        current.parts.append(text)
        if here.link:
            current.link_chars += len(text)

    def leave(name: str) -> None:
        """Close the nearest ``name``, which is open, and all within it."""
        nonlocal here
        while True:
            closed, here = here, here.parent
            open_now[closed.name] -= 1
            if closed.name == name:
                return

    at = 0
    while found := _TOKEN.search(page, at):
        say(page[at : found.start()])
        at = found.end()
        if not found["name"]:
            continue
        name = found["name"].lower()
        if found["end"]:
            if name == "br":
                say(" ")
            elif open_now[name]:
                leave(name)
                if name in BLOCK:
                    current = None
            continue
        if name in VOID:
            if name == "br":
                say(" ")
            elif name == "hr":
                current = None
            continue
        if name in BLOCK:
            current = None
            closes = CLOSES.get(name, frozenset())
            if open_now["p"] or any(open_now[c] for c in closes):
                e = here
                while e is not root and e.name not in SCOPES and e.name != "p" and e.name not in closes:
                    e = e.parent
                if e.name == "p" or e.name in closes:
                    leave(e.name)
        here = opened(name, found["attrs"], here)
        open_now[name] += 1
        if name in RAW:  # nothing but its own end tag ends it
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            leave(name)
        elif found["attrs"].endswith("/") and name not in BLOCK and name != "a":
            leave(name)
    say(page[at:])
    return blocks


def content_score(element: Element, text: str, link_chars: int) -> float:
    """Cost of calling the block boilerplate less that of calling it content."""
    evidence = element.evidence
    if element.name in ("h1", "h2") and element.in_article and element.header_only:
        evidence = TAG_WEIGHT["article"]  # the article's own headline
    size = len(text)
    score = BIAS + evidence + LINK_WEIGHT * min(1.0, link_chars / max(1, size))
    score += min(2.0, size / 120) + (0.5 if text[-1:] in ".!?…:;\"”»" else 0.0)
    return score


def closeness(a: Element, b: Element) -> float:
    """1 for the same parent, falling with the steps between the two in the tree."""
    x, y, steps = a, b, 0
    while x is not y:
        if steps == FAR:
            return 0.0  # an edge that weighs next to nothing isn't looked for any further
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        steps += 1
    return 2.0 / (2.0 + max(0, steps - 2)) if steps else 1.0


def max_flow_sides(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of the minimum cut (True: content) by Dinic's maximum flow."""
    n = len(scores)
    source, sink = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def link(u: int, v: int, c: float, back: float) -> None:
        out[u].append(len(to))
        to.append(v)
        cap.append(c)
        out[v].append(len(to))
        to.append(u)
        cap.append(back)

    for k, s in enumerate(scores):
        if s > 0:
            link(source, k, s, 0.0)
        else:
            link(k, sink, -s, 0.0)
    for u, v, w in edges:
        link(u, v, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(cap[e] for e in path)
                cut = 0
                for i, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                for i, e in enumerate(path):
                    if cap[e] <= tiny:
                        cut = i
                        break
                u = to[path[cut] ^ 1]
                del path[cut:]
            while turn[u] < len(out[u]):
                e = out[u][turn[u]]
                if cap[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            if turn[u] < len(out[u]):
                path.append(out[u][turn[u]])
                u = to[path[-1]]
            elif u == source:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def page_graph(page: str) -> tuple[list[str], list[float], list[tuple[int, int, float]]]:
    """Texts of a page's blocks, their classifier scores, and the edges (a, b, weight) between them."""
    texts, elements, scores = [], [], []
    for block in blocks_of(page):
        text = " ".join(html.unescape("".join(block.parts)).split())
        if text:
            texts.append(text)
            elements.append(block.element)
            scores.append(content_score(block.element, text, block.link_chars))
    edges, last = [], {}
    for k, e in enumerate(elements):
        if k:
            edges.append((k - 1, k, SMOOTHNESS * closeness(elements[k - 1], e)))
        parent = id(e.parent)
        if last.get(parent, k - 1) != k - 1:  # a sibling that isn't the block before
            edges.append((last[parent], k, SMOOTHNESS / 2))
        last[parent] = k
    return texts, scores, edges


def extract(page: str | None) -> str:
    """The main text of a page: content blocks joined by an empty line."""
    if not page:
        return ""
    texts, scores, edges = page_graph(page)
    return "\n\n".join(t for t, kept in zip(texts, max_flow_sides(scores, edges), strict=True) if kept)


@F.arrow_udf(T.StringType())
def main_text(pages: pa.Array) -> pa.Array:
    return pa.array([extract(p.as_py()) for p in pages], pa.string())


def extract_pages(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    return pages.withColumn(out_col, main_text(F.col(f"`{html_col}`")))


def op4(pages: DataFrame) -> DataFrame:
    """Contract digest."""
    rows = pages.select("page_id", "url", main_text(F.col("html")).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
