"""Main text of web pages by tag-path ratios.

A page is cut into text nodes with their root-to-leaf tag paths. Over each path
the length of its text and its punctuation are summed and divided by its nodes
(text to tag-path ratio, punctuation to tag-path ratio). Both ratios are laid out
in page order, smoothed by a Gaussian window, fused by their product with the
path's share of link-free text, and thresholded at a share of their deviation:
nodes above it are content. The smallest element that holds all content is the
article; its blocks are returned, headings and short paragraphs with them, as
these are content by place though not by length.

Tags and names are priors, and the weights have the last word. Menus, page headers and
footers and readers' comments are never part of the article, whatever their weight.
Other elements that seldom hold one (those whose class, id or role says so) are left
out unless they hold half of the weight of what is left; a form, aside or dialog is
the page's wrapper only if it also holds a main, article or h1 element, or nine tenths
of the weight. Main and article elements are taken whole where they hold half of
the weight that is left; then a content node counts for the outermost of these that
it lies in. A teaser beside a longer text is so not taken for the page's article.

Reading a page takes time in proportion to its length: tags are matched without
going back, a path is a number that is given once to each (parent's path, tag), and
sums go up the tree once.

Cases: null html counts as empty and gives an empty text; unclosed, crossed and
truncated tags are closed as they can be (an end tag closes the innermost open element
of its name; that of an inline element only within its block); a tag that the page's
end cuts off is dropped; pages without any tag are one block; very long and deeply nested pages
are read whole; of equal weights all are kept; repeated rows each give their row;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video select option button xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"caption", "legend", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
#: Elements that hold no article, by tag; header and footer only outside an article.
NEVER = frozenset("nav aside form menu dialog head".split())
#: Parts of a class, id or role (split at - and _) that mark what isn't the article.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navi navigation newsletter notice notices "
    "notification notifications pagination pager popup promo promotion recommended related replies respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets alert "
    "contentinfo complementary dialog form".split()
)
#: First parts that only say what is elsewhere on the page, as in has-sidebar.
ABOUT = frozenset("has with no without is show hide".split())
INSIDE = frozenset("article main".split())
#: Elements that may wrap a whole page, and parts of names that mark readers' comments.
WRAPPERS = frozenset("form aside dialog".split())
FIXED = (NEVER | {"header", "footer"}) - WRAPPERS
COMMENTS = frozenset("comment comments commentlist disqus respond responses replies reply".split())

#: A tag; nothing in it goes back, so a broken one costs one look ahead.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PUNCT = re.compile(r"[.,;:!?…。、！？，；]")
DEVIATIONS = 0.25
HALF, NEARLY_ALL = 0.5, 0.9
CHUNK_CHARS = 4_000_000
P_STOPS = frozenset("table td th li div section article main blockquote body".split())
ITEM_STOPS = frozenset("ul ol dl table menu".split())
ITEMS = {"li": 0, "dd": 1, "dt": 1, "tr": 2, "td": 3, "th": 3}


class _Element:
    """An open or closed element. ``own``: it seldom holds an article; ``never``: it, or an element above, never does; ``heads``: it is or holds a main, article or h1.

    ``p`` and ``items`` count the open paragraphs and items that a start tag could close, ``depth`` the elements above."""

    __slots__ = ("depth", "heads", "items", "link", "named", "never", "out", "own", "p", "path", "tag", "up", "weight", "within")

    def __init__(self, tag: str, up: _Element | None, attrs: str, paths: dict) -> None:
        self.tag, self.up = tag, up
        self.path = paths.setdefault((up.path if up else -1, tag), len(paths))
        self.within = bool(up and up.within) or tag in INSIDE
        self.named = (up.named if up else None) or (self if tag in INSIDE else None)
        self.link = bool(up and up.link) or tag == "a"
        self.p = (0 if up is None or tag in P_STOPS else up.p) + (tag == "p")
        items = (0, 0, 0, 0) if up is None or tag in ITEM_STOPS else up.items
        if tag in ITEMS:
            items = tuple(n + (i == ITEMS[tag]) for i, n in enumerate(items))
        self.items = items
        said = self._says(attrs)
        self.own = tag in NEVER or tag in ("header", "footer") and not self.within or tag == "footer" or bool(said)
        self.never = bool(up and up.never) or self.own and tag in FIXED or said == COMMENTS
        self.heads, self.weight, self.out, self.depth = tag in INSIDE or tag == "h1", 0.0, False, up.depth + 1 if up else 0

    def _says(self, attrs: str) -> bool | frozenset:
        """Whether the attributes say that this isn't the article; ``COMMENTS`` if they say that it is readers' comments."""
        if not attrs or self.tag in ("html", "body", "main"):
            return False
        tokens = " ".join("".join(m[1:]) for m in ATTR.findall(attrs)).lower().split()
        said = [t for t in tokens if _marks(t, self.tag, self.within)]
        if any(COMMENTS & set(re.split(r"[-_]+", t)) for t in said):
            return COMMENTS
        return bool(said) or bool(HIDDEN.search(attrs))


def _marks(token: str, tag: str, within: bool) -> bool:
    parts = re.split(r"[-_]+", token)
    if tag == "article":
        return parts[0] in ("comment", "comments", "reply")
    if token in ("header", "site-header", "page-header"):
        return not within
    return parts[0] not in ABOUT and any(x in MARKED for x in parts)


def _nodes(page: str) -> tuple[list[_Element], list[tuple[_Element, int, str]]]:
    """All elements in order, and (element, block number, text) of each run of text in page order."""
    paths: dict = {}
    root = cur = _Element("", None, "", paths)
    elements = [root]
    opened: dict[str, list[_Element]] = defaultdict(list)  # the open elements of each tag
    blocks: list[_Element] = []  # the open block elements
    block, at, n = 0, 0, len(page)
    out: list[tuple[_Element, int, str]] = []
    endless: set[str] = set()  # raw elements that have no end from here on

    def add(text: str) -> None:
        if text:
            out.append((cur, block, _html.unescape(text) if "&" in text else text))

    def closed(upto: _Element) -> _Element:
        """Close all from the innermost element to this one; each is closed once."""
        e = cur
        while True:
            opened[e.tag].pop()
            if e.tag in BLOCK:
                blocks.pop()
            if e is upto:
                return e.up
            e = e.up

    begun = 0  # of the text that isn't added yet
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            break
        ahead = page[lt + 1 : lt + 3]
        if ahead[:1] in "!?" and ahead:
            add(page[begun:lt])
            end = page.find("-->", lt + 2) if page.startswith("<!--", lt) else page.find(">", lt)
            at = begun = n if end < 0 else end + (3 if page.startswith("<!--", lt) else 1)
            continue
        if not (ahead[:1].isascii() and ahead[:1].isalpha() or ahead[:1] == "/" and (ahead[1:].isascii() and ahead[1:].isalpha() or lt + 2 >= n) or lt + 1 >= n):
            at = lt + 1  # a mark in the text
            continue
        add(page[begun:lt])
        m = TAG.match(page, lt)
        if m is None:  # the page's end cuts it off
            at = begun = n
            break
        at = begun = m.end()
        tag = m[2].lower()
        if m[1]:
            block += tag in BLOCK
            if opened[tag] and (tag in BLOCK or not blocks or blocks[-1].depth < opened[tag][-1].depth):
                cur = closed(opened[tag][-1])
            continue
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end is not None:
                at = begun = end.end()
            elif tag in ("script", "style", "textarea", "title"):
                at = begun = n
            else:
                endless.add(tag)
            continue
        block += tag in BLOCK
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            if tag == "br":
                add(" ")
            continue
        # what a start tag closes
        ends = ("li",) if tag == "li" else ("dd", "dt") if tag in ("dd", "dt") else ("tr",) if tag == "tr" else ("td", "th") if tag in ("td", "th") else ("p",)
        if cur.items[ITEMS[tag]] if tag in ITEMS else cur.p and tag in CLOSES_P:
            e = cur
            while e is not root and e.tag not in ends and e.tag not in (ITEM_STOPS if tag in ITEMS else P_STOPS):
                e = e.up
            if e is not root and e.tag in ends:
                cur = closed(e)
        cur = _Element(tag, cur, m[3], paths)
        elements.append(cur)
        opened[tag].append(cur)
        if tag in BLOCK:
            blocks.append(cur)
    add(page[begun:])
    return elements, out


def path_weights(nodes: list[tuple[int, int, int, bool]], sigma: float = 1.0) -> list[float]:
    """The fused, smoothed weight of each node (path, length, punctuation, link) in page order."""
    if not nodes:
        return []
    path, n, k, link = (np.array(x) for x in zip(*nodes, strict=True))
    _, path = np.unique(path, return_inverse=True)
    size, count = np.bincount(path, n), np.bincount(path)
    text = (size / count)[path]
    marks = ((np.bincount(path, k) + 1) / count)[path]
    free = (1 - np.bincount(path, n * link) / np.maximum(size, 1))[path]
    r = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    smooth = lambda x: np.convolve(x, kernel, "full")[r : r + len(x)] / np.convolve(np.ones(len(x)), kernel, "full")[r : r + len(x)]
    return (smooth(text) * smooth(marks) * free).tolist()


def _weighed(real: list[tuple[_Element, int, str]]) -> list[float]:
    return path_weights([(e.path, len(t), len(PUNCT.findall(t)), e.link) for e, _, t in real])


def main_text(page: str | None) -> str:
    if not page:
        return ""
    elements, found = _nodes(page)
    real = [x for x in found if x[2].strip() and not x[0].never]
    if not real:
        return ""
    _judge(elements, real)
    real = [x for x in real if not x[0].out]
    if not real:
        return ""
    weights = _weighed(real)
    total = sum(weights)
    mean = total / len(weights)
    dev = math.sqrt(sum((w - mean) ** 2 for w in weights) / len(weights))
    cut = min(DEVIATIONS * dev, max(weights))
    chosen = [(e, w) for (e, _, _), w in zip(real, weights, strict=True) if w >= cut and (w > 0 or cut == 0)] or [(e, 0.0) for e, _, _ in real]
    named = any(e.named for e, _ in chosen) and sum(w for (e, _, _), w in zip(real, weights, strict=True) if e.named) >= HALF * total
    top = _holder(elements, [e for e, _ in chosen], named)
    inside = {id(top)}
    for e in elements:  # those above come first
        if e.up is not None and id(e.up) in inside:
            inside.add(id(e))
    blocks: dict[int, list[str]] = {}
    for e, b, t in found:
        if not e.out and (id(e) in inside or named and e.named):
            blocks.setdefault(b, []).append(t)
    return "\n\n".join(x for x in (" ".join("".join(p).split()) for p in blocks.values()) if x)


def _judge(elements: list[_Element], real: list[tuple[_Element, int, str]]) -> None:
    """Set ``out``: below an element that never holds the article, or that seldom does and doesn't hold enough of the weight that is left."""
    for (e, _, _), w in zip(real, _weighed(real), strict=True):
        e.weight += w
    for e in reversed(elements):  # those below come first
        if e.up is not None:
            e.up.weight += e.weight
            e.up.heads |= e.heads and not e.never
    total = elements[0].weight
    for e in elements:
        enough = e.weight >= HALF * total and e.weight > 0 and (e.tag not in WRAPPERS or e.heads or e.weight >= NEARLY_ALL * total)
        e.out = bool(e.up and e.up.out) or e.never or e.own and not enough


def _holder(elements: list[_Element], chosen: list[_Element], named: bool) -> _Element:
    """The smallest block element that holds all chosen nodes; with ``named`` the outermost article or main of each node in one."""
    held: dict[int, int] = defaultdict(int)
    want = 0
    for e in {id(x): x for x in ((e.named if named and e.named else e) for e in chosen)}.values():
        held[id(e)] += 1
        want += 1
    lowest = elements[0]
    for e in reversed(elements):  # those below come first
        if held[id(e)] == want:
            lowest = e
            break
        if e.up is not None:
            held[id(e.up)] += held[id(e)]
    while lowest.tag and (lowest.tag not in BLOCK or lowest.tag in ("p", "h1", "h2", "h3", "li")):
        lowest = lowest.up
    return lowest


def extract(df: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``n_chars`` of each page; no shuffle."""
    kept = [f for f in df.schema.fields if f.name in keep]
    names = [f"c{i}" for i in range(len(kept))]
    schema = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, kept, strict=True)) + "text string, n_chars long"

    def pages(batches):
        for batch in batches:
            for rows, html in text_slices(batch, "html", CHUNK_CHARS):
                text = [main_text(x) for x in html]
                yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], [*names, "text", "n_chars"])

    cols = [F.col(f"`{f.name}`").alias(n) for n, f in zip(names, kept, strict=True)]
    return df.select(*cols, F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(pages, schema).toDF(*[f.name for f in kept], "text", "n_chars")
