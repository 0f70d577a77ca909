"""Main text of web pages: flat text blocks, classified by a decision tree on their own and their neighbours' features.

A page is cut into blocks at block-level tags. Each block has its word count and link density, those of the block before
and after, and what the markup around it says (a boilerplate container, an article container, a heading). The tree is grown on the small
labelled table LABELLED below, with Gini splits, and comes out as:

    in boilerplate: no
    own link density above 0.5: heading only
    link density before at most 0.55: yes
    more than 5.5 words: yes, fewer: in an article only

Everything is row-wise.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/>"']+)""")
#: Elements whose content is never text, up to the closing tag.
_SKIP = set("script style noscript template iframe svg canvas object title select textarea button math audio video map datalist".split())
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _SKIP}
#: Of these, the elements that swallow the rest of a page that never closes them; the others count as plain then.
_RAW = {"script", "style", "title", "textarea", "iframe"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del input".split())
_VOID = set("br img hr input meta link wbr area base col embed source track param".split())
_BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "menu", "menubar", "alert", "form"}
_MARKS = set(
    "ad ads adv advert adverts advertisement advertising adbox banner cookie cookies consent gdpr notice notices alert sidebar sidebars side aside comment comments reply replies respond disqus menu menus nav navbar navigation topnav breadcrumb breadcrumbs footer masthead "
    "promo promos promotion sponsor sponsored related recommended recommendations share sharing social subscribe subscription newsletter popup modal overlay widget widgets toolbar pagination pager login signin signup register search disclaimer copyright skip header teaser teasers trending tags".split()
)
#: Those that also count on an article element, which has many classes of its own.
_ARTICLE_MARKS = set("ad advert advertisement comment comments reply replies respond promo sponsored related recommended teaser teasers".split())
_CONTENT = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_SPLIT = re.compile(r"[^a-z0-9]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "article", "heading")
#: words, link density, those of the block before and after (-1: none), in boilerplate, in an article, heading; 1: main text.
LABELLED = (
    # menus, lists of links, link-only adverts and pointers, wherever they stand
    (1, 1.0, -1, -1, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 1.0, 12, 0.0, 1, 0, 0, 0), (3, 0.9, 2, 1.0, 3, 1.0, 0, 0, 0, 0),
    (8, 1.0, 6, 0.8, 7, 1.0, 0, 0, 0, 0), (12, 0.7, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (30, 0.8, 8, 0.9, 5, 1.0, 0, 0, 0, 0), (5, 0.6, 40, 0.0, 4, 1.0, 0, 0, 0, 0),
    (1, 1.0, -1, -1, 2, 1.0, 0, 0, 0, 0), (6, 1.0, 60, 0.0, 50, 0.0, 0, 1, 0, 0), (14, 1.0, 40, 0.0, 30, 0.0, 0, 1, 0, 0), (2, 1.0, 25, 0.0, -1, -1, 0, 1, 0, 0),
    (9, 1.0, 70, 0.1, 45, 0.0, 0, 0, 0, 0), (3, 1.0, 30, 0.0, 4, 1.0, 0, 1, 0, 0), (7, 0.8, 30, 0.0, 55, 0.0, 0, 1, 0, 0), (20, 0.9, 50, 0.0, 50, 0.0, 0, 0, 0, 0),
    # text in boilerplate containers: notices, comments, footers, teasers
    (14, 0.0, 2, 1.0, 9, 0.0, 1, 0, 0, 0), (15, 0.0, 60, 0.0, -1, -1, 1, 0, 0, 0), (40, 0.0, 60, 0.0, -1, -1, 1, 0, 0, 0), (120, 0.0, 60, 0.0, 80, 0.0, 1, 0, 0, 0),
    (60, 0.0, 120, 0.0, 40, 0.0, 1, 0, 0, 0), (12, 0.0, 60, 0.0, 90, 0.0, 1, 0, 0, 0), (3, 0.0, 90, 0.0, 5, 0.0, 1, 0, 0, 0), (200, 0.0, 12, 0.0, 20, 0.0, 1, 0, 0, 0),
    (6, 0.0, 70, 0.0, 30, 0.0, 1, 0, 1, 0), (5, 0.0, 3, 1.0, 30, 0.0, 1, 0, 1, 0),
    # articles: headings, also linked ones, paragraphs of any length, some with links in them, also before lists of links
    (9, 0.0, 14, 0.0, 40, 0.0, 0, 1, 1, 1), (3, 0.0, 14, 0.0, 60, 0.0, 0, 1, 1, 1), (8, 1.0, 2, 1.0, 50, 0.0, 0, 1, 1, 1), (6, 1.0, 14, 0.0, 60, 0.0, 0, 1, 1, 1),
    (80, 0.0, 9, 0.0, 60, 0.0, 0, 1, 0, 1), (300, 0.0, 80, 0.0, 200, 0.0, 0, 1, 0, 1), (2, 0.0, 80, 0.0, 60, 0.0, 0, 1, 0, 1), (1, 0.0, 20, 0.0, 12, 0.0, 0, 1, 0, 1),
    (6, 0.0, 12, 0.0, 14, 0.0, 0, 1, 0, 1), (25, 0.1, 40, 0.0, 30, 0.0, 0, 1, 0, 1), (12, 0.4, 40, 0.0, 30, 0.2, 0, 1, 0, 1), (1, 0.0, 6, 0.0, 3, 1.0, 0, 1, 0, 1),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 1, 0, 1), (50, 0.0, 60, 0.0, 4, 1.0, 0, 1, 0, 1), (22, 0.0, 2, 1.0, 2, 1.0, 0, 1, 0, 1),
    # text outside articles: long or among text it is main, short and among links or at the end it is not
    (70, 0.0, 6, 0.0, 60, 0.0, 0, 0, 0, 1), (45, 0.05, 70, 0.0, 60, 0.0, 0, 0, 0, 1), (30, 0.1, 40, 0.0, 25, 0.0, 0, 0, 0, 1), (150, 0.02, -1, -1, -1, -1, 0, 0, 0, 1),
    (20, 0.0, -1, -1, -1, -1, 0, 0, 0, 1), (6, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1), (9, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0, 1), (7, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 1),
    (5, 0.0, 14, 0.0, 45, 0.0, 0, 0, 1, 1), (18, 0.0, 30, 0.0, 22, 0.1, 0, 0, 0, 1), (90, 0.3, 60, 0.1, 70, 0.1, 0, 0, 0, 1), (35, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 1),
    (28, 0.0, 3, 1.0, 3, 1.0, 0, 0, 0, 1), (2, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 0), (4, 0.0, 5, 1.0, -1, -1, 0, 0, 0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1, 0),
)


def grow(rows: np.ndarray, y: np.ndarray, depth: int = 8):
    """A binary tree (feature, cut, left if <= cut, right) with Gini splits; a leaf is 0 or 1."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = rows[:, f] <= cut
            gini = sum(part.sum() * (p := y[part].mean()) * (1 - p) for part in (left, ~left))
            if best is None or gini < best[0] - 1e-12:
                best = gini, f, float(cut)
    if best is None:
        return int(share >= 0.5)
    _, f, cut = best
    left = rows[:, f] <= cut
    return f, cut, grow(rows[left], y[left], depth - 1), grow(rows[~left], y[~left], depth - 1)


@lru_cache(1)
def tree():
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1].astype(int))


def is_main(features) -> bool:
    node = tree()
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return bool(node)


def _container(tag: str, attrs: str, in_article: bool) -> int:
    """1: boilerplate by its element or role, 2: an article, 3: hidden, 4: boilerplate by a word of its class or id, else 0."""
    if tag in _BOILER or (tag == "header" and not in_article):
        return 1
    kind = 2 if tag in _CONTENT else 0
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            name, value = (m[1] or m[5] or "").lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                return 3
            if name == "role":
                if value in _ROLES:
                    return 1
                if value in ("main", "article"):
                    kind = 2
            elif name in ("class", "id") and tag not in ("body", "html", "main"):
                if (_ARTICLE_MARKS if tag == "article" else _MARKS).intersection(_SPLIT.split(value)):
                    return 1 if tag == "article" else 4
    return kind


class _Open:
    """An open element: its kind, and how many words, articles and first headings it has held so far."""

    __slots__ = ("tag", "kind", "words", "inner")

    def __init__(self, tag: str, kind: int):
        self.tag, self.kind, self.words, self.inner = tag, kind, 0, False


def blocks(page: str | None) -> list[tuple[str, float, int, int, int]]:
    """Text, link density, in boilerplate, in an article outside boilerplate, heading of each block in page order; blocks without words are left out.

    A class word makes an element boilerplate unless it is the page's frame: unless it holds more than half of the words outside other
    boilerplate, and an article or a first heading, or more than nine tenths.
    """
    if not page:
        return []
    out: list = []
    text: list[str] = []
    linked = 0
    stack: list[_Open] = []
    marked: list[_Open] = []  # open elements that a class word marks
    level = [0, 0, 0, 0, 0]  # open elements of each kind
    anchors = heading = 0
    total = 0

    def flush() -> None:
        nonlocal linked, total
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                chars = sum(map(len, words))
                out.append((" ".join(words), min(1.0, linked / chars), level[1] > 0, level[2] > 0, int(heading > 0), tuple(marked)))
                if not level[1]:
                    total += len(words)
                    for element in marked:
                        element.words += len(words)
            text.clear()
        linked = 0

    at = 0
    while m := _TOKEN.search(page, at):
        if not level[3] and m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if anchors:
                linked += len("".join(html.unescape(piece).split()))
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag, close, attrs = tag.lower(), m[1], m[3] or ""
        if tag in _SKIP:
            if tag != "button":
                flush()
            if not close and not attrs.endswith("/"):
                end = _CLOSE[tag].search(page, at)  # all up to the closing tag is skipped, whatever looks like a tag
                at = end.start() if end else len(page) if tag in _RAW else at
            continue
        if tag == "a":
            anchors = 0 if close else 1
        if tag not in _INLINE:
            flush()
            if tag in _HEADINGS:
                heading = 0 if close else 1
        if tag in _VOID:
            continue
        if close:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    for element in stack[k:]:
                        level[element.kind] -= 1
                    del stack[k:]
                    marked = [e for e in stack if e.kind == 4]
                    break
        elif tag not in ("p", "li", "b", "i", "a", "em", "strong", "option", "dt", "dd", "tr", "td", "th") or attrs.strip():
            kind = _container(tag, attrs, level[2] > 0)
            if kind and tag in _INLINE:
                flush()
            if (kind == 2 or tag == "h1") and not level[1]:
                for element in marked:
                    element.inner = True
            stack.append(_Open(tag, kind))
            level[kind] += 1
            if kind == 4:
                marked = [*marked, stack[-1]]
    if not level[3] and at < len(page):
        text.append(page[at:])
    flush()

    def is_frame(element: _Open) -> bool:
        return 10 * element.words > 9 * total or (element.inner and 2 * element.words > total)

    found = []
    for words, links, boiler, article, head, under in out:
        boiler = boiler or not all(map(is_frame, under))
        found.append((words, links, int(boiler), int(article and not boiler), head))
    return found


def main_text(page: str | None) -> str:
    """The main text: the blocks that the tree keeps, joined by one newline."""
    found = blocks(page)
    keep = []
    count = [len(b[0].split(" ")) for b in found]
    for i, (text, links, boiler, article, heading) in enumerate(found):
        before = (count[i - 1], found[i - 1][1]) if i else (-1, -1)
        after = (count[i + 1], found[i + 1][1]) if i + 1 < len(found) else (-1, -1)
        if is_main((count[i], links, *before, *after, boiler, article, heading)):
            keep.append(text)
    return "\n".join(keep)


def extract(df: DataFrame, page: str = "html", text: str = "text", keep_page: bool = True) -> DataFrame:
    """df with `text`, the main text of the whole page; null and empty pages, and pages without any, give an empty text.

    A column of df called like `text` is replaced. Rows are independent.
    """
    keep = [c for c in df.columns if c != text and (keep_page or c != page)]
    (whole,) = fresh(df, "page")
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType())])

    def run(batches):
        for batch in batches:
            out = pa.array([main_text(x.as_py()) for x in batch.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + [out], names=[*keep, text])

    return df.select(*keep, df[page].alias(whole)).mapInArrow(run, schema)
