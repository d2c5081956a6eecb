"""Main text of web pages from flat text blocks.

A page is cut into flat text blocks (runs of text between block-level tags).
Each block is described by its own and its neighbours' word count and link
density and by how what encloses it is marked; a decision tree decides whether
it is main text. The tree is trained here, on the small labelled table below.
Marks are features beside the counts, as pages mark wrongly or not at all:
clear furniture never is main text; text of a marked article always is, unless
a word that may also name its subject (``legal``, ``header``) marks it; there,
on pages that mark no article, and outside an article that is marked, words and
link density of the block and its neighbours decide.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that do not break a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
# Elements that never have an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no markup; it goes on to their end tag and is not text of the page.
RAW = frozenset("script style noscript iframe textarea title".split())
# Elements of markup that is not text of the page. Without an end tag they hide nothing.
HIDING = frozenset("template svg canvas select button object".split())
# Formulas are text within their paragraph; drawing elements are only met in an svg that has no end tag.
MATH = frozenset(
    "math maction annotation annotation-xml menclose merror mfenced mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt "
    "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
DRAWING = frozenset("circle clippath defs ellipse g line lineargradient mask path polygon polyline radialgradient rect stop symbol text tspan use".split())
# Enclosing elements, and words in class, id or role, that mark page furniture.
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog header".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner promo sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup "
    "sidebar widget related recommended recommendations share sharing social menu nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "disqus reply replies login search pagination pager toolbar contentinfo complementary".split()
)
# Words that may as well name what an article is about, or a part of it.
WEAK_WORDS = frozenset("header legal copyright tags form".split())
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("article main content post entry story articlebody".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "weak", "zone", "heading")
# The labelled table: blocks of these sizes (words, links), with these beside them
# (nothing, links, a short line, prose), under all marks. zone: 1 inside the
# article, 0 the page marks none, -1 outside the article that the page marks.
SIZES = [(w, k) for w in (2, 6, 9, 12, 16, 25, 45, 90, 250) for k in (0.0, 0.3, 0.9)]
SIDES = [(0, 0.0), (3, 1.0), (6, 0.0), (30, 0.0), (60, 0.9), (60, 0.1)]
MARKS = [(f, weak, zone, h) for f in (0, 1) for weak in (0, 1) for zone in (-1, 0, 1) for h in (0, 1)]


def is_main_by_hand(size: tuple, before: tuple, after: tuple, marks: tuple) -> bool:
    """How the table is labelled: what a reader of such pages says of a block."""
    (words, links), (furniture, weak, zone, heading) = size, marks
    prose = lambda side, n: side[0] >= n and side[1] <= 0.5
    between = prose(before, 20) and prose(after, 20)
    if furniture:
        return False
    if zone == 1 and not weak:
        return True  # links of the article are its text, too
    if links > 0.5:
        return False
    if zone == 1:  # a word that may name the subject: on prose, headings and lines between paragraphs
        return bool(heading or words >= 12 or between)
    if zone == -1:  # the marked article is not all: long prose that goes on
        return not weak and words >= 45 and prose(before, 60) and prose(after, 60)
    if weak:
        return words >= 25 and (prose(before, 20) or prose(after, 20))
    if words >= 16:
        return True
    return between or bool(heading and prose(after, 20)) or (words >= 9 and (prose(before, 20) or prose(after, 20)))


LABELLED = [(*size, *before, *after, *marks, int(is_main_by_hand(size, before, after, marks))) for size in SIZES for before in SIDES for after in SIDES for marks in MARKS]


@dataclass
class Node:
    """A leaf if ``feature`` is negative, else ``value <= cut`` goes to ``low``."""

    feature: int
    cut: float
    main: bool
    low: Node | None = None
    high: Node | None = None


def train_tree(rows: list[tuple], depth: int = 12) -> Node:
    """CART with the Gini impurity; cuts lie midway between neighbouring values."""
    data = np.array(rows, float)
    x, y = data[:, :-1], data[:, -1]

    def grow(at: np.ndarray, left: int) -> Node:
        share = y[at].mean()
        leaf = Node(-1, 0.0, bool(share >= 0.5))
        if left == 0 or share in (0.0, 1.0):
            return leaf
        best = (share * (1 - share) * len(at) - 1e-9, None)
        for f in range(x.shape[1]):
            values = np.unique(x[at, f])
            for cut in (values[1:] + values[:-1]) / 2:
                low = x[at, f] <= cut
                cost = sum(len(p) * (m := y[p].mean()) * (1 - m) for p in (at[low], at[~low]))
                if cost < best[0] - 1e-12:
                    best = (cost, (f, cut, low))
        if best[1] is None:
            return leaf
        f, cut, low = best[1]
        return Node(f, float(cut), leaf.main, grow(at[low], left - 1), grow(at[~low], left - 1))

    return grow(np.arange(len(data)), depth)


@functools.cache
def default_tree() -> Node:
    return train_tree(LABELLED)


def is_main(tree: Node, features: tuple) -> bool:
    while tree.feature >= 0:
        tree = tree.low if features[tree.feature] <= tree.cut else tree.high
    return tree.main


# A quoted value may hold '<' where its closing quote stands before a blank, '/' or '>'.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)"
    r"(?P<attrs>(?:[^<>\"'=]|=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|=|\"[^\"<]*\"|'[^'<]*')*[^<>]*)>?|<[!?][^>]*>?",
    re.S | re.I,
)
_HIDING = re.compile(rf"<(?:{'|'.join(sorted(HIDING))})\b", re.I)
# The tag that ends a raw element: of code the next end tag; a further start tag of the others shows that the first has no end.
_RAW_END = {t: re.compile(rf"<({'/' if t in ('script', 'style') else '/?'}){t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!important\s*)?(?:;|$)", re.I)
# What a form that is a whole page's frame holds.
_FRAMED = re.compile(r"<(?:article|main|h1|nav|footer)\b", re.I)


def attributes(attrs: str) -> dict[str, str]:
    """Attribute values by lower-case name; of a repeated one the first."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attrs):
        out.setdefault(name.lower(), a or b or c)
    return out


def _role(tag: str, attrs: str, in_article: bool) -> str:
    """'furniture', 'weak', 'article' or '' for an element that opens."""
    if tag in FURNITURE_TAGS and not (tag == "header" and in_article):
        return "furniture"
    found = "article" if tag in ARTICLE_TAGS else ""
    values = attributes(attrs) if attrs else {}
    if "hidden" in values or values.get("aria-hidden", "").strip().lower() == "true" or _UNSEEN.search(values.get("style", "")):
        return "furniture"
    for key in ("class", "id", "role"):
        for name in values.get(key, "").lower().split():
            parts = re.split(r"[-_]+", name)
            if parts[0] in ("has", "with", "no", "is"):
                continue
            comments = parts[0].startswith("comment") or parts[-1].startswith("comment")
            if tag in ARTICLE_TAGS or tag in ("html", "body"):
                if comments and tag == "article":
                    return "furniture"
                continue
            ends = {parts[0], parts[-1]}
            if comments or ends & FURNITURE_WORDS:
                return "furniture"
            if ends & WEAK_WORDS:
                found = "weak"
            elif ends & ARTICLE_WORDS and found != "weak":
                found = "article"
    return found


def _tags(page: str, ends: dict[int, int]) -> Iterator[tuple[re.Match, str, int]]:
    """(markup, its tag or '', place after it and what it hides), in order.

    ``ends``: where the hiding elements end, by the place of their start tag.
    """
    at = foreign = 0
    while m := _MARKUP.search(page, at):
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag in ("svg", "math") and not m["attrs"].endswith("/") and m.start() not in ends:
            foreign = max(0, foreign + (-1 if m["end"] else 1))
        if tag in RAW and not m["end"] and not (foreign and m["attrs"].endswith("/")):
            end = _RAW_END[tag].search(page, at)
            if end and end[1]:
                at = end.end()
            elif tag in ("script", "style"):
                at = len(page)
        at = ends.get(m.start(), at)
        yield m, tag, at


def _extents(page: str) -> dict[int, int]:
    """Where the elements that have an end tag end, by the place of their start tag."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    unended: Counter = Counter()
    for m, tag, _ in _tags(page, {}):
        if not tag or tag in RAW or tag in VOID or tag in INLINE:
            continue
        if unended[tag] and (m["end"] or tag in ("button", "select")):  # these two do not nest
            while True:
                name, start = stack.pop()
                unended[name] -= 1
                if name == tag:
                    break
            if m["end"]:
                ends[start] = m.end()
        if not m["end"] and not m["attrs"].endswith("/"):
            stack.append((tag, m.start()))
            unended[tag] += 1
    return ends


@dataclass
class Block:
    text: str
    words: int
    links: float
    furniture: int
    weak: int
    article: bool
    heading: int


def text_blocks(page: str) -> list[Block]:
    """The page's flat text blocks, in order."""
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    link_parts: list[str] = []
    held = dict.fromkeys(("furniture", "weak", "article", ""), 0)
    heading = in_link = 0
    ends = _extents(page)
    starts = {at: e for at, e in ends.items() if _HIDING.match(page, at)}

    def close() -> None:
        nonlocal parts, link_parts
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                linked = len(html.unescape(" ".join(link_parts)).split())
                blocks.append(Block(text, words, min(1.0, linked / words), int(held["furniture"] > 0), int(held["weak"] > 0), held["article"] > 0, int(heading > 0)))
            parts, link_parts = [], []

    def leave(tag: str, role: str) -> None:
        nonlocal heading
        held[role] -= 1
        heading -= tag in HEADINGS

    at = 0
    for m, tag, after in _tags(page, starts):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                link_parts.append(piece)
        at = after
        if not tag or tag in MATH or tag in DRAWING:
            if tag in ("annotation", "annotation-xml", "mtr", "mtd"):
                parts.append(" ")
            continue
        if tag in RAW or tag in HIDING:
            parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m["end"] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        close()
        in_link = 0
        if tag == "head":  # what it may hold is stepped over; anything else belongs to the body
            continue
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    for t, role in reversed(stack[i:]):
                        leave(t, role)
                    del stack[i:]
                    break
        elif tag not in VOID and not m["attrs"].endswith("/"):
            if stack and tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == tag:
                leave(*stack.pop())
            role = _role(tag, m["attrs"], held["article"] > 0)
            if role == "furniture" and tag in FURNITURE_TAGS:
                end = ends.get(m.start())
                if end is None or (tag == "form" and _FRAMED.search(page, m.end(), end)):
                    role = ""  # without an end tag it marks nothing; a form around a page is its frame
            stack.append((tag, role))
            held[role] += 1
            heading += tag in HEADINGS
    if at < len(page):
        parts.append(page[at:])
    close()
    return blocks


def main_text(page: str | None, tree: Node) -> str:
    """Main-text blocks of one page, joined by one line break."""
    blocks = text_blocks(page or "")
    marked = any(b.article and not b.furniture for b in blocks)
    kept = []
    for i, b in enumerate(blocks):
        before, after = blocks[i - 1] if i else None, blocks[i + 1] if i + 1 < len(blocks) else None
        features = (
            b.words, b.links, before.words if before else 0, before.links if before else 0.0, after.words if after else 0, after.links if after else 0.0,
            b.furniture, b.weak, (1 if b.article else -1) if marked else 0, b.heading,
        )
        if is_main(tree, features):
            kept.append(b.text)
    return "\n".join(kept)


def extract_text(pages: DataFrame, *, html_col: str = "html", labelled: list[tuple] | None = None) -> DataFrame:
    """All columns of ``pages`` plus ``text`` and ``n_chars`` (code points).

    ``labelled``: another table to train the tree on (rows of ``FEATURES`` and
    the label).

    Defined cases: null or empty html, and pages without main text, give an
    empty text of 0 characters; tags, comments, scripts and styles left open end
    with the page; other elements without an end tag hide nothing; formulas and
    links of an article are its text; equal pages give equal texts; columns already named ``text`` or
    ``n_chars`` are replaced; an empty table gives an empty result.
    """
    tree = train_tree(labelled) if labelled else default_tree()

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(x, tree) for x in s.tolist()], dtype=object)

    return pages.withColumn("text", text(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))
