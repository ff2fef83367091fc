"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of blocks. A block is described by its words and the share of them in links, by those of
its neighbours, by the kind of region it stands in and by whether it is a heading. The tree is grown from a small
labelled table of such blocks when the module is first used.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import added, mapped, table, texts

#: Elements whose content is never text of the page. A head is none of them: all that may stand in one is, and where
#: its end tag is left out, as it may be, the first text or other element begins the body.
DROPPED = frozenset("script style noscript template title textarea select option button svg math iframe object audio video canvas map datalist dialog".split())
#: Of those, the ones whose content ends only at their own end tag.
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that a start tag of the same group ends.
SIBLINGS = {t: g for g in (frozenset({"li"}), frozenset({"dt", "dd"}), frozenset({"td", "th"}), frozenset({"tr"})) for t in g}
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
ASIDE_TAGS = frozenset("nav footer aside form menu fieldset".split())
MAIN_TAGS = frozenset("article main".split())
#: Words of class, id and role that name what stands beside the text, and those that name the text.
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs footer foot sidebar aside widget related recommended share sharing social comment comments reply replies respond disqus cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup signin login register search pagination pager toolbar copyright legal disclaimer tags masthead contentinfo complementary skip teaser".split()
)
MAIN_WORDS = frozenset("article post entry content main story maincontent articlebody".split())
#: Words that leave the meaning of a name to its other words: "comment-list" is comments, "share-price" is no sharing.
NEUTRAL_WORDS = MAIN_WORDS | frozenset(
    "area bar big block body bottom box buttons button col column container desktop entry fixed form global grid group header heading icon icons info inline inner item items js large left link links list local mid mobile more new news outer page panel posts articles stories primary region right row secondary section site slot small sticky text title top unit us wrap wrapper".split()
)

NONE, MAIN, ASIDE, HEAD = 0, 1, -1, -2

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s>/]*+)",
    re.S,
)
_MARK = re.compile("[>\"']")
#: Attributes that are read; values of others are passed over.
_ATTRIBUTE = re.compile(r"\"[^\"]*\"|'[^']*'|(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    region: int
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _beside(name: str) -> bool:
    """Whether a whole name (a class, an id, a role) says that its element stands beside the text: one of its words
    does, and none of them says anything else."""
    words = [w.lower() for w in _PART.findall(name)]
    if name.lower() in ASIDE_WORDS:
        return True
    return any(w in ASIDE_WORDS for w in words) and all(w in ASIDE_WORDS or w in NEUTRAL_WORDS or w.isdigit() or len(w) == 1 for w in words)


def _region(tag: str, attributes: str, outer: int) -> tuple[int, bool]:
    """The kind of region that an element opens, and whether its content is hidden."""
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        if not m[1]:
            continue
        value = m[2] or m[3] or m[4] or ""
        key = m[1].lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return outer, True
        if key in ("class", "id", "role"):
            names.update(value.split())
    if tag in ("html", "body"):
        return outer, False
    if tag in ASIDE_TAGS or any(map(_beside, names)):
        return ASIDE, False
    words = {w.lower() for name in names for w in (*_PART.findall(name), name)}
    if tag == "header" or "header" in words and tag not in MAIN_TAGS:
        return (HEAD if outer == MAIN else ASIDE), False
    if tag in MAIN_TAGS or words & MAIN_WORDS and outer != ASIDE:
        return MAIN, False
    return outer, False


class TagEnds:
    """Where the tags of a page end: at the first '>' outside quoted values, however long those are.

    If a quote never closes, the tag ends at the first '>' after its name. Every quote is followed once only, so the
    work is linear in the page, whatever its quotes.
    """

    def __init__(self, page: str):
        self.page, self.after = page, {}  # by place of an opening quote: where its tag ends, or -1

    def of(self, at: int) -> int:
        """The place of the '>' of the tag whose name ends at `at`, or the length of the page."""
        page, after, opened, end = self.page, self.after, [], -1
        m = _MARK.search(page, at)
        while m:
            k = m.start()
            if page[k] == ">":
                end = k
                break
            if k in after:
                end = after[k]
                break
            opened.append(k)
            closing = page.find(page[k], k + 1)
            m = _MARK.search(page, closing + 1) if closing >= 0 else None
        after.update(dict.fromkeys(opened, end))
        if end < 0:
            end = page.find(">", at)
        return end if end >= 0 else len(page)


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order; those without text are left out."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # element, region, dropped
    parts: list[str] = []
    linked = at = 0
    link_depth: int | None = None
    heading = False

    def state() -> tuple[int, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (NONE, False)

    def close() -> None:
        nonlocal parts, linked
        if parts:
            words = "".join(parts).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), state()[0], heading))
        parts, linked = [], 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not state()[1]:
            decoded = html.unescape(raw) if "&" in raw else raw
            parts.append(decoded)
            if link_depth is not None:
                linked += len(decoded.split())

    n, ends = len(page), TagEnds(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not state()[1]:
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        end = ends.of(at)
        ending, attributes, at = bool(m[1]), page[at:end], end + 1
        if tag in RAW:
            if not ending:
                end = re.compile(rf"</{tag}(?=[\s>/]|\Z)[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
                if tag == "textarea":
                    parts.append(" ")
            continue
        if tag == "a":
            link_depth = None if ending else len(stack)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE and not (not ending and ("class" in attributes or "hidden" in attributes or "style" in attributes)):
            if ending and any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in VOID:
            if tag == "hr":
                close()
            continue
        if tag in INLINE:
            region, hidden = _region(tag, attributes, state()[0])
            if hidden or region == ASIDE != state()[0]:  # its words go; the paragraph that it stands in goes on
                stack.append((tag, state()[0], True))
            continue
        close()
        if tag in HEADINGS:
            heading = not ending
        if ending:
            if any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
                if link_depth is not None and link_depth > len(stack):
                    link_depth = None
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if tag not in HEADINGS:
            heading = False
        if (same := SIBLINGS.get(tag)) and stack and stack[-1][0] in same:
            stack.pop()
        region, hidden = _region(tag, attributes, state()[0])
        if not attributes.rstrip().endswith("/"):
            stack.append((tag, region, state()[1] or hidden or tag in DROPPED))
    close()
    return out


#: A small labelled table of blocks. Words, link density, words before, link density before, words
#: after, link density after, region (1 the text, 0 none named, -1 beside it, -2 head of the text), heading, main text.
LABELLED = """
1 1.0 0 0.0 1 1.0 -1 0 0
1 1.0 1 1.0 1 1.0 -1 0 0
2 1.0 1 1.0 7 0.0 -1 0 0
7 0.0 1 1.0 9 0.0 -1 0 0
12 0.0 1 1.0 14 0.0 -1 0 0
40 0.0 3 0.0 60 0.0 -1 0 0
90 0.1 20 0.0 25 0.0 -1 0 0
13 0.0 80 0.0 0 0.0 -1 0 0
16 0.2 45 0.0 0 0.0 -1 0 0
6 0.0 30 0.0 20 0.0 -1 1 0
3 0.0 60 0.0 12 0.3 -1 1 0
25 0.0 60 0.0 30 0.0 -1 0 0
9 0.0 7 0.0 30 0.0 1 1 1
3 0.0 7 0.0 2 0.0 1 1 1
30 0.0 9 0.0 60 0.0 1 0 1
120 0.0 30 0.0 45 0.0 1 0 1
60 0.1 120 0.0 8 0.0 1 0 1
2 0.0 120 0.0 90 0.0 1 0 1
1 0.0 9 0.0 14 0.0 1 0 1
8 0.0 60 0.0 13 0.0 1 0 1
4 0.0 2 0.0 3 0.0 1 0 1
18 0.4 50 0.0 40 0.0 1 0 1
45 0.6 50 0.0 40 0.1 1 0 1
6 0.3 30 0.0 30 0.0 1 0 1
5 1.0 60 0.0 5 1.0 1 0 0
2 1.0 5 1.0 4 1.0 1 0 0
3 1.0 90 0.0 0 0.0 1 0 0
8 0.9 6 1.0 7 1.0 1 0 0
9 0.0 4 0.0 30 0.0 -2 1 1
4 0.0 7 0.0 80 0.0 -2 1 1
5 0.0 9 0.0 40 0.0 -2 0 0
6 0.5 9 0.0 70 0.0 -2 0 0
14 0.1 8 0.0 60 0.0 -2 0 0
1 1.0 0 0.0 1 1.0 0 0 0
2 1.0 1 1.0 2 1.0 0 0 0
5 0.8 2 1.0 3 1.0 0 0 0
9 0.7 40 0.0 8 1.0 0 0 0
3 0.0 2 1.0 2 1.0 0 0 0
6 0.0 1 1.0 9 1.0 0 0 0
8 0.0 0 0.0 3 1.0 0 0 0
7 0.0 5 1.0 0 0.0 0 0 0
11 0.2 6 0.5 0 0.0 0 0 0
4 0.0 3 0.0 2 0.0 0 0 0
8 0.0 2 1.0 50 0.0 0 1 1
5 0.0 40 0.0 60 0.0 0 1 1
7 0.0 3 0.0 35 0.0 0 1 1
20 0.0 30 0.0 25 0.0 0 0 1
35 0.0 8 0.0 50 0.0 0 0 1
70 0.0 35 0.0 12 0.0 0 0 1
140 0.1 70 0.0 90 0.0 0 0 1
10 0.0 60 0.0 80 0.0 0 0 1
6 0.0 45 0.0 70 0.0 0 0 1
28 0.2 60 0.0 9 0.3 0 0 1
22 0.0 9 0.0 24 0.0 0 0 1
50 0.7 9 1.0 9 1.0 0 0 0
26 0.8 60 0.0 7 1.0 0 0 0
2 0.0 0 0.0 1 1.0 -1 1 0
3 0.0 60 0.0 5 0.0 -1 1 0
2 0.0 12 0.0 8 0.0 -1 1 0
8 0.0 0 0.0 2 0.0 -1 1 0
30 0.0 5 0.0 3 0.0 -1 0 0
45 0.0 2 0.0 6 0.0 -1 0 0
80 0.0 3 0.0 9 0.0 -1 0 0
18 0.0 0 0.0 0 0.0 -1 0 0
7 0.0 40 0.0 40 0.0 -1 0 0
24 0.0 30 0.0 3 0.0 0 0 1
60 0.0 40 0.0 4 0.0 0 0 1
33 0.0 6 0.0 5 1.0 0 0 1
17 0.0 20 0.0 4 0.0 0 0 1
14 0.0 0 0.0 0 0.0 0 0 1
4 0.0 0 0.0 0 0.0 0 0 1
4 0.0 40 0.0 0 0.0 0 0 0
3 0.0 25 0.0 0 0.0 0 0 0
5 0.0 30 0.0 2 1.0 0 0 0
6 0.0 17 0.0 0 0.0 0 0 0
25 0.0 7 0.0 4 0.0 1 0 1
60 0.0 9 0.0 7 0.0 1 0 1
20 0.0 40 0.0 13 0.0 1 0 1
35 0.0 50 0.0 1 1.0 1 0 1
50 0.0 2 1.0 40 0.0 1 0 1
8 0.0 9 0.0 1 1.0 1 0 1
15 0.0 60 0.0 2 1.0 1 0 1
27 0.0 27 0.0 5 1.0 1 0 1
70 0.0 15 0.0 1 0.0 1 0 1
11 0.0 70 0.0 0 0.0 1 0 1
5 0.0 11 0.0 0 0.0 1 0 1
3 0.0 40 0.0 1 0.0 1 0 1
1 0.0 40 0.0 1 0.0 1 0 1
40 0.1 9 0.0 2 0.0 1 0 1
22 0.2 3 1.0 2 1.0 1 0 1
6 0.0 22 0.0 2 0.0 1 0 1
2 0.0 3 0.0 1 1.0 1 0 1
1 0.0 1 1.0 2 0.0 1 0 1
7 0.0 1 1.0 1 0.0 1 1 1
"""


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    main: bool = False


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 1) -> Node:
    """A tree by the least Gini impurity; ties take the first feature and the lowest cut."""
    if not depth or len(set(y.tolist())) < 2:
        return Node(main=bool(y.mean() >= 0.5))
    best = (np.inf, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            a, b = y[low], y[~low]
            if min(len(a), len(b)) >= least:
                impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (a, b))
                if impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut))
    _, f, cut = best
    if f < 0:
        return Node(main=bool(y.mean() >= 0.5))
    low = x[:, f] <= cut
    return Node(f, cut, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def decide(node: Node, x: list[float]) -> bool:
    while node.feature >= 0:
        node = node.low if x[node.feature] <= node.cut else node.high
    return node.main


def _described(words, density, words0, density0, words1, density1, region, heading) -> list[float]:
    """Named regions first, so that equal splits prefer them; counts of words on a logarithmic scale."""
    log = lambda n: float(np.log1p(n))
    return [float(region == ASIDE), float(region == MAIN), float(region == HEAD), density, float(heading), log(words), density0, density1, log(words0), log(words1)]


@lru_cache(maxsize=1)
def tree() -> Node:
    rows = [[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()]
    return grow(np.array([_described(*r[:-1]) for r in rows]), np.array([r[-1] for r in rows]))


def main_text(page: str, root: Node | None = None) -> str:
    """The blocks of main text, one a line; empty if there are none."""
    root, found = root or tree(), blocks(page)
    kept = []
    none = Block("", 0, 0, NONE, False)
    for k, b in enumerate(found):
        before, after = found[k - 1] if k else none, found[k + 1] if k + 1 < len(found) else none
        if decide(root, _described(b.words, b.density, before.words, before.density, after.words, after.density, b.region, b.heading)):
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """pages(html, ...) with `text`, the main text (any column of that name goes).

    Null html: empty. Every row stays, repeated ones too; an empty table gives an empty one; pages of any length are
    read whole; other columns may have any names. Where a leaf of the tree holds as many blocks of text as of others,
    its blocks are text.
    """
    pages = pages.drop("text")
    at = pages.columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([main_text(p) for p in texts(b.column(at))], pa.string())], [*b.schema.names, "text"])

    return mapped(pages, run, added(pages, text=T.StringType()))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
