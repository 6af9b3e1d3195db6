"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks (text between block-level tags).  A classifier's
log-odds of each block being main text become its capacity to source or sink;
blocks that follow each other, and blocks that follow each other inside one
parent element, are tied by smoothness edges.  The minimum cut, found by
maximum flow, is the labelling with the least total cost.

The classifier has two parts.  A logistic regression over the shape of a block
(length, links, punctuation, tag, depth) is trained on at most ``PAGES`` pages,
where elements that name their own meaning (article, main; nav, footer, aside,
form) serve as labels; and those elements and telling class names add a fixed
amount each.  What matters of the elements around a block ends at the nearest
article or main.

Blocks whose own capacity exceeds all their edges keep their label in any
minimum cut, so they are settled first and flow runs over the rest only.

Defined cases: null or blank html gives the empty text; unclosed elements,
comments, scripts and styles end with the page; another raw element ends at its
own end tag, and without one, or self-closed (svg, math), at its start tag; repeated rows each get their
own result; other columns do not matter; an empty input gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm import common as C
from veldt.llm.ftrl import train_in_task

PAGES = 400
ADJACENT, NEAR, APART = 1.0, 0.7, 0.3
MAIN_BONUS, BOILER_COST = 4.0, 10.0
SHAPE_LIMIT = 3.0

# Element names and words by their meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT = "script style"  # to the end tag, whatever stands in between
RAW = "noscript template title svg iframe textarea select object canvas math"
CLOSABLE = frozenset("svg math".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre "
                  "search section summary table tbody td tfoot th thead tr ul".split())
MAIN_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset search head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation "
    "sidebar footer header masthead breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr notice popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments respond disqus widget toolbar copyright disclaimer form search tags teaser".split())
# An open element of the key ends where one of the values begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
        "option": {"option"}, "head": {"body"},
        "p": BLOCK - {"br", "body", "html", "head"}}

_SKIP = r"<!--.*?(?:-->|\Z)|<(" + "|".join(TEXT.split()) + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
_ATTRS = r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
_TOKEN = re.compile(_SKIP + r"|<(/?)([a-zA-Z][^\s/>]*)" + _ATTRS + r"|<[!?][^>]*>|[^<]+|<", re.S | re.I)
_RAW = re.compile(_SKIP + r"|<(/?)(" + "|".join(RAW.split()) + r")(?=[\s/>])" + _ATTRS, re.S | re.I)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_STOPS = re.compile(r"[.,;:!?]")


@dataclass
class Element:
    tag: str
    up: Element | None
    depth: int
    boiler: bool = False   # an element around the block, up to the nearest main one, is boilerplate
    main: bool = False
    own_boiler: bool = False


@dataclass
class Block:
    parent: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _marks(tag: str, attrs: str) -> tuple[bool, bool]:
    main, boiler = tag in MAIN_TAGS, tag in BOILER_TAGS
    if attrs.strip() and tag not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role":
                main, boiler = main or value == "main", boiler or value in BOILER_ROLES
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                boiler = True
            elif name == "style":
                boiler = boiler or "display:none" in value.replace(" ", "")
            else:
                boiler = boiler or not BOILER_WORDS.isdisjoint(_SPLIT.split(value))
    return main, boiler


def _element(tag: str, attrs: str, up: Element) -> Element:
    main, boiler = _marks(tag, attrs)
    if main and not boiler:
        return Element(tag, up, up.depth + 1, False, True)
    # a header of the page is boilerplate, one inside the article is not
    own = boiler or (tag == "header" and not up.main)
    return Element(tag, up, up.depth + 1, up.boiler or own, up.main, own)


def _raw_ends(page: str) -> dict[int, int]:
    """End of each raw element that has an end tag, by the place of its start tag."""
    ends, opened = {}, {}
    for m in _RAW.finditer(page):
        tag = (m[3] or "").lower()
        if m[2]:
            if opened.get(tag):
                ends[opened[tag].pop()] = m.end()
        elif tag and not (tag in CLOSABLE and m[4].endswith("/")):
            opened.setdefault(tag, []).append(m.start())
    return ends


def _tokens(page: str) -> Iterator[re.Match]:
    """Tokens outside raw elements."""
    ends, at = _raw_ends(page), 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = ends.get(m.start(), m.end())
        if at == m.end():
            yield m


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    now, out = Element("", None, 0), []
    block, links = Block(now), 0
    for m in _tokens(page):
        tag = m[3]
        if tag is None:
            s = m[0]
            if m[1] is None and (s[0] != "<" or s == "<"):
                block.parts.append(s)
                if links:
                    block.linked += len(s)
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m[2] else 1
        if tag not in BLOCK:
            continue
        if block.parts:
            out.append(block)
        if m[2]:
            at = now
            while at is not None and at.tag != tag:
                at = at.up
            if at is not None and at.up is not None:
                now = at.up
        elif tag not in VOID:
            at = now
            while at.up is not None and at.tag in ENDS and tag in ENDS[at.tag]:
                now = at = at.up
            now = _element(tag, m[4], now)
        block = Block(now)
    if block.parts:
        out.append(block)
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


# ------------------------------------------------------------- classifier

FEATURES = 9


def shape(b: Block) -> list[float]:
    n, words = len(b.text), b.text.count(" ") + 1
    tag = b.parent.tag
    return [1.0, math.log1p(words), min(1.0, b.linked / n), min(1.0, len(_STOPS.findall(b.text)) / words), float(tag == "p"),
            float(tag in ("h1", "h2", "h3")), float(tag in ("li", "td", "th", "dd", "dt")), float(words <= 3), min(1.0, b.parent.depth / 10)]


#: weights while no page of the sample names its parts
PLAIN = np.array([-1.5, 0.8, -3.0, 2.0, 0.5, 0.5, -0.5, -1.0, 0.0])


def fit_shape(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression with both classes weighted alike, by gradient descent."""
    if len(set(y)) < 2:
        return PLAIN
    weight, w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * (x.T @ ((p - y) * weight) / len(y) + 0.001 * w)
    return w


def train(pages: DataFrame, key: str = "page_id", text: str = "html", pages_used: int = PAGES) -> np.ndarray:
    """Shape weights from the pages whose ids hash lowest."""
    C.small_batches(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, page in zip(f["doc_id"], f["html"], strict=True):
                rows = [(shape(b), int(not b.parent.boiler)) for b in blocks_of(page or "") if b.parent.boiler or b.parent.main]
                if rows:
                    yield pd.DataFrame({"doc_id": k, "x": [r[0] for r in rows], "y": [r[1] for r in rows]})

    ids = C.materialize(pages.select(F.col(key).cast("bigint").alias("doc_id")).dropna().distinct()
                        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(pages_used), "sample-ids")
    sample = pages.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("html")) \
        .join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"]).mapInPandas(run, "doc_id long, x array<double>, y int")
    model = train_in_task(sample, lambda s: {"w": fit_shape(np.array(s["x"].tolist()), s["y"].to_numpy().astype(float))})
    return model.get("w", PLAIN)


def log_odds(blocks: list[Block], w: list[float]) -> list[float]:
    out = []
    for b in blocks:
        s = sum(a * c for a, c in zip(shape(b), w, strict=True))
        s = max(-SHAPE_LIMIT, min(SHAPE_LIMIT, s))
        out.append(s + (MAIN_BONUS if b.parent.main else 0.0) - (BOILER_COST if b.parent.boiler else 0.0))
    return out


# ------------------------------------------------------------- minimum cut

def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for i, b in enumerate(blocks):
        # siblings: blocks whose parent elements hang under one element
        group = id(b.parent.up if b.parent.up is not None else b.parent)
        if i:
            a = blocks[i - 1].parent
            out.append((i - 1, i, ADJACENT if id(a.up if a.up is not None else a) == group else APART))
        if group in last and last[group] != i - 1:
            out.append((last[group], i, NEAR))
        last[group] = i
    return out


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where a node is on the source's side of the minimum cut.

    Cost of a labelling: -unary for each positive node labelled False, unary
    for each negative one labelled True, and the weight of every cut edge.
    """
    n = len(unary)
    side: list[bool | None] = [None] * n
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    own, free, queue = list(unary), [sum(w for _, w in e) for e in near], deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(own[i]) > free[i]:
            side[i] = own[i] > 0
            for j, w in near[i]:
                if side[j] is None:
                    own[j] += w if side[i] else -w
                    free[j] -= w
                    queue.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        inner = [(number[a], number[b], w) for a, b, w in edges if side[a] is None and side[b] is None]
        for i, s in zip(rest, _flow([own[i] for i in rest], inner), strict=True):
            side[i] = s
    return [bool(s) for s in side]


def _flow(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Maximum flow by shortest augmenting paths in layers; what the source still reaches is True."""
    n = len(unary)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def add(a: int, b: int, forth: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(forth)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, u in enumerate(unary):
        if u > 0:
            add(s, i, u, 0.0)
        elif u < 0:
            add(i, t, -u, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried, path, v = [0] * (n + 2), [], s
        while True:
            if v == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                back = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                v = to[path[back] ^ 1]
                del path[back:]
                continue
            while tried[v] < len(head[v]):
                e = head[v][tried[v]]
                if cap[e] > tiny and level[to[e]] == level[v] + 1:
                    break
                tried[v] += 1
            if tried[v] < len(head[v]):
                path.append(head[v][tried[v]])
                v = to[path[-1]]
            elif path:
                e = path.pop()
                v = to[e ^ 1]
                tried[v] += 1
            else:
                break


# ------------------------------------------------------------- operator

def main_text(page: str | None, w: list[float]) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    keep = min_cut(log_odds(blocks, w), edges_of(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, weights: np.ndarray, key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    C.small_batches(pages.sparkSession)
    w = [float(x) for x in weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(p, w) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(g) for g in got], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(text).alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
