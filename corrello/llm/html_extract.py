"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks with their DOM paths.  A classifier, a
logistic model of each block's layout and form, gives its log-odds of being
content; these are the capacities to the two terminals.  Neighbouring blocks,
and following blocks of one parent, are tied by smoothness edges that are the
stronger the nearer they are in the DOM.  The minimum cut, found by max-flow,
separates content from boilerplate with the least total cost.

The model is learned from the labelled pages of ``page_examples``; the scale of
the smoothness edges is the one that labels a second set of them best.  Both are
a matter of a second, happen on the driver and go to the tasks as a few numbers.
Everything else happens per page, so nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrello.llm.page_examples import labelled_pages, plain_pages
from corrello.store import table

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript plaintext".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: An opening tag closes these open elements, up to the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that never hold running text of a page.
NO_TEXT = RAW | set("head template svg object canvas audio video select option button input datalist meter progress".split())
#: Words in class, id and role that speak for and against content.
FOR = set("article content entry main post story text body prose".split())
AGAINST = set(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments complementary consent "
    "contentinfo cookie cookies copyright dialog disqus footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter "
    "notice notification outbrain pager pagination paywall popup promo promotion recommended related reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription taboola toc toolbar topbar widget widgets".split()
)
AGAINST_TAGS = set("nav footer aside form menu dialog search fieldset".split())
TEXT_TAGS = set("p pre blockquote h1 h2 h3 h4 h5 h6".split())
#: Labelled pages to learn from, and to choose the scale of the edges by.
TRAIN_PAGES, SCALE_PAGES, PLAIN_PAGES = 400, 150, 40
#: Scales of the smoothness edges that are tried.
SCALES = (0.0, 0.25, 0.5, 1.0, 2.0, 4.0)

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|$))|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|</[^a-zA-Z][^>]*(?:>|$)",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"?|'[^']*'?|[^\s"'>]+)""", re.S)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass(slots=True)
class Element:
    tag: str
    depth: int
    up: Element | None
    # of itself and all around it:
    article: bool = False
    main: bool = False
    named: int = 0  # elements with names that speak for content
    off_tag: bool = False
    off_name: bool = False
    hidden: bool = False
    link: bool = False


@dataclass(slots=True)
class Block:
    home: Element
    text: str
    linked: int



def _element(tag: str, attrs: str, up: Element | None) -> Element:
    depth = up.depth + 1 if up else 0
    e = Element(tag, depth, up)
    if up:
        e.article, e.main, e.named, e.off_tag, e.off_name = up.article, up.main, up.named, up.off_tag, up.off_name
    e.hidden, e.link = bool(up and up.hidden) or tag in NO_TEXT, bool(up and up.link) or tag == "a"
    names: set[str] = set()
    if "=" in attrs:
        for name, value in _ATTR.findall(attrs):
            if name.lower() in ("class", "id", "role"):
                names.update(x.lower() for x in _NAMES.findall(value))
    outer = tag in ("html", "body", "main")
    inside = e.article or e.main or e.named > 0
    if tag == "article":
        e.off_name = e.off_name or bool(names & {"comment", "comments", "reply", "ad", "advert", "sponsored", "related", "promo"})
    elif not outer:
        e.off_tag = e.off_tag or tag in AGAINST_TAGS or (tag == "header" and not inside)
        e.off_name = e.off_name or bool(names & AGAINST)
    e.article = e.article or tag == "article"
    e.main = e.main or tag == "main"
    e.named += bool(names & FOR) and not outer
    return e


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; white space is one space, references are decoded."""
    root = Element("#page", 0, None)
    stack, out = [root], []
    parts: list[str] = []
    linked = 0
    home = root
    at = 0

    def text(raw: str) -> None:
        nonlocal linked, home
        if not raw or stack[-1].hidden:
            return
        if not parts:
            home = next((e for e in reversed(stack) if e.tag in BLOCK), root)
        parts.append(raw)
        if stack[-1].link:
            linked += len(raw)

    def flush() -> None:
        nonlocal linked
        if parts:
            whole = " ".join(html.unescape("".join(parts)).split())
            if whole:
                out.append(Block(home, whole, linked))
            parts.clear()
        linked = 0

    def leave(down_to: int) -> None:
        if any(e.tag in BLOCK for e in stack[down_to:]):
            flush()
        del stack[down_to:]

    seen = 0
    while (mark := page.find("<", seen)) >= 0:
        m = _TOKEN.match(page, mark)
        if m is None:  # a bare "<" is text
            seen = mark + 1
            continue
        text(page[at:mark])
        at = seen = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    leave(i)
                    break
                if stack[i].tag in BLOCK and tag not in BLOCK:
                    break  # a stray inline end does not close a block
            continue
        if tag in BLOCK:
            flush()
            for i in range(len(stack) - 1, 0, -1):  # an open paragraph ends here
                if stack[i].tag == "p":
                    leave(i)
                    break
                if stack[i].tag in BLOCK:
                    break
            if tag in CLOSES:
                ends, stop = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in stop:
                        break
                    if stack[i].tag in ends:
                        leave(i)
                        break
        if tag == "br":
            text(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
            at = seen = end.end() if end else len(page)
            continue
        if not m[3].endswith("/") or tag in BLOCK or tag == "a":
            stack.append(_element(tag, m[3], stack[-1]))
    text(page[at:])
    flush()
    return out


def _distance(a: Element, b: Element) -> int:
    """Steps between two elements by way of their nearest common one."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth and a.up is not None:
            a = a.up
        elif b.up is not None:
            b = b.up
        else:
            break
        steps += 1
    return steps


_SENTENCE = re.compile(r"[.!?…]")


def features(blocks: list[Block]) -> np.ndarray:
    """One row of layout and form per block."""
    framed = any((b.home.article or b.home.main or b.home.named) and not (b.home.off_tag or b.home.off_name) for b in blocks)
    plain = not any(b.linked or b.home.article or b.home.main or b.home.named or b.home.off_tag or b.home.off_name for b in blocks)
    out = np.zeros((len(blocks), 13))
    for i, b in enumerate(blocks):
        e, words = b.home, b.text.count(" ") + 1
        inside = e.article or e.main or e.named > 0
        off = e.off_tag or e.off_name
        out[i] = (
            1,
            e.article,
            e.main,
            min(e.named, 2),
            e.off_tag,
            e.off_name,
            off and inside,
            framed and not inside,
            min(1.0, b.linked / max(1, len(b.text))) ** 2 * (words < 25) * (not inside),
            np.log1p(min(words, 60)) * (not inside),
            bool(_SENTENCE.search(b.text)) * (not inside),
            e.tag in TEXT_TAGS and not inside,
            plain,  # nothing on the page is marked or linked
        )
    return out


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: next blocks, and the next block below the same parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, 2.0 / (1 + _distance(blocks[i - 1].home, b.home))))
        parent = id(b.home.up)
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, 0.5))
        last[parent] = i
    return out


@dataclass(frozen=True, slots=True)
class Model:
    """Weights of a block's features (their sum is its log-odds), scale of the edges."""

    weights: tuple[float, ...]
    scale: float

    def costs(self, blocks: list[Block]) -> list[float]:
        """Positive: what it costs to call the block boilerplate; negative: content."""
        return (features(blocks) @ np.array(self.weights)).tolist()

    def labels(self, blocks: list[Block]) -> list[bool]:
        return minimum_cut(self.costs(blocks), [(a, b, self.scale * w) for a, b, w in ties(blocks)])


def learn(train: list[tuple[str, dict[str, bool]]], choose: list[tuple[str, dict[str, bool]]], ridge: float = 0.02, steps: int = 40) -> Model:
    """Logistic regression by Newton's method on ``train``; the scale (the least of
    the best) is the one with which the cut errs least on ``choose``."""

    def known(pages):
        for page, truth in pages:
            blocks = blocks_of(page)
            yield blocks, [truth.get(b.text) for b in blocks]

    x, y = [], []
    for blocks, truth in known(train):
        rows = features(blocks)
        for row, t in zip(rows, truth, strict=True):
            if t is not None:
                x.append(row)
                y.append(t)
    xs, ys = np.array(x), np.array(y, float)
    w = np.zeros(xs.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
        grad = xs.T @ (p - ys) + ridge * w
        w -= np.linalg.solve((xs * (p * (1 - p))[:, None]).T @ xs + ridge * np.eye(len(w)), grad)
    weights = tuple(round(float(v), 6) for v in w)
    pages = list(known(choose))
    wrong = {s: sum(t is not None and t != k for blocks, truth in pages for t, k in zip(truth, Model(weights, s).labels(blocks), strict=True)) for s in SCALES}
    return Model(weights, min(SCALES, key=lambda s: (wrong[s], s)))


@lru_cache(maxsize=1)
def default_model() -> Model:
    return learn(labelled_pages(TRAIN_PAGES, 1) + plain_pages(PLAIN_PAGES, 3), labelled_pages(SCALE_PAGES, 2))


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for blocks on the content side.  Max-flow by shortest augmenting
    levels (Dinic); blocks with a zero cost and no pull are boilerplate."""
    n = len(unary)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def tie(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(there)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, u in enumerate(unary):
        if u > 0:
            tie(source, i, u, 0.0)
        elif u < 0:
            tie(i, sink, -u, 0.0)
    for a, b, w in edges:
        tie(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in graph[v]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        while True:  # one augmenting path at a time, without recursion
            path: list[int] = []
            v = source
            while v != sink:
                while turn[v] < len(graph[v]):
                    e = graph[v][turn[v]]
                    if room[e] > tiny and level[to[e]] == level[v] + 1:
                        break
                    turn[v] += 1
                else:
                    if not path:
                        break
                    v = to[path.pop() ^ 1]
                    turn[v] += 1
                    continue
                path.append(e)
                v = to[e]
            if v != sink:
                break
            flow = min(room[e] for e in path)
            for e in path:
                room[e] -= flow
                room[e ^ 1] += flow


def main_text(page: str | None, model: Model | None = None) -> str:
    """Content blocks in page order, joined by an empty line; "" if there are none."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    kept = (model or default_model()).labels(blocks)
    return "\n\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``; null html is
    an empty page.  Nothing else is dropped or cut: pages of any length are read whole,
    repeated rows stay repeated, an empty table gives no rows, and columns other than
    page_id, url and html are not read, so none clashes."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
