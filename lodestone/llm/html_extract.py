"""HTML main-text extraction by minimum-cut labelling (list item 7).

A page is cut to blocks of text at block-level tags. A logistic classifier over text and markup gives each block log odds of being
content: these are the capacities from the source (content) or to the sink (boilerplate). Smoothness edges
tie each block to the next one, more strongly the closer they stand in the element tree, and to the next one of the same parent.
The minimum cut, found by maximum flow, labels all blocks of the page together.

The classifier's weights are learned from pages that mark their article by its element: blocks inside are content, blocks outside are not. The
element itself is held out from learning; where a page has one, it adds ``MARKED``. A prior around weights set by hand keeps features that
the sample lacks, and is all there is for a corpus without such pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import arrays

#: Where markup may start, and in a tag what ends it or hides its end.
_OPENING = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_END = re.compile(r"[\"'>]")
#: Numbers of characters that are longer than any character's.
_LONG_NUMBER = re.compile(r"&#(?:0*+[0-9]{8,}+|[xX]0*+[0-9a-fA-F]{7,}+);?")
_ZEROS = re.compile(r"(&#[xX]?)0++(?=[0-9a-fA-F])")
_HINT = re.compile(r"""(?:\A|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SILENT = frozenset("script style template title textarea select option button datalist".split())
#: What of these is read as text only, up to their end or that of the page.
_RAW = frozenset("script style title textarea".split())
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*+>", re.IGNORECASE) for tag in _RAW}
#: Of these a second one closes the first.
_SINGLE = frozenset("select option button".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split()
)
_GAP = frozenset("br td th wbr img input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BAD_TAG = frozenset("nav aside footer form menu dialog fieldset head".split())
_GOOD_TAG = frozenset(("article", "main"))
_BAD_WORD = frozenset(
    "nav navbar navigation menu sidebar footer header masthead ad ads advert adverts advertisement banner promo promotion sponsor sponsored comment comments disqus respond cookie cookies consent notice alert popup modal overlay share sharing social breadcrumb breadcrumbs related recommended widget login signup subscribe newsletter form search toolbar pagination pager complementary contentinfo".split()
)
_GOOD_WORD = frozenset("article content main post entry story body text".split())
#: The classifier's features with the weights that learning starts from.
PRIOR = {"start": -1.0, "words": 2.4, "links": -3.0, "sentence": 0.8, "title": 1.5, "heading": 0.6, "item": -0.3, "kin": 1.0, "good name": 1.5, "bad name": -4.0}
#: Words of a block, and of all blocks of one parent, from which more make no difference.
_WORDS, _KIN = 40, 150
#: Log odds that the article's own element adds.
MARKED = 2.0
#: Pages that mark their article, and blocks of theirs, that weights are learned from at most; and the prior's weight against the mean loss.
TRAIN_PAGES, TRAIN_BLOCKS, PULL = 2_000, 20_000, 0.002
#: Smoothness: between neighbours of one parent, and along one parent; and its share with each step that neighbours are further apart in the
#: tree, and across the border of an element whose name tells boilerplate.
NEAR, PARENT, FAR, BORDER = 0.3, 0.3, 0.25, 0.25
_UNIT = 1000


@dataclass
class _Open:
    tag: str
    number: int
    bad: bool
    good: bool
    marked: bool = False
    outer: _Open | None = None
    depth: int = 1


@dataclass
class Block:
    """``inner``: the innermost open element; ``bad``, ``good``: what names around the block tell; ``marked``: whether it is in an article's element."""

    text: str
    linked: int
    tag: str
    inner: _Open
    bad: bool
    good: bool
    marked: bool


def _hints(attributes: str) -> set[str]:
    return {t.lower() for m in _HINT.finditer(attributes) for t in _TOKEN.findall(m[1] or m[2] or m[3] or "")}


class _Markup:
    """Goes forward over a page's tags. What a quote hides is looked at once, whatever starts before it."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        #: Quotes after which, read as opening ones, no end comes.
        self.open: set[int] = set()

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, slash, name (empty but for elements) and attributes of the next tag, comment or declaration from ``at`` on."""
        page = self.page
        while m := _OPENING.search(page, at):
            if m[1]:
                end = page.find("-->", m.end())
                return m.start(), len(page) if end < 0 else end + 3, "", "", ""
            if m.start() < self.last:
                end = self._end(m.end()) if m[3] else page.find(">", m.end()) + 1
                return m.start(), end, m[2] or "", m[3] or "", page[m.end() : end - 1] if m[3] else ""
            at = page.find("<!--", m.end())  # nothing else ends any more
            if at < 0:
                return None
        return None

    def _end(self, at: int) -> int:
        """Behind the bracket that ends a tag: the next one that no quotes hide, or, where they are not closed, the next one at all."""
        start, seen = at, []
        while m := _END.search(self.page, at):
            if m[0] == ">":
                return m.end()
            seen.append(m.start())
            at = -1 if m.start() in self.open else self.page.find(m[0], m.end()) + 1
            if at <= 0:
                break
        self.open.update(seen)
        return self.page.find(">", start) + 1

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the end of an element that is read as text only, or of the page."""
        end = _RAW_ENDS[tag].search(self.page, at)
        return end.end() if end else len(self.page)


def _unescaped(text: str) -> str:
    """References decoded; numbers beyond all characters, however long, are the replacement character."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", _ZEROS.sub(r"\1", text)) if "&#" in text else text)


def _closed(page: str) -> dict[int, int]:
    """From where a silent element starts to its end, for those that are closed before an element around them is.

    Others are not closed at all: what follows them is the page's text.
    """
    ends: dict[int, int] = {}
    stack: list[list] = []  # tag, start, whether it is still open
    count: dict[str, int] = {}
    at, markup = 0, _Markup(page)
    while m := markup.after(at):
        begin, at, closing, tag, attributes = m
        tag = tag.lower()
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                at = markup.raw_end(tag, at)
        elif tag in _SILENT or (tag in _BLOCK and tag not in _VOID):
            if closing:
                while count.get(tag):
                    last, start, live = stack.pop()
                    count[last] -= live
                    if live and last == tag:
                        if tag in _SILENT:
                            ends[start] = at
                        break
            elif tag in _BLOCK or not attributes.endswith("/"):
                if tag in _SINGLE and count.get(tag):
                    for one in reversed(stack):
                        if one[0] == tag and one[2]:
                            one[2] = 0
                            count[tag] -= 1
                            break
                stack.append([tag, begin, 1])
                count[tag] = count.get(tag, 0) + 1
    return ends


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order: references decoded, white space single, empty ones left out. Time is in proportion to the page."""
    out: list[Block] = []
    stack: list[_Open] = [_Open("", 0, False, False)]
    run: list[str] = []
    linked, in_link, number, at = 0, 0, 0, 0
    ends: dict[int, int] | None = None
    markup, count = _Markup(page), Counter()

    def pop() -> None:
        count[stack.pop().tag] -= 1

    def close() -> None:
        nonlocal linked
        if run:
            text = " ".join(_unescaped("".join(run)).split())
            if text:
                top = stack[-1]
                out.append(Block(text, linked, top.tag, top, top.bad, top.good, top.marked))
            run.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            run.append(text)
            if in_link:
                linked += len(text)

    while True:
        m = markup.after(at)
        say(page[at : m[0]] if m else page[at:])
        if not m:
            break
        begin, at, closing, tag, attributes = m
        if not tag:
            continue
        tag = tag.lower()
        if tag in _SILENT:
            if not closing and not attributes.endswith("/"):
                if tag in _RAW:
                    at = markup.raw_end(tag, at)
                else:
                    ends = _closed(page) if ends is None else ends
                    at = ends.get(begin, at)
            run.append(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in _GAP:
            run.append(" ")
        elif tag in _BLOCK:
            close()
            in_link = 0
            if closing:
                while count[tag]:
                    last = stack[-1].tag
                    pop()
                    if last == tag:
                        break
            elif tag not in _VOID:
                if stack[-1].tag == "p" or (tag in ("li", "dd", "dt", "tr") and stack[-1].tag == tag):
                    pop()
                number += 1
                outer, said = stack[-1], _hints(attributes) if attributes else set()
                within = outer.good or outer.marked
                bad = tag in _BAD_TAG or (tag == "header" and not within)
                if said & _BAD_WORD and not said & _GOOD_WORD and tag not in ("html", "body", "article", "main") and not (within and said <= {"header", "entry", "post", "article"}):
                    bad = True
                good = bool(said & _GOOD_WORD and not said & _BAD_WORD and tag not in ("html", "body"))
                stack.append(_Open(tag, number, outer.bad or bad, outer.good or good, outer.marked or tag in _GOOD_TAG, outer, outer.depth + 1))
                count[tag] += 1
    close()
    return out


def _parent(block: Block) -> int:
    return block.inner.outer.number if block.inner.outer else 0


def features(found: list[Block]) -> list[list[float]]:
    """Of each block of a page, in the order of ``PRIOR``."""
    words = [b.text.count(" ") + 1 for b in found]
    kin: dict[int, int] = {}
    for b, n in zip(found, words):
        kin[_parent(b)] = kin.get(_parent(b), 0) + n * (not b.linked)
    out = []
    for b, n in zip(found, words):
        sentence = b.text[-1] in ".!?…:;\"”»)。"
        heading = b.tag in ("h2", "h3", "h4", "h5", "h6")
        mass = min(kin[_parent(b)], _KIN) / _KIN
        out.append([1.0, min(n, _WORDS) / _WORDS, min(1.0, b.linked / len(b.text)), sentence, b.tag == "h1", heading, b.tag == "li", mass, b.good and not b.bad, b.bad])
    return out


def scores(found: list[Block], weights: Sequence[float] = tuple(PRIOR.values())) -> list[float]:
    """The classifier's log odds that each block of a page is content."""
    return [sum(w * x for w, x in zip(weights, row)) + MARKED * b.marked for b, row in zip(found, features(found))]


def fitted(x: np.ndarray, y: np.ndarray, pull: float = PULL) -> list[float]:
    """Weights of the logistic regression of ``y`` on the columns of ``x``, drawn to ``PRIOR``, by Newton's method."""
    prior = np.array(list(PRIOR.values()))
    w = prior.copy()
    for _ in range(50 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + pull * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + pull * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w = w - move * min(1.0, 2 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-8:
            break
    return w.tolist()


def _apart(a: Block, b: Block) -> int:
    """Steps in the element tree between two blocks' parents."""
    x, y, steps = a.inner, b.inner, 0
    while x is not y:
        if x.depth >= y.depth:
            x = x.outer
        else:
            y = y.outer
        steps += 1
    return steps


def _tie(strength: float, a: Block, b: Block) -> float:
    return strength if a.bad == b.bad else strength * BORDER


def labels(found: list[Block], weights: Sequence[float] = tuple(PRIOR.values())) -> list[bool]:
    """Which blocks are content: the source's side of the minimum cut."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            edges[i - 1, i] = _tie(NEAR * FAR ** max(0, _apart(found[i - 1], b) - 2), found[i - 1], b)
        parent = _parent(b)
        if parent in last:
            key = (last[parent], i)
            edges[key] = edges.get(key, 0) + _tie(PARENT, found[last[parent]], b)
        last[parent] = i
    return minimum_cut([round(x * _UNIT) for x in scores(found, weights)], {k: round(w * _UNIT) for k, w in edges.items()})


def minimum_cut(gain: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """True for nodes on the source's side. ``gain``: capacity from the source, or, if negative, to the sink; edges go both ways.

    Maximum flow by shortest augmenting paths, phase by phase: levels from all nodes that can still send, then paths along
    levels to nodes that can still take.
    """
    n = len(gain)
    excess = list(gain)
    room: list[dict[int, int]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        room[a][b] = room[b][a] = w
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if excess[i] > 0)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            a = queue.popleft()
            if excess[a] < 0:
                reached = True
            for b, w in room[a].items():
                if w > 0 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if not reached:
            return [x >= 0 for x in level]
        ways = [iter(list(r)) for r in room]
        for source in range(n):
            while excess[source] > 0 and level[source] == 0:
                path, a = [source], source
                while excess[a] >= 0:
                    for b in ways[a]:
                        if room[a][b] > 0 and level[b] == level[a] + 1:
                            path.append(b)
                            ways[a] = _again(b, ways[a])
                            a = b
                            break
                    else:
                        level[a] = -2  # no way on from here in this phase
                        path.pop()
                        if not path:
                            break
                        a = path[-1]
                if not path:
                    break
                flow = min(excess[source], -excess[a], *(room[x][y] for x, y in zip(path, path[1:])))
                for x, y in zip(path, path[1:]):
                    room[x][y] -= flow
                    room[y][x] += flow
                excess[source] -= flow
                excess[a] += flow


def _again(first: int, rest: Iterator[int]) -> Iterator[int]:
    yield first
    yield from rest


def main_text(page: str | None, weights: Sequence[float] = tuple(PRIOR.values())) -> str:
    """The page's content blocks, joined by an empty line."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, labels(found, weights)) if keep)


@arrays.tidy
def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of pages' blocks and whether they are content. Of an article's blocks those with a name of boilerplate are left out: they may be either."""
    names = ["page", "place", "content", "x"]
    for batch, _, _ in arrays.passes(batches, "html"):
        rows = []
        for key, page in zip(*(batch.column(c).to_pylist() for c in ("page", "html"))):
            found = blocks(page)
            rows += [(key, i, b.marked, [float(v) for v in x]) for i, (b, x) in enumerate(zip(found, features(found))) if not (b.marked and b.bad)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.float64())))], names)


def train(pages: DataFrame, most_pages: int = TRAIN_PAGES, most_blocks: int = TRAIN_BLOCKS) -> list[float]:
    """The classifier's weights, from at most ``most_pages`` pages that mark their article (those of least hash) and ``most_blocks`` of their blocks."""
    marked = pages.filter(F.col("html").rlike("(?i)<(article|main)[\\s>]")).select(F.xxhash64("html").alias("page"), "html")
    some = marked.select("page").distinct().orderBy("page").limit(most_pages)
    sample = marked.join(F.broadcast(some), "page", "left_semi").mapInArrow(_labelled, "page bigint, place bigint, content boolean, x array<double>").dropDuplicates(["page", "place"])
    rows = sample.orderBy(F.xxhash64("page", "place"), "page", "place").limit(most_blocks).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(PRIOR))
    return fitted(x, rows.column("content").to_numpy().astype(float))


def _extract(weights: Sequence[float]):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in arrays.passes(batches, "html"):
            texts = [main_text(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return arrays.tidy(extract)


def extract(pages: DataFrame, weights: Sequence[float] | None = None) -> DataFrame:
    """One row per input row: ``page_id, url, text`` (empty if nothing is content, for null html too) and ``n_chars``.

    ``weights`` default to what ``train`` learns from the pages themselves. The whole page is read; broken markup (unclosed elements, stray
    brackets, cut references) is taken as browsers would, as far as text goes. Null ids and urls stay null, repeated rows are extracted
    each, other columns are ignored, and an empty table gives an empty result. Equal pages have equal texts, also where scores tie (a tie
    is boilerplate).
    """
    arrays.session_limits(pages)
    slim = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = slim.mapInArrow(_extract(train(slim) if weights is None else weights), "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
