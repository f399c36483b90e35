"""Main content of web pages as a maximum-scoring subsequence of tags and words.

A page is a sequence of tags with runs of words between them. A word scores
the same positive weight, a tag the negative weight of its name, and one linear
scan finds the contiguous region with the highest sum (Pasternack and Roth,
"Extracting Article Text from the Web with Maximum Subsequence Segmentation",
2009). The weights come from labelled pages: those whose only article or main element says
what their content is. A weight is the log ratio of a token's share inside to its
share outside, kept positive for words and negative for tags; the word weight is
then multiplied by the factor of SCALES with the best mean F1 on these pages. The
labelling elements themselves have no weight of their own.
"""

from __future__ import annotations

import html
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import buffers, chunks, plain, word_spans

#: At most so many labelled pages, of at most so many bytes each, are used to fit the weights; every page is extracted.
LABELLED_PAGES, LABELLED_BYTES = 2_000, 1 << 20
LEAST, MOST = 0.05, 8.0
SCALES = (0.25, 0.5, 1.0, 2.0, 4.0)
NAMES = (
    b"", b"a", b"abbr", b"address", b"area", b"aside", b"audio", b"b", b"base", b"bdi", b"bdo", b"big", b"blockquote", b"body", b"br", b"button", b"canvas", b"caption", b"center", b"cite", b"code", b"col",
    b"colgroup", b"data", b"datalist", b"dd", b"del", b"details", b"dfn", b"dialog", b"div", b"dl", b"dt", b"em", b"embed", b"fieldset", b"figcaption", b"figure", b"font", b"footer", b"form", b"frame", b"h1",
    b"h2", b"h3", b"h4", b"h5", b"h6", b"head", b"header", b"hr", b"html", b"i", b"iframe", b"img", b"input", b"ins", b"kbd", b"label", b"legend", b"li", b"link", b"map", b"mark", b"menu", b"meta", b"nav",
    b"noscript", b"object", b"ol", b"optgroup", b"option", b"output", b"p", b"param", b"picture", b"pre", b"progress", b"q", b"s", b"samp", b"script", b"section", b"select", b"small", b"source", b"span",
    b"strong", b"style", b"sub", b"summary", b"sup", b"svg", b"table", b"tbody", b"td", b"template", b"textarea", b"tfoot", b"th", b"thead", b"time", b"title", b"tr", b"track", b"u", b"ul", b"var", b"video", b"wbr",
)
_ID = {name: k for k, name in enumerate(NAMES)}
#: Tags that only label content; they count as unknown ones.
_CONTENT = (b"article", b"main")
#: Nothing in it goes back over what it has read, and it is only applied up to a page's last ">", so a page takes linear time.
_TAG = re.compile(rb"<!--.*?(?:(-->)|\Z)|<(script|style)\b[^>]*+>.*?(?:(</\2\s*+>)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*+)[^>]*+>|<[!?][^>]*+>", re.DOTALL | re.IGNORECASE)
_INLINE = frozenset((b"a", b"abbr", b"b", b"bdi", b"bdo", b"big", b"cite", b"code", b"dfn", b"em", b"font", b"i", b"ins", b"kbd", b"label", b"mark", b"q", b"s", b"samp", b"small", b"span", b"strong", b"sub", b"sup", b"time", b"u", b"var", b"wbr"))
_PAGE = "page_id long, content string, n_words long, start_byte long, end_byte long"


@dataclass
class Tokens:
    """Tags of one page: name index, byte range, the words before the first tag and after each, and whether they lie inside a content element."""

    tag: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    inside: np.ndarray
    labelled: bool


def tokens(page: bytes, first_words: np.ndarray) -> Tokens:
    """first_words: sorted places of the first byte of every word of the page's bytes, markup included."""
    tag, start, end, inside, depth, opened = array("H", [0]), array("q", [0]), array("q", [0]), array("B", [0]), 0, 0
    last = page.rfind(b">") + 1
    for m in _TAG.finditer(page, 0, last):
        name = (m[5] or m[2] or b"").lower()
        if name in _CONTENT:
            depth = max(0, depth + (-1 if m[4] else 1))
            opened += not m[4]
        tag.append(_ID.get(name, 0))
        start.append(m.start())
        end.append(m.end())
        inside.append(depth > 0)
        if m.end() == last and not (m[1] or m[3]) and (m[2] or page.startswith(b"<!--", m.start())):
            end[-1] = len(page)  # what a comment, script or style without an end holds
    open_ = page.find(b"<!--", max(last, end[-1]))
    if open_ >= 0:
        for column, value in ((tag, 0), (start, open_), (end, len(page)), (inside, depth > 0)):
            column.append(value)
    after = np.append(start[1:], len(page))
    counts = np.searchsorted(first_words, after) - np.searchsorted(first_words, end)
    return Tokens(np.array(tag, np.int64), np.array(start), np.array(end), counts, np.array(inside, bool), opened == 1)


@dataclass(frozen=True)
class Weights:
    word: float
    tag: np.ndarray


DEFAULT = Weights(1.0, np.full(len(NAMES), -3.0))


def best_region(t: Tokens, weights: Weights) -> tuple[int, int]:
    """First and last of the word runs of the highest-scoring region; (0, -1) without words. Of equal ones the first, then shortest."""
    if not t.words.any():
        return 0, -1
    cost = weights.tag[t.tag]
    cost[0] = 0.0
    total = np.cumsum(cost + weights.word * t.words)
    begin = total - weights.word * t.words  # the sum before each run of words
    low = np.minimum.accumulate(begin)
    last = int(np.argmax(np.round(total - low, 9)))
    return int(np.flatnonzero(begin[: last + 1] == low[last])[-1]), last


def _scores(t: Tokens, weights: Weights) -> float:
    first, last = best_region(t, weights)
    chosen = np.zeros(len(t.words), bool)
    chosen[first : last + 1] = True
    hit = t.words[chosen & t.inside].sum()
    return 2 * hit / max(1, t.words[chosen].sum() + t.words[t.inside].sum())


def fit(pages: list[Tokens]) -> Weights:
    """Weights from labelled pages; DEFAULT if there is none with words inside and outside of its content."""
    words, tags = np.zeros(2), np.zeros((2, len(NAMES)))
    for t in pages:
        side = t.inside.astype(int)
        words += np.bincount(side, t.words, 2)
        for k in (0, 1):
            tags[k] += np.bincount(t.tag[1:][side[1:] == k], minlength=len(NAMES))
    if not words.all():
        return DEFAULT
    total = words + tags.sum(axis=1)
    word = float(np.clip(np.log(words[1] / total[1]) - np.log(words[0] / total[0]), LEAST, MOST))
    share = np.log((tags[1] + 0.5) / (total[1] + 1)) - np.log((tags[0] + 0.5) / (total[0] + 1))
    tag = np.where(tags.sum(axis=0) > 0, np.clip(share, -MOST, -LEAST), -1.0)
    tag[0] = -1.0
    made = [Weights(word * k, tag) for k in SCALES]
    return made[int(np.argmax([np.mean([_scores(t, w) for t in pages]) for w in made]))]


def _pages(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, Tokens]]:
    """(row, bytes, tokens) of every page of a chunk."""
    texts = plain(batch.column("h"))
    raw, offsets = buffers(texts)
    start, _, first = word_spans(raw, offsets)
    data = raw.tobytes()
    for k in range(len(texts)):
        page = data[offsets[k] : offsets[k + 1]]
        yield k, page, tokens(page, start[first[k] : first[k + 1]] - offsets[k])


def train(pages: DataFrame, limit: int = LABELLED_PAGES, most_bytes: int = LABELLED_BYTES) -> Weights:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "h"):
                found = [t for _, _, t in _pages(part)]
                lists = [pa.array([x.tolist() for x in column]) for column in ([t.tag for t in found], [t.words for t in found], [t.inside for t in found])]
                yield pa.RecordBatch.from_arrays([pa.array([t.labelled for t in found], pa.bool_()), lists[0].cast(pa.list_(pa.int32())), lists[1].cast(pa.list_(pa.int32())), lists[2].cast(pa.list_(pa.bool_()))], ["labelled", "tag", "words", "inside"])

    marked = pages.select(F.col("page_id").cast("long").alias("id"), F.col("html").alias("h")).where("id is not null and octet_length(h) <= %d and h rlike '(?i)<(article|main)[ >]'" % most_bytes)
    chosen = marked.select("id").orderBy(F.xxhash64("id", F.lit(3)), "id").limit(limit).distinct()
    sample = marked.join(F.broadcast(chosen), "id").orderBy("id", F.xxhash64("h")).select("h")
    rows = sample.mapInArrow(run, "labelled boolean, tag array<int>, words array<int>, inside array<boolean>").where("labelled").toPandas()
    blank = np.empty(0)
    return fit([Tokens(np.array(r.tag), blank, blank, np.array(r.words), np.array(r.inside, bool), True) for r in rows.itertuples()])


def content(page: bytes, t: Tokens, first: int, last: int) -> str:
    """The text between the region's ends: markup removed, entities decoded, one line a block, single spaces."""
    parts = []
    stops = np.append(t.start[1:], len(page))
    for k in range(first, last + 1):
        if k > first and NAMES[t.tag[k]] not in _INLINE:
            parts.append(b"\n")
        parts.append(page[t.end[k] : stops[k]])
    lines = (" ".join(x.split()) for x in html.unescape(b"".join(parts).decode("utf-8", "replace")).split("\n"))
    return "\n".join(x for x in lines if x)


def extracted(pages: DataFrame, limit: int = LABELLED_PAGES) -> DataFrame:
    """``(page_id, content, n_words, start_byte, end_byte)`` for every row of pages.

    Pages that are null, empty or without words have an empty content, no words and the range 0 to 0. Rows are
    handled one by one, so repeated rows give repeated results and a null page_id is carried. A page
    without tags is all content. Without labelled pages the weights are DEFAULT. Only page_id and html are read.
    """
    weights = train(pages, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "h"):
                rows = []
                for _, page, t in _pages(part):
                    first, last = best_region(t, weights)
                    if last < first:
                        rows.append(("", 0, 0, 0))
                    else:
                        stop = t.start[last + 1] if last + 1 < len(t.start) else len(page)
                        rows.append((content(page, t, first, last), int(t.words[first : last + 1].sum()), int(t.end[first]), int(stop)))
                arrays = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 3), strict=True)]
                yield pa.RecordBatch.from_arrays([pc.cast(part.column("id"), pa.int64()), *arrays], [c.split()[0] for c in _PAGE.split(", ")])

    return pages.select(F.col("page_id").cast("long").alias("id"), F.col("html").alias("h")).mapInArrow(run, _PAGE)
