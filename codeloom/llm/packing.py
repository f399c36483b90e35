"""Order-preserving packing of documents into fixed windows by dynamic programming.

Documents keep their order by doc_id. Every document is a run of sentences, the
places where a window may be cut; a cut that truncates a document at a sentence costs
SPLIT tokens, one between documents nothing. A sentence longer than a window
has further places every ``window`` tokens, each costing HARD, so no text is lost. A
window of at most ``window`` tokens costs its padding. With cut(j) the penalty of place j,
best[j] = cut(j) + min over i of best[i] + window - (total[j] - total[i]), where
total[j] - total[i] <= window: the admissible i form a sliding interval and the
key best[i] + total[i] doesn't depend on j, so a monotone queue finds every
minimum in constant amortised time.

The order is cut into shards of about SHARD tokens, whatever the ids are, which are
packed in parallel. Shard k begins at a cut near token k * SHARD: the nearest one of the best
packing of MARGIN windows on either side. So no window is closed because a shard
ends, the shards are the same on every run, and only sentence lengths are shuffled, never text.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Table
from .text import buffers, chunks, plain, word_spans

WINDOW, SPLIT, HARD, SHARD, MARGIN = 2048, 64, 256, 1 << 22, 32
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "_"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True

_PIECE = "struct<doc_id:long,first_sentence:int,sentences:int,tokens:int,start:long,end:long>"
_WINDOWS = f"shard long, window int, tokens int, padding int, split boolean, pieces array<{_PIECE}>"


def sentences(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and end byte of every sentence, whether it goes on after it, and the first sentence of every text.

    A token is a word or one ASCII mark. A sentence ends after a run of . ! ? that blank space or
    the text's end follows, or after a line break; the rest of a text is one too. One of more than
    ``window`` tokens is several, of ``window`` tokens but for the last. Together they cover the text.
    """
    raw, offsets = buffers(texts)
    start, _, _ = word_spans(raw, offsets)
    if not len(raw):
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, bool), np.zeros(len(offsets), np.int64)
    after = np.ones(len(raw), bool)
    after[:-1] = _BLANK[raw[1:]]
    stop = (_END[raw] & after) | (raw == 10)
    last = offsets[1:][np.diff(offsets) > 0] - 1
    stop[last] = True
    end = np.flatnonzero(stop) + 1
    token = _MARK[raw]
    token[start] = True
    total = np.concatenate([[0], np.cumsum(token, dtype=np.int64)])
    begin = np.concatenate([[0], end[:-1]])
    forced = np.zeros(len(end), bool)
    long = np.flatnonzero(total[end] - total[begin] > window)
    if len(long):
        more = np.concatenate([begin[k] + np.flatnonzero(token[begin[k] : end[k]])[window::window] for k in long])
        end = np.concatenate([end, more])
        order = np.argsort(end, kind="stable")
        end, forced = end[order], np.concatenate([forced, np.ones(len(more), bool)])[order]
    return np.diff(total[np.concatenate([[0], end])]), end, forced, np.searchsorted(end, offsets, side="right")


def choose_cuts(tokens: list[int], penalty: list[int], window: int) -> tuple[int, list[int]]:
    """The least cost and the ends (exclusive) of the windows. tokens are at most ``window`` each; penalty is that of a cut after each."""
    total, best, back = 0, 0, [0]
    sums = [0]
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j, (n, cut) in enumerate(zip(tokens, penalty, strict=True), 1):
        total += n
        sums.append(total)
        while sums[queue[0][1]] < total - window:
            queue.popleft()
        key, i = queue[0]
        best = key + window - total + cut
        back.append(i)
        key = best + total
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(tokens)
    while j:
        cuts.append(j)
        j = back[j]
    return best, cuts[::-1]


def _lengths(docs: DataFrame, window: int) -> DataFrame:
    """Tokens (n) and ends (e) of each document's sentences; the end is negative where a sentence goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                texts = plain(part.column("t"))
                n, end, forced, first = sentences(texts, window)
                _, offsets = buffers(texts)
                own = np.repeat(np.arange(len(texts)), np.diff(first))
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (n, np.where(forced, -1, 1) * (end - offsets[own]))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *lists], ["id", "n", "e"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t")).where("id is not null and length(t) > 0")
    return narrow.mapInArrow(run, "id long, n array<int>, e array<int>")


def _ordered(docs: DataFrame, window: int) -> Table:
    """``(id, n, e, h, part, at, t)``: sentences of the documents in order, each range of the order with its own running number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = batch.column("t").to_numpy().astype(np.int64)
            at = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "at"])

    tokens = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = _lengths(docs, window).withColumn("t", tokens).where("t > 0").withColumn("h", F.xxhash64("n", "e"))
    ranged = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "n", "e").withColumn("part", F.spark_partition_id())
    return Table(ranged.mapInArrow(run, "id long, n array<int>, e array<int>, t long, h long, part int, at long"), "sentences")


def pack(docs: DataFrame, window: int = WINDOW, split: int = SPLIT, hard: int = HARD, shard: int = SHARD, margin: int = MARGIN) -> DataFrame:
    """One row a window: shard, number, tokens, padding, whether it ends inside a document, and its pieces.

    A piece is a run of sentences of one document with its tokens and its range of UTF-8 bytes.
    Documents follow each other by doc_id; rows that share one by a hash of their sentence lengths. Texts
    that are null, empty or without tokens, and rows without a doc_id, take no place. Only doc_id and text are read.
    """
    near = margin * window
    if shard < 2 * near:
        raise ValueError("a shard must hold twice its margin of windows")
    ordered = _ordered(docs, window)
    spark, base, starts = docs.sparkSession, 0, []
    for r in ordered.df.groupBy("part").agg(F.sum("t").alias("t")).orderBy("part").collect():  # a row a range
        starts.append((r.part, base))
        base += r.t
    begin = spark.createDataFrame(starts, "part int, base long")
    rows = ordered.df.join(F.broadcast(begin), "part").select("id", "n", "e", (F.col("base") + F.col("at")).alias("g"), "t")
    shards = max(1, -(-base // shard))
    first, last = F.floor((F.col("g") - near) / shard) + 1, F.floor((F.col("g") + F.col("t") + near - 1) / shard)
    edges = rows.withColumn("k", F.explode(F.sequence(F.greatest(first, F.lit(1)), F.least(last, F.lit(shards - 1))))) if shards > 1 else rows.limit(0).withColumn("k", F.lit(0).cast("long"))
    edges = edges.where((F.greatest(first, F.lit(1)) <= F.col("k")) & (F.col("k") <= last))
    cuts = Table(_groups(edges.select(F.col("k").alias("shard"), F.lit(0).alias("kind"), "g", "id", "n", "e"), lambda k, _, own: _cut(k, own, window, split, hard, shard, near), "k long, at long"), "cuts").df
    inside = F.explode(F.sequence(F.greatest(F.floor((F.col("g") - near) / shard), F.lit(0)), F.least(last, F.lit(shards - 1))))
    blank = [F.lit(None).cast("long").alias("id"), *(F.lit(None).cast("array<int>").alias(c) for c in "ne")]
    parts = rows.select(inside.alias("shard"), F.lit(2).alias("kind"), "g", "id", "n", "e")
    ends = cuts.select(F.col("k").alias("shard"), F.lit(0).alias("kind"), F.col("at").alias("g"), *blank).union(cuts.select(F.col("k") - 1, F.lit(1), "at", *blank))
    return _groups(parts.union(ends), lambda k, ends, own: _windows(k, ends, own, window, split, hard), _WINDOWS)


def _groups(rows: DataFrame, use: Callable, schema: str) -> DataFrame:
    """use(shard, {kind: g of the cut}, [(g, id, n, e), ...]) of every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends, held = None, {}, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "kind", "g", "id")]
            for key, kind, g, doc, n, e in zip(*columns, batch.column("n"), batch.column("e"), strict=True):
                if key != now:
                    if held:
                        yield from use(now, ends, held)
                    now, ends, held = key, {}, []
                if kind < 2 and doc is None:
                    ends[kind] = g
                else:
                    held.append((g, doc, n.values.to_numpy().astype(np.int64), e.values.to_numpy().astype(np.int64)))
        if held:
            yield from use(now, ends, held)

    return rows.repartition("shard").sortWithinPartitions("shard", "kind", "g").select("shard", "kind", "g", "id", "n", "e").mapInArrow(run, schema)


class _Run:
    """Sentences of documents in order: tokens, tokens up to the end of each in the whole order, its document, place in it, bytes, and the penalty of a cut after it."""

    def __init__(self, docs: list[tuple[int, int, np.ndarray, np.ndarray]], low: int, high: int, split: int, hard: int) -> None:
        sizes = np.array([len(n) for _, _, n, _ in docs])
        first = np.cumsum(sizes) - sizes
        tokens, end = np.concatenate([n for _, _, n, _ in docs]), np.concatenate([e for _, _, _, e in docs])
        owner = np.repeat(np.arange(len(docs)), sizes)
        total = np.cumsum(tokens)
        until = total - np.repeat(total[first] - tokens[first], sizes) + np.repeat(np.array([g for g, *_ in docs]), sizes)
        start = np.concatenate([[0], np.abs(end[:-1])])
        start[first] = 0
        last = np.zeros(len(tokens), bool)
        last[first + sizes - 1] = True
        penalty = np.where(last, 0, np.where(end < 0, hard, split))
        ok = (until > low) & (until <= high)
        self.tokens, self.until, self.owner, self.place = tokens[ok], until[ok], owner[ok], (np.arange(len(tokens)) - np.repeat(first, sizes))[ok]
        self.start, self.end, self.last, self.penalty = start[ok], np.abs(end)[ok], last[ok], penalty[ok]


_FAR = 1 << 62


def _cut(k: int, docs: list, window: int, split: int, hard: int, shard: int, near: int) -> Iterator[pa.RecordBatch]:
    run = _Run(docs, k * shard - near, k * shard + near, split, hard)
    at = k * shard
    if len(run.tokens):
        _, cuts = choose_cuts(run.tokens.tolist(), run.penalty.tolist(), window)
        ends = run.until[np.array(cuts) - 1]
        at = int(ends[np.argmin(np.abs(ends - k * shard))])
    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([at])], ["k", "at"])


def _windows(shard: int, ends: dict[int, int], docs: list, window: int, split: int, hard: int) -> Iterator[pa.RecordBatch]:
    run = _Run(docs, ends.get(0, -1), ends.get(1, _FAR), split, hard)
    if not len(run.tokens):
        return
    _, cuts = choose_cuts(run.tokens.tolist(), run.penalty.tolist(), window)
    cuts = np.array(cuts, np.int64)
    begin = np.concatenate([[0], cuts[:-1]])
    first = np.flatnonzero(np.concatenate([[True], run.owner[1:] != run.owner[:-1]]))
    edges = np.unique(np.concatenate([begin, first]))
    stop = np.append(edges[1:], len(run.tokens))
    total = np.concatenate([[0], np.cumsum(run.tokens)])
    used = total[cuts] - total[begin]
    ids = np.array([d for _, d, _, _ in docs], np.int64)
    columns = (ids[run.owner[edges]], run.place[edges].astype(np.int32), (stop - edges).astype(np.int32), (total[stop] - total[edges]).astype(np.int32), run.start[edges], run.end[stop - 1])
    pieces = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["doc_id", "first_sentence", "sentences", "tokens", "start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(edges, begin), len(edges)).astype(np.int32)), pieces)
    n = len(cuts)
    arrays = [np.full(n, shard, np.int64), np.arange(n, dtype=np.int32), used.astype(np.int32), (window - used).astype(np.int32), ~run.last[cuts - 1]]
    yield pa.RecordBatch.from_arrays([*(pa.array(a) for a in arrays), lists], ["shard", "window", "tokens", "padding", "split", "pieces"])
