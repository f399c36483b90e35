"""Language-model scores from a probabilistic suffix tree over UTF-8 bytes.

Ron, Singer and Tishby, "The Power of Amnesia" (1996), with their bound L on the memory as DEPTH.
All runs of DEPTH + 1 bytes of the corpus are counted. A context of any length up to
DEPTH is retained if the next-byte distribution after it diverges from the one after
its suffix: N * KL >= DIVERGES nats, N its occurrences. Nothing else leaves a context out, so the
tree grows with the corpus. Suffixes of retained contexts are retained as well. Distributions
are smoothed towards that of the suffix by Witten and Bell's rule, the root's towards the uniform one.
Every byte of a document is predicted from the longest suffix of what precedes
it that is a state of the tree; for the first bytes of a document that is as long as they are.

A key holds a context, the nearest symbol in its highest bits, and a next byte; so suffixes are
prefixes of the key, and the tree is grown in parallel by the two nearest symbols. Only contexts of
one symbol at most come to the driver. The tree is a table of seen next bytes and, for each context,
the cost of passing to its suffix. It lies in the shared folder in parts of about PART rows by the
two nearest symbols; a task that scores texts holds one part at a time if there are many.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Table, new_path
from .text import buffers, chunks, plain

DEPTH, DIVERGES = 6, 12.0
#: Rows of the tree in one part, rows that a task keeps loaded, bytes of text that it scores at a time, and keys that wait until they are merged into its counts.
PART, HELD, BLOCK, WAITING = 4_000_000, 8_000_000, 1 << 19, 1 << 19
_START = 257  # stands before a document; byte b is b + 1, and 0 is no symbol
_BITS = 9
_BYTE = (1 << _BITS) - 1
_SCORE = "doc_id long, n_bytes long, bits_per_byte double, mean_context double"


def _mask(level: int, depth: int) -> int:
    """Selects the nearest ``level`` symbols of a key."""
    return ((1 << _BITS * level) - 1) << _BITS * (depth + 1 - level)


def grams(raw: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """One key a byte: the ``depth`` symbols before it from the nearest to the farthest, then the byte, 9 bits each."""
    n = len(raw)
    symbol = raw.astype(np.int64) + 1
    since = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    key = np.zeros(n, np.int64)
    for k in range(1, depth + 1):
        before = np.full(n, _START, np.int64)
        before[k:] = symbol[: n - k] if n > k else 0
        before[since < k] = _START
        key = (key << _BITS) | before
    return (key << _BITS) | symbol


def blocks(raw: np.ndarray, offsets: np.ndarray, depth: int, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """Where each run of at most ``size`` bytes begins, and its keys; so a text of any length takes bounded memory."""
    for low in range(0, len(raw), size):
        high, before = min(low + size, len(raw)), max(low - depth, 0)
        own = np.unique(np.clip(offsets, before, high)) - before
        yield low, grams(raw[before:high], own, depth)[low - before :]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _merged(keys: np.ndarray, counts: np.ndarray, new: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sets of sorted keys as one; counts may be changed in place. Only the result is as long as the keys held."""
    at = np.searchsorted(keys, new)
    there = np.zeros(len(new), bool)
    inner = at < len(keys)
    there[inner] = keys[at[inner]] == new[inner]
    counts[at[there]] += n[there]
    at, new, n = at[~there], new[~there], n[~there]
    at += np.arange(len(at))
    old = np.ones(len(keys) + len(new), bool)
    old[at] = False
    out = []
    for held, more in ((keys, new), (counts, n)):
        both = np.empty(len(old), np.int64)
        both[at], both[old] = more, held
        out.append(both)
    return tuple(out)


def _trim() -> None:
    """Hands freed memory back to the system at the end of a task, as its worker lives on beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _counted(batches: Iterator[pa.RecordBatch], depth: int, held: int) -> Iterator[pa.RecordBatch]:
    """``(key, n)`` of the texts t of a task, combined up to ``held`` keys at a time."""
    keys, counts, waiting, n_waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def pieces(size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), size):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + size]), pa.array(counts[k : k + size])], ["key", "n"])

    for batch in batches:
        for part in chunks(batch, "t"):
            for _, own in blocks(*buffers(plain(part.column("t"))), depth, WAITING):
                waiting.append(own)
                n_waiting += len(own)
                if n_waiting >= WAITING:
                    new, n = np.unique(np.concatenate(waiting), return_counts=True)
                    waiting, n_waiting = [], 0
                    keys, counts = _merged(keys, counts, new, n)
                    if len(keys) > held:
                        yield from pieces()
                        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    if waiting:
        keys, counts = _merged(keys, counts, *np.unique(np.concatenate(waiting), return_counts=True))
        waiting = []
    yield from pieces()


def gram_counts(docs: DataFrame, depth: int = DEPTH, held: int = 1 << 21) -> DataFrame:
    """``(key, n)`` over all texts; each task combines its own counts, up to ``held`` keys at a time, before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(batches, depth, held)
        _trim()

    return docs.select(F.col("text").alias("t")).where("length(t) > 0").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Level:
    """Contexts of one length: (context, next byte) keys in order, their counts, and for each context where its keys begin, its count N and its kinds of next bytes."""

    keys: np.ndarray
    n: np.ndarray
    first: np.ndarray
    total: np.ndarray
    kinds: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray) -> Level:
        context = keys & ~_BYTE
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        return cls(keys, n, first, np.add.reduceat(n, first), np.diff(np.append(first, len(keys))))

    @property
    def context(self) -> np.ndarray:
        return self.keys[self.first] & ~_BYTE

    def spread(self, per_context: np.ndarray) -> np.ndarray:
        return np.repeat(per_context, self.kinds)


def _diverges(level: Level, up: Level, depth: int, d: int, least: float) -> np.ndarray:
    """Whether N * KL of each context against its suffix, which is in ``up``, reaches ``least``."""
    at = np.searchsorted(up.keys, level.keys & (_mask(d - 1, depth) | _BYTE))
    ratio = np.log(level.n / level.spread(level.total)) - np.log(up.n[at] / up.spread(up.total)[at])
    return np.round(np.add.reduceat(level.n * ratio, level.first), 6) >= least


def _smoothed(level: Level, below: np.ndarray) -> np.ndarray:
    """Probability of each seen next byte; below: that after the suffix."""
    kinds = level.spread(level.kinds)
    return (level.n + kinds * below) / (level.spread(level.total) + kinds)


def _rows(level: Level, p: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tree rows of the kept contexts: -log2 p of the seen next bytes; under no byte, that of passing to the suffix."""
    own = level.spread(keep)
    keys = np.concatenate([level.context[keep], level.keys[own]])
    bits = -np.log2(np.concatenate([(level.kinds / (level.total + level.kinds))[keep], p[own]]))
    return keys, bits.astype(np.float32)


def _grow(keys: np.ndarray, n: np.ndarray, top: np.ndarray, depth: int, diverges: float) -> tuple[np.ndarray, np.ndarray]:
    """Tree rows of all contexts of two symbols or more whose grams are given. top: keys, counts and probabilities of one symbol."""
    levels: dict[int, Level] = {depth: Level.of(keys, n)}
    for d in range(depth - 1, 1, -1):
        keys, n = _summed(levels[d + 1].keys & (_mask(d, depth) | _BYTE), levels[d + 1].n)
        levels[d] = Level.of(keys, n)
    one = Level.of(top[0].astype(np.int64), top[1].astype(np.int64))
    keep = {}
    for d in range(depth, 1, -1):
        keep[d] = _diverges(levels[d], levels[d - 1] if d > 2 else one, depth, d, diverges)
        if d < depth:
            kept = np.unique(levels[d + 1].context[keep[d + 1]] & _mask(d, depth))
            keep[d][np.searchsorted(levels[d].context, kept)] = True
    out, below = [], top[2]
    for d in range(2, depth + 1):
        up = levels[d - 1] if d > 2 else one
        below = _smoothed(levels[d], below[np.searchsorted(up.keys, levels[d].keys & (_mask(d - 1, depth) | _BYTE))])
        out.append(_rows(levels[d], below, keep[d]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass(frozen=True)
class Tree:
    """Rows of contexts of one symbol at most, and where the other parts lie: the first key of each."""

    keys: np.ndarray
    bits: np.ndarray
    firsts: np.ndarray
    path: str
    depth: int


_NOTHING = Tree(np.arange(1, 257), np.full(256, 8.0, np.float32), np.empty(0, np.int64), "", DEPTH)


def _first_levels(counts: DataFrame, depth: int) -> tuple[np.ndarray, Level]:
    """Smoothed probabilities of the root, by byte, and the contexts of one symbol."""
    key = F.col("key").bitwiseAND(F.lit(_mask(1, depth) | _BYTE))
    rows = counts.groupBy(key.alias("key")).agg(F.sum("n").alias("n")).toPandas().sort_values("key")  # at most 257 * 256
    one = Level.of(rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
    root = np.bincount((one.keys & _BYTE) - 1, one.n, 256)
    kinds = np.count_nonzero(root)
    return (root + kinds / 256) / (root.sum() + kinds), one


def train(docs: DataFrame, depth: int = DEPTH, diverges: float = DIVERGES, part: int = PART) -> Tree:
    """The tree of all texts; without any text all bytes are alike."""
    if not 2 <= depth <= DEPTH:
        raise ValueError(f"a key holds contexts of 2 to {DEPTH} symbols")
    counts = Table(gram_counts(docs, depth), "grams")
    if counts.df.isEmpty():
        counts.drop()
        return _NOTHING
    root, one = _first_levels(counts.df, depth)
    p1 = _smoothed(one, root[(one.keys & _BYTE) - 1])
    shared = docs.sparkSession.sparkContext.broadcast((one.keys, one.n, p1))
    prefix = _mask(2, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, full = [], 0, 1 << 18

        def rows(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _grow(keys, n, shared.value, depth, diverges)], ["key", "bits"])

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("key", "n")))
            size += batch.num_rows
            if size >= full:
                keys, n = joined()
                cut = int(np.searchsorted(keys & prefix, keys[-1] & prefix))
                if cut:
                    yield rows(keys[:cut], n[:cut])
                held, size = [(keys[cut:], n[cut:])], len(keys) - cut
                full = max(1 << 18, 2 * size)
        if size:
            yield rows(*joined())
        held.clear()
        _trim()

    grown = counts.df.repartition(F.col("key").bitwiseAND(F.lit(prefix))).sortWithinPartitions("key").mapInArrow(run, "key long, bits float")
    tree = Table(grown, "suffix-tree")
    counts.drop()
    two = F.col("key").bitwiseAND(F.lit(prefix))
    sizes = tree.df.groupBy(two.alias("p")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("p")  # at most 257 * 257
    kept = np.unique(sizes["p"].to_numpy(np.int64) & _mask(1, depth))
    flat = Level.of(np.arange(1, 257), np.bincount((one.keys & _BYTE) - 1, one.n, 256).astype(np.int64))
    keep = _diverges(one, Level.of(flat.keys[flat.n > 0], flat.n[flat.n > 0]), depth, 1, diverges)
    keep[np.searchsorted(one.context, kept)] = True
    keys, bits = _rows(one, p1, keep)
    keys, bits = np.concatenate([np.arange(1, 257), keys]), np.concatenate([-np.log2(root).astype(np.float32), bits])
    order = np.argsort(keys)
    n = sizes["n"].to_numpy(np.int64)
    group = (np.cumsum(n) - n) // part
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(n) else np.empty(0, np.int64)
    firsts = sizes["p"].to_numpy(np.int64)[first]
    path = new_path(docs.sparkSession, "tree-parts")
    names = docs.sparkSession.createDataFrame(list(zip(sizes["p"].tolist(), (np.cumsum(np.isin(np.arange(len(n)), first)) - 1).tolist(), strict=True)), "p long, part int")
    placed = tree.df.withColumn("p", two).join(F.broadcast(names), "p").drop("p")
    placed.repartition("part").sortWithinPartitions("part", "key").write.partitionBy("part").option("compression", "zstd").parquet(path)
    tree.drop()
    return Tree(keys[order], bits[order], firsts, path, depth)


class _Parts:
    """Parts of a tree as sorted arrays, as many as HELD rows allow."""

    def __init__(self, tree: Tree) -> None:
        self.tree, self.loaded = tree, {}

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.loaded:
            if sum(len(x[0]) for x in self.loaded.values()) > HELD - PART:
                self.loaded.clear()
            system, path = pafs.FileSystem.from_uri(self.tree.path if ":" in self.tree.path else f"file://{self.tree.path}")
            rows = pq.read_table(f"{path}/part={k}", columns=["key", "bits"], filesystem=system, partitioning=None)
            keys, bits = (rows.column(c).to_numpy() for c in ("key", "bits"))
            if (keys[1:] < keys[:-1]).any():
                order = np.argsort(keys, kind="stable")
                keys, bits = keys[order], bits[order]
            self.loaded[k] = keys, bits
        return self.loaded[k]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def look_up(own: np.ndarray, tree: Tree, parts: _Parts) -> tuple[np.ndarray, np.ndarray]:
    """-log2 p of each gram of the sorted keys, and the length of the state that predicts it."""
    bits, level = np.zeros(len(own)), np.zeros(len(own), np.int64)
    edge = np.searchsorted(own & _mask(2, tree.depth), tree.firsts)
    spans = [(-1, 0, len(own))] if not len(edge) else [(k, a if k else 0, b) for k, (a, b) in enumerate(zip(edge, np.append(edge[1:], len(own)), strict=True))]
    for k, a, b in spans:
        if a == b:
            continue
        u = own[a:b]
        large = parts[k] if k >= 0 else (tree.keys[:0], tree.bits[:0])
        table = lambda d: large if d > 1 else (tree.keys, tree.bits)  # noqa: E731, B023
        deep, rest = np.zeros(len(u), np.int64), np.arange(len(u))
        for d in range(tree.depth, 0, -1):
            _, ok = _find(table(d)[0], u[rest] & _mask(d, tree.depth))
            deep[rest[ok]] = d
            rest = rest[~ok]
        cost, open_ = np.zeros(len(u)), np.ones(len(u), bool)
        for d in range(tree.depth, -1, -1):
            mine = np.flatnonzero(open_ & (deep >= d))
            keys, values = table(d)
            at, ok = _find(keys, u[mine] & (_mask(d, tree.depth) | _BYTE))
            cost[mine[ok]] += values[at[ok]]
            open_[mine[ok]] = False
            mine = mine[~ok]
            if d and len(mine):
                at, _ = _find(keys, u[mine] & _mask(d, tree.depth))
                cost[mine] += values[at]
        bits[a:b], level[a:b] = cost, deep
    return bits, level


def scored(docs: DataFrame, depth: int = DEPTH, diverges: float = DIVERGES, part: int = PART) -> DataFrame:
    """``(doc_id, n_bytes, bits_per_byte, mean_context)`` for every row of docs.

    bits_per_byte is the mean of -log2 p over the text's UTF-8 bytes and mean_context the mean length of the
    states used. Both are null for a null or empty text, whose n_bytes is 0. Every row is scored by itself, so repeated
    rows and null doc_ids are carried. The tree is trained on all rows. Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, depth, diverges, part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        parts = _Parts(tree)
        for batch in batches:
            for piece in chunks(batch, "t", BLOCK):
                raw, offsets = buffers(plain(piece.column("t")))
                size, sums = np.diff(offsets), np.zeros((2, len(offsets) - 1))
                for low, keys in blocks(raw, offsets, tree.depth):
                    own, where = np.unique(keys, return_inverse=True)
                    edge = np.clip(offsets, low, low + len(keys)) - low
                    for total, value in zip(sums, look_up(own, tree, parts), strict=True):
                        so_far = np.concatenate([[0.0], np.cumsum(value[where])])
                        total += so_far[edge[1:]] - so_far[edge[:-1]]
                arrays = [pa.array(size), *(pa.array(np.round(x / np.maximum(size, 1), 6), pa.float64(), mask=size == 0) for x in sums)]
                yield pa.RecordBatch.from_arrays([piece.column("id").cast(pa.int64()), *arrays], [c.split()[0] for c in _SCORE.split(", ")])
        parts.loaded.clear()
        _trim()

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t")).mapInArrow(run, _SCORE)
