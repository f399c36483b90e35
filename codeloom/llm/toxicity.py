"""Toxicity by lexicon induction over a word graph.

Vertices are whole words (case folded, as 64-bit hashes). Seeds come from labelled
documents: words that stand out by the number of toxic documents, against clean ones, that
hold them, counted plainly and again with copies discounted (only documents that
bring a context, the two neighbours, of their own); and frequent words that lean to clean
documents. Edges join all words that occur within WINDOW words of each other anywhere in the
corpus, weighted by shifted positive pointwise mutual information, if so many pairs stand out
from chance by the test that seeds pass. Random walks with restart from the toxic and from the clean seeds give two visiting
probabilities a word, p and q (Hamilton et al., "Inducing Domain-Specific
Sentiment Lexicons", 2016). With f its share of all words, its polarity is
(p - q) / (p + q + LIFT * f): near 1 only for words that the toxic walk visits far more
often than both the clean walk and chance. Polar words make the lexicon unless
more clean than toxic labelled documents hold them. A document's score is the sum of the
polarities of its lexicon words.

Pairs are counted in PASSES passes over all texts, each for its share of the hashes of the rarer word, and
the shuffle of one is deleted before the next. A task combines its own pairs and sends them in compressed pieces
by that hash. The CODED most frequent words have short codes there, pairs of the DENSE most frequent ones
are counted in an array, and a bounded Bloom filter keeps words of too few uses out: all of it saves bytes
and changes no count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fingerprints import bloom, may_hold
from .labelled import LABELLED, labelled_texts
from .store import Table, shuffles_deleted
from .text import chunks, mix64, plain, words

WINDOW, STEPS, RESTART = 5, 6, 0.2
#: Uses from which a word is a vertex, and pairs from which two words have an edge, whatever the size of the corpus.
LEAST_COUNT, LEAST_TOGETHER, SHIFT = 5, 4, 5.0
#: Likelihood ratio of a toxic seed and of an edge (about one chance in 16,000); polarity from which a word is in the lexicon; weight of chance in it.
STANDS_OUT, POLAR, LIFT = 16.0, 0.5, 10.0
#: Words with a short code in the pieces that tasks send; those of them whose pairs a task counts in an array; entries a task holds; words of the lexicon in one broadcast.
CODED, DENSE, WAITING, PART = 1 << 16, 1 << 12, 3 << 19, 1 << 20
#: Passes in which pairs are counted; more take less disk and more time.
PASSES = 2
#: Steps of the walk in one execution, whose shuffles are deleted before the next; fewer take less disk and shuffle the edges more often.
LEG = 3


_CODEC = pa.Codec("zstd", compression_level=4)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, signed, and the index of the first word of every text."""
    w = words(plain(texts))
    return w.hash.view(np.int64), w.bounds


def word_id(word: str) -> int:
    """The vertex of a word."""
    return int(word_hashes(pa.array([word]))[0][0])


def _first(*sorted_columns: np.ndarray) -> np.ndarray:
    """Places where any of the columns, sorted together, has a new value."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in sorted_columns], axis=0)
    return np.flatnonzero(new)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _short(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.int32) if counts.max(initial=0) < 1 << 31 else counts


class _Counter:
    """Counts of integer keys, merged whenever as many keys wait as are held."""

    def __init__(self, limit: int = 1 << 19) -> None:
        self.keys, self.counts, self.waiting, self.limit, self.full = [], [], 0, limit, limit

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(_short(counts))
        self.waiting += len(keys)
        if self.waiting > self.full:
            self.merge()
            self.full = self.waiting + max(self.limit, self.waiting // 2)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
            self.keys, self.counts = [], []
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            del order
            new = _first(keys)
            self.keys, self.counts = [keys[new]], [_short(np.add.reduceat(counts, new, dtype=np.int64))]
            self.waiting = len(new)
        return (self.keys[0], self.counts[0]) if self.keys else (np.empty(0, np.int64), np.empty(0, np.int64))


def _packed(*columns: np.ndarray) -> bytes:
    """Integer columns, each with its own length, in byte planes that compress well."""
    sizes = np.array([len(columns), *(len(c) for c in columns)], np.int64).tobytes()
    planes = b"".join(np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return sizes + _CODEC.compress(planes, asbytes=True)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    raw = np.frombuffer(pa.decompress(blob[8 + 8 * n :], 8 * int(sizes.sum()), codec="zstd", asbytes=True), np.uint8)
    edge = np.concatenate([[0], np.cumsum(8 * sizes)])
    return [np.ascontiguousarray(raw[a:b].reshape(8, -1).T).view(np.int64).ravel() for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _rows(pieces: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.int32()), pa.array([b for _, b in pieces], pa.binary())], ["bucket", "rows"])


def _split(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of each bucket as one piece."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [x[order] for x in columns]
    edge = np.append(_first(bucket), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    for k in range(0, len(edge) - 1, 64):
        yield _rows([(int(bucket[i]), _packed(*(x[i:j] for x in columns))) for i, j in zip(edge[k : k + 64], edge[k + 1 : k + 65], strict=False)])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[list[np.ndarray]]]]:
    """Each bucket with its pieces, one at a time."""
    from itertools import groupby

    rows = ((b, blob) for batch in batches for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("rows"), strict=True))
    for bucket, own in groupby(rows, key=lambda x: x[0]):
        yield bucket, (_unpacked(blob.as_py()) for _, blob in own)


def _sent(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("bucket").sortWithinPartitions("bucket")


def _word_counts(texts: DataFrame, buckets: int = 1024, waiting: int = WAITING) -> DataFrame:
    """``(word, n)``: uses of every word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Counter()
        for batch in batches:
            for part in chunks(batch, "t"):
                seen.add(word_hashes(part.column("t"))[0])
                if seen.waiting > waiting:
                    keys, n = seen.merge()
                    yield from _split(_bucket(keys, buckets), [keys, n])
                    seen = _Counter()
        keys, n = seen.merge()
        yield from _split(_bucket(keys, buckets), [keys, n])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in _by_bucket(batches):
            seen = _Counter()
            for keys, n in pieces:
                seen.add(keys, n)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in seen.merge()], ["word", "n"])

    return _sent(texts.mapInArrow(count, "bucket int, rows binary")).mapInArrow(total, "word long, n long")


def _most_frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """At most ``most`` of the most frequent words in falling order, without a sort of all words: those above a bound that a histogram gives."""
    band = F.floor(F.log2("n") * 16)
    left, least = most, None
    for r in counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("band")).collect():  # some hundreds
        left -= r.words
        if left < 0:
            break
        least = r.band
    rows = counts.where(band >= least if least is not None else F.lit(False)).toPandas()
    return rows.sort_values(["n", "word"], ascending=[False, True])


def _document_counts(sample: DataFrame) -> DataFrame:
    """``(word, toxic, clean)``: labelled documents of either class that hold the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (_Counter(), _Counter())
        for batch in batches:
            for part in chunks(batch, "t"):
                word, bounds = word_hashes(part.column("t"))
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                order = np.lexsort((word, doc))
                once = order[_first(doc[order], word[order])] if len(order) else order
                y = part.column("y").to_numpy(zero_copy_only=False)[doc[once]]
                for k in (0, 1):
                    seen[k].add(word[once][y == k])
        for k in (0, 1):
            own, n = seen[k].merge()
            none = np.zeros_like(n)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in ((own, n, none) if k else (own, none, n))], ["word", "toxic", "clean"])

    counted = sample.mapInArrow(run, "word long, toxic long, clean long")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _neighbours(word: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the words on either side of the given places; a text's end has none."""
    doc = np.searchsorted(bounds, at, side="right")
    left = np.where(at > bounds[doc - 1], word[np.maximum(at - 1, 0)], 0).view(np.uint64)
    right = np.where(at + 1 < bounds[doc], word[np.minimum(at + 1, len(word) - 1)], 0).view(np.uint64)
    return mix64(mix64(left) + np.uint64(3) * mix64(right + np.uint64(1))).view(np.int64)


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _contexts(sample: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``(word, toxic, clean)`` for the chosen words: documents of either class that bring a context which no document of the class with a lesser id has."""
    chosen = np.sort(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                word, bounds = word_hashes(part.column("t"))
                at = np.flatnonzero(_among(word, chosen))
                doc = np.searchsorted(bounds, at, side="right") - 1
                columns = [pa.array(word[at]), pa.array(_neighbours(word, bounds, at) if len(at) else at), *(part.column(c).take(pa.array(doc)) for c in ("y", "id"))]
                yield pa.RecordBatch.from_arrays(columns, ["word", "c", "y", "id"])

    first = sample.mapInArrow(run, "word long, c long, y int, id long").groupBy("word", "y", "c").agg(F.min("id").alias("id"))
    docs = first.groupBy("word", "y", "id").agg(F.lit(1).alias("one"))
    return docs.groupBy("word").agg(F.count(F.when(F.col("y") == 1, 1)).alias("toxic"), F.count(F.when(F.col("y") == 0, 1)).alias("clean"))


class _Vocabulary:
    """Numbers of words in the order in which a task meets them."""

    def __init__(self) -> None:
        self.words, self.numbers = np.empty(0, np.int64), np.empty(0, np.int64)

    def of(self, word: np.ndarray) -> np.ndarray:
        own, where = np.unique(word, return_inverse=True)
        new = own[~_among(own, self.words)]
        if len(new):
            at = np.searchsorted(self.words, new)
            self.numbers = np.insert(self.numbers, at, len(self.words) + np.arange(len(new)))
            self.words = np.insert(self.words, at, new)
        return self.numbers[np.searchsorted(self.words, own)][where]

    def in_order(self) -> np.ndarray:
        out = np.empty_like(self.words)
        out[self.numbers] = self.words
        return out


def _probes(word: np.ndarray) -> np.ndarray:
    return np.stack([word, word >> 27], axis=1)


@dataclass(frozen=True)
class _Codes:
    """The most frequent words in falling order, their uses, the seeds whose pairs are counted by context, the number of all words, and the filter of vertices."""

    word: np.ndarray
    uses: np.ndarray
    seeds: np.ndarray
    total: int
    filter: np.ndarray

    def __post_init__(self) -> None:
        order = np.argsort(self.word)
        object.__setattr__(self, "order", order)
        object.__setattr__(self, "sorted", self.word[order])

    def of(self, word: np.ndarray) -> np.ndarray:
        """The code of each word, -1 for others that may be vertices, or -2."""
        code = np.full(len(word), -1)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, word), len(self.sorted) - 1)
            code = np.where(self.sorted[at] == word, self.order[at], -1)
        rest = np.flatnonzero(code < 0)
        code[rest[~may_hold(self.filter, _probes(word[rest]))]] = -2
        return code


def _pairs(texts: DataFrame, shared: Broadcast, buckets: int, waiting: int = WAITING, densest: int = DENSE, least: int = LEAST_TOGETHER, least_count: int = LEAST_COUNT, shift: float = SHIFT, turn: int = 0, passes: int = 1) -> DataFrame:
    """``(a, b, n, w)``: how often two words stand within WINDOW words of each other, ``least`` times or more; those of the pass ``turn`` of ``passes``.

    If b is coded, w is the weight of the edge, and pairs without one are left out; else w is null. Rows with a
    seed have it as a (the lesser of two), and count occurrences of the same two neighbours once, so copies of a document add nothing to a seed's edges.
    """

    def pieces(seen: _Counter, names: _Vocabulary, codes: _Codes) -> Iterator[pa.RecordBatch]:
        keys, n = seen.merge()
        if not len(keys):
            return
        rare, size = names.in_order(), len(codes.word)
        every = np.concatenate([_bucket(codes.word, buckets), _bucket(rare, buckets)])
        key, other = keys >> 32, keys & 0xFFFFFFFF
        order = np.argsort(every[key], kind="stable")  # keys are in order, so they stay so within a bucket
        key, other, n = key[order], other[order], n[order]
        edge = np.searchsorted(every[key], np.arange(buckets + 1))
        out = []
        for k in np.flatnonzero(np.diff(edge)):
            own = slice(edge[k], edge[k + 1])
            first = _first(key[own])
            both = np.concatenate([key[own][first], other[own]])
            named, where = np.unique(both[both >= size], return_inverse=True)
            both[both >= size] = size + where
            heads, tails = both[: len(first)], both[len(first) :]
            gaps = np.diff(tails, prepend=0)
            gaps[first] = tails[first]
            out.append((int(k), _packed(heads, np.diff(np.append(first, len(tails))), gaps, n[own], rare[named - size])))
            if len(out) == 64:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: _Codes = shared.value
        size, seeds = len(codes.word), codes.seeds
        most = min(densest, size)
        dense = np.zeros(most * (most - 1) // 2, np.int32)
        seen, names, held, n_held = _Counter(), _Vocabulary(), [], 0

        def by_context() -> Iterator[pa.RecordBatch]:
            seed, other, context = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((context, other, seed))
            once = order[_first(seed[order], other[order], context[order])]
            seed, other, context = seed[once], other[once], context[once]
            yield from _split(-1 - _bucket(seed ^ mix64(other.view(np.uint64)).view(np.int64), buckets), [seed, other, context])

        for batch in batches:
            for part in chunks(batch, "t"):
                word, bounds = word_hashes(part.column("t"))
                if not len(word):
                    continue
                code = codes.of(word)
                rare, seed, vertex = np.flatnonzero(code == -1), _among(word, seeds), code > -2
                mine = _bucket(word, buckets) % passes == turn
                code[rare] = size + names.of(word[rare])
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                rare = code[rare[mine[rare]]]
                keys, close, open_ = [rare << 32 | rare], [], vertex & ~seed
                for step in range(1, WINDOW + 1):
                    ok = np.flatnonzero((doc[step:] == doc[:-step]) & (word[step:] != word[:-step]) & open_[step:] & open_[:-step])
                    x, y = code[ok], code[ok + step]
                    swap = np.where((x >= size) & (y >= size), word[ok] < word[ok + step], x < y)
                    own = mine[np.where(swap, ok + step, ok)]
                    x, y = np.where(swap, y, x)[own], np.where(swap, x, y)[own]
                    small = x < most
                    keys.append((x << 32 | y)[~small])
                    close.append((x * (x - 1) // 2 + y)[small])
                seen.add(np.concatenate(keys))
                at, n = np.unique(np.concatenate(close), return_counts=True)
                dense[at] += n.astype(np.int32)
                hit = np.flatnonzero(seed)
                if len(hit):
                    context = _neighbours(word, bounds, hit)
                    for step in (*range(-WINDOW, 0), *range(1, WINDOW + 1)):
                        to = np.clip(hit + step, 0, len(word) - 1)
                        ok = np.flatnonzero((to == hit + step) & (doc[to] == doc[hit]) & (word[to] != word[hit]) & vertex[to] & mine[to])
                        held.append((word[hit[ok]], word[to[ok]], context[ok]))
                        n_held += len(ok)
                if n_held > waiting // 4:
                    yield from by_context()
                    held, n_held = [], 0
                if seen.waiting > waiting:
                    seen.merge()
                    if seen.waiting > waiting * 7 // 8:
                        yield from pieces(seen, names, codes)
                        seen, names = _Counter(), _Vocabulary()
        yield from pieces(seen, names, codes)
        if n_held:
            yield from by_context()
        for low in range(0, most, 1 << 11):
            seen, begin = _Counter(), low * (low - 1) // 2 if low else 0
            at = begin + np.flatnonzero(dense[begin : min(low + (1 << 11), most) * (min(low + (1 << 11), most) - 1) // 2])
            x = np.searchsorted(np.arange(most) * (np.arange(most) - 1) // 2, at, side="right") - 1
            seen.add(x << 32 | at - x * (x - 1) // 2, dense[at])
            yield from pieces(seen, _Vocabulary(), codes)

    def distinct(parts: Iterator[list[np.ndarray]]) -> pa.RecordBatch:
        seed, other, context = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((context, other, seed))
        once = order[_first(seed[order], other[order], context[order])]
        seed, other = seed[once], other[once]
        first = _first(seed, other)
        n = np.diff(np.append(first, len(seed)))
        seed, other = seed[first], other[first]
        return _edges(seed, other, n, np.full(len(n), np.nan), (n >= least) & ((seed < other) | ~_among(other, shared.value.seeds)))

    def _edges(a: np.ndarray, b: np.ndarray, n: np.ndarray, w: np.ndarray, ok: np.ndarray) -> pa.RecordBatch:
        arrays = pa.array(a[ok]), pa.array(b[ok]), pa.array(n[ok].astype(np.int64)), pa.array(w[ok].astype(np.float32), from_pandas=True)
        return pa.RecordBatch.from_arrays(list(arrays), ["a", "b", "n", "w"])

    def summed(parts: Iterator[list[np.ndarray]], codes: _Codes) -> pa.RecordBatch:
        size, names, seen = len(codes.word), _Vocabulary(), _Counter()
        for heads, runs, gaps, n, rare in parts:
            here = np.concatenate([np.arange(size), size + names.of(rare)])
            first = np.cumsum(runs) - runs
            total = np.cumsum(gaps)
            tails = total - np.repeat(total[first] - gaps[first], runs)
            keys = here[np.repeat(heads, runs)] << 32 | here[tails]
            order = np.argsort(keys, kind="stable")
            seen.add(keys[order], n[order])
        keys, n = seen.merge()
        key, other, rare = keys >> 32, keys & 0xFFFFFFFF, names.in_order()
        every = np.concatenate([codes.word, rare])
        own, uses = key == other, np.concatenate([codes.uses, np.zeros(len(rare), np.int64)])
        uses[key[own]] = n[own]
        ok = ~own & (n >= least) & (uses[key] >= least_count)
        key, other, n = key[ok], other[ok], n[ok]
        expected, coded = 2.0 * WINDOW * uses[key] * uses[other] / codes.total, other < size
        with np.errstate(divide="ignore"):
            lift = np.log(n / expected)
        good = ~coded | ((lift > np.log(shift)) & (2 * (n * lift - n + expected) >= STANDS_OUT))
        return _edges(every[key], every[other], n, np.where(coded, lift - np.log(shift), np.nan), good)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, parts in _by_bucket(batches):
            yield distinct(parts) if bucket < 0 else summed(parts, shared.value)

    return _sent(texts.mapInArrow(count, "bucket int, rows binary")).mapInArrow(total, "a long, b long, n long, w float")


@dataclass(frozen=True)
class Seeds:
    """Words to restart from and the probability of each."""

    word: np.ndarray
    weight: np.ndarray


def stands_out(toxic: np.ndarray, clean: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio of an excess of toxic documents, and how many times the usual share of them are toxic."""
    n = np.maximum(toxic + clean, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(toxic > 0, toxic * np.log(toxic / (n * rate)), 0) + np.where(clean > 0, clean * np.log(clean / (n * (1 - rate))), 0))
    return g, toxic / n / rate


def choose_seeds(sample: DataFrame, known: DataFrame) -> tuple[Seeds, Seeds]:
    """Toxic seeds stand out by all documents and by those with contexts of their own; calm ones are the most frequent that lean to clean, two for each toxic one.

    known: ``_document_counts`` of the sample. The words that come to the driver are of the bounded sample.
    """
    none = Seeds(np.empty(0, np.int64), np.empty(0))
    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return none, none
    rate = size[1] / (size[0] + size[1])
    often = F.col("toxic") / (F.col("toxic") + F.col("clean")) / rate
    likely = known.where((F.col("toxic") > 1) & (often > 3)).toPandas()
    word = likely["word"].to_numpy(np.int64)[stands_out(*(likely[c].to_numpy(np.int64) for c in ("toxic", "clean")), rate)[0] >= STANDS_OUT]
    own = _contexts(sample, word).toPandas().sort_values("word")
    word, toxic, clean = (own[c].to_numpy(np.int64) for c in ("word", "toxic", "clean"))
    g, ratio = stands_out(toxic, clean, rate)
    good = (g >= STANDS_OUT) & (ratio > 3)
    calm = known.where((often <= 1) & (F.col("clean") > 0)).orderBy(F.desc("clean"), "word").limit(2 * int(good.sum())).toPandas() if good.any() else own[:0]
    if not good.any() or not len(calm):
        return none, none
    weight = calm["clean"].to_numpy(float)
    return Seeds(word[good], toxic[good] / toxic[good].sum()), Seeds(calm["word"].to_numpy(np.int64), weight / weight.sum())


def _walk(edges: DataFrame, weights: DataFrame, toxic: Seeds, calm: Seeds, steps: int, restart: float, leg: int = LEG) -> Table:
    """``(word, p, q)``: visiting probabilities of walks that restart from the toxic (p) and the calm (q) seeds.

    ``edges`` (src, dst, w) has both directions; ``weights`` (word, all) the sum of the w from each vertex. ``leg``
    steps read one shuffle of the edges and are written; what moves in a step is a row a vertex.
    """
    spark = edges.sparkSession
    rows = [(int(s), restart * float(w), 0.0) for s, w in zip(toxic.word, toxic.weight, strict=True)]
    rows += [(int(s), 0.0, restart * float(w)) for s, w in zip(calm.word, calm.weight, strict=True)]
    start = spark.createDataFrame(rows, "word long, p double, q double")
    table = Table(start.select("word", F.col("p") / restart, F.col("q") / restart).toDF("word", "p", "q"), "visits")
    spread = edges.where("src is not null and dst is not null").repartition("src")  # inferred for some steps only, which would then have a shuffle of their own
    for done in range(0, steps, leg):
        now = table.df
        for _ in range(min(leg, steps - done)):
            sent = now.join(weights.hint("shuffle_hash"), "word").select(F.col("word").alias("src"), *((F.col(c) * (1 - restart) / F.col("all")).alias(c) for c in "pq"))
            moved = spread.join(sent.hint("shuffle_hash"), "src").select(F.col("dst").alias("word"), *((F.col(c) * F.col("w")).alias(c) for c in "pq"))
            now = moved.union(start).groupBy("word").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        before, table = table, Table(now, "visits")
        before.drop()
    return table


@dataclass(frozen=True)
class Lexicon:
    """Sorted vertices, their polarities, and the score from which a document is toxic."""

    word: np.ndarray
    polarity: np.ndarray
    least: float


def _scores(texts: pa.Array, word: np.ndarray, polarity: np.ndarray) -> np.ndarray:
    own, bounds = word_hashes(texts)
    if not len(word) or not len(own):
        return np.zeros(len(texts))
    at = np.minimum(np.searchsorted(word, own), len(word) - 1)
    value = np.concatenate([[0.0], np.cumsum(np.where(word[at] == own, polarity[at], 0.0))])
    return value[bounds[1:]] - value[bounds[:-1]]


def score(docs: DataFrame, lexicon: Lexicon, column: str = "text"):
    """A column: the sum of the polarities of the words of a text; 0 for a null or empty text.

    The lexicon is broadcast in parts of at most PART words, 16 bytes each.
    """

    def part(word: np.ndarray, polarity: np.ndarray):
        shared = docs.sparkSession.sparkContext.broadcast((word, polarity))

        def run(texts: pa.Array) -> pa.Array:
            batch = pa.RecordBatch.from_arrays([texts], ["t"])
            out = [_scores(x.column("t"), *shared.value) for x in chunks(batch, "t")]
            return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

        return F.arrow_udf(run, "double")(column)

    total = F.lit(0.0)
    for k in range(0, len(lexicon.word), PART):
        total = total + part(lexicon.word[k : k + PART], lexicon.polarity[k : k + PART])
    return F.round(total, 4)


def best_cut(s: np.ndarray, y: np.ndarray) -> float:
    """The score that parts toxic (1) from clean (0) rows with the highest sum of both rates; halfway to the next lower one."""
    values = np.unique(s[s > 0])
    if not len(values) or not (y == 1).any() or not (y == 0).any():
        return float("inf")
    toxic, clean = np.sort(s[y == 1]), np.sort(s[y == 0])
    caught = 1 - np.searchsorted(toxic, values) / len(toxic)
    spared = np.searchsorted(clean, values) / len(clean)
    k = int(np.argmax(caught + spared))
    return float((values[k] + (values[k - 1] if k else 0.0)) / 2)


def induce(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, steps: int = STEPS, coded: int = CODED) -> Lexicon:
    """The lexicon of a corpus. Without toxic and clean labels it is empty and no document is toxic."""
    with shuffles_deleted(docs.sparkSession):
        return _induced(docs, labels, limit, steps, coded)


def _induced(docs: DataFrame, labels: DataFrame, limit: int, steps: int, coded: int) -> Lexicon:
    spark = docs.sparkSession
    texts = docs.select(F.col("text").alias("t"))
    sample = Table(labelled_texts(docs, labels, "toxic", limit), "toxic-sample")
    known = Table(_document_counts(sample.df), "labelled-words")
    toxic, calm = choose_seeds(sample.df, known.df)
    if not len(toxic.word):
        sample.drop()
        known.drop()
        return Lexicon(np.empty(0, np.int64), np.empty(0), float("inf"))
    counts = Table(_word_counts(texts), "word-counts")
    total = counts.df.agg(F.sum("n")).first()[0]
    often = _most_frequent(counts.df, coded)
    vertices = bloom(counts.df.where(F.col("n") >= LEAST_COUNT).select(F.col("word").alias("d1"), F.shiftright("word", 27).alias("d2")))
    shared = spark.sparkContext.broadcast(_Codes(often["word"].to_numpy(np.int64), often["n"].to_numpy(np.int64), np.sort(toxic.word), total, vertices))
    found = []
    for turn in range(PASSES):
        found.append(Table(_pairs(texts, shared, buckets=min(max(total >> 19, 64), 1 << 14), turn=turn, passes=PASSES), "word-pairs"))
    pairs = found[0].df
    for more in found[1:]:
        pairs = pairs.union(more.df)
    of = counts.df.where(F.col("n") >= LEAST_COUNT)
    expected = F.col("a.n").cast("double") * F.col("b.n") * (2.0 * WINDOW / total)
    lift = F.log(F.col("x.n") / expected)
    weighed = (
        pairs.where("w is null").alias("x").join(of.alias("a"), F.col("x.a") == F.col("a.word")).join(of.alias("b"), F.col("x.b") == F.col("b.word"))
        .where((lift > float(np.log(SHIFT))) & (2 * (F.col("x.n") * lift - F.col("x.n") + expected) >= STANDS_OUT)).select("x.a", "x.b", (lift - float(np.log(SHIFT))).cast("float").alias("w"))
    )
    one = Table(pairs.where("w is not null").select("a", "b", "w").union(weighed), "word-edges")
    both = one.df.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "w").select("e.src", "e.dst", "w")
    for table in found:
        table.drop()
    weights = Table(both.groupBy(F.col("src").alias("word")).agg(F.sum("w").alias("all")), "out-weights")
    walked = _walk(both, weights.df, toxic, calm, steps, RESTART)
    one.drop()
    weights.drop()
    visited = walked.df.join(counts.df, "word")
    polar = visited.select("word", ((F.col("p") - F.col("q")) / (F.col("p") + F.col("q") + F.col("n") * (LIFT / total))).alias("polarity"))
    made = polar.where(F.col("polarity") >= POLAR).toPandas().sort_values("word")
    against = known.df.where("clean > toxic").select("word").toPandas()["word"]
    made = made[~made["word"].isin(against)]
    lexicon = Lexicon(made["word"].to_numpy(np.int64), np.round(made["polarity"].to_numpy(float), 6), float("inf"))
    judged = sample.df.select("y", score(sample.df, lexicon, "t").alias("s")).toPandas()
    for table in (sample, known, counts, walked):
        table.drop()
    return Lexicon(lexicon.word, lexicon.polarity, best_cut(judged["s"].to_numpy(float), judged["y"].to_numpy()))


def toxic_documents(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``(doc_id, score, toxic)`` for every row whose score reaches the threshold; toxic is true.

    Every row is scored by itself: repeated rows and null doc_ids give rows as well if their
    text is toxic. Null, empty and wordless texts score 0. Only doc_id and text are read.
    """
    found = induce(docs, labels, limit)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(docs, found).alias("score"))
    return scored.where(F.col("score") >= found.least).withColumn("toxic", F.lit(True))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """The rows of docs that ``toxic_documents`` doesn't report, with all their columns."""
    found = induce(docs, labels, limit)
    return docs.where(score(docs, found) < found.least)
