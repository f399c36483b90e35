"""Benchmark decontamination with a distributed positional inverted index.

The index stores every token of the training documents. It is partitioned by
document into segments of about SEGMENT_WORDS words; a document lies in one segment
whole. A segment is one row: its sorted term hashes, the length of each
posting list, and all lists as differences of token positions in the segment,
compressed. Document frequencies of the test terms come from all segments.

Every run of PHRASE words of a test item is an exact-phrase query. In each
segment the lists of its terms are intersected after subtracting the term's
place in the phrase, from the term with the fewest documents in the corpus
to the one with the most, so a query ends at its first empty intersection.
Adjacent matches of an item are merged. A proximity match is a window of less than NEAR_WIDTH times
the item's length in words that holds at least NEAR_SHARE of the item's different terms, if these
are NEAR_LEAST or more, and whose terms are evidence of NEAR_BITS bits: a term of which
a window holds x by chance counts -log2(min(1, x)), so frequent words alone don't match. Any such window
holds some of the item's rarest terms, so only documents with enough of these are looked at.
Overlapping windows are one match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Table
from .text import chunks, plain, words

PHRASE, SEGMENT_WORDS = 8, 1_000_000
NEAR_LEAST, NEAR_SHARE, NEAR_WIDTH, NEAR_BITS = 5, 0.75, 2.0, 24.0
#: Bytes of benchmark text whose queries are broadcast at a time; a larger benchmark is searched in parts.
MOST_BYTES = 16 << 20

_SEGMENT = "ids binary, bounds binary, terms binary, lengths binary, docs binary, places binary"
_MATCH = "doc_id long, item_id long, kind string, doc_word long, item_word long, n_words long"


def _segment(ids: list[np.ndarray], counts: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    lengths = np.diff(np.append(first, len(ordered)))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    owner = np.searchsorted(bounds, order, side="right")
    new = np.ones(len(order), bool)
    new[1:] = owner[1:] != owner[:-1]
    new[first] = True
    docs = np.add.reduceat(new, first)
    place = order.astype(np.int64)
    gap = place.copy()
    gap[1:] -= place[:-1]
    gap[first] = place[first]
    packed = zstandard.ZstdCompressor(level=1).compress(gap.astype(np.uint32).tobytes())
    parts = (np.concatenate(ids), bounds.astype(np.int64), ordered[first], lengths.astype(np.uint32), docs.astype(np.uint32))
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (*(p.tobytes() for p in parts), packed)], [c.split()[0] for c in _SEGMENT.split(", ")])


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Segments of the positional index of all rows that have a doc_id and a word. Rows that share a doc_id are indexed each by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, hashes, held = [], [], [], 0
        for batch in batches:
            for part in chunks(batch, "t"):
                w = words(plain(part.column("t")))
                ids.append(part.column("id").to_numpy(zero_copy_only=False).astype(np.int64))
                counts.append(w.count)
                hashes.append(w.hash)
                held += len(w.hash)
                if held >= segment_words:
                    yield _segment(ids, counts, hashes)
                    ids, counts, hashes, held = [], [], [], 0
        if held:
            yield _segment(ids, counts, hashes)

    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t")).where("id is not null")
    return narrow.mapInArrow(run, _SEGMENT)


def frequencies(index: DataFrame, terms: np.ndarray) -> tuple[dict[int, tuple[int, int]], int]:
    """Documents that hold each of the terms and its uses, and the number of all words. Only the term columns of the index are read."""
    shared = index.sparkSession.sparkContext.broadcast(np.sort(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total, words_held = np.zeros((2, len(terms)), np.int64), 0
        for batch in batches:
            for own, docs, lengths in zip(batch.column("terms"), batch.column("docs"), batch.column("lengths"), strict=True):
                here = np.frombuffer(own.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(here, terms), len(here) - 1)
                for row, column in zip(total, (docs, lengths), strict=True):
                    n = np.frombuffer(column.as_buffer(), np.uint32)
                    row += np.where(here[at] == terms, n[at], 0)
                words_held += int(n.sum(dtype=np.int64))
        some = np.flatnonzero(total[0])
        columns = [np.append(terms[some].view(np.int64), 0), np.append(total[0, some], 0), np.append(total[1, some], words_held), np.append(np.zeros(len(some), bool), True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["term", "docs", "uses", "all"])

    counted = index.select("terms", "docs", "lengths").mapInArrow(run, "term long, docs long, uses long, all boolean")
    rows = counted.groupBy("term", "all").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses")).collect()
    return {int(np.int64(r.term).view(np.uint64)): (r.docs, r.uses) for r in rows if not r["all"]}, sum(r.uses for r in rows if r["all"])


@dataclass(frozen=True)
class Near:
    """An item's different terms from rarest to most frequent, the evidence of each, how many a window needs, how many of the first ``lead`` it then holds at least, and its width."""

    item: int
    terms: np.ndarray
    bits: np.ndarray
    need: int
    lead: int
    width: int

    @property
    def lead_need(self) -> int:
        return self.lead - (len(self.terms) - self.need)


@dataclass(frozen=True)
class Queries:
    """Test items as term hashes; the terms of every phrase and every proximity query from rarest to most frequent."""

    items: list[tuple[int, np.ndarray]]
    phrase_item: np.ndarray
    phrase_start: np.ndarray
    phrase_size: np.ndarray
    order: np.ndarray
    near: list[Near]


def plan(items: list[tuple[int, np.ndarray]], frequency: dict[int, tuple[int, int]], total: int, phrase: int = PHRASE) -> Queries:
    """Phrase queries whose terms all occur in the corpus, and proximity queries enough of whose terms do; no other can match."""
    which, start, size, order, near = [], [], [], [], []
    for k, (_, terms) in enumerate(items):
        n = min(phrase, len(terms))
        df, uses = np.array([frequency.get(int(t), (0, 0)) for t in terms], dtype=np.int64).T
        for s in range(len(terms) - n + 1 if n else 0):
            own = df[s : s + n]
            if own.min() > 0:
                which.append(k)
                start.append(s)
                size.append(n)
                order.append(np.pad(np.argsort(own, kind="stable"), (0, phrase - n)))
        distinct, first = np.unique(terms, return_index=True)
        need, width = int(np.ceil(NEAR_SHARE * len(distinct))), int(NEAR_WIDTH * len(terms))
        if len(distinct) >= NEAR_LEAST and np.count_nonzero(df[first]) >= need:
            rank = np.lexsort((distinct, uses[first]))
            chance = width * uses[first][rank] / total
            bits = np.where(chance > 0, -np.log2(np.clip(chance, 1e-300, 1)), 0.0)
            if bits.sum() >= NEAR_BITS:
                near.append(Near(k, distinct[rank], bits, need, min(len(distinct), 2 * (len(distinct) - need + 1)), width))
    shape = np.array(order, dtype=np.int64).reshape(-1, phrase)
    return Queries(items, *(np.array(x, dtype=np.int64) for x in (which, start, size)), shape, near)


class _Segment:
    def __init__(self, row: dict[str, pa.Scalar]) -> None:
        read = lambda c, kind: np.frombuffer(row[c].as_buffer(), kind)
        self.ids, self.bounds, self.terms = read("ids", np.int64), read("bounds", np.int64), read("terms", np.uint64)
        self.edge = np.concatenate([[0], np.cumsum(read("lengths", np.uint32), dtype=np.int64)])
        gaps = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["places"].as_buffer()), np.uint32)
        self.gaps, self.lists = gaps, {}

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Index of each term, or -1."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, term: int) -> np.ndarray:
        if term not in self.lists:
            self.lists[term] = np.cumsum(self.gaps[self.edge[term] : self.edge[term + 1]], dtype=np.int64)
        return self.lists[term]

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, places, side="right") - 1


def _phrases(segment: _Segment, q: Queries) -> list[tuple[np.ndarray, ...]]:
    """(document, item, place in document, place in item, words) of every merged run of phrase matches."""
    flat = np.concatenate([t for _, t in q.items]) if q.items else np.empty(0, np.uint64)
    edge = np.concatenate([[0], np.cumsum([len(t) for _, t in q.items])]).astype(np.int64)
    known = segment.find(flat)
    alive = np.arange(len(q.phrase_item))
    for step in range(q.order.shape[1]):
        term = known[edge[q.phrase_item[alive]] + q.phrase_start[alive] + q.order[alive, step]]
        alive = alive[(term >= 0) | (step >= q.phrase_size[alive])]
    found = []
    for p in alive:
        item, start, size = int(q.phrase_item[p]), int(q.phrase_start[p]), int(q.phrase_size[p])
        base, at = int(edge[item]) + start, None
        for step in range(size):
            offset = int(q.order[p, step])
            term = int(known[base + offset])
            places = segment.postings(term) - offset
            if at is None:
                at = places
            else:
                small, large = (at, places) if len(at) < len(places) else (places, at)
                where = np.minimum(np.searchsorted(large, small), len(large) - 1)
                at = small[large[where] == small]
            if not len(at):
                break
        if len(at):
            at = at[at >= 0]
            doc = segment.doc(at)
            at, doc = at[at + size <= segment.bounds[doc + 1]], doc[at + size <= segment.bounds[doc + 1]]
            found.append(np.stack([doc, np.full_like(at, item), at - segment.bounds[doc], np.full_like(at, start), np.full_like(at, size)]))
    if not found:
        return []
    doc, item, at, start, size = np.concatenate(found, axis=1)
    order = np.lexsort((start, at - start, item, doc))
    doc, item, at, start, size = (x[order] for x in (doc, item, at, start, size))
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (at[1:] - start[1:] == at[:-1] - start[:-1]) & (start[1:] <= start[:-1] + size[:-1])
    head = np.flatnonzero(~same)
    last = np.append(head[1:], len(doc)) - 1
    return [(doc[head], item[head], at[head], start[head], start[last] + size[last] - start[head])]


def _windows(p: np.ndarray, kind: np.ndarray, q: Near) -> Iterator[tuple[int, int]]:
    """First and last place of every match among the sorted places p of the terms ``kind`` in one document."""
    seen, different, bits, low, open_ = [0] * len(q.terms), 0, 0.0, 0, None
    weight, p, kind = q.bits.tolist(), p.tolist(), kind.tolist()
    for high, (at, k) in enumerate(zip(p, kind, strict=True)):
        if not seen[k]:
            different, bits = different + 1, bits + weight[k]
        seen[k] += 1
        while at - p[low] >= q.width:
            j = kind[low]
            seen[j] -= 1
            if not seen[j]:
                different, bits = different - 1, bits - weight[j]
            low += 1
        if different >= q.need and bits >= NEAR_BITS - 1e-9:
            left = low
            while seen[kind[left]] > 1:  # the shortest of the windows that end here
                seen[kind[left]] -= 1
                left += 1
            for k2 in kind[low:left]:
                seen[k2] += 1
            if open_ and p[left] <= open_[1]:
                open_ = open_[0], at
            else:
                if open_:
                    yield open_
                open_ = p[left], at
    if open_:
        yield open_


def _near(segment: _Segment, q: Queries) -> list[tuple[np.ndarray, ...]]:
    if not q.near:
        return []
    sizes = np.array([len(x.terms) for x in q.near])
    base = np.cumsum(sizes) - sizes
    at = segment.find(np.concatenate([x.terms for x in q.near]))
    present = np.concatenate([[0], np.cumsum(at >= 0)])
    lead, need, least = (np.array([getattr(x, c) for x in q.near]) for c in ("lead", "lead_need", "need"))
    rows = []
    for k in np.flatnonzero((present[base + lead] - present[base] >= need) & (present[base + sizes] - present[base] >= least)):
        x, own = q.near[k], at[base[k] : base[k] + sizes[k]]
        docs = [np.unique(segment.doc(segment.postings(int(t)))) for t in own[: x.lead] if t >= 0]
        full, n = np.unique(np.concatenate(docs), return_counts=True)
        full = full[n >= x.lead_need]
        if not len(full):
            continue
        lists = [segment.postings(int(t)) if t >= 0 else segment.bounds[:0] for t in own]
        low, high = ([np.searchsorted(x, segment.bounds[full + i]) for x in lists] for i in (0, 1))
        for i in np.flatnonzero(np.sum([a < b for a, b in zip(low, high, strict=True)], axis=0) >= x.need):
            spans = [y[a[i] : b[i]] for y, a, b in zip(lists, low, high, strict=True)]
            places, kind = np.concatenate(spans), np.repeat(np.arange(len(spans)), [len(y) for y in spans])
            order = np.argsort(places, kind="stable")
            rows += [(full[i], x.item, first - segment.bounds[full[i]], 0, last - first + 1) for first, last in _windows(places[order], kind[order], x)]
    return [tuple(np.array(c) for c in zip(*rows, strict=True))] if rows else []


def search(index: DataFrame, queries: Queries) -> DataFrame:
    """``(doc_id, item_id, kind, doc_word, item_word, n_words)``: phrase and proximity matches of all items in all documents."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        items = np.array([i for i, _ in queries.items], dtype=np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                segment = _Segment({c: batch.column(c)[k] for c in batch.schema.names})
                for kind, rows in (("phrase", _phrases(segment, queries)), ("proximity", _near(segment, queries))):
                    for doc, item, at, start, size in rows:
                        arrays = [pa.array(segment.ids[doc]), pa.array(items[item]), pa.array([kind] * len(doc))]
                        yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x.astype(np.int64)) for x in (at, start, size))], [c.split()[0] for c in _MATCH.split(", ")])

    return index.mapInArrow(run, _MATCH)


def benchmark_items(benchmark: DataFrame) -> list[tuple[int, np.ndarray]]:
    """Term hashes of every item. Items without an id or a word ask for nothing; rows that share an id are items of their own."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").alias("t")).where("id is not null").toPandas()
    rows = rows.sort_values(["id", "t"], kind="stable")
    w = words(plain(pa.array(rows["t"], pa.string(), from_pandas=True)))
    items = [(int(i), w.hash[w.bounds[k] : w.bounds[k + 1]]) for k, i in enumerate(rows["id"])]
    return [x for x in items if len(x[1])]


def matches(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All matches of the benchmark's items in docs, from an index of all of docs' words.

    doc_word and item_word count words from 0; n_words is the length of the matching passage. Items
    shorter than ``phrase`` words match whole; those of fewer than NEAR_LEAST different terms have no proximity matches. Texts that are
    null, empty or without words match nothing, as do rows without a doc_id. Repeated documents are reported each. A benchmark of
    more than ``most_bytes`` is searched in parts, over one index. Only doc_id, item_id and text are read.
    """
    index = Table(build_index(docs), "positional-index")
    parts = -(-(benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most_bytes)
    made = []
    for k in range(max(1, parts)):
        own = benchmark if parts < 2 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        items = benchmark_items(own)
        terms = np.unique(np.concatenate([t for _, t in items])) if items else np.empty(0, np.uint64)
        frequency, total = frequencies(index.df, terms) if len(terms) else ({}, 0)
        made.append(Table(search(index.df, plan(items, frequency, total, phrase)), "benchmark-matches").df)
    index.drop()
    found = made[0]
    for more in made[1:]:
        found = found.union(more)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """The documents without those that match an item, with all their columns. Rows without a doc_id stay."""
    dirty = Table(matches(docs, benchmark, phrase).select(F.col("doc_id").alias("__dirty")).distinct(), "contaminated").df
    return docs.join(dirty, docs["doc_id"].cast("long") == dirty["__dirty"], "left_anti")
