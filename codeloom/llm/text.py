"""Columnar tokenising shared by the corpus operators.

A batch of texts is lower-cased by Arrow, cut into words by a byte class
table and hashed by position-dependent tabulation, all with numpy over the
whole batch: no Python code runs per word or per character. A word is a
maximal run of ASCII letters, digits, underscores and non-ASCII characters
other than the general and Latin-1 punctuation blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True
_WORD[128:] = True
_TAB = np.random.Generator(np.random.PCG64(20240817)).integers(0, 2**64, 64 * 256, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; arithmetic wraps modulo 2**64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one large_string array without nulls (null reads as the empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets between them, starting at 0."""
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``limit`` bytes of text each; a longer text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


@dataclass
class Words:
    """Words of a batch: byte range and hash of each; those of text d are bounds[d]:bounds[d + 1]."""

    raw: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.count)


def word_mask(raw: np.ndarray) -> np.ndarray:
    mask = _WORD[raw]
    for lead, follow, width in ((0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3), (0xC2, None, 2)):
        at = np.flatnonzero(raw == lead)
        if len(at):
            at = at[at + width <= len(raw)]
            if follow is not None:
                at = at[np.isin(raw[at + 1], follow)]
            for k in range(width):
                mask[at + k] = False
    return mask


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of the first word of every text."""
    if not len(raw):
        empty = np.empty(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    mask = word_mask(raw)
    edge = np.empty(len(raw) + 1, dtype=bool)
    edge[0], edge[-1] = mask[0], mask[-1]
    np.not_equal(mask[1:], mask[:-1], out=edge[1:-1])
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    both = np.unique(inner[mask[inner] & mask[inner - 1]])
    at = np.flatnonzero(edge)
    if len(both):
        at = np.sort(np.concatenate([at, both, both]))
    start, end = at[::2], at[1::2]
    return start, end, np.searchsorted(start, offsets)


def words(texts: pa.Array, lower: bool = True) -> Words:
    raw, offsets = buffers(plain(pc.utf8_lower(texts) if lower else texts))
    start, end, bounds = word_spans(raw, offsets)
    if not len(start):
        return Words(raw, offsets, start, end, np.empty(0, np.uint64), bounds)
    length = end - start
    first = np.cumsum(length) - length
    total = int(first[-1] + length[-1])
    place = np.arange(total) - np.repeat(first - start, length)
    within = np.arange(total) - np.repeat(first, length)
    key = ((within & 63) << 8) | raw[place]
    value = np.add.reduceat(_TAB[key], first)
    return Words(raw, offsets, start, end, mix64(value + length.astype(np.uint64)), bounds)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one text, and the first index of every text.

    A text with fewer words than n, but at least one, has a single shingle of all its words.
    """
    count = w.count
    own = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    bounds = np.concatenate([[0], np.cumsum(own)])
    at = np.arange(bounds[-1]) + np.repeat(w.bounds[:-1] - bounds[:-1], own)
    size = np.repeat(np.minimum(count, n), own)
    value = np.zeros(len(at), np.uint64)
    last = len(w.hash) - 1
    for k in range(n):
        part = w.hash[np.minimum(at + k, last)] if last >= 0 else np.empty(0, np.uint64)
        if k:
            part = np.where(k < size, part, np.uint64(0))
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k))
    return value, bounds
