"""License scans: winnowed template fingerprints, then banded alignment.

Every template is cut into GRAM-word hashes; of each WINNOW consecutive ones the
least is kept (the winnowing of Schleimer, Wilkerson and Aiken, 2003). The
kept hashes form an inverted index to (template, place). Looking all grams of a
document up in it gives hits; hits of one template whose diagonals (place in
document less place in template) lie within the band of each other are a
candidate. It is aligned with the template by a local alignment limited to
the band around these diagonals: a match scores 2, a mismatch or a gap -1.
An alignment is reported if it covers at least COVERAGE of the template's words. The text
on either side of it is aligned again, until none does. Where
reports of one document overlap, the one with the highest coverage, then the
most matched words, stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .text import chunks, plain, shingles, words

GRAM, WINNOW, BAND, COVERAGE = 3, 2, 6, 0.8
_ROW = "doc_id long, license string, template int, coverage double, matched int, first_word long, last_word long"


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least of each run of ``window`` hashes, the last of equal ones; all runs count even in a shorter sequence."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.empty(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(runs)) + window - 1 - np.argmin(runs[:, ::-1], axis=1))


class Index:
    """Winnowed grams of all templates: sorted hashes with their template and place."""

    def __init__(self, texts: list[str], gram: int = GRAM, window: int = WINNOW) -> None:
        w = words(plain(pa.array(texts, pa.string())))
        self.words = [w.hash[w.bounds[k] : w.bounds[k + 1]] for k in range(len(texts))]
        hashes, bounds = shingles(w, gram)
        kept = [(hashes[bounds[k] : bounds[k + 1]], k) for k in range(len(texts))]
        rows = [(h[p], k, p) for h, k in kept for p in winnow(h, window).tolist()]
        key, template, place = (np.concatenate([np.array([x[k]], kind) for x in rows] or [np.empty(0, kind)]) for k, kind in enumerate((np.uint64, np.int64, np.int64)))
        order = np.argsort(key, kind="stable")
        self.key, self.template, self.place, self.gram = key[order], template[order], place[order], gram

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in hashes, template and place in it of every shared gram."""
        if not len(self.key):
            return (np.empty(0, np.int64),) * 3
        low = np.searchsorted(self.key, hashes)
        found = np.flatnonzero(self.key[np.minimum(low, len(self.key) - 1)] == hashes)
        low, high = low[found], np.searchsorted(self.key, hashes[found], side="right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(found, n), self.template[at], self.place[at]


#: An alignment as one number that compares like (score, matched, start + 1).
_SCORE, _MATCH = 1 << 44, 1 << 26


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int, int]:
    """Score, matched words, first and last place in text of the best local alignment with low <= place in text - place in template <= high.

    Rows are template words; a row is computed at once, gaps in it as a running maximum.
    """
    width = high - low + 1
    step = np.arange(width) * _SCORE
    above = np.zeros(width + 1, np.int64)
    best = (0, -1)
    for i, word in enumerate(template):
        begin, end = max(0, -i - low), min(width, len(text) - i - low)
        now = np.zeros(width + 1, np.int64)
        if begin < end:
            j = np.arange(i + low + begin, i + low + end)
            before = above[begin:end]
            value = np.where(before > 0, before, j + 1) + np.where(text[j] == word, 2 * _SCORE + _MATCH, -_SCORE)
            value = np.maximum(value, above[begin + 1 : end + 1] - _SCORE)
            value = np.maximum.accumulate(value + step[begin:end]) - step[begin:end]
            now[begin:end] = np.where(value >= _SCORE, value, 0)
            k = int(np.argmax(now[:width] // _SCORE))
            if now[k] // _SCORE > best[0] // _SCORE:
                best = (int(now[k]), i + low + k)
        above = now
    found, last = best
    return found // _SCORE, found % _SCORE // _MATCH, found % _MATCH - 1, last


def _candidates(doc: np.ndarray, template: np.ndarray, diagonal: np.ndarray, band: int) -> Iterator[tuple[int, int, int, int]]:
    if not len(doc):
        return
    order = np.lexsort((diagonal, template, doc))
    doc, template, diagonal = doc[order], template[order], diagonal[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (template[1:] != template[:-1]) | (diagonal[1:] - diagonal[:-1] > band)
    first = np.flatnonzero(new)
    for a, b in zip(first, np.append(first[1:], len(doc)), strict=True):
        yield int(doc[a]), int(template[a]), int(diagonal[a]), int(diagonal[b - 1])


def scan_text(text: np.ndarray, candidates: list[tuple[int, int, int]], index: Index, band: int, least: float) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, matched, first, last) of the reports of one document, without overlaps."""
    found = []
    for template, low, high in candidates:
        own = index.words[template]
        rest = [(max(0, low - band), min(len(text), high + band + len(own) + 1))]
        while rest:
            begin, end = rest.pop()
            if end - begin < least * len(own):
                continue
            first_diagonal, last_diagonal = max(low - band, begin - len(own)), min(high + band, end)
            _, matched, first, last = align(own, text[begin:end], first_diagonal - begin, last_diagonal - begin)
            if matched >= least * len(own):
                found.append((template, matched / len(own), matched, begin + first, begin + last))
                rest += [(begin, begin + first), (begin + last + 1, end)]
    kept: list[tuple[int, float, int, int, int]] = []
    for x in sorted(found, key=lambda x: (-x[1], -x[2], x[3], x[0])):
        if all(x[3] > y[4] or x[4] < y[3] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[3])


def license_matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """One row a notice found: doc_id, license, template number, matched share and number of its words, and the span in words of the text.

    Every row of docs is scanned by itself, so repeated rows report again and a null doc_id is carried. Null,
    empty and wordless texts have no notice. Only doc_id and text are read.
    """
    index = Index([t for _, t in templates])
    names = np.array([n for n, _ in templates], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in chunks(batch, "t"):
                w = words(plain(part.column("t")))
                hashes, bounds = shingles(w, index.gram)
                at, template, place = index.hits(hashes)
                doc = np.searchsorted(bounds, at, side="right") - 1
                mine: dict[int, list[tuple[int, int, int]]] = {}
                for d, t, low, high in _candidates(doc, template, at - bounds[doc] - place, band):
                    mine.setdefault(d, []).append((t, low, high))
                ids = part.column("id")
                for d, candidates in mine.items():
                    rows += [(ids[d].as_py(), names[t], t, *rest) for t, *rest in scan_text(w.hash[w.bounds[d] : w.bounds[d + 1]], candidates, index, band, coverage)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _ROW.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t")).mapInArrow(run, _ROW)
