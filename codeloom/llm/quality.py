"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a linear function of numeric features of its text.
Pairs of a good and a bad labelled document are preferences; the weights
minimise the logistic loss of their feature differences (Newton steps, L2
penalty). The fitted sample also gives the share of documents that fall below
the strength which parts the two classes best. The threshold is the quantile
of the strengths of all documents at that share, less its sampling error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import LABELLED, labelled_texts
from .store import Table, unused
from .text import buffers, chunks, mix64, plain, words

PAIRS, PENALTY, BOUND = 100_000, 1e-2, 32.0
FEATURES = (
    "log_chars", "log_words", "word_bytes", "upper", "digit", "space", "line", "mark", "symbol", "other_alphabet",
    "same_byte", "same_word", "distinct_words", "distinct_triples", "short_words", "long_words",
)
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[9, 32]] = 3
_KIND[[10, 13]] = 4
_KIND[[ord(c) for c in ".,;:'\"?-()"]] = 5
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"?-()_"]] = 6
_KIND[128:] = 7


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text; null and empty texts are all zeros."""
    w = words(texts)
    raw, offsets = buffers(texts)
    n = len(texts)
    size, count = np.diff(offsets), w.count
    kind = _KIND[raw]
    per = lambda k: _sums(kind == k, offsets) / np.maximum(size, 1)
    same = np.zeros(len(raw), bool)
    same[1:] = raw[1:] == raw[:-1]
    doc, length = w.doc, w.end - w.start
    again = np.zeros(len(doc), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    triple = w.hash.copy()
    for k in (1, 2):
        triple[:-k] = mix64(triple[:-k] + w.hash[k:] * np.uint64(2 * k + 1))
    many = np.maximum(count, 1)
    columns = [
        np.log1p(size), np.log1p(count), _sums(length, w.bounds) / many / 10, per(1), per(2), per(3), per(4), per(5), per(6), per(7),
        _sums(same, offsets) / np.maximum(size, 1), _sums(again, w.bounds) / many, _distinct(doc, w.hash, n) / np.maximum(count, 1) ** 0.9,
        _distinct(doc, triple, n) / many, _sums(length <= 2, w.bounds) / many, _sums(length >= 14, w.bounds) / many,
    ]
    return np.stack(columns, axis=1) if n else np.empty((0, len(FEATURES)))


@dataclass(frozen=True)
class Model:
    """Strength = weights . [z, z**2] with z the clipped standard score of each feature; share: of documents to reject."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    share: float

    def terms(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.concatenate([z, z * z], axis=1)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.clip(self.terms(x) @ self.weights, -BOUND, BOUND), 3) + 0.0


def _newton(d: np.ndarray, penalty: float) -> np.ndarray:
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        gradient = -(d.T @ p) / len(d) + penalty * w
        hessian = (d.T * (p * (1 - p))) @ d / len(d) + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = PENALTY) -> Model:
    """Weights from pairs of a good (1) and a bad (0) row. With one class only, every strength is 0 and nothing is rejected."""
    k = x.shape[1]
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(k), np.ones(k), np.zeros(2 * k), 0.0)
    scale = x.std(axis=0)
    blank = Model(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), np.zeros(2 * k), 0.0)
    terms, good, bad = blank.terms(x), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if len(good) * len(bad) <= pairs:
        i, j = np.repeat(good, len(bad)), np.tile(bad, len(good))
    else:
        random = np.random.Generator(np.random.PCG64(5))
        i, j = random.choice(good, pairs), random.choice(bad, pairs)
    weights = _newton(terms[i] - terms[j], penalty)
    s = np.clip(terms @ weights, -BOUND, BOUND)
    order = np.argsort(s, kind="stable")
    below_bad, below_good = np.cumsum(y[order] == 0) / len(bad), np.cumsum(y[order] == 1) / len(good)
    cut = int(np.argmax(below_bad - below_good)) + 1
    share = cut / len(s)
    return Model(blank.centre, blank.scale, weights, max(0.0, share - 2 * float(np.sqrt(share * (1 - share) / len(s)))))


def train(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                x = features(plain(part.column("t")))
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), values], ["id", "y", "x"])

    rows = labelled_texts(docs, labels, "quality", limit).mapInArrow(run, "id long, y int, x array<double>").toPandas()
    rows["key"] = rows["x"].map(tuple)
    rows = rows.sort_values(["id", "key"], kind="stable")
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["y"].to_numpy())


def strength(model: Model):
    """A column function of a text column: its strength; that of a text without words is the least possible."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for part in chunks(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
            x = features(plain(part.column("t")))
            out.append(np.where(x[:, 1] > 0, model.strength(x), -BOUND))
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return F.arrow_udf(run, "double")


def threshold(strengths: DataFrame, share: float) -> float:
    """The exact ``share`` quantile of column s over all rows. s has three decimals within +-BOUND, so counts by value are few."""
    counts = sorted((r.s, r.n) for r in strengths.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect())
    left = share * sum(n for _, n in counts)
    for s, n in counts:
        if n > left:
            return s
        left -= n
    return -BOUND


def scored(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``(doc_id, strength, keep)`` for every row of docs.

    Rows are judged one by one, so repeated rows and null doc_ids give rows as well. A null,
    empty or wordless text has the least strength and isn't kept. Without labels of both classes all
    strengths are 0 and every text with words is kept. Only doc_id and text are read.
    """
    model = train(docs, labels, limit)
    made = Table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), strength(model)("text").alias("strength")), "strengths").df
    least = threshold(made.select(F.col("strength").alias("s")), model.share)
    return made.withColumn("keep", F.col("strength") >= max(least, -BOUND + 0.001))


def accepted(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """The rows that ``scored`` keeps, with all their columns. They are written with their strength, so that texts are read for it once."""
    model, name = train(docs, labels, limit), unused(docs, "strength")
    made = Table(docs.withColumn(name, strength(model)("text")), "strengths").df
    least = threshold(made.select(F.col(name).alias("s")), model.share)
    return made.where(F.col(name) >= max(least, -BOUND + 0.001)).drop(name)
