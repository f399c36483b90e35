"""Canonical exact digests.

The canonical form of a text is NFKC, then case folded, then with runs of white
space as one space and none at the ends. Its 128-bit xxHash groups documents; that
shuffle moves 16 bytes a document. Digests that occur once need no more. For the
others the canonical texts are grouped by digest and text, which compares
bytes inside equal buckets and combines copies before the shuffle. A Bloom filter of the
repeated texts, by a hash of the text as it is, keeps nearly all others out of it before they are made canonical again. The filter has BITS bits for a
digest and MOST_BITS at most; beyond that more texts pass it and are found to be
single, so its size is bounded and the result exact at any scale. Only if a digest has
two different texts are its documents joined back by text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Table

BITS, MOST_BITS, PROBES = 12, 1 << 27, 4
_DIGEST = "doc_id long, raw long, d1 long, d2 long, chars long"
_TEXT = "doc_id long, d1 long, d2 long, text string"


def canonical(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def wide(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _made(batch: pa.RecordBatch, digest: Callable[[str], bytes]) -> tuple[list[str], np.ndarray]:
    """Canonical texts and their digests, two longs each."""
    texts = [canonical(x) for x in batch.column("t").to_pylist()]
    return texts, np.frombuffer(b"".join(map(digest, texts)), np.int64).reshape(-1, 2)


def digests(docs: DataFrame, digest: Callable[[str], bytes] = wide) -> DataFrame:
    """``(doc_id, raw, d1, d2, chars)`` of every row; raw is a hash of the text as it is, chars the length of the canonical text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, made = _made(batch, digest)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("raw"), pa.array(made[:, 0]), pa.array(made[:, 1]), pa.array([len(x) for x in texts], pa.int64())], [c.split()[0] for c in _DIGEST.split(", ")])

    return _narrow(docs).mapInArrow(run, _DIGEST)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t"), F.xxhash64("text").alias("raw")).where("id is not null")


def bloom(repeated: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """The 64-bit words of a filter of pairs (d1, d2); their number is a power of two."""
    n = repeated.count()
    bits = 64
    while bits < min(n * BITS, most_bits):
        bits *= 2
    low = F.lit(bits - 1)
    place = F.explode(F.array(*[(F.col("d1").bitwiseAND(low) + F.col("d2").bitwiseAND(low) * k).bitwiseAND(low) for k in range(PROBES)]))
    rows = repeated.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("b")).toPandas()
    words = np.zeros(bits // 64, np.int64)
    words[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return words


def may_hold(words: np.ndarray, made: np.ndarray) -> np.ndarray:
    ok = np.ones(len(made), bool)
    low = np.int64(len(words) * 64 - 1)
    for k in range(PROBES):
        p = ((made[:, 0] & low) + (made[:, 1] & low) * k) & low
        ok &= (words[p >> 6] >> (p & 63)) & 1 == 1
    return ok


def _texts(docs: DataFrame, words: np.ndarray, digest: Callable[[str], bytes]) -> DataFrame:
    """Canonical texts of the rows that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_numpy()
            batch = batch.take(pa.array(np.flatnonzero(may_hold(shared.value, np.stack([raw, raw >> 27], axis=1)))))
            texts, made = _made(batch, digest)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made[:, 0]), pa.array(made[:, 1]), pa.array(texts, pa.string())], [c.split()[0] for c in _TEXT.split(", ")])

    return _narrow(docs).mapInArrow(run, _TEXT)


def exact_groups(docs: DataFrame, digest: Callable[[str], bytes] = wide) -> DataFrame:
    """``(doc_id, group_id, group_size, chars)`` for every row that has a doc_id.

    group_id is the least doc_id of all rows whose canonical text is the same, byte for byte, and
    group_size the number of these rows. Null, empty and blank texts are one group, the empty text. Rows
    that share a doc_id count each; a null doc_id gives no row. Only doc_id and text are read.
    """
    made = Table(digests(docs, digest), "digests")
    repeated = Table(made.df.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2"), "repeated")
    words = bloom(made.df.join(repeated.df, ["d1", "d2"], "left_semi").select(F.col("raw").alias("d1"), F.shiftright("raw", 27).alias("d2")).distinct())
    repeated.drop()
    texts = _texts(docs, words, digest)
    classes = Table(texts.groupBy("d1", "d2", "text").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size")), "classes")
    kinds = classes.df.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("kinds"), F.first("group_id").alias("group_id"), F.first("group_size").alias("group_size"))
    kinds = Table(kinds, "kinds").df
    joined = made.df.join(kinds, ["d1", "d2"], "left")
    one = joined.where("kinds is null or kinds = 1")
    out = one.select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "chars")
    if kinds.where("kinds > 1").isEmpty():
        return out
    clash = texts.join(kinds.where("kinds > 1").select("d1", "d2"), ["d1", "d2"], "left_semi").join(classes.df, ["d1", "d2", "text"])
    return out.union(clash.select("doc_id", "group_id", "group_size", F.length("text").cast("long").alias("chars")))


ORACLE = r"""
WITH folded AS (
  SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss'), '\s+', ' ', 'g')) AS canon
  FROM documents WHERE doc_id IS NOT NULL
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY canon) AS group_id, count(*) OVER (PARTITION BY canon) AS group_size, length(canon) AS chars
FROM folded
"""
