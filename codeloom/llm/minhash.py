"""Near-duplicate groups: MinHash, banding, signature verification, components.

Every text becomes the set of its word 3-shingles. ``bands * rows`` universal
hash functions (multiply-shift, a*x + b modulo 2**64 with odd a) take their
minima over the set; 16 bits of each make the signature. Four minima form one
band, exactly a long. Texts with the same whole signature are one vertex.
Vertices sharing a band are compared by signature inside their bucket: all
with the least vertex first, then each that failed with all the rest, so no
linked pair is missed and a bucket of copies costs one comparison a row.
Buckets are counted with map-side combination, and only the members of those with two vertices or
more are joined back, which splits hot ones. Buckets that hold the same vertices are handled once; one of more than
``block`` vertices is split into pairs of blocks that together cover all its
pairs. Components of the verified pairs are the groups.

Chance of meeting in a band, by Jaccard similarity, with 40 bands of 4:
0.92 at 0.5, 0.99 at 0.6, above 0.9999 from 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .store import Table, unused
from .text import chunks, mix64, plain, shingles, words

SHINGLE, BANDS, ROWS, THRESHOLD, BLOCK = 3, 40, 4, 0.5, 4096


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(61))
    return random.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1), random.integers(0, 2**64, n, dtype=np.uint64)


def signatures(texts: pa.Array, shingle: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """One row of 16-bit values for every text that has a word, and the positions of those texts."""
    hashes, bounds = shingles(words(texts), shingle)
    has = np.flatnonzero(np.diff(bounds))
    a, b = _family(bands * rows)
    low = np.empty((bands * rows, len(has)), np.uint64)
    if len(has):
        first, work = bounds[has], np.empty_like(hashes)
        for k in range(bands * rows):
            np.multiply(hashes, a[k], out=work)
            np.add(work, b[k], out=work)
            np.minimum.reduceat(work, first, out=low[k])
    return np.ascontiguousarray((mix64(low) & np.uint64(0xFFFF)).astype(np.uint16).T), has


def _sign(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "t"):
                matrix, has = signatures(plain(part.column("t")), shingle, bands, rows)
                keys = matrix.view(np.int64).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node").take(pa.array(has)),
                        pa.array([xxhash.xxh3_128_digest(row) for row in matrix], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), pa.array(keys)),
                    ],
                    ["node", "digest", "sig"],
                )

    return docs.mapInArrow(run, "node long, digest binary, sig array<long>")


def link_bucket(nodes: np.ndarray, sig: np.ndarray, need: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of equal signature places >= need that connect whatever all such pairs of the bucket connect."""
    alike = (sig == sig[0]).sum(axis=1) >= need
    pairs = [(np.full(int(alike.sum()), nodes[0]), nodes[alike])]
    for k in np.flatnonzero(~alike):
        near = np.flatnonzero((sig == sig[k]).sum(axis=1) >= need)
        pairs.append((np.full(len(near), nodes[k]), nodes[near]))
    return pairs


def _link(members: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """Verified pairs of partitions sorted by bucket and node."""
    need = int(np.ceil(threshold * bands * rows - 1e-9))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of whole buckets: starts, nodes, signatures. The last bucket of a batch waits for the next."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("f1", "f2", "unit")], axis=1)
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            sig = batch.column("sig").flatten().to_numpy().reshape(-1, bands).view(np.uint16)
            if held and not (key == held[0][0][0]).all():
                same = (key == held[0][0][0]).all(axis=1)
                n = int(np.argmin(same))
                held.append((key[:n], nodes[:n], sig[:n]))
                yield (np.zeros(1, np.int64), *(np.concatenate([h[i] for h in held]) for i in (1, 2)))
                held, key, nodes, sig = [], key[n:], nodes[n:], sig[n:]
            start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            cut = 0 if held else int(start[-1])
            if cut:
                yield start[:-1], nodes[:cut], sig[:cut]
            held.append((key[cut:], nodes[cut:], sig[cut:].copy()))
        if held:
            yield (np.zeros(1, np.int64), *(np.concatenate([h[i] for h in held]) for i in (1, 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, nodes, sig in groups(batches):
            size = np.diff(np.append(start, len(nodes)))
            lead = np.repeat(start, size)
            alike = (sig == sig[lead]).sum(axis=1) >= need
            good = np.logical_and.reduceat(alike, start)
            take = alike & np.repeat(good, size) & (lead != np.arange(len(nodes)))
            pairs = [(nodes[lead[take]], nodes[take])]
            for g in np.flatnonzero(~good):
                own = slice(start[g], start[g] + size[g])
                pairs += link_bucket(nodes[own], sig[own], need)
            u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
            apart = u != v
            yield pa.RecordBatch.from_arrays([pa.array(u[apart]), pa.array(v[apart])], ["u", "v"])

    return members.mapInArrow(run, "u long, v long")


def _units(members: DataFrame, block: int) -> DataFrame:
    """Splits a bucket of n > block vertices into units, one for every pair of its ceil(n / block) blocks."""
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    units = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(mine, j) * parts + F.greatest(mine, j))
    return members.select("f1", "f2", "node", F.explode(F.when(parts > 1, units).otherwise(F.array(F.lit(0)))).alias("unit"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(doc_id, group_id, group_size, keep)`` for every document of a group of two or more.

    group_id is the least doc_id of the group and keep is true for that one. Only the columns
    doc_id and text are read. A text of fewer words than a shingle counts as one shingle.
    Rows without a doc_id, and null, empty or wordless texts, belong to no group. Rows that
    share a doc_id are one document with the shingle sets of all of them. ``rows`` must be 4.
    """
    if rows != 4:
        raise ValueError("a band is four 16-bit minima packed in a long")
    narrow = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").alias("t")).where("node is not null")
    signed = Table(_sign(narrow, shingle, bands, rows), "signatures")
    vertices = Table(signed.df.groupBy("digest").agg(F.min("node").alias("node"), F.count_distinct("node").alias("n"), F.first("sig").alias("sig")), "vertices")
    banded = vertices.df.select("node", F.xxhash64("digest").alias("d"), F.posexplode("sig").alias("band", "key")).select("node", "d", F.xxhash64("band", "key").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("d").alias("f1"), F.bit_xor(F.xxhash64("d", F.lit(7))).alias("f2")).where("n > 1")
    members = banded.select("bucket", "node").join(shared, "bucket")
    units = _units(members.dropDuplicates(["f1", "f2", "node"]), block)
    ready = units.join(vertices.df.select("node", "sig"), "node").repartition("f1", "f2", "unit").sortWithinPartitions("f1", "f2", "unit", "node")
    copies = signed.df.select(F.col("node").alias("v"), "digest").join(vertices.df.where("n > 1").select("digest", F.col("node").alias("u")), "digest").select("u", "v")
    stars = connected_components(_link(ready, bands, rows, threshold).union(copies))
    signed.drop()
    vertices.drop()
    grouped = stars.df.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id"))
    sizes = grouped.groupBy("group_id").agg((F.count(F.lit(1)) + 1).alias("group_size"))
    heads = sizes.select(F.col("group_id").alias("doc_id"), "group_id", "group_size", F.lit(True).alias("keep"))
    return grouped.join(sizes, "group_id").select("doc_id", "group_id", "group_size", F.lit(False).alias("keep")).union(heads)


def keep_one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The documents without all but the first of each near-duplicate group, with all their columns.

    Of rows that share a doc_id one stays, the one with the least text. Rows without a
    doc_id stay.
    """
    marks = near_duplicates(docs, **parameters)
    again, gone, nth, mine = (unused(docs, c) for c in ("again", "gone", "nth", "mine"))
    ids = docs.select(F.col("doc_id").cast("long").alias(mine)).where(F.col(mine).isNotNull())
    repeated = ids.groupBy(mine).agg(F.count(F.lit(1)).alias(nth)).where(F.col(nth) > 1)
    twice_ids = Table(repeated.select(F.col(mine).alias(again)), "repeated").df
    gone_ids = Table(marks.where("not keep").select(F.col("doc_id").alias(gone)), "gone").df
    kept = docs.join(gone_ids, docs["doc_id"].cast("long") == gone_ids[gone], "left_anti")
    once = kept.join(twice_ids, kept["doc_id"].cast("long") == twice_ids[again], "left_anti")
    twice = kept.join(twice_ids, kept["doc_id"].cast("long") == twice_ids[again], "left_semi")
    order = Window.partitionBy(F.col("doc_id").cast("long")).orderBy("text")
    first = twice.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return once.union(first)
