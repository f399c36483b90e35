"""Bounded, repeatable samples of labelled documents for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are used to fit a model; every document is scored.
LABELLED = 20_000


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, limit: int = LABELLED) -> DataFrame:
    """``(id, t, y)`` of at most ``limit`` labelled documents, those with the least hash of their doc_id.

    Labels are 0 or 1. Null ids and labels don't count, nor does a document with both labels.
    The sample is small, so it is broadcast to the scan of the documents.
    """
    one = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(column).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    one = one.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    chosen = one.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t"))
    return texts.join(F.broadcast(chosen), "id").select("id", "t", "y")
