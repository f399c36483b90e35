"""Connected components by alternating large-star and small-star operations.

Follows Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).
Each operation is one min-aggregation per vertex and one join with the edges,
so a hub of any degree is combined on the map side and split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Table


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every vertex sends the least vertex of its closed neighbourhood to its larger neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least_neighbour(both).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every vertex sends the least of its smaller neighbours to the others of them and takes it itself."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _least_neighbour(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    own = low.select("u", F.col("low").alias("v"))
    return moved.union(own).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x or 0


def connected_components(edges: DataFrame) -> Table:
    """Stars ``(u, v)``: v is the least vertex of u's component and u any other vertex of it.

    ``edges`` has long columns u and v; loops and repeated edges don't matter, and a null
    end drops the edge. No edges give no rows.
    """
    now = Table(edges.where("u <> v").select("u", "v").distinct(), "edges")
    before = _state(now.df)
    while True:
        after_large = Table(large_star(now.df), "large-star")
        now.drop()
        now = Table(small_star(after_large.df), "small-star")
        after_large.drop()
        state = _state(now.df)
        if state == before:
            return now
        before = state
