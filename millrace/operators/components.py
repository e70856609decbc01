"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import removed, written


def _nearest(pairs: DataFrame) -> DataFrame:
    """The least of each node and its partners; summed up within tasks before the shuffle."""
    return written(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of all nodes that have an edge; component is the smallest id reachable.

    Edges may repeat and point either way; loops are dropped. Each step is a grouped
    minimum and a join with it, whose hot side (a hub's edges) Spark can split, and is
    written before the next, and the tables before it are removed. The number of steps grows with the logarithm of the
    longest path. No edges: no rows.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    # u > v: each edge points to the smaller id.
    now = written(edges.select(high.alias("u"), low.alias("v")).where("u <> v").distinct())
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = _nearest(both)
        large = both.join(nearest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(large.where("u <> v").distinct())
        removed(nearest, now)
        nearest = _nearest(stars)
        joined = stars.join(nearest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        )
        now = written(small.where("u <> v").distinct())
        removed(nearest, stars)
        if (after := _state(now)) == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
