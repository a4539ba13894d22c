"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


#: Edges up to which the nodes' minima are broadcast (16 bytes each); beyond it, they are joined by shuffle.
BROADCAST_EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reached) of every node of ``edges`` (columns a, b: bigint, no nulls).

    Nodes without edges have no row. Each round is two aggregations to minima and two joins on the edges, and is kept as Parquet in
    the shared folder; the number of rounds grows with the logarithm of the longest path. Nothing is collected but a row count and a checksum.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        small_enough = F.broadcast if 2 * state[0] <= BROADCAST_EDGES else lambda table: table
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(small_enough(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_enough(low), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = keep(small.where("u <> v").distinct(), 2 * state[0])
        before, state = state, _state(now)
        if state == before:
            break
    rows = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return rows.unionByName(rows.select(F.col("component").alias("node"), "component").distinct())
