"""Connected components by alternating star steps, each a pre-aggregated join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import staged, unstage


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges`` (u, v); the smallest reachable node.

    Every node is hung under the smallest of its neighbours, first for larger, then
    for smaller ones, until the edges are stars. Rounds grow with the logarithm of
    the longest path. Joins are plain, so a node with very many links is split by
    adaptive execution. Self links and repeated links are allowed; no links, no rows.
    """
    now = staged(edges.where(F.col("u") != F.col("v"))
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = _both(now)
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lows, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u != v").distinct())
        after = staged(small, "edges")
        new = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstage(now)
        now = after
        if tuple(new) == mark:
            break
        mark = tuple(new)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select("node", F.col("node").alias("component")))
