"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the smallest node that can be reached) for every node of ``edges`` (columns a, b).

    A node's smallest neighbour comes from an aggregation with map-side combine and is joined back, so a node with very
    many neighbours isn't gathered anywhere. Every round is written to the checkpoint folder.
    """
    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    nodes = cut_lineage(now.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    before = state(now)
    for _ in range(most_rounds if before[0] else 0):
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = cut_lineage(small)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("the components did not settle")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
