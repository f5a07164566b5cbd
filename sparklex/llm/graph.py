"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklex.llm.shared import stored


def _facts(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of its component, for edges (a, b) of longs.

    Null ends and loops are ignored.  Each round shuffles the edges by node twice
    and is written to the shared folder; rounds grow with the logarithm of the
    components' diameter.  An empty edge table gives an empty result.
    """
    edges = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "edges")
    before = _facts(edges)
    while before[0]:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = near.select("u", "v", least.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = F.min("v").over(Window.partitionBy("u"))
        small = large.select("u", "v", least.alias("m"))
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges = stored(small, "edges")
        after = _facts(edges)
        if after == before:
            break
        before = after
    lowest = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return lowest.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
