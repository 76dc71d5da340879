"""Connected components of an edge table by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import staged

LEAST_STEPS = 1


def _star(sides: DataFrame) -> DataFrame:
    """sides(u, v): v's of each u, to edges (v, smallest of u's)."""
    low = sides.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    return sides.join(low, "u").select("v", "m", "u")


def components(edges: DataFrame) -> DataFrame:
    """edges(u long, v long) to (node, component), component being the smallest node reachable. Nodes without edges are absent.

    Each step writes its edges to the shared folder. It ends when a step changes nothing, after about log2(nodes) steps.
    """
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        pairs = _star(large)
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(pairs.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = staged(small.distinct(), "edges")
        # a step that changes nothing keeps the number of edges and the sum of hashes
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v"), F.col("v")).distinct())
