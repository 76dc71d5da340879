"""Origins of any depth: where each node's chain of parents ends, by pointer doubling.

Each round joins every open pointer with the pointer of the node it points to, so distances double; chains of depth d need
log2(d) rounds and no round holds a path. A chain that is still open when pointers span more steps than there are nodes runs
into a cycle. Rounds are written tables.

Nulls: a null parent, or one that is no node, ends a chain. Of several parents of a node the smallest counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.operators import tables


def origins(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, origin (null in or behind a cycle), depth (steps to the origin, null likewise), cyclic."""
    edges = nodes.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("up"))
    known = edges.select(F.col("node").alias("up"), F.lit(True).alias("real"))
    edges = edges.join(known, "up", "left").select("node", F.when(F.col("real"), F.col("up")).alias("up"))
    # at: the node reached after `depth` steps; it has reached the origin if open is false
    state = tables.written(edges.select("node", F.coalesce("up", "node").alias("at"), F.col("up").isNotNull().cast("long").alias("depth"), F.col("up").isNotNull().alias("open")), "origins")
    total, span = state.count(), 1
    while span <= total and not state.where("open").isEmpty():
        step = state.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("depth").alias("more"), F.col("open").alias("still"))
        moved = state.where("open").join(step, "at").select("node", F.col("to").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("still").alias("open"))
        state = tables.written(state.where("not open").union(moved), "origins")
        span *= 2
    return state.select(F.col("node").alias(node), F.when(~F.col("open"), F.col("at")).alias("origin"), F.when(~F.col("open"), F.col("depth")).alias("depth"), F.col("open").alias("cyclic"))
