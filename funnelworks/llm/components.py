"""Connected components of a graph given by its edges, as iterated DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge; a component is named by its least node.

    Each round every node takes its least neighbour (or itself) as parent, and that one's
    parent; the edges move to the parents, and those inside one node go. The graph shrinks
    at least by its leaves every round, so the joins read less and less. A round ends in
    reliable checkpoints; joins of two checkpoints let Spark split a node of high degree. Node
    names should be hashes: names that rise along a path would shrink it by two a round only.
    """
    left = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())
    component = None
    while True:
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("to")))
        up = least.select(F.col("node").alias("_at"), F.col("to").alias("_up"))
        parent = cut(least.join(up, least["to"] == up["_at"]).select("node", F.col("_up").alias("to")))
        if component is None:
            component = parent.select("node", F.col("to").alias("component"))
        else:
            moved = component.join(parent.select(F.col("node").alias("_at"), "to"), F.col("component") == F.col("_at"), "left")
            component = cut(moved.select("node", F.coalesce("to", "component").alias("component")))
        first = left.join(parent.select(F.col("node").alias("u"), F.col("to").alias("pu")), "u").select("pu", "v")
        second = cut(first).join(parent.select(F.col("node").alias("v"), F.col("to").alias("pv")), "v")
        left = cut(second.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).where("u <> v").distinct())
        if not left.limit(1).count():
            return component
