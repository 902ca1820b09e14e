"""Connected components of an undirected graph, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b); loops and repeats are allowed.

    Each round gives every node the smallest of itself and its neighbours, follows these pointers to their ends by
    doubling them, and contracts the edges to what they lead to; contracted edges that are loops or repeats go, so later rounds
    are small.  It ends when no edge is left, after about log(diameter) rounds.  Minima are pre-aggregated before the
    shuffle, and what a round leaves is written to the shared checkpoint folder.
    """
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = cut(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = None
    while True:
        step = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("root")).withColumnRenamed("u", "node")
        while True:  # pointers are doubled until they lead to a node that points to itself
            via = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = cut(step.join(via, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            step = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if roots is None:
            roots = step
        else:
            further = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = cut(roots.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        left = step.select(F.col("node").alias("u"), F.col("root").alias("a"))
        right = step.select(F.col("node").alias("v"), F.col("root").alias("b"))
        both = cut(both.filter("u <> v").join(left, "u").join(right, "v").filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        if both.isEmpty():
            return roots.select("node", F.col("root").alias("component"))
