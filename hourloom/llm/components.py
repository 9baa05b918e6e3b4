"""Connected components by contraction of edges, on Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import cut


def ranked(name: str) -> Column:
    """A node after its hash, to compare by."""
    return F.struct(F.xxhash64(name).alias("hash"), F.col(name).alias("node"))


def connected(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edges (a, b); label is one node of the component.

    Every round maps a node to the one with the least hash among itself and its neighbours, and keeps the edges between different
    images. Hashes are in random order, so each round is expected to remove a constant share of the nodes left, whatever the graph.
    Hot nodes meet only joins with one row per node and aggregations that combine before the exchange.
    """
    left = cut(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct())
    labels = None
    while left.limit(1).count():
        ends = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = ends.groupBy("a").agg(F.min(ranked("b")).alias("least"))
        step = cut(nearest.select(F.col("a").alias("node"), F.least(ranked("a"), "least")["node"].alias("to")))
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            onward = step.select(F.col("node").alias("label"), "to")
            labels = cut(labels.join(onward, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        first = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").select("x", "b")
        both = first.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").select("x", "y")
        pairs = both.filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = cut(pairs.distinct())
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
