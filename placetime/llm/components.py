"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetime.llm.tables import Tables


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); the component is its smallest node.

    Alternates large and small stars: every node's greater neighbours, then its smaller ones, are
    tied to the smallest node around it. The number of rounds grows with the logarithm of the
    longest path, and there are never more edges than at the start; a node with many
    neighbours is a key of a minimum that combines map side, and joins read written tables, whose
    crowded partitions adaptive execution splits.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = tables.settle(pairs.distinct())
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = tables.settle(_least(both))
        ties = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = tables.settle(ties.filter("a > b").distinct())
        lower = tables.settle(_least(large))
        ties = large.join(lower, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = tables.settle(ties.unionAll(lower.select("a", F.col("least").alias("b"))).filter("a > b").distinct())
        # Both are sets of edges, so they are the same if they have as many and no new one.
        changed = small.count() != edges.count() or not small.join(edges, ["a", "b"], "left_anti").isEmpty()
        tables.drop(edges, least, large, lower)
        edges = small
        if not changed:
            named = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return named.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _least(pairs: DataFrame) -> DataFrame:
    """Per node a, the least node around it, itself included."""
    return pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
