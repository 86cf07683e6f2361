"""Connected components of a graph given as pairs, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that a task works on at least, as long as there are so many: small graphs don't take a task for each partition in each step.
TASK_EDGES = 50_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every end of ``edges``; the component is the smallest node that can be reached.

    Each step is one aggregation and one join on nodes, so a node with very many neighbours is a skewed join that adaptive
    execution splits. The number of steps grows with the logarithm of the graph.
    """
    edges = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = _state(edges)
    while before[0]:
        tasks = -(-2 * before[0] // TASK_EDGES)
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        # Every larger neighbour of a node is tied to the least one around that node.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # All smaller neighbours of a node, and the node itself, are tied to its least neighbour.
        tied = large.join(least, "u").select("u", "v", "m")
        edges = cut(
            tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionAll(tied.select("u", F.col("m").alias("v")))
            .coalesce(tasks)
            .distinct()
        )
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
