"""Connected components of a graph given as an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b. Returns node, component (its smallest node) for every node that has an edge to another.

    Every node points to the smallest of itself and its neighbours; edges are redrawn between what their ends point
    to, until none is left; then the pointers are followed back. Each level is a table in the shared folder, so a node
    with very many edges is split by the adaptive skew join, and edges only shrink.
    """
    edges = stored(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels = []
    while not levels or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("up")))
        levels.append(up)
        left = up.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        edges = stored(edges.join(left, "a").join(right, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    found = levels[-1].select("node", F.col("up").alias("component"))
    for up in reversed(levels[:-1]):
        above = found.select(F.col("node").alias("up"), "component")
        found = up.join(above, "up", "left").select("node", F.coalesce("component", "up").alias("component"))
    return stored(found)
