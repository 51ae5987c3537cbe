"""Connected components by alternating stars, with no vertex's edges gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import attach, stored


def _least_neighbours(edges: DataFrame, own: str) -> DataFrame:
    return stored(edges.groupBy(own).agg(F.min("other").alias("least"), F.count("*").alias("n")), "least")


def _distinct(pairs: DataFrame) -> DataFrame:
    """Edges between different vertices, larger end first, each once."""
    high, low = F.greatest("x", "y"), F.least("x", "y")
    return stored(pairs.where("x <> y").select(high.alias("high"), low.alias("low")).distinct(), "edges")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Tie each larger neighbour of a vertex to the least of the vertex and its neighbours."""
    both = edges.select(F.col("low").alias("own"), F.col("high").alias("other")).unionByName(edges.select(F.col("high").alias("own"), F.col("low").alias("other")))
    least = _least_neighbours(both, "own").withColumn("least", F.least("least", "own"))
    up = edges.select(F.col("low").alias("own"), "high")
    return _distinct(attach(up, least, ["own"], "n", total).select(F.col("high").alias("x"), F.col("least").alias("y")))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Tie a vertex and its smaller neighbours to the least of them."""
    down = edges.select(F.col("high").alias("own"), F.col("low").alias("other"))
    least = _least_neighbours(down, "own")
    smaller = attach(down, least, ["own"], "n", total).select(F.col("other").alias("x"), F.col("least").alias("y"))
    return _distinct(smaller.unionByName(least.select(F.col("own").alias("x"), F.col("least").alias("y"))))


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """For every vertex with an edge to another: ``node`` and ``root``, the least vertex it can reach.

    Vertices are longs; pairs with a null end are no edges; repeated edges and loops are ignored.
    """
    edges = _distinct(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")))

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first())

    before = mark(edges)
    while before[0]:
        edges = _small_star(_large_star(edges, before[0]), 2 * before[0])
        if (after := mark(edges)) == before:
            break
        before = after
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
