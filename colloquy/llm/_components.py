"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the node's smallest neighbour or itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is either linked down, once, or a root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down")))).alias("x")).select("x.*")
    counts = ends.groupBy("node").agg(F.sum("down").alias("links"), F.min("down").alias("least"))
    return counts.where("links > 1 or (links = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``; the root is the smallest.

    Nodes without an edge are not listed. Each round is written to the shared
    folder; rounds go with the logarithm of the longest path.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for _ in range(max_rounds):
        edges = written(_small_star(_large_star(edges)), name)
        if _are_stars(edges):
            break
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
