"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesops.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the smallest node around it."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = around.filter(F.col("b") > F.col("a")).join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of every node, and the node, to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter(F.col("a") != F.col("b")).unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node with an edge (a, b); root is the smallest node reachable.

    Alternates large and small stars until every edge points at its root. The number of rounds grows
    with the logarithm of the longest path; every round is written to the shared folder. A node's
    smallest neighbour is an aggregate combined before the shuffle and joined back, so a node with
    very many edges is split like any skewed join. An empty table of edges gives no rows; loops and
    repeated edges do not matter.
    """
    down = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = written(down.distinct(), "edges")
    while True:
        after = written(_small_star(_large_star(current)), "edges")
        # Done when every node has one edge and no root has one of its own.
        inner = after.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        left = inner.filter(F.col("n") > 1).limit(1).count()
        if not left:
            left = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        current = after
        if not left:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
