"""Connected components by alternating large-star and small-star steps; links stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(a, b) for every node a that is not the least of its component, b being the least. `edges`: a, b of one orderable type.

    A node's rows meet in one key only as stars of distinct neighbours, and joins on it can be split by AQE.
    Each round is written to the shared folder, so no lineage grows and lost executors cost one round.
    """
    now = written(edges.where(F.col("a") != F.col("b")).distinct(), "edges")
    for _ in range(most):
        new = written(_small_star(_large_star(now)), "edges")
        changed = new.join(now, ["a", "b"], "left_anti").limit(1).count()
        if not changed and new.count() == now.count():
            return new
        now = new
    raise RuntimeError(f"components did not settle in {most} rounds")
