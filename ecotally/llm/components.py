"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecotally.session import reliable_checkpoint


def _large(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to its smallest one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the smallest node it reaches, for the nodes
    other than the smallest of each component.

    ``edges`` has long columns a and b; order, repeats and loops do not matter.
    Each round halves the paths; it is checkpointed, and the rounds end when the
    edges stand still.  Only two numbers a round reach the driver.
    """
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = reliable_checkpoint(edges)
    seen = None
    for _ in range(most_rounds):
        edges = reliable_checkpoint(_small(_large(edges).distinct()).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
    raise RuntimeError(f"components still change after {most_rounds} rounds")
