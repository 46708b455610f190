"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    # Written first: a join of two plain shuffles is one whose hot side can be split.
    least = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = scratch.save(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) for every node that has an edge and isn't the root.

    ``edges`` has columns a and b. Minima are summed before each shuffle and edges are joined to them,
    so a hub's neighbours are never gathered. Each round is written; rounds end when one changes nothing.
    """
    edges, before = scratch.save(edges.select("a", "b").where("a != b").distinct()), None
    for _ in range(most_rounds):
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = seen
        large = scratch.save(_large_star(edges, scratch).distinct())
        after = scratch.save(_small_star(large, scratch).distinct())
        scratch.drop(large)
        scratch.drop(edges)
        edges = after
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
