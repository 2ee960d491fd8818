"""Connected components as joins: alternating star contraction, no driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(least, "a")
        .filter("b > a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: every a has one b, and no b is an a."""
    seen = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    if not seen.filter("n > 1").isEmpty():
        return False
    return edges.select(F.col("b").alias("a")).join(seen.select("a"), "a", "left_semi").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of `edges` (a, b), component = least node reachable.

    Self-links, nulls and repeated links are allowed; a node with only a self-link is left out
    (it is its own component). Every round is written to the shared checkpoint folder, and
    minima are pre-aggregated, so a hub costs a skewed join that adaptive execution splits.
    """
    now = checkpointed(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(rounds):
        if _settled(now):
            break
        now = checkpointed(_small_star(_large_star(now)))
    else:
        raise RuntimeError("components did not settle")
    centers = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        centers.withColumn("component", F.col("node"))
    )
