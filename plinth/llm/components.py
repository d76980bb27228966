"""Connected components by alternating large-star and small-star rounds.

Each round is two group-and-join steps over the edge table; a component of
n nodes needs about log2(n) rounds, and every round's edges are checkpointed
in the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import durable


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Self-links and repeated links are ignored; null ends are ignored. An empty
    edge table gives an empty result. Rounds end when the edges no longer
    change; RuntimeError if `rounds` were not enough.
    """
    now = durable(edges.select("a", "b").where("a <> b").distinct())
    was = _mark(now)
    for _ in range(rounds if was[0] else 0):
        now = durable(_small(_large(now)))
        mark = _mark(now)
        if mark == was:
            break
        was = mark
    else:
        if was[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
