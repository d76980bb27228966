"""Churn, hotspots, and co-change."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators.graph import settled


def churn(changes: DataFrame, item: str, author: str, at: str, added: Column, removed: Column) -> DataFrame:
    """Per item: commits (rows), sums of added and removed, first and last time, distinct authors.

    What is no number, as the marks of binary files, counts as zero.
    """
    number = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0))
    return changes.groupBy(item).agg(F.count("*").alias("commits"), F.sum(number(added)).alias("added"), F.sum(number(removed)).alias("removed"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.countDistinct(author).alias("author_count"))


def fan_in(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(dst, deps): distinct sources of each target."""
    return edges.groupBy(dst).agg(F.countDistinct(src).alias("deps"))


def hotspots(churned: DataFrame, deps: DataFrame, item: str) -> DataFrame:
    """item, commits, deps and score = commits * (1 + deps)."""
    joined = churned.join(deps, item, "left").withColumn("deps", F.coalesce("deps", F.lit(0)))
    return joined.select(item, "commits", "deps", (F.col("commits") * (1 + F.col("deps"))).alias("score"))


def weighed(rows: DataFrame, item: str, src: str) -> DataFrame:
    """hotspots of rows (item, src) that hold both changes and sources: rows are brought together once, by item and source."""
    pairs = rows.groupBy(item, src).agg(F.count("*").alias("__n"))
    counts = pairs.groupBy(item).agg(F.sum("__n").alias("commits"), F.count(src).alias("deps"))
    return counts.select(item, "commits", "deps", (F.col("commits") * (1 + F.col("deps"))).alias("score"))


def untested_risk(scored: DataFrame, files: DataFrame, tested: DataFrame, item: str, noise: Sequence[str]) -> DataFrame:
    """scored items that no test claims and whose pattern (files: item, pattern) is no noise."""
    return quiet(scored, files, item, noise).join(tested.select(item).distinct(), item, "left_anti")


def quiet(scored: DataFrame, files: DataFrame, item: str, noise: Sequence[str]) -> DataFrame:
    """scored items whose pattern (files: item, pattern) is none of noise; items without a file are left out."""
    return scored.join(files.where(~F.col("pattern").isin(list(noise))).select(item).distinct(), item, "left_semi")


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    return scored.orderBy(*order).limit(k)


def ranked(scored: DataFrame, item: str) -> DataFrame:
    """scored with the rank of every item; equal scores by item.

    The rank is global without a global task: rows are partitioned by range and
    sorted there, the number of rows of each partition gives the next one's
    offset, and only those numbers reach the driver. Many equal scores part by
    item.
    """
    order = (F.desc("score"), F.asc(item))
    placed = settled(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [(p, start) for (p, _), start in zip(counts, accumulate((n for _, n in counts), initial=0))]
    offsets = scored.sparkSession.createDataFrame(before, "__part long, __before long")  # a row per partition
    ranks = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return ranks.select(*scored.columns, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))


def cochange(baskets: DataFrame, basket: str, item: str, max_items: int = 25, min_changes: int = 5, min_degree: float = 0.3) -> DataFrame:
    """Pairs (a < b) of items that change together: co, both counts, Jaccard degree and both confidences.

    Baskets of more than max_items are left out before pairs are made, and so
    are items of fewer than min_changes clean baskets: the pairs stay linear in
    the rows. The threshold is on the unrounded degree.
    """
    rows = baskets.select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct()
    size = rows.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") <= max_items).select("basket")
    clean = rows.join(size, "basket", "left_semi")
    counts = clean.groupBy("item").agg(F.count("*").alias("changes")).where(F.col("changes") >= min_changes)
    kept = clean.join(counts.select("item"), "item", "left_semi")
    a, b = kept.alias("a"), kept.alias("b")
    pairs = a.join(b, (F.col("a.basket") == F.col("b.basket")) & (F.col("a.item") < F.col("b.item"))).groupBy(F.col("a.item").alias("a"), F.col("b.item").alias("b")).agg(F.count("*").alias("co"))
    ca, cb = counts.select(F.col("item").alias("a"), F.col("changes").alias("changes_a")), counts.select(F.col("item").alias("b"), F.col("changes").alias("changes_b"))
    degree = F.col("co") / (F.col("changes_a") + F.col("changes_b") - F.col("co"))
    out = pairs.join(ca, "a").join(cb, "b").where(degree >= min_degree)
    return out.select("a", "b", "co", "changes_a", "changes_b", F.round(degree, 3).alias("degree"), F.round(F.col("co") / F.col("changes_a"), 3).alias("a_then_b"), F.round(F.col("co") / F.col("changes_b"), 3).alias("b_then_a"))


def explained(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (a, b) with imports 1 where an edge joins them in either direction."""
    either = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("imports", F.lit(1))
    return pairs.join(either, ["a", "b"], "left").withColumn("imports", F.coalesce("imports", F.lit(0)))


def explained_within(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """pairs (a, b) with imports 1 where both ends, two items, share a module of places (item, module), else 0.

    As explained by edges between all items of a module, whose number is the
    square of theirs: here each end brings its modules, of which an item has few.
    """
    held = places.groupBy("item").agg(F.collect_set("module").alias("__in"))
    side = lambda k: held.select(F.col("item").alias(k), F.col("__in").alias(f"__{k}"))
    shared = F.coalesce(F.arrays_overlap("__a", "__b") & (F.col("a") != F.col("b")), F.lit(False))
    rows = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return rows.select(*pairs.columns, shared.cast("int").alias("imports"))
