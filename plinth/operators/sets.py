"""Set operations and top-k per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_least(parts: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value): the least value of each key in any part."""
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.min(value).alias(value))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().subtract(b)


def one_sided(pairs: DataFrame, changed: DataFrame) -> DataFrame:
    """Pairs (a, b) of which exactly one end is among the changed nodes, with a_changed."""
    held = changed.select("node").distinct()
    both = pairs.join(held.select(F.col("node").alias("a"), F.lit(True).alias("__a")), "a", "left").join(held.select(F.col("node").alias("b"), F.lit(True).alias("__b")), "b", "left")
    return both.where(F.col("__a").isNull() != F.col("__b").isNull()).select(*pairs.columns, F.col("__a").isNotNull().alias("a_changed"))


def top_per_group(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each group in the given order."""
    return rows.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")
