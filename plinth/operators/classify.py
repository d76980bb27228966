"""Ordered first-match classification and its coverage."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A named test; `when` is a regular expression for the subject, or makes a condition from its column."""

    name: str
    tier: int
    when: str | Callable[[Column], Column]


def classify(rows: DataFrame, rules: Sequence[Rule], subject: str, fallback: tuple[str, int] = ("other", -1), tiers: Sequence[int] | None = None) -> DataFrame:
    """rows with columns pattern and tier of the first rule that matches, as one CASE expression.

    A rule of an unknown tier is refused. A null subject matches no regular
    expression and takes the fallback.
    """
    if tiers is not None and (unknown := sorted({r.tier for r in rules} - set(tiers))):
        raise ValueError(f"unknown tiers {unknown}")
    pattern = tier = None
    for r in rules:
        test = F.col(subject).rlike(r.when) if isinstance(r.when, str) else r.when(F.col(subject))
        pattern = F.when(test, r.name) if pattern is None else pattern.when(test, r.name)
        tier = F.when(test, r.tier) if tier is None else tier.when(test, r.tier)
    if pattern is None:
        return rows.withColumns({"pattern": F.lit(fallback[0]), "tier": F.lit(fallback[1])})
    return rows.withColumns({"pattern": pattern.otherwise(fallback[0]), "tier": tier.otherwise(fallback[1])})


def coverage(classified: DataFrame, fallback: str = "other") -> DataFrame:
    """(pattern, n, pct, classified_pct): rows by pattern and the share that some rule names, to one decimal."""
    counts = classified.groupBy("pattern").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("pattern") != fallback, F.col("n")).otherwise(0)).alias("named"))
    joined = counts.crossJoin(F.broadcast(total))  # one row of totals
    return joined.select("pattern", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"), F.round(100.0 * F.col("named") / F.col("total"), 1).alias("classified_pct"))


def absent(rows: DataFrame, column: str, configured: Sequence[str]) -> DataFrame:
    """The configured names that no row has."""
    wanted = rows.sparkSession.createDataFrame([(x,) for x in configured], f"{column} string")
    return wanted.join(rows.select(column).distinct(), column, "left_anti")


def suffix_hint(unclassified: DataFrame, subject: str) -> DataFrame:
    """(suffix, n) of what no rule named, by the last dotted part of the name."""
    return unclassified.groupBy(F.regexp_extract(F.col(subject), "(\\.[^./]+)$", 1).alias("suffix")).agg(F.count("*").alias("n"))


def dominant(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n): the most frequent value of each group, the smallest of equals."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("__rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))).where("__rank = 1").drop("__rank")
