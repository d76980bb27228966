"""Renamed files by their content: a similarity join of removed and added files over their lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators.graph import settled


def _lines(files: DataFrame) -> DataFrame:
    """(path, token, size): each line of a file with the number of equal ones before it, so that a file's tokens are a set."""
    rows = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).where(F.trim("line") != "")
    nth = F.row_number().over(Window.partitionBy("path", "line").orderBy("at"))
    rows = rows.select("path", F.concat_ws("#", nth.cast("string"), F.sha2(F.rtrim("line"), 256)).alias("token")).distinct()
    return rows.join(rows.groupBy("path").agg(F.count("*").alias("size")), "path")


def _asked(tokens: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """The rarest tokens of each file, as many as two similar files cannot both do without a common one.

    Of n tokens, a file of similarity s shares s / (2 - s) * n or more.
    """
    rank = F.row_number().over(Window.partitionBy("path").orderBy("n", "token"))
    needed = F.ceil(F.col("size") * F.lit(least / (2 - least)) - 1e-9)
    return tokens.join(frequency, "token").withColumn("__rank", rank).where(F.col("__rank") <= F.col("size") - needed + 1).select("path", "token", "size")


def similar(removed: DataFrame, added: DataFrame, least: float = 0.5) -> DataFrame:
    """(old, new, similarity) of files (path, text) that share lines: twice the common ones by all of both, at least `least`.

    Blank lines and trailing blanks do not count. Candidates share one of their
    rarest lines, so common lines such as a closing brace pair nothing; which
    ones are rare is counted over both sides, so no similar pair is missed.
    """
    a, b = settled(_lines(removed)), settled(_lines(added))
    frequency = a.select("token").union(b.select("token")).groupBy("token").agg(F.count("*").alias("n"))
    left, right = (_asked(x, frequency, least).select(F.col("path").alias(k), "token", F.col("size").alias(f"{k}_size")) for x, k in ((a, "old"), (b, "new")))
    near = F.least("old_size", "new_size") * 2 >= F.lit(least) * (F.col("old_size") + F.col("new_size"))
    pairs = left.join(right, "token").where(near).select("old", "new", "old_size", "new_size").distinct()
    held = pairs.join(a.select(F.col("path").alias("old"), "token"), "old").join(b.select(F.col("path").alias("new"), "token"), ["new", "token"])
    score = 2 * F.count("*") / (F.first("old_size") + F.first("new_size"))
    return held.groupBy("old", "new").agg(score.alias("similarity")).where(F.col("similarity") >= least)


def renames(removed: DataFrame, added: DataFrame, least: float = 0.5) -> DataFrame:
    """(old, new, similarity): similar() pairs of which each file is in one, the most similar first, then by names.

    In a round every pair that is the best of both its files is taken, which
    gives what taking the best pair again and again would. Files without a line
    are in none.
    """
    left, taken = settled(similar(removed, added, least)), []
    order = (F.desc("similarity"), F.asc("old"), F.asc("new"))
    first: Column = F.row_number()
    while not left.isEmpty():
        ranked = left.withColumns({f"__{k}": first.over(Window.partitionBy(k).orderBy(*order)) for k in ("old", "new")})
        best = settled(ranked.where("__old = 1 and __new = 1").select("old", "new", "similarity"))
        taken.append(best)
        left = settled(left.join(best.select("old"), "old", "left_anti").join(best.select("new"), "new", "left_anti"))
    return reduce(DataFrame.unionByName, taken, left)
