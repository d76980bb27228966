"""Model tables found by the signature of what they were made from, so that an unchanged side is not read again."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from plinth.sources import model
from plinth.sources.git import git

#: The table of published snapshots, beside the model's tables.
POINTERS, POINTER = "_published", "side string, signature string, number bigint"


def tree_signature(spark: SparkSession, root: str, extensions: Sequence[str] = ("ts", "tsx")) -> str:
    """A digest of every file's path, length and time of change below root; no file is opened.

    Counts and sums are order-free and partly computed where the listing is.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    one = F.sha2(F.concat_ws("\n", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256)
    part = lambda i: F.sum(F.conv(F.substring(one, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return files.agg(F.sha2(F.concat_ws(" ", F.count("*").cast("string"), *[F.coalesce(part(i), F.lit("")) for i in range(4)]), 256).alias("s")).first().s


def commit_signature(repo: str, ref: str = "HEAD") -> str:
    """The name that git gives the content of a commit's tree: equal for equal trees, whatever their history."""
    return git(repo, "rev-parse", f"{ref}^{{tree}}").decode().strip()


def _pointers(spark: SparkSession, folder: str, side: str) -> list[Row]:
    """The side's publications, newest first: a row for each time its content changed."""
    try:
        return spark.read.schema(POINTER).json(f"{folder}/{POINTERS}").where(F.col("side") == side).orderBy(F.desc("number")).collect()
    except AnalysisException:
        return []


def current(spark: SparkSession, folder: str, side: str = "be") -> str | None:
    """The signature of the side's published snapshot."""
    return next((r.signature for r in _pointers(spark, folder, side)), None)


def keep(spark: SparkSession, folder: str, signature: str, build: Callable[[], Mapping[str, DataFrame]], side: str = "be") -> bool:
    """Publish the snapshot of signature; whether it had to be built.

    build makes the tables. A snapshot is published by one row in one file,
    appended after all its tables are whole, so readers see the one before or
    this one; a build that was cut off is no snapshot and is written over by the
    next. A side has one writer at a time. Content that was published before is
    pointed to again, without a build.
    """
    known = _pointers(spark, folder, side)
    fresh = signature not in {r.signature for r in known}
    if fresh:
        model.save(build(), folder, signature, side)
    if not known or known[0].signature != signature:
        spark.createDataFrame([(side, signature, known[0].number + 1 if known else 1)], POINTER).coalesce(1).write.mode("append").json(f"{folder}/{POINTERS}")
    return fresh


def tables(spark: SparkSession, folder: str, names: Sequence[str], side: str = "be") -> dict[str, DataFrame]:
    """The published tables of the side; only their partitions are read."""
    signature = current(spark, folder, side)
    if signature is None:
        raise ValueError(f"nothing is published for side {side!r} in {folder}")
    return model.load(spark, folder, names, signature, side)
