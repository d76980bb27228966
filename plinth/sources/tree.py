"""Source trees as rows (path, text)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, text string"


def read_tree(spark: SparkSession, root: str, extensions: Sequence[str] = ("ts", "tsx"), ignore: Sequence[str] = ()) -> DataFrame:
    """Files below root with one of the extensions, paths relative to it.

    ignore holds regular expressions for the relative path. Spark lists and
    reads the files, so root may be in any store it can open.
    """
    glob = "*.{" + ",".join(extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = raw.select(_relative(root).alias("path"), F.decode("content", "UTF-8").alias("text"))
    for pattern in ignore:
        rows = rows.where(~F.col("path").rlike(pattern))
    return rows


def _relative(root: str):
    """The file's path after the root's own, whatever scheme and authority stand before both."""
    bare = "/" + root.split("://")[-1].strip("/")
    return F.regexp_replace("path", f"^.*?\\Q{bare}\\E/+", "")


def from_mapping(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    return spark.createDataFrame(list(files.items()), SCHEMA)
