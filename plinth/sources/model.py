"""Model tables kept as Parquet, and the baseline as one small JSON file."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(tables: Mapping[str, DataFrame], folder: str, snapshot: str, side: str = "be") -> None:
    """Write each table below folder, partitioned by snapshot and side; other snapshots stay as they are."""
    for name, rows in tables.items():
        rows.withColumns({"snapshot_id": F.lit(snapshot), "side": F.lit(side)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id", "side").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names: Iterable[str], snapshot: str | None = None, side: str | None = None) -> dict[str, DataFrame]:
    """The tables, of one snapshot and side where these are named; only their partitions are read."""
    out = {}
    for name in names:
        rows = spark.read.schema(_with_keys(spark, f"{folder}/{name}")).parquet(f"{folder}/{name}")
        rows = rows if snapshot is None else rows.where(F.col("snapshot_id") == snapshot)
        out[name] = rows if side is None else rows.where(F.col("side") == side)
    return out


def _with_keys(spark: SparkSession, path: str):
    """The table's schema with text keys: snapshot names of digits alone are no numbers."""
    from pyspark.sql.types import StringType

    schema = spark.read.parquet(path).schema
    for key in ("snapshot_id", "side"):
        schema[key].dataType = StringType()
    return schema


def write_baseline(current: DataFrame, path: str, previous: DataFrame | None = None) -> None:
    """Write findings (fingerprint, rule, src, dst) as JSON lines, with the notes that previous has for them."""
    rows = current.select("fingerprint", "rule", "src", "dst")
    if previous is not None:
        rows = rows.join(previous.select("fingerprint", "note").dropDuplicates(["fingerprint"]), "fingerprint", "left")
    rows.write.mode("overwrite").json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("fingerprint string, rule string, src string, dst string, note string").json(path)
