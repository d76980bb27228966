"""Rescans that read changed files alone.

One table holds a row for every file: its stamp (length and time of change), the
digest of its content and what was extracted from it. A rescan lists the tree
without content, reads the files whose stamp is new, extracts again from those
whose digest differs, and replaces only the partitions that hold them. What
spans files, such as resolved imports, is joined from the table afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.operators.graph import settled
from plinth.sources.tree import _relative

#: Partitions of the table, and paths that one read names.
BUCKETS, NAMED = 256, 5000


def bucket(path: str) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def held(spark: SparkSession, home: str) -> DataFrame | None:
    """(path, stamp, digest, rows, bucket) of every file, None before the first rescan."""
    try:
        return spark.read.parquet(home).where("path is not null")
    except AnalysisException:
        return None


def extracted(spark: SparkSession, home: str) -> DataFrame:
    """All files' rows, as extract gave them."""
    return held(spark, home).select(F.explode("rows").alias("r")).select("r.*")


def rescan(spark: SparkSession, root: str, home: str, extract: Callable[[DataFrame], DataFrame], by: str, extensions: Sequence[str] = ("ts", "tsx")) -> dict[str, int]:
    """Bring the table at home up to date with the tree below root; how many files were read, changed and removed.

    extract makes rows of files (path, text), each from one file alone, which
    column `by` names. A file whose content is the same under a new stamp is
    read but changes nothing. An interrupted rescan leaves whole partitions, and
    the next one does the rest.
    """
    glob = "*.{" + ",".join(extensions) + "}"
    load = lambda paths: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths)
    stamp = F.concat_ws(" ", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    listed = settled(load(root).select(F.col("path").alias("at"), _relative(root).alias("path"), stamp.alias("stamp")))
    old = held(spark, home)
    before = old.select("path", F.col("stamp").alias("__stamp"), F.col("digest").alias("__digest")) if old else listed.limit(0).select("path", F.col("stamp").alias("__stamp"), F.col("stamp").alias("__digest"))
    new = listed.join(before, "path", "left").where("not (stamp <=> __stamp)")
    names, texts = (r.at for r in new.select("at").toLocalIterator()), []
    while part := list(islice(names, NAMED)):
        texts.append(load(part).select("path", "content"))
    read = 0
    changed = None
    if texts:
        content = reduce(DataFrame.unionByName, texts).select(F.col("path").alias("at"), F.sha2("content", 256).alias("digest"), F.decode("content", "UTF-8").alias("text"))
        seen = settled(content.join(new, "at"))
        read = seen.count()
        changed = seen.where("not (digest <=> __digest)")
    gone = before.join(listed, "path", "left_anti").select("path")
    touched = gone if changed is None else changed.select("path").unionByName(gone)
    touched = settled(touched.withColumn("bucket", bucket("path")))
    counts = {"read": read, "changed": 0 if changed is None else changed.count(), "removed": gone.count()}
    if touched.isEmpty():
        return counts
    made = []
    if changed is not None:
        rows = extract(changed.select("path", "text"))
        grouped = rows.groupBy(F.col(by).alias("path")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))
        made.append(changed.join(grouped, "path", "left").select("path", "stamp", "digest", F.coalesce("rows", F.array().cast(dict(grouped.dtypes)["rows"])).alias("rows")))
    if old is not None:
        near = old.join(F.broadcast(touched.select("bucket").distinct()), "bucket")  # at most BUCKETS rows
        made.append(near.join(touched.select("path"), "path", "left_anti").select("path", "stamp", "digest", "rows"))
        # A partition that loses its last file has to be written too.
        empty = touched.select(F.lit(None).cast("string").alias("path"), F.lit("").alias("stamp"), F.lit("").alias("digest"), "bucket").distinct()
    full = reduce(DataFrame.unionByName, made).withColumn("bucket", bucket("path"))
    full = full if old is None else full.unionByName(empty, allowMissingColumns=True)
    settled(full.repartition("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(home)
    return counts
