"""A bounded sample of labelled rows for the classifiers' training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, columns: list[str], rows: int, train_only: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' doc_id, text and `keep` of at most `rows` labelled doc_ids, with the label columns as y_<name>.

    The doc_ids are those of the smallest hashes, so the sample does not depend
    on order or partitioning. train_only leaves out doc_ids whose crc32 (as
    text) is divisible by 5. Labels that are null or other than 0 and 1 and null
    doc_ids are not used; of several labels of a doc_id the largest counts, and
    of several texts that of the smallest hash, so a doc_id that repeats is one
    row.
    """
    named = [F.col(c).cast("int").alias(f"y_{c}") for c in columns]
    ok = F.col("doc_id").isNotNull()
    for c in columns:
        ok = ok & F.col(f"y_{c}").isin(0, 1)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *named).where(ok)
    if train_only:
        chosen = chosen.where(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(*[F.max(f"y_{c}").alias(f"y_{c}") for c in columns]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    found = text.join(F.broadcast(chosen), "doc_id")  # `rows` rows of a few integers
    names = [f"y_{c}" for c in columns]
    one = F.min_by(F.struct("text", *keep), F.struct(F.xxhash64("text"), *keep)).alias("one")
    return found.groupBy("doc_id", *names).agg(one).select("doc_id", "one.text", *[f"one.{c}" for c in keep], *names)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0
