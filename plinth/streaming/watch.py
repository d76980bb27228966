"""Debounced change streams: bursts become one event, and a recompute keeps its last good result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def debounced(events: DataFrame, at: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, begun, ended, n): events of a key closer than gap are one burst, which ends gap after its last event.

    Batch and streaming alike; a stream needs `late`, its watermark.
    """
    rows = events.withWatermark(at, late) if late else events
    grouped = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("begun"), F.col("w.end").alias("ended"), "n")


def publish(bursts: DataFrame, recompute: Callable[[DataFrame, int], str], pointer: dict, checkpoint: str) -> DataStreamWriter:
    """A stream writer that recomputes once per micro-batch with rows.

    recompute returns where its result is; pointer["current"] moves only when it
    succeeds, so readers keep the last good result. When it fails, pointer["error"]
    says why and the stream stops: the batch is not committed, and the next run
    recomputes it.
    """

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        try:
            pointer["current"] = recompute(batch, number)
            pointer["version"] = pointer.get("version", 0) + 1
            pointer.pop("error", None)
        except Exception as e:  # the last good result stays
            pointer["error"] = str(e)
            raise

    return bursts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
