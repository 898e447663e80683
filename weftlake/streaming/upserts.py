"""Streams that keep tables up to date: idempotent upserts and counts over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.kvstore import KvStore


def upsert_stream(rows: DataFrame, store: KvStore, table: str) -> DataStreamWriter:
    """A writer that puts the cells of each batch of ``rows (key, cols, at)`` into a table of the store.

    Of several rows of one key in a batch the last by ``at`` counts.  A batch
    that is written again after a failure leaves the table as it was, so a
    stream can go on from where it stopped.
    """

    def write(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("key").agg(F.max_by("cols", "at").alias("cols"))
        store.put(table, last)

    return rows.writeStream.foreachBatch(write)


def counts_over_time(events: DataFrame, time: str, key: str, length: str, late: str) -> DataFrame:
    """``start, key, n``: events per key and window of time; events later than ``late`` are left out."""
    windows = events.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count(F.lit(1)).alias("n"))
    return windows.select(F.col("window.start").alias("start"), key, "n")
