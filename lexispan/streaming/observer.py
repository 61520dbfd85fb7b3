"""Observers and streaming ingest (an extension: the batch engine needs neither).

An observer is told of every file that was read. On a stream of files, each micro-batch is one incremental reindex.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Observer = Callable[[DataFrame], None]


def notify(files: DataFrame, observers: Sequence[Observer] | None) -> None:
    """Gives every observer the files that were read; an observer that fails is passed over, as the index doesn't depend on it."""
    for tell in observers or ():
        try:
            tell(files)
        except Exception:  # noqa: BLE001
            continue


def watched(spark: SparkSession, folder: str, schema: str, most_files: int = 100) -> DataFrame:
    """Stream of Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def ingest(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs apply on every micro-batch; once: what is there now, then stop."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def feed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events of each type in each window; events later than the watermark don't count in a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n")
