"""Keeping an index current from a stream of file versions, and event windows as an extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILE_VERSION = "path string, content_hash string, mtime_ns long, text string, deleted boolean"


def newest(versions: DataFrame) -> DataFrame:
    """The last version of each path in a batch."""
    return versions.groupBy("path").agg(F.max_by(F.struct(*[c for c in versions.columns if c != "path"]), F.struct("mtime_ns", "content_hash")).alias("v")).select("path", "v.*")


def sync_stream(spark: SparkSession, folder: str, checkpoint: str, apply: Callable[[DataFrame, int], None], once: bool = True, files_per_trigger: int = 1000) -> StreamingQuery:
    """Hands each micro-batch's newest file versions to `apply`, which writes them to the index; replays after a failure
    give the same batch under the same number, so `apply` must be idempotent by it."""
    stream = spark.readStream.schema(FILE_VERSION).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    out = stream.writeStream.foreachBatch(lambda batch, no: apply(newest(batch), no)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of events (ts, event_type) by tumbling window; events later than the watermark are left out. An extension."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
