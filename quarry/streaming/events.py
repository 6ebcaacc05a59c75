"""Streams over the event table: live pushes, exactly-once requests, versioned state.

Windowed counts are an addition of this engine; the business semantics have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, in event time."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def push(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch of events to a sender; the batch number lets it drop what it has already sent."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first event of every key; state is dropped when the watermark passes."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event time and type; late events count until the watermark passes."""
    counts = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def latest_state(stream: DataFrame, publish: Callable[[DataFrame], None], checkpoint: str):
    """Versioned state: every batch is reduced to the newest row of each user and handed on for publishing."""

    def run(batch: DataFrame, _: int) -> None:
        publish(batch.groupBy("user_id").agg(F.max("event_id").alias("version"), F.max_by("event_type", "event_id").alias("state")))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
