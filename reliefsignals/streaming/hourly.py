"""Hourly signals per place as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from reliefsignals.functions.clock import hour_start, hour_text
from reliefsignals.operators.geocode import LEVELS


#: Files that one micro-batch reads at most.
FILES_PER_TRIGGER = 64
SUMS = ("n_rows", "n_need_rows", "urgency")


def open_stream(
    spark: SparkSession, path: str, schema: StructType, *, files_per_trigger: int = FILES_PER_TRIGGER
) -> DataFrame:
    """Follow a folder, or a path pattern, of Parquet messages, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _sums(grouped: GroupedData) -> DataFrame:
    return grouped.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum((F.col("pred_any_need") == 1).cast("long")).alias("n_need_rows"),
        F.sum("urgency_score").alias("urgency"),
    )


def hourly_sums(messages: DataFrame, level: str) -> DataFrame:
    """Sums per hour and place of a batch frame; messages without a time are in no hour."""
    timed = messages.where(F.col("created_at_local").isNotNull())
    return _sums(timed.withColumn("hour", hour_text(hour_start(F.col("created_at_local")))).groupBy("hour", *LEVELS[level]))


def hourly_signals(messages: DataFrame, level: str = "province", *, delay: str = "2 hours") -> DataFrame:
    """Row, need and urgency sums per wall-clock hour and place.

    ``messages`` is prepared; it may be a stream or a batch frame.  On a stream, hours
    stay open until ``delay`` after their end, then leave the state, and Spark drops later
    messages for them: use it for live views only.  ``sum_hourly`` keeps all of them.
    """
    keys: Sequence[str] = LEVELS[level]
    timed = messages.where(F.col("created_at_local").isNotNull()).withColumn(
        "at", F.col("created_at_local").cast("timestamp")
    )
    sums = _sums(timed.withWatermark("at", delay).groupBy(F.window("at", "1 hour"), *keys))
    return sums.select(
        hour_text(F.col("window.start")).alias("hour"), *keys, "n_rows", "n_need_rows", "urgency"
    )


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write all input available now to Parquet, exactly once, and stop."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


def sum_hourly(messages: DataFrame, folder: str, level: str = "province") -> StreamingQuery:
    """Add all input available now to the sums in ``folder``; nothing is late.

    Each micro-batch writes its own sums per hour and place under its number, replacing
    what an interrupted attempt may have left, so every message counts once.  Messages may
    come in any order and at any time: there is no state between batches and no watermark.
    """

    def add(batch: DataFrame, number: int) -> None:
        hourly_sums(batch, level).write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")

    writer = messages.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state")
    return writer.trigger(availableNow=True).start()


def summed_hourly(spark: SparkSession, folder: str, level: str = "province") -> DataFrame:
    """Hourly signals over everything ``sum_hourly`` has added so far."""
    keys = ("hour", *LEVELS[level])
    sums = spark.read.parquet(f"{folder}/sums")
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def replay_hourly_signals(messages: DataFrame, folder: str, level: str = "province") -> DataFrame:
    """Run a bounded stream to its end and read the result, whatever the order of its files."""
    sum_hourly(messages, folder, level).awaitTermination()
    return summed_hourly(messages.sparkSession, folder, level)
