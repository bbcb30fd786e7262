"""Ranked hotspots kept up to date: each micro-batch ranks again the hours it changed, no others.

Below the folder, each micro-batch writes under its number: ``sums`` per hour and place,
``changed`` hours, and ``ranked`` hotspots of these. A replayed batch overwrites its own folders
with the same rows. The current ranking of an hour is the one of the last batch that changed it.

``compact`` writes the current rows of all batches up to a number once, ordered by hour; readers use
it as soon as it is whole and skip the batches in it. ``drop_compacted`` deletes these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reliefsignals.operators.geocode import LEVELS, GeoIndex, geocode
from reliefsignals.operators.hotspots import checked_level, checked_mode, rank_points, signal_of
from reliefsignals.streaming.hourly import SUMS, hourly_sums

TABLES = ("sums", "ranked", "changed")
COMPACT_EVERY = 50


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    path, files = _path(spark, folder)
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def compacted_to(spark: SparkSession, folder: str) -> int:
    """The last batch that is in a whole compaction, or -1."""
    for n in reversed(_numbers(spark, f"{folder}/compacted", "upto=")):
        path, files = _path(spark, f"{folder}/compacted/upto={n}/changed/_SUCCESS")
        if files.exists(path):
            return n
    return -1


def _rows(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of a table with their batch: the compaction and the batches after it."""
    upto = compacted_to(spark, folder)
    later = [f"{folder}/{name}/batch={n}" for n in _numbers(spark, f"{folder}/{name}", "batch=") if n > upto]
    parts = [spark.read.option("basePath", f"{folder}/{name}").parquet(*later)] if later else []
    if upto >= 0:
        parts.append(spark.read.parquet(f"{folder}/compacted/upto={upto}/{name}"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def current_sums(spark: SparkSession, folder: str, level: str) -> DataFrame:
    return _rows(spark, folder, "sums").groupBy("hour", *LEVELS[level]).agg(*[F.sum(c).alias(c) for c in SUMS])


def current_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The ranking of every hour, as ``hotspots_timeline`` gives it for all messages so far."""
    last = _rows(spark, folder, "changed").groupBy("hour").agg(F.max("batch").alias("batch"))
    return _rows(spark, folder, "ranked").join(last, ["hour", "batch"]).drop("batch")


def compact(spark: SparkSession, folder: str, upto: int, level: str) -> None:
    """Write what batches up to ``upto`` add up to; ``changed`` last, its marker makes it count."""
    last = _rows(spark, folder, "changed").groupBy("hour").agg(F.max("batch").alias("batch"))
    made = {
        "sums": current_sums(spark, folder, level).withColumn("batch", F.lit(upto)),
        "ranked": _rows(spark, folder, "ranked").join(last, ["hour", "batch"]),
        "changed": last,
    }
    for name in TABLES:
        ordered = made[name].repartitionByRange("hour").sortWithinPartitions("hour")
        ordered.write.mode("overwrite").parquet(f"{folder}/compacted/upto={upto}/{name}")


def drop_compacted(spark: SparkSession, folder: str) -> None:
    """Delete batches and compactions that the newest compaction replaces; no reader may still use them."""
    upto = compacted_to(spark, folder)
    old = [f"{folder}/{t}/batch={n}" for t in TABLES for n in _numbers(spark, f"{folder}/{t}", "batch=") if n <= upto]
    old += [f"{folder}/compacted/upto={n}" for n in _numbers(spark, f"{folder}/compacted", "upto=") if n < upto]
    for name in old:
        path, files = _path(spark, name)
        files.delete(path, True)


def rank_hourly(
    messages: DataFrame,
    folder: str,
    index: GeoIndex,
    level: str = "province",
    mode: str = "count_any_need",
    *,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Add all input available now and rank the hours it changes."""
    level, mode = checked_level(level), checked_mode(mode)
    keys = LEVELS[level]

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def put(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
            return spark.read.parquet(f"{folder}/{name}/batch={number}")

        sums = put(hourly_sums(batch, level).sortWithinPartitions("hour"), "sums")
        changed = put(sums.select("hour").distinct(), "changed")
        first, last = changed.agg(F.min("hour"), F.max("hour")).first()
        # The bounds reach the scan, where files ordered by hour are skipped by their statistics.
        near = _rows(spark, folder, "sums").where(F.col("hour").between(F.lit(first), F.lit(last)))
        whole = near.join(changed, "hour", "left_semi").groupBy("hour", *keys).agg(*[F.sum(c).alias(c) for c in SUMS])
        signal, counts = signal_of(mode)
        places = whole.where(counts).select("hour", *keys, signal.alias("signal"))
        put(rank_points(geocode(places, level, index)), "ranked")
        if (number + 1) % compact_every == 0:
            compact(spark, folder, number, level)

    writer = messages.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/state")
    return writer.trigger(availableNow=True).start()
