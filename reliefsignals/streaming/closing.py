"""Hours that close: event-time state with timers, and late rows beside the result.

An hour and place is kept in state until the stream has seen a message ``delay`` later than the
hour's end. A timer then emits its sums once and frees the state. What comes later still is
emitted at once as a ``late`` row, with its own sums, and never dropped: closed and late rows
together are all messages.

Spark drops rows behind the watermark before an operator sees them. The event time is therefore
carried ``HOLD`` in the future and the watermark follows it by ``HOLD``, so the watermark is the
latest time seen. For this, times are held between ``FIRST`` and ``LAST``, which lie no further than
``HOLD`` apart: no row is ever behind the watermark. Hours after ``LAST`` count, but stay open.

Keys are hour, place and one of ``parts`` (by a hash of the message), so a hot hour or place is
spread over tasks; sums of parts are added by the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reliefsignals.functions.clock import hour_start, hour_text
from reliefsignals.operators.geocode import LEVELS

FIRST, LAST, HOLD = "1950-01-01", "2100-01-01", "54788 days"
HOUR = 3_600_000
PARTS = 4
SUMS = ("n_rows", "n_need_rows", "urgency")
_SUM_TYPES = "n_rows bigint, n_need_rows bigint, urgency double"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _processor(delay: int, names: list[str]):
    """The state of one key; made inside a function, so it reaches the workers by value."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    hour, state = HOUR, _SUM_TYPES

    def added(a, b):
        return b if a is None else a if b is None else a + b

    class Closing(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.sums = handle.getValueState("sums", state)

        def _row(self, key, kind, sums):
            cells = [*key, kind, *sums]
            frame = pd.DataFrame({n: [c] for n, c in zip(names, cells)})
            # A missing sum stays missing, and a missing place stays null.
            return frame.astype({"urgency": "float64"})

        def handleInputRows(self, key, rows, timerValues):
            sums = (0, 0, None)
            for frame in rows:
                values = frame["urgency"].dropna()
                urgency = float(values.sum()) if len(values) else None
                sums = (sums[0] + len(frame), sums[1] + int(frame["need"].sum()), added(sums[2], urgency))
            closes = int(key[0]) + hour + delay
            if closes <= timerValues.getCurrentWatermarkInMs():
                yield self._row(key, "late", sums)
                return
            if self.sums.exists():
                old = self.sums.get()
                sums = (old[0] + sums[0], old[1] + sums[1], added(old[2], sums[2]))
            else:
                self.handle.registerTimer(closes)
            self.sums.update(sums)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            sums = self.sums.get()
            self.sums.clear()
            yield self._row(key, "closed", sums)

        def close(self):
            pass

    return Closing()


def closing_hours(messages: DataFrame, level: str = "province", *, delay_hours: float = 2, parts: int = PARTS) -> DataFrame:
    """A stream of ``opens`` (ms), places, ``part``, ``kind`` (closed, late) and sums.

    ``messages`` is a prepared stream; messages without a time have no hour and are left out.
    """
    places = list(LEVELS[level])
    at = F.col("created_at_local").cast("timestamp")
    first, last = F.lit(FIRST).cast("timestamp"), F.lit(LAST).cast("timestamp")
    timed = messages.where(F.col("created_at_local").isNotNull()).select(
        F.unix_millis(hour_start(F.col("created_at_local")).cast("timestamp")).alias("opens"),
        *places,
        F.pmod(F.xxhash64("created_at_local", "urgency_score"), F.lit(parts)).cast("int").alias("part"),
        F.coalesce((F.col("pred_any_need") == 1).cast("long"), F.lit(0).cast("long")).alias("need"),
        F.col("urgency_score").cast("double").alias("urgency"),
        (F.greatest(F.least(at, last), first) + F.expr(f"INTERVAL {HOLD}")).alias("held"),
    )
    keys = ["opens", *places, "part"]
    types = ["bigint", *["string"] * len(places), "int"]
    schema = ", ".join([*[f"{k} {t}" for k, t in zip(keys, types)], "kind string", _SUM_TYPES])
    grouped = timed.withWatermark("held", HOLD).groupBy(*keys)
    made = _processor(int(delay_hours * HOUR), [*keys, "kind", *SUMS])
    return grouped.transformWithStateInPandas(made, schema, "Append", "EventTime")


def close_hours(messages: DataFrame, folder: str, level: str = "province", *, delay_hours: float = 2, parts: int = PARTS) -> StreamingQuery:
    """Add all input available now: closed hours and late rows to ``folder/rows``, open hours to the state."""
    spark = messages.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # the state of timers needs this store; a query keeps its own copy
    try:
        stream = closing_hours(messages, level, delay_hours=delay_hours, parts=parts)
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
        return writer.trigger(availableNow=True).start(f"{folder}/rows")
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def open_hours(spark: SparkSession, folder: str, level: str = "province") -> DataFrame:
    """Sums of the hours that have not closed yet, read from the state of the last finished batch."""
    state = spark.read.format("statestore").option("stateVarName", "sums").load(f"{folder}/state")
    keys = ["opens", *LEVELS[level], "part"]
    return state.select(*[f"key.{k}" for k in keys], F.lit("open").alias("kind"), *[f"value.{c}" for c in SUMS])


def hours_so_far(spark: SparkSession, folder: str, level: str = "province") -> DataFrame:
    """All hours: sums of everything seen, how many rows came late, and whether the hour is still open."""
    rows = spark.read.parquet(f"{folder}/rows").unionByName(open_hours(spark, folder, level))
    opens = F.timestamp_millis("opens").cast("timestamp_ntz")
    summed = rows.groupBy("opens", *LEVELS[level]).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.sum(F.when(F.col("kind") == "late", F.col("n_rows")).otherwise(0)).alias("late_rows"),
        F.bool_or(F.col("kind") == "open").alias("open"),
    )
    return summed.select(hour_text(opens).alias("hour"), *LEVELS[level], *SUMS, "late_rows", "open")
