"""Exact quantiles of groups of any size, by counts of values and running sums.

``percentile``, over a window or as an aggregate, holds all values of a group in one task. Here
equal values are counted first, and the values of a group fall into ranges of a 64th of an octave:

1. Counts per range and their running sums tell which ranges hold a wanted position. A group has
   as many rows here as it has ranges, whatever its size.
2. Only the values of these ranges are counted out, each range by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranges per octave. No double has a binary logarithm beyond 1100, so ranges of both signs stay apart.
PER_OCTAVE = 64
_BEYOND = 1100 * PER_OCTAVE


def value_range(v: Column) -> Column:
    """The number of a value's range; it never falls when the value grows. NaN is the largest value."""

    def size(positive: Column) -> Column:
        return F.floor(F.least(F.log2(positive) * F.lit(PER_OCTAVE), F.lit(float(_BEYOND)))) + F.lit(2 * _BEYOND)

    top = F.lit(4 * _BEYOND).cast("long")
    return F.when(F.isnan(v), top).when(v > 0, size(v)).when(v < 0, -size(-v)).otherwise(F.lit(0).cast("long"))


def group_quantiles(df: DataFrame, by: str, value: str, quantiles: Sequence[float]) -> DataFrame:
    """One row per group: ``group, values, total, cuts``.

    ``cuts`` are the quantiles in the order asked for, between two values in proportion, as
    ``percentile`` has them. Null values do not count; a group without a value has no row. Rows
    without a group are left out.
    """
    counted = (
        df.select(F.col(by).alias("group"), F.col(value).cast("double").alias("v"))
        .where("group IS NOT NULL AND v IS NOT NULL")
        .groupBy("group", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("range", value_range(F.col("v")))
    )
    ranges = counted.groupBy("group", "range").agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("sum"))
    group = Window.partitionBy("group")
    placed = ranges.select(
        "group",
        "range",
        (F.sum("n").over(group.orderBy("range")) - F.col("n")).alias("before"),
        F.col("n").alias("inside"),
        F.sum("n").over(group).alias("values"),
        F.sum("sum").over(group).alias("total"),
    )
    positions = [F.lit(float(q)) * (F.col("values") - 1) for q in quantiles]
    ends = [edge(p).cast("long") for p in positions for edge in (F.floor, F.ceil)]

    def holds(first: Column, n: Column, position: Column) -> Column:
        return (position >= first) & (position < first + n)

    any_wanted = F.lit(False)
    for p in ends:
        any_wanted = any_wanted | holds(F.col("before"), F.col("inside"), p)
    wanted = placed.where(any_wanted).drop("inside")
    # A few ranges per group find their values; both sides are dealt by group and range.
    inside = counted.join(wanted.hint("shuffle_hash"), ["group", "range"])
    running = Window.partitionBy("group", "range").orderBy("v")
    first = inside.withColumn("first", F.col("before") + F.sum("n").over(running) - F.col("n"))
    found = first.groupBy("group").agg(
        F.max("values").alias("values"),
        F.max("total").alias("total"),
        *[F.max(F.when(holds(F.col("first"), F.col("n"), p), F.col("v"))).alias(f"v{i}") for i, p in enumerate(ends)],
    )

    def between(i: int, p: Column) -> Column:
        low, high = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        mixed = (F.ceil(p) - p) * low + (p - F.floor(p)) * high
        return F.when(low == high, low).otherwise(mixed)

    cuts = F.array(*[between(i, p) for i, p in enumerate(positions)])
    return found.select("group", "values", "total", cuts.alias("cuts"))
