"""Hotspots: signal per hour and place, located, ranked and graded.

Messages are reduced to one row per hour and place (``cells``) before anything else;
joins, windows and rankings work on these.  A hot hour or place therefore costs one
row per place after map-side aggregation, however many messages it has.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefsignals import fixed_values as fv
from reliefsignals.functions.clock import hour_text
from reliefsignals.functions.places import PLACE_COLUMNS, location_label
from reliefsignals.functions.text import collapse_whitespace
from reliefsignals.operators.aggregates import Source, hour_preference
from reliefsignals.operators.filters import Filters, apply_filters, during
from reliefsignals.operators.geocode import LEVELS, GeoIndex, geocode
from reliefsignals.operators.measures import Measures, answered_by_sums, compact, measure
from reliefsignals.operators.quantiles import group_quantiles
from reliefsignals.schema import Dataset

MODES = ("count_rows", "count_any_need", "sum_urgency")
DEFAULT_LEVEL = "province"
DEFAULT_MODE = "count_any_need"


def checked_level(level: str) -> str:
    return level if level in LEVELS else DEFAULT_LEVEL


def checked_mode(mode: str) -> str:
    return mode if mode in MODES else DEFAULT_MODE


def signal_of(mode: str) -> tuple[Column, Column]:
    """Of a row of sums: its signal, and whether it belongs to the mode's result."""
    signal = {"count_rows": "n_rows", "count_any_need": "n_need_rows", "sum_urgency": "urgency"}[mode]
    return F.col(signal).cast("double"), F.col("n_need_rows") > 0 if mode == "count_any_need" else F.lit(True)


def cells(source: Source, filters: Filters | None, keys: Sequence[str], mode: str) -> DataFrame:
    """One row per hour and place: ``n_rows, n_need_rows, signal, counts``.

    ``counts`` tells whether the place belongs to the mode's result at all; the others
    are kept because the choice of an hour looks at all messages.
    """
    m = measure(source, filters)
    timed = Measures(m.matched.where(F.col("hour").isNotNull()), m.dataset, m.whole)
    sums = compact(timed, ["hour", *keys]).frame
    if set(keys) - set(sums.columns):
        absent = {k: F.lit("") for k in set(keys) - set(sums.columns)}
        sums = sums.withColumns(absent).where(F.lit(False))
    signal, counts = signal_of(mode)
    table = sums.select(
        "hour",
        *keys,
        "n_rows",
        "n_need_rows",
        signal.alias("signal"),
        counts.alias("counts"),
    )
    # True for every row.  It keeps all sums in use wherever the table is read, so that
    # both readers in a plan (hour choice and points) share one aggregation.
    return table.where("n_rows > 0 AND n_need_rows >= 0 AND signal IS NOT NULL")


def signals(
    source: Source,
    filters: Filters | None = None,
    level: str = DEFAULT_LEVEL,
    mode: str = DEFAULT_MODE,
) -> DataFrame:
    """Signal per hour and place, before any coordinates."""
    keys = LEVELS[checked_level(level)]
    table = cells(source, filters, keys, checked_mode(mode)).where("counts")
    return table.select(hour_text(F.col("hour")).alias("hour"), *keys, "signal")


def all_levels(source: Source, filters: Filters | None = None, mode: str = DEFAULT_MODE) -> DataFrame:
    """Signals of every hour at all three levels.

    Messages are summed once at the finest level; the coarser sums come from those rows.
    """
    p, d, n = PLACE_COLUMNS
    fine = cells(source, filters, PLACE_COLUMNS, checked_mode(mode)).where("counts")
    sets = [["hour", p], ["hour", p, d], ["hour", p, d, n]]
    rolled = fine.groupingSets(sets, "hour", p, d, n).agg(
        F.grouping_id().alias("gid"), F.sum("signal").alias("signal")
    )
    level = F.when(F.col("gid") == 3, "province").when(F.col("gid") == 1, "district").otherwise("neighborhood")
    return rolled.select(
        hour_text(F.col("hour")).alias("hour"),
        level.alias("level"),
        p,
        F.when(F.col("gid") < 3, F.col(d)).otherwise(F.lit("")).alias(d),
        F.when(F.col("gid") < 1, F.col(n)).otherwise(F.lit("")).alias(n),
        "signal",
    )


def pick_hour(table: DataFrame, hour: str | None, default: str = "busiest") -> DataFrame:
    """Rows of one hour: the requested if it exists, else the default one.

    The choice is part of the plan: per-hour sums of the same cells give one row, which
    is broadcast.
    """
    per_hour = table.groupBy("hour").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_need_rows").alias("n_need_rows")
    )
    best = per_hour.agg(F.max_by("hour", hour_preference(hour, default)).alias("hour"))
    return table.join(F.broadcast(best), "hour")


def _shown() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("signal") > 0)


def severity(signal: Column, cuts: Column) -> Column:
    """Grade of a signal against the quantiles in ``cuts`` (highest first)."""
    grade = None
    for i, (_, name) in enumerate(fv.SEVERITY_CUTS):
        above = signal >= cuts[i]
        grade = F.when(above, F.lit(name)) if grade is None else grade.when(above, F.lit(name))
    return grade.otherwise(F.lit(fv.SEVERITY_REST))


def rank_points(
    located: DataFrame, by: str = "hour", *, skip_empty: bool = True, large_groups: bool = False
) -> DataFrame:
    """Rank, share and severity of located places within each ``by`` group.

    A group has one row per place.  Ties rank by name, then by coordinate.  The places of an
    hour are one window group.  With ``large_groups`` totals and quantiles come from counts of
    signals (``group_quantiles``), so that no task holds a group, and ranks are numbered along
    a sort, which spills: the same rows, by more and smaller steps.  Rows without a group are
    left out then.
    """
    keys = [c for c in PLACE_COLUMNS if c in located.columns]
    points = located.where(_shown())
    group = Window.partitionBy(by)
    ranked = points.withColumn("rank", F.row_number().over(group.orderBy(F.desc("signal"), *keys, "lat", "lon")))
    quantiles = [q for q, _ in fv.SEVERITY_CUTS]
    if large_groups:
        # One row per group, dealt by it as the numbered points are.
        stats = group_quantiles(points, by, "signal", quantiles).withColumnRenamed("group", by)
        graded = ranked.join(stats.hint("shuffle_hash"), by)
    else:
        cuts = F.percentile("signal", F.array(*[F.lit(q) for q in quantiles]))
        graded = ranked.withColumn("total", F.sum("signal").over(group)).withColumn("cuts", cuts.over(group))
    names = {c: collapse_whitespace(F.col(c)) if c in keys else F.lit("") for c in PLACE_COLUMNS}
    label = location_label([F.col(k) for k in keys], skip_empty=skip_empty)
    return graded.select(
        by,
        "rank",
        label.alias("location"),
        *[v.alias(k) for k, v in names.items()],
        "lat",
        "lon",
        "level_used",
        "signal",
        (F.col("signal") / F.col("total") * F.lit(100.0)).alias("share_pct"),
        severity(F.col("signal"), F.col("cuts")).alias("severity"),
    )


def _is_hour(text: str) -> bool:
    """Whether the text names an hour just as results do."""
    try:
        return dt.datetime.fromisoformat(text).strftime("%Y-%m-%dT%H:00:00") == text
    except ValueError:
        return False


def hour_cells(
    source: Source, filters: Filters | None, keys: Sequence[str], mode: str, hour: str | None = None, default: str = "busiest"
) -> DataFrame:
    """Cells of one hour: the requested if it exists, else the default one.

    A requested hour of messages is looked for first, in its own range of time alone and
    up to the first match.  If there is one, only that range is read; every hour is summed
    only where none was requested or the requested one has no message.  Stored sums, where they
    answer, are small enough to be read at once.
    """
    by_range = isinstance(source, Dataset) and not answered_by_sums(source, filters)
    if hour is not None and by_range and "created_at_local" in source.frame.columns:
        one = during(source, hour) if _is_hour(hour) else None
        if one is not None and not apply_filters(one.frame, one.schema, filters).isEmpty():
            return cells(one, filters, keys, mode)
    return pick_hour(cells(source, filters, keys, mode), hour, default)


def _located(
    source: Source, index: GeoIndex, filters: Filters | None, hour: str | None, level: str, mode: str, default: str
) -> DataFrame:
    level, mode = checked_level(level), checked_mode(mode)
    table = hour_cells(source, filters, LEVELS[level], mode, hour, default).where("counts")
    return geocode(table.select("hour", *LEVELS[level], "signal"), level, index)


def _with_hour_text(df: DataFrame) -> DataFrame:
    return df.withColumn("hour", hour_text(F.col("hour")))


def hotspots(
    source: Source,
    index: GeoIndex,
    filters: Filters | None = None,
    hour: str | None = None,
    level: str = DEFAULT_LEVEL,
    mode: str = DEFAULT_MODE,
    *,
    default: str = "busiest",
    skip_empty: bool = True,
) -> DataFrame:
    """Ranked hotspots of one hour (the requested if it exists, else the default one).

    ``rank`` gives the order; the rows are not sorted once more.
    """
    located = _located(source, index, filters, hour, level, mode, default)
    return _with_hour_text(rank_points(located, skip_empty=skip_empty))


def hotspots_timeline(
    source: Source,
    index: GeoIndex,
    filters: Filters | None = None,
    level: str = DEFAULT_LEVEL,
    mode: str = DEFAULT_MODE,
    *,
    large_groups: bool = False,
) -> DataFrame:
    """Ranked hotspots of every hour, in one job."""
    level, mode = checked_level(level), checked_mode(mode)
    table = cells(source, filters, LEVELS[level], mode).where("counts")
    located = geocode(table.select("hour", *LEVELS[level], "signal"), level, index)
    return _with_hour_text(rank_points(located, large_groups=large_groups))


def top_hotspots(points: DataFrame, n: int = fv.HOTSPOT_LIST_ROWS) -> DataFrame:
    """The first ``n`` hotspots of each group of ``hotspots`` or ``hotspots_timeline``."""
    return points.where(F.col("rank") <= n)


def hotspot_stats(
    source: Source,
    index: GeoIndex,
    filters: Filters | None = None,
    hour: str | None = None,
    level: str = DEFAULT_LEVEL,
    mode: str = DEFAULT_MODE,
    *,
    placeable_only: bool = False,
) -> DataFrame:
    """One row: total signal, points, top signal, coordinate coverage, map centre.

    Coverage is points per place of the hour.  ``placeable_only`` leaves places without
    a neighbourhood out of its base and counts a place once per coordinate.
    """
    located = _located(source, index, filters, hour, level, mode, "busiest")
    base = F.col("placeable") if placeable_only else F.col("copy") == 1
    shown = _shown()
    stats = located.agg(
        F.max("hour").alias("hour"),
        F.coalesce(F.sum(F.when(shown, F.col("signal"))), F.lit(0.0)).alias("total_signal"),
        F.count_if(shown).alias("hotspots"),
        F.coalesce(F.max(F.when(shown, F.col("signal"))), F.lit(0.0)).alias("top_signal"),
        F.count_if(base).alias("places"),
        F.avg(F.when(shown, F.col("lat"))).alias("center_lat"),
        F.avg(F.when(shown, F.col("lon"))).alias("center_lon"),
    )
    coverage = F.when(F.col("places") > 0, F.col("hotspots") / F.col("places") * F.lit(100.0)).otherwise(F.lit(0.0))
    return stats.select(
        hour_text(F.col("hour")).alias("hour"),
        "total_signal",
        "hotspots",
        "top_signal",
        coverage.alias("geo_coverage_pct"),
        "center_lat",
        "center_lon",
    )


def hour_delta(
    source: Source,
    index: GeoIndex,
    filters: Filters | None = None,
    level: str = DEFAULT_LEVEL,
    mode: str = DEFAULT_MODE,
    *,
    parity: bool = False,
) -> DataFrame:
    """Each hour's total signal and point count against the previous existing hour.

    By default both hours count located points.  With ``parity`` the previous hour
    counts all its places, located or not.  Without previous figures the differences
    are null; percentages are null when the previous figure is 0, and
    ``previous_zero`` says so.  The window has no partition: it runs over hours only.
    """
    level, mode = checked_level(level), checked_mode(mode)
    table = cells(source, filters, LEVELS[level], mode)
    located = geocode(table.select("hour", *LEVELS[level], "signal", "counts"), level, index)
    shown = _shown() & F.col("counts")
    # One row per place, whatever the number of its coordinates.
    place = F.col("counts") & (F.col("copy") == 1)
    per_hour = located.groupBy("hour").agg(
        F.sum(F.when(shown, F.col("signal"))).alias("total_signal"),
        F.count_if(shown).alias("hotspots"),
        F.sum(F.when(place, F.col("signal"))).alias("all_signal"),
        F.count_if(place & (F.col("signal") > 0)).alias("all_places"),
    )
    timeline = Window.orderBy("hour")
    before = ("all_signal", "all_places") if parity else ("total_signal", "hotspots")
    seen = F.lag(before[0]).over(timeline).isNotNull()
    steps = per_hour.select(
        "hour",
        "total_signal",
        "hotspots",
        F.lag(before[0]).over(timeline).alias("previous_signal"),
        F.when(seen, F.lag(before[1]).over(timeline)).alias("previous_hotspots"),
    ).where("hotspots > 0")

    def change(now: str, previous: str, prefix: str) -> list[Column]:
        diff = F.col(now) - F.col(previous)
        percent = F.when(F.col(previous) != 0, diff / F.col(previous) * F.lit(100.0))
        return [diff.alias(f"{prefix}_diff"), percent.alias(f"{prefix}_diff_pct")]

    return steps.select(
        hour_text(F.col("hour")).alias("hour"),
        "total_signal",
        "hotspots",
        "previous_signal",
        "previous_hotspots",
        *change("total_signal", "previous_signal", "signal"),
        *change("hotspots", "previous_hotspots", "hotspots"),
        F.coalesce(F.col("previous_signal") == 0, F.lit(False)).alias("previous_zero"),
    )
