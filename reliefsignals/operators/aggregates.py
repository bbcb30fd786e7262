"""Counting operators: labels, places, days, hours, totals.

Each takes a ``Dataset`` (with filters) or a ``Measures`` frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefsignals import fixed_values as fv
from reliefsignals.functions.clock import hour_text
from reliefsignals.functions.labels import name_of
from reliefsignals.functions.text import strip
from reliefsignals.operators.filters import Filters, apply_filters, date_value
from reliefsignals.operators.measures import Measures, compact, measure
from reliefsignals.schema import Dataset

Source = Dataset | Measures
Centroids = dict[str, tuple[float, float]]


def _percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, 0 for an empty whole."""
    return F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))


def _sum0(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0).cast("long"))


# --- labels -----------------------------------------------------------------


def label_counts(source: Source, filters: Filters | None = None) -> DataFrame:
    """``label, label_name, count``, most frequent first, ties in label order."""
    m = measure(source, filters)
    sums = m.matched.agg(*[_sum0(F.col(c)).alias(c) for c in m.flags.values()], F.count(F.lit(1)).alias("any"))
    rows = [
        F.struct(
            (-F.col(c)).alias("order"),
            F.lit(i).alias("position"),
            F.lit(x).alias("label"),
            F.lit(name_of(x)).alias("label_name"),
            F.col(c).alias("count"),
        )
        for i, (x, c) in enumerate(m.flags.items())
    ]
    # Few labels: they are sorted inside the one row of sums, without an exchange.
    long = sums.select(F.inline(F.array_sort(F.array(*rows)))) if rows else _no_labels(sums)
    return long.drop("order", "position")


def _no_labels(frame: DataFrame) -> DataFrame:
    columns = {"position": "int", "label": "string", "label_name": "string", "count": "long"}
    return frame.where(F.lit(False)).select(*[F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def prevalence(source: Source, filters: Filters | None = None) -> DataFrame:
    """Per label: positives and rate in the full table and under the filters, from one scan.

    Metadata may declare the full counts.  If it declares all of them, messages that
    fail the filters are not read at all.
    """
    dataset = source if isinstance(source, Dataset) else source.dataset
    declared_rows = dataset.declared_int("row_count")
    declared = {x: dataset.declared_positives(x) for x in dataset.schema.flagged}
    whole = declared_rows is None or None in declared.values()
    m = measure(source, filters, whole=whole)
    hit = F.col("matched")
    aggregates = [_sum0(F.col("n_rows")).alias("rows_full"), _sum0(F.when(hit, F.col("n_rows"))).alias("rows_hit")]
    for c in m.flags.values():
        aggregates += [_sum0(F.col(c)).alias(f"{c}_full"), _sum0(F.when(hit, F.col(c))).alias(f"{c}_hit")]
    totals = m.frame.agg(*aggregates)
    full_rows = F.col("rows_full") if declared_rows is None else F.lit(declared_rows)
    rows = []
    for i, (x, c) in enumerate(m.flags.items()):
        full = F.col(f"{c}_full") if declared[x] is None else F.lit(declared[x])
        full = full.cast("long")
        rows.append(
            F.struct(
                (-full).alias("order"),
                F.lit(i).alias("position"),
                F.lit(x).alias("label"),
                F.lit(name_of(x)).alias("label_name"),
                full.alias("full_positive"),
                _percent(full, full_rows).alias("full_rate_pct"),
                F.col(f"{c}_hit").alias("filtered_positive"),
                _percent(F.col(f"{c}_hit"), F.col("rows_hit")).alias("filtered_rate_pct"),
            )
        )
    return totals.select(F.inline(F.array_sort(F.array(*rows)))).drop("order", "position")


# --- places -----------------------------------------------------------------


def province_counts(source: Source, filters: Filters | None = None) -> DataFrame:
    """Messages per named province, in no order."""
    m = measure(source, filters)
    named = m.matched.where(strip(F.col("province")) != "")
    return named.groupBy("province").agg(F.sum("n_rows").alias("count"))


def province_map(
    source: Source, filters: Filters | None = None, centroids: Centroids = fv.PROVINCE_CENTROIDS
) -> DataFrame:
    """Messages per province that has a known centre, with its coordinates."""
    counts = province_counts(source, filters).where(F.col("province").isin(*centroids))
    return counts.select(
        "province",
        "count",
        centroid(F.col("province"), centroids, 0).alias("lat"),
        centroid(F.col("province"), centroids, 1).alias("lon"),
    )


def centroid(province: Column, centroids: Centroids, axis: int) -> Column:
    """Latitude (axis 0) or longitude (axis 1) of a province's centre, null if unknown.

    The centres are a literal map inside the plan: no join, nothing to broadcast.
    """
    if not centroids:
        return F.lit(None).cast("double")
    pairs = [F.lit(x) for name, xy in centroids.items() for x in (name, float(xy[axis]))]
    return F.try_element_at(F.create_map(*pairs), province)


def province_ranking(
    source: Source,
    filters: Filters | None = None,
    n: int = fv.PROVINCE_RANKING_ROWS,
    centroids: Centroids = fv.PROVINCE_CENTROIDS,
) -> DataFrame:
    """The ``n`` provinces of ``province_map`` with most messages, ties by name."""
    return province_map(source, filters, centroids).orderBy(F.desc("count"), "province").limit(n)


def distinct_values(dataset: Dataset, column: str) -> DataFrame:
    """Distinct non-empty values of a text column, as ``value``."""
    df = dataset.frame
    if column not in df.columns:
        return df.where(F.lit(False)).select(F.lit(None).cast("string").alias("value"))
    values = df.select(strip(F.col(column).cast("string")).alias("value")).where("value != ''")
    return values.distinct()


# --- time -------------------------------------------------------------------


def temporal_daily(source: Source, filters: Filters | None = None) -> DataFrame:
    """Per day: messages, need signals and mean urgency."""
    m = measure(source, filters)
    days = m.matched.where(F.col("date_value").isNotNull()).groupBy("date_value")
    sums = days.agg(
        F.sum("n_rows").alias("rows"), F.sum("n_needs").alias("needs"), F.sum("urgency").alias("urgency")
    )
    return sums.select(
        F.date_format("date_value", "yyyy-MM-dd").alias("date"),
        "rows",
        "needs",
        (F.col("urgency") / F.col("rows")).alias("urgency"),
    )


def temporal_counts(dataset: Dataset, filters: Filters | None = None) -> DataFrame:
    """Messages per ``date`` text as it stands; the empty text is a group of its own."""
    df = apply_filters(dataset.frame, dataset.schema, filters)
    return df.groupBy("date").agg(F.count(F.lit(1)).alias("count"))


def per_hour(source: Source, filters: Filters | None = None) -> DataFrame:
    """Row and need counts per existing hour: the small table behind all hour choices."""
    m = measure(source, filters)
    return (
        m.matched.where(F.col("hour").isNotNull())
        .groupBy("hour")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_need_rows").alias("n_need_rows"))
    )


def hours(source: Source, filters: Filters | None = None) -> DataFrame:
    """Existing hours as text, in no order."""
    return per_hour(source, filters).select(hour_text(F.col("hour")).alias("hour"))


def hour_preference(requested: str | None = None, default: str = "busiest") -> Column:
    """Sort key that is greatest for the hour to show.

    First the requested hour, if it exists; else the hour with most need signals (of
    most messages, if there are no needs at all), earliest on a tie; or just the first
    hour with ``default="first"``.
    """
    wanted = F.lit(0) if requested is None else (hour_text(F.col("hour")) == requested).cast("int")
    early = -F.unix_timestamp("hour")
    if default == "first":
        return F.struct(wanted.alias("w"), early.alias("e"))
    rows_if_no_need = F.when(F.col("n_need_rows") == 0, F.col("n_rows")).otherwise(F.lit(0))
    return F.struct(
        wanted.alias("w"), F.col("n_need_rows").alias("n"), rows_if_no_need.alias("r"), early.alias("e")
    )


def default_hour(source: Source, filters: Filters | None = None, default: str = "busiest") -> DataFrame:
    """One row: the hour shown first (null without any hour)."""
    best = per_hour(source, filters).agg(F.max_by("hour", hour_preference(default=default)).alias("hour"))
    return best.select(hour_text(F.col("hour")).alias("hour"))


def hour_cursor(source: Source, filters: Filters | None = None, *, wrap: bool = True) -> DataFrame:
    """Previous and next existing hour of each hour.

    At the ends the previous hour stays put, and the next one wraps to the first hour
    or stays put.  The window has no partition: it runs over distinct hours only.
    """
    timeline = Window.orderBy("hour")
    everything = timeline.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hour = F.col("hour")
    end = F.first("hour").over(everything) if wrap else hour
    moves = per_hour(source, filters).select(
        "hour",
        F.coalesce(F.lag("hour").over(timeline), hour).alias("previous_hour"),
        F.coalesce(F.lead("hour").over(timeline), end).alias("next_hour"),
    )
    return moves.select(*[hour_text(F.col(c)).alias(c) for c in moves.columns])


def hour_label_counts(
    source: Source, filters: Filters | None = None, hour: str | None = None, n: int = fv.HOUR_LABEL_ROWS
) -> DataFrame:
    """The most frequent labels of one hour (the requested, else the default one)."""
    m = compact(measure(source, filters), ["hour"])
    table = m.matched.where(F.col("hour").isNotNull())
    chosen = table.agg(F.max_by(F.struct("*"), hour_preference(hour)).alias("best")).select("best.*")
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(x).alias("label"),
            F.lit(name_of(x)).alias("label_name"),
            F.col(c).alias("count"),
        )
        for i, (x, c) in enumerate(m.flags.items())
    ]
    long = chosen.select(F.inline(F.array(*rows))) if rows else _no_labels(chosen)
    return long.where("count > 0").orderBy(F.desc("count"), "position").limit(n).drop("position")


# --- totals -----------------------------------------------------------------


def summary(source: Source, filters: Filters | None = None) -> DataFrame:
    """One row of headline figures for the full table and the filtered part."""
    m = measure(source, filters, whole=True)
    hit = F.col("matched")

    def hits(c: str) -> Column:
        return _sum0(F.when(hit, F.col(c)))

    place = F.when(hit, F.nullif(strip(F.col("province")), F.lit(""))) if "province" in m.frame.columns else None
    totals = m.frame.agg(
        _sum0(F.col("n_rows")).alias("total_rows"),
        hits("n_rows").alias("filtered_rows"),
        hits("n_needs").alias("need_signals"),
        (F.lit(0).cast("long") if place is None else F.countDistinct(place)).alias("province_count"),
        F.coalesce(F.sum(F.when(hit, F.col("urgency"))), F.lit(0.0)).alias("urgency"),
        F.coalesce(F.max(F.when(hit, F.col("urgency_top"))), F.lit(0.0)).alias("max_urgency"),
        *[hits(c).alias(c) for c in m.flags.values()],
    )
    ranked = [
        F.struct(F.col(c).alias("count"), F.lit(-i).alias("order"), F.lit(x).alias("label"))
        for i, (x, c) in enumerate(m.flags.items())
    ]
    nothing = F.struct(F.lit(0).cast("long").alias("count"), F.lit(0).alias("order"), F.lit(None).cast("string").alias("label"))
    top = F.array_max(F.array(*ranked)) if ranked else nothing
    return totals.withColumn("top", top).select(
        "total_rows",
        "filtered_rows",
        "need_signals",
        _percent(F.col("need_signals"), F.col("filtered_rows")).alias("need_signal_rate_pct"),
        "province_count",
        F.when(F.col("filtered_rows") > 0, F.col("urgency") / F.col("filtered_rows"))
        .otherwise(F.lit(0.0))
        .alias("avg_urgency"),
        "max_urgency",
        F.col("top.label").alias("top_label"),
        F.col("top.count").alias("top_label_count"),
    )


def options(dataset: Dataset) -> DataFrame:
    """What a filter panel offers, as rows ``section, item, value``.

    One scan: messages are summed per place, and grouping sets over these sums give the
    distinct provinces, the distinct districts and the overall ranges together.  Distinct
    values stay rows, however many there are.
    """
    df = dataset.frame
    place = {c: strip(F.col(c).cast("string")) if c in df.columns else F.lit("") for c in ("province", "district")}
    urgency = F.col("urgency_score").cast("double") if "urgency_score" in df.columns else F.lit(None).cast("double")
    base = df.select(
        place["province"].alias("province"),
        place["district"].alias("district"),
        date_value(df).alias("day"),
        urgency.alias("urgency"),
    )
    ranges_of = [F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.min("low").alias("low"), F.max("high").alias("high")]
    places = base.groupBy("province", "district").agg(
        F.count(F.lit(1)).alias("weight"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.min("urgency").alias("low"),
        F.max("urgency").alias("high"),
    )
    # One weightless row keeps the overall group alive for an empty table.
    nothing = df.sparkSession.range(1).select(
        F.lit("").alias("province"),
        F.lit("").alias("district"),
        F.lit(0).cast("long").alias("weight"),
        *[F.lit(None).cast("date").alias(c) for c in ("first_day", "last_day")],
        *[F.lit(None).cast("double").alias(c) for c in ("low", "high")],
    )
    grouped = places.unionByName(nothing).groupingSets([["province"], ["district"], []], "province", "district").agg(
        F.grouping_id().alias("gid"), F.sum("weight").alias("n"), *ranges_of
    )
    # gid: bit 2 = province summed away, bit 1 = district summed away.
    low, high = fv.URGENCY_RANGE_WHEN_EMPTY

    def item(section: str, name: str, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("item"), value.cast("string").alias("value"))

    ranges = F.array(
        item("date_range", "min", F.date_format("first_day", "yyyy-MM-dd")),
        item("date_range", "max", F.date_format("last_day", "yyyy-MM-dd")),
        item("urgency_range", "min", F.coalesce(F.col("low"), F.lit(low))),
        item("urgency_range", "max", F.coalesce(F.col("high"), F.lit(high))),
        item("rows", "count", F.col("n")),
        *[item("label", x, F.lit(name_of(x))) for x in dataset.schema.labels],
        *[item("source", k, F.lit(v)) for k, v in source_facts(dataset).items()],
    )
    one = (
        F.when(F.col("gid") == 3, ranges)
        .when(F.col("gid") == 1, F.array(item("province", "name", F.col("province"))))
        .otherwise(F.array(item("district", "name", F.col("district"))))
    )
    return grouped.where("gid = 3 OR coalesce(province, district, '') != ''").select(F.inline(one))


def source_facts(dataset: Dataset) -> dict[str, str | None]:
    """Provenance fields of the metadata, as text."""
    note = dataset.metadata.get("content_overlap_audit_artifact")
    facts = {
        "kind": dataset.kind,
        "canonical": bool(dataset.metadata.get("canonical", False)),
        "generated_at": dataset.metadata.get("generated_at"),
        "experiment": dataset.metadata.get("selected_experiment_key"),
        "threshold_source": dataset.metadata.get("threshold_source"),
        "threshold_type": dataset.metadata.get("threshold_type"),
        "row_count": dataset.metadata.get("row_count"),
        "rows_before": dataset.metadata.get("rows_before"),
        "rows_after": dataset.metadata.get("rows_after"),
        "duplicate_rows_removed": dataset.metadata.get("duplicate_rows_removed"),
        "content_overlap_note": note.get("note") if isinstance(note, dict) else None,
    }
    return {k: None if v is None else str(v) for k, v in facts.items()}


def provenance_check(dataset: Dataset) -> DataFrame:
    """Counted against declared figures: one row for the table and one per label."""
    m = measure(dataset)
    sums = m.frame.agg(
        _sum0(F.col("n_rows")).alias("n_rows"), *[_sum0(F.col(c)).alias(c) for c in m.flags.values()]
    )

    def line(item: str, counted: Column, declared: int | None) -> Column:
        expected = F.lit(declared).cast("long")
        return F.struct(
            F.lit(item).alias("item"),
            counted.alias("counted"),
            expected.alias("declared"),
            F.coalesce(counted != expected, F.lit(False)).alias("differs"),
        )

    lines = [line("row_count", F.col("n_rows"), dataset.declared_int("row_count"))]
    lines += [line(x, F.col(c), dataset.declared_positives(x)) for x, c in m.flags.items()]
    facts = {k: dataset.declared_int(k) for k in ("rows_before", "rows_after", "duplicate_rows_removed")}
    return sums.select(F.inline(F.array(*lines))).select(
        "*",
        F.lit(dataset.kind).alias("source_kind"),
        *[F.lit(v).cast("long").alias(k) for k, v in facts.items()],
    )
