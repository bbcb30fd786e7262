"""Registered queries: one per operator, each over whole given tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import adapter as A
from reliefsignals.functions.clock import hour_start, hour_text
from reliefsignals.functions.labels import label_name, row_labels
from reliefsignals.functions.places import location_label
from reliefsignals.functions.text import clean_text, fix_mojibake, info_signal
from reliefsignals.operators import aggregates as agg
from reliefsignals.operators import hotspots as hot
from reliefsignals.operators import messages as msg
from reliefsignals.operators import scoring
from reliefsignals.operators.duplicates import duplicate_check, without_duplicates
from reliefsignals.operators.filters import Filters, apply_filters, during
from reliefsignals.operators.geocode import (
    LEVELS,
    gazetteer_districts,
    gazetteer_neighborhoods,
    gazetteer_provinces,
    geocode,
    store_index,
)
from reliefsignals.operators.prepare import (
    add_date_time,
    add_timestamps,
    apply_info_rule,
    coerce_numbers,
    labels_long,
    normalize_places,
    prepare,
    unreadable_times,
)
from reliefsignals.plans.overview import overview
from reliefsignals.schema import Dataset, discover_schema
from reliefsignals.sources.gazetteer import load_gazetteer
from reliefsignals.sources.predictions import load_predictions, publish_predictions, read_published, replace_days
from reliefsignals.sources.search import narrowed
from reliefsignals.streaming.closing import close_hours, hours_so_far
from reliefsignals.streaming.hourly import append_to, open_stream, replay_hourly_signals
from reliefsignals.streaming.ranking import current_ranking, rank_hourly

Query = Callable[[SparkSession, str], DataFrame]

METADATA = {
    "canonical": True,
    "row_count": 12000,
    "rows_before": 12500,
    "rows_after": 12000,
    "duplicate_rows_removed": 500,
    "pred_positives": {"saglik": 1500, "gida_su": 9000},
    "generated_at": "2024-02-01T00:00:00Z",
    "selected_experiment_key": "exp",
    "threshold_source": "cv",
    "threshold_type": "per_label",
}

PICKED = Filters(
    start_date=dt.date(2024, 1, 4),
    end_date=dt.date(2024, 1, 20),
    provinces=("ASIA", "EUROPE", "MIDDLE EAST"),
    labels=("saglik", "altyapi", "guvenlik"),
    urgency_min=1.0,
)
COMBINED = replace(PICKED, districts=("NATION_3", "NATION_8", "NATION_12", "NATION_19"), search=" HABER ")


# --- sources ------------------------------------------------------------------


def q_load_predictions(spark: SparkSession, sf: str) -> DataFrame:
    folder = A.folder(A.configure(spark), "cells")
    writer = A.raw_cells(spark, sf).write.option("header", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return _prepared_view(load_predictions(spark, folder).frame)


def _prepared_view(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        "tweet_clean",
        F.date_format("created_at_parsed", "yyyy-MM-dd HH:mm:ss").alias("utc"),
        "date",
        "time",
        "province",
        "district",
        "neighborhood",
        "urgency_score",
        "pred_saglik",
        "prob_saglik",
        "pred_bilgi_paylasimi",
        "postprocess_info_v1_added",
        "pred_label_count",
        "pred_any_need",
    )


def q_load_gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    folder = A.folder(A.configure(spark), "gazetteer")
    # Some longitudes are unreadable; names carry blanks and capitals.
    raw = A.customer_gazetteer(spark, sf).select(
        F.concat(F.lit(" "), "province").alias("province"),
        "district",
        F.initcap("neighborhood_clean").alias("neighborhood_clean"),
        F.col("lat").cast("string").alias("lat"),
        F.when(F.col("lat") > 36.25, F.col("lon").cast("string")).otherwise("?").alias("lon"),
    )
    writer = raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
    writer.csv(folder)
    return load_gazetteer(spark, folder)


def q_publish_predictions(spark: SparkSession, sf: str) -> DataFrame:
    folder = A.folder(A.configure(spark), "published")
    publish_predictions(A.signals(spark, sf), folder)
    wanted = Filters(start_date=dt.date(2024, 1, 4), end_date=dt.date(2024, 1, 20))
    return agg.temporal_daily(read_published(spark, folder), wanted)


# --- projections --------------------------------------------------------------


def q_labels_long(spark: SparkSession, sf: str) -> DataFrame:
    ds = A.signals(spark, sf)
    return labels_long(ds.frame, ds.schema)


def q_labels_long_discovered(spark: SparkSession, sf: str) -> DataFrame:
    """Labels found in the header: the two quality flags of the documents."""
    docs, marks = A.table(spark, sf, "documents"), A.table(spark, sf, "labels")
    joined = docs.select("doc_id").join(marks, "doc_id", "left")
    raw = joined.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("quality").alias("pred_quality"),
        F.col("toxic").alias("pred_toxic"),
    )
    frame = prepare(raw)
    return labels_long(frame, discover_schema(frame.columns))


def damaged_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, a third read with the wrong code page, a third beyond repair."""
    misread = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    by_turn = (
        F.when(F.col("doc_id") % 3 == 0, misread)
        .when(F.col("doc_id") % 3 == 1, F.concat(misread, F.lit(" \ufffd")))
        .otherwise(F.col("text"))
    )
    return A.table(spark, sf, "documents").select("doc_id", by_turn.alias("text"))


def q_fix_mojibake(spark: SparkSession, sf: str) -> DataFrame:
    fixed = damaged_documents(spark, sf).withColumn("fixed", fix_mojibake(F.col("text")))
    return fixed.select(
        "doc_id",
        F.md5("fixed").alias("fixed_md5"),
        F.length("fixed").cast("long").alias("fixed_length"),
        (F.length("fixed") < F.length("text")).alias("shorter"),
    )


def q_normalize_location(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_places(A.raw_cells(spark, sf)).select("id", "province", "district", "neighborhood")


def q_parse_created_at(spark: SparkSession, sf: str) -> DataFrame:
    return add_timestamps(A.raw_cells(spark, sf)).select(
        "id",
        F.date_format("created_at_parsed", "yyyy-MM-dd HH:mm:ss").alias("utc"),
        F.date_format("created_at_local", "yyyy-MM-dd HH:mm:ss").alias("local"),
    )


def q_derive_date_time(spark: SparkSession, sf: str) -> DataFrame:
    return add_date_time(add_timestamps(A.raw_cells(spark, sf))).select("id", "date", "time")


def q_parse_date_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's time written in one of nine forms, some with the day first."""
    at = F.col("ts")
    forms = (
        "dd.MM.yyyy HH:mm", "MMM d, yyyy HH:mm", "yyyyMMdd", "dd/MM/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss",
        "d MMM yyyy HH:mm", "EEE, dd MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "'in quarter' q",
    )
    cells = F.array(*[F.date_format(at, f) for f in forms])
    cell = F.element_at(cells, (F.col("event_id") % len(forms) + 1).cast("int"))
    parsed = add_timestamps(A.table(spark, sf, "events").select("event_id", cell.alias("created_at")), day_first=True)
    return parsed.select("event_id", F.date_format("created_at_parsed", "yyyy-MM-dd HH:mm:ss").alias("utc"))


def q_unreadable_times(spark: SparkSession, sf: str) -> DataFrame:
    return unreadable_times(A.raw_cells(spark, sf))


def q_hour_bucket(spark: SparkSession, sf: str) -> DataFrame:
    hour = hour_text(hour_start(F.col("created_at_local")))
    return A.plain_signals(spark, sf).select("id", hour.alias("hour"))


def q_coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    raw = A.raw_cells(spark, sf)
    df = coerce_numbers(raw, discover_schema(raw.columns))
    return df.select("id", "urgency_score", "pred_saglik", "prob_saglik", "pred_altyapi", "prob_altyapi")


def q_info_signal(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("id").cast("bigint")
    text = (
        F.when(n % 3 == 0, F.upper("tweet_clean"))
        .when(n % 3 == 1, F.concat(F.lit("su "), "tweet_clean", F.lit("\n numara")))
        .otherwise(F.col("tweet_clean"))
    )
    return A.plain_signals(spark, sf).select("id", info_signal(text).alias("signal"))


def _with_rule_words(text: Column, n: Column) -> Column:
    """Whole texts with words of the rule put in, by number: one family, two, an announcement, none."""
    words = ("HABER ALAMIYORUZ", "haber alamıyoruz, bilen var mı", "DUYURU: dağıtım", "su lazım", "telefon 0555")
    inserted = F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), half), F.lit(" "), inserted, F.lit(" "), F.substring(text, half + 1, F.length(text)))


def q_info_signal_documents(spark: SparkSession, sf: str) -> DataFrame:
    text = _with_rule_words(F.col("text"), F.col("doc_id"))
    return A.table(spark, sf, "documents").select("doc_id", info_signal(text).alias("signal"))


def q_info_rule_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """The rule after the classifier and after thresholds, on whole conversation turns."""
    n = F.col("conv_id") + F.col("turn")
    rows = A.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        _with_rule_words(F.col("text"), n).alias("tweet_clean"),
        F.lit(0).alias("pred_bilgi_paylasimi"),
        (n % 10 / F.lit(10.0)).alias("prob_bilgi_paylasimi"),
        F.array().cast("array<string>").alias("predicted"),
    )
    ruled = scoring.score_postprocess(apply_info_rule(rows), "tweet_clean")
    return ruled.select("conv_id", "turn", "pred_bilgi_paylasimi", F.array_join("predicted", ",").alias("predicted"))


def q_label_sums_beyond_int(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged flags far beyond 32 bits are summed as they are."""
    raw = A.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"),
        (F.col("event_id") * 4_000_000_000).cast("string").alias("pred_saglik"),
        F.lit("2147483647").alias("pred_barinma"),
        F.lit("2147483647.5").alias("pred_gida_su"),
    )
    return prepare(raw).select("id", "pred_saglik", "pred_label_count", "pred_any_need")


def q_info_postprocess(spark: SparkSession, sf: str) -> DataFrame:
    return A.signals(spark, sf).frame.select("id", "pred_bilgi_paylasimi", "postprocess_info_v1_added")


def q_label_count_any_need(spark: SparkSession, sf: str) -> DataFrame:
    return A.signals(spark, sf).frame.select("id", "pred_label_count", "pred_any_need")


def q_row_labels(spark: SparkSession, sf: str) -> DataFrame:
    ds = A.signals(spark, sf)
    return ds.frame.select(
        "id",
        F.array_join(row_labels(ds.schema), ",").alias("labels"),
        F.array_join(row_labels(ds.schema, 2), ",").alias("first_two"),
    )


def q_pretty_label(spark: SparkSession, sf: str) -> DataFrame:
    known = F.element_at(F.array(*[F.lit(x) for x in A.LABELS]), (F.col("event_id") % 9 + 1).cast("int"))
    other = F.concat(F.col("event_type"), F.lit("_type_"), F.col("event_id") % 5)
    label = F.when(F.col("event_id") % 2 == 0, known).otherwise(other)
    return A.table(spark, sf, "events").select("event_id", label_name(label).alias("name"))


def q_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    # Letters are taken apart and odd blanks put in, in every other document.
    apart = F.replace(F.replace("text", F.lit("\u00e9"), F.lit("e\u0301")), F.lit(" "), F.lit("\u00a0 \u3000"))
    text = F.when(F.col("doc_id") % 2 == 0, apart).otherwise(F.col("text"))
    cleaned = A.table(spark, sf, "documents").select("doc_id", clean_text(text).alias("cleaned"))
    return cleaned.select("doc_id", F.md5("cleaned").alias("md5"), F.length("cleaned").cast("long").alias("length"))


def q_location_label(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.col(c) for c in ("province", "district", "neighborhood")]
    return A.plain_signals(spark, sf).select(
        "id",
        location_label(parts).alias("location"),
        location_label(parts, skip_empty=False).alias("location_full"),
    )


# --- filters ------------------------------------------------------------------


def filtered(filters: Filters, *columns: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ds = A.signals(spark, sf)
        return apply_filters(ds.frame, ds.schema, filters).select("id", *columns)

    return run


def _documents_as_messages(spark: SparkSession, sf: str) -> Dataset:
    docs = A.table(spark, sf, "documents")
    return Dataset.of(docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("tweet_clean")))


def q_filter_search(spark: SparkSession, sf: str) -> DataFrame:
    ds = _documents_as_messages(spark, sf)
    return apply_filters(ds.frame, ds.schema, Filters(search="  EßE ")).select("id")


def q_filter_search_ligatures(spark: SparkSession, sf: str) -> DataFrame:
    """Texts whose "fi" and "ss" are single letters, searched in plain spelling."""
    docs = A.table(spark, sf, "documents")
    text = F.replace(F.replace("text", F.lit("fi"), F.lit("\ufb01")), F.lit("ss"), F.lit("ẞ"))
    ds = Dataset.of(docs.select(F.col("doc_id").cast("string").alias("id"), text.alias("tweet_clean")))
    parts = [apply_filters(ds.frame, ds.schema, Filters(search=s)).select(F.lit(s).alias("search"), "id") for s in ("fi", "ss")]
    return parts[0].union(parts[1])


def q_hotspots_known_hour(spark: SparkSession, sf: str) -> DataFrame:
    """Hotspots of a requested hour of a published table: other hours are not read."""
    folder = A.folder(A.configure(spark), "published")
    publish_predictions(A.signals(spark, sf), folder)
    return hot.hotspots(read_published(spark, folder), A.geo_index(spark, sf), hour="2024-01-10T05:00:00", level="neighborhood")


def _published(spark: SparkSession, dataset: Dataset, search: bool = False) -> Dataset:
    folder = A.folder(A.configure(spark), "published")
    publish_predictions(dataset, folder, search=search)
    return read_published(spark, folder)


PLACES_ONLY = Filters(start_date=PICKED.start_date, end_date=PICKED.end_date, provinces=PICKED.provinces)


def q_hotspots_published(spark: SparkSession, sf: str) -> DataFrame:
    """Answered by the stored sums: no message is read."""
    ds = _published(spark, A.signals(spark, sf))
    return hot.hotspots_timeline(ds, A.geo_index(spark, sf), PLACES_ONLY, level="neighborhood")


def q_summary_published(spark: SparkSession, sf: str) -> DataFrame:
    return agg.summary(_published(spark, A.signals(spark, sf)), PLACES_ONLY)


def q_replaced_days(spark: SparkSession, sf: str) -> DataFrame:
    """A published table of which three days were published anew, with more urgency and fewer messages."""
    folder, ds = A.folder(A.configure(spark), "published"), A.signals(spark, sf)
    publish_predictions(ds, folder)
    some = ds.frame.where("date BETWEEN '2024-01-10' AND '2024-01-12' AND cast(id AS bigint) % 3 > 0")
    replace_days(replace(ds, frame=some.withColumn("urgency_score", F.col("urgency_score") + 8.0)), folder)
    return agg.temporal_daily(read_published(spark, folder))


SEARCHED = ("EßE", "apache license", "licensed under the apache", "555-")


def q_filter_search_published(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of a published table that hold common and rare words, found by block signatures."""
    docs = A.table(spark, sf, "documents")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60).cast("timestamp_ntz")
    texts = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("tweet_clean"), at.alias("created_at_local"),
        F.date_format(at, "yyyy-MM-dd").alias("date"),
    )
    ds, parts = _published(spark, Dataset.of(texts), search=True), []
    for s in SEARCHED:
        near = narrowed(ds, Filters(search=s))
        parts.append(apply_filters(near.frame, near.schema, Filters(search=s)).select(F.lit(s).alias("search"), "id"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def q_provenance_published(spark: SparkSession, sf: str) -> DataFrame:
    """Declared figures travel with a published table."""
    folder = A.folder(A.configure(spark), "published")
    publish_predictions(A.signals(spark, sf, METADATA), folder)
    return agg.provenance_check(read_published(spark, folder))


DEDUP_METADATA = {"rows_before": 10000, "rows_after": 9900, "duplicate_rows_removed": 100}


def q_provenance_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Declared figures of a deduplication that looked at text and source, audited by text alone."""
    docs = A.table(spark, sf, "documents").select("doc_id", "text", "source")
    cleaned = without_duplicates(docs, ["text", "source"], "doc_id")
    return duplicate_check(Dataset.of(cleaned, DEDUP_METADATA), ["text"], docs)


def q_without_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    talk = A.table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return without_duplicates(talk, ["role", "text"]).select("id", "role")


def q_filter_search_regex(spark: SparkSession, sf: str) -> DataFrame:
    talk = A.table(spark, sf, "conversations")
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    ds = Dataset.of(talk.select(key.alias("id"), F.col("text").alias("tweet")))
    return apply_filters(ds.frame, ds.schema, Filters(search_regex="(é|E)[a-z]*ON[ .]")).select("id")


def q_filter_hour(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of a requested hour that exists, and of the fallback for one that does not."""
    ds = A.signals(spark, sf)
    parts = [
        hot.hour_cells(ds, None, LEVELS["province"], "count_rows", hour).select(
            F.lit(hour).alias("requested"), hour_text(F.col("hour")).alias("hour"), "province", "n_rows"
        )
        for hour in ("2024-01-10T05:00:00", "1999-01-01T00:00:00")
    ]
    return parts[0].unionByName(parts[1])


def q_filter_during(spark: SparkSession, sf: str) -> DataFrame:
    return during(A.signals(spark, sf), "2024-01-10T05:00:00").frame.select("id", "province")


# --- places -------------------------------------------------------------------


def located(level: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        cells = hot.cells(A.signals(spark, sf), None, LEVELS[level], "count_any_need").where("counts")
        points = geocode(cells.select("hour", *LEVELS[level], "signal"), level, A.geo_index(spark, sf))
        return points.where("placeable").select(
            hour_text(F.col("hour")).alias("hour"), *LEVELS[level], "signal", "lat", "lon"
        )

    return run


def q_geocode_level_used(spark: SparkSession, sf: str) -> DataFrame:
    level = "neighborhood"
    cells = hot.cells(A.signals(spark, sf), None, LEVELS[level], "count_any_need").where("counts")
    points = geocode(cells.select("hour", *LEVELS[level], "signal"), level, A.geo_index(spark, sf))
    return points.where("placeable").groupBy("level_used").agg(
        F.count(F.lit(1)).alias("places"), F.sum("signal").alias("signal")
    )


def q_geocode_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Places located by a gazetteer that lies in buckets of the join keys, for beyond the broadcast bound."""
    level, name = "neighborhood", f"gazetteer_{uuid.uuid4().hex}"
    cells = hot.cells(A.signals(spark, sf), None, LEVELS[level], "count_any_need").where("counts")
    index = store_index(A.geo_index(spark, sf), A.folder(A.configure(spark), "gazetteer"), name)
    points = geocode(cells.select("hour", *LEVELS[level], "signal"), level, index)
    return points.where("placeable").select(hour_text(F.col("hour")).alias("hour"), *LEVELS[level], "signal", "lat", "lon")


def q_gazetteer(build: Callable[[DataFrame], DataFrame], spark: SparkSession, sf: str) -> DataFrame:
    return build(A.customer_gazetteer(spark, sf))


# --- aggregates ---------------------------------------------------------------


def on_signals(
    operator: Callable[..., DataFrame], filters: Filters | None = PICKED, metadata: dict | None = None, **options: object
) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return operator(A.signals(spark, sf, metadata), filters, **options)

    return run


def on_dataset(operator: Callable[..., DataFrame], metadata: dict | None = None, **options: object) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return operator(A.signals(spark, sf, metadata), **options)

    return run


def on_places(operator: Callable[..., DataFrame], filters: Filters | None = None, **options: object) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return operator(A.signals(spark, sf), A.geo_index(spark, sf), filters, **options)

    return run


def timeline_part(level: str, mode: str, *columns: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        points = hot.hotspots_timeline(A.signals(spark, sf), A.geo_index(spark, sf), None, level, mode)
        return points.select("hour", "province", "district", "neighborhood", *columns)

    return run


def q_hotspot_severity(spark: SparkSession, sf: str) -> DataFrame:
    """Severity per day at district level: larger groups with fewer ties than hours have."""
    ds, keys = A.signals(spark, sf), LEVELS["district"]
    cells = hot.cells(ds, None, keys, "sum_urgency").where("counts")
    day = F.date_format("hour", "yyyy-MM-dd")
    daily = cells.groupBy(day.alias("day"), *keys).agg(F.sum("signal").alias("signal"))
    points = hot.rank_points(geocode(daily, "district", A.geo_index(spark, sf)), by="day", large_groups=True)
    return points.select("day", *keys, "signal", "severity")


def q_top_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    points = hot.hotspots(A.signals(spark, sf), A.geo_index(spark, sf), level="neighborhood")
    return hot.top_hotspots(points).select("hour", "rank", "location", "signal")


def q_overview(spark: SparkSession, sf: str) -> DataFrame:
    folder = A.folder(A.configure(spark), "overview")
    return overview(A.signals(spark, sf), PICKED, A.CENTROIDS, folder).long()


def q_top_messages(spark: SparkSession, sf: str) -> DataFrame:
    top = msg.top_messages(A.signals(spark, sf), PICKED, 60)
    return top.withColumns({c: F.array_join(c, ",") for c in ("labels", "label_names")})


def q_top_messages_many(spark: SparkSession, sf: str) -> DataFrame:
    """More messages than any list of a page shows."""
    return msg.top_messages(A.signals(spark, sf), None, 700).select("id", "urgency")


def q_ticker(spark: SparkSession, sf: str) -> DataFrame:
    """Items made of whole conversation turns, long ones cut with dots; the most urgent are blank."""
    talk = A.table(spark, sf, "conversations")
    rows = talk.select(
        F.format_string("%08d-%04d", "conv_id", "turn").alias("id"),
        F.when((F.col("conv_id") % 4 == 0) | (F.col("conv_id") % 10 > 7), F.lit(" ")).otherwise(F.col("text")).alias("tweet_clean"),
        (F.col("conv_id") % 10).cast("double").alias("urgency_score"),
        F.col("role").alias("province"),
        *[((F.col("conv_id") + i) % 2).cast("int").alias(f"pred_{x}") for i, x in enumerate(A.LABELS)],
    )
    items = msg.ticker(Dataset.of(rows))
    return items.withColumn("labels", F.array_join("labels", ","))


# --- streaming ----------------------------------------------------------------


FILES, FILES_AT_ONCE = 9, 2


def _event_stream(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """The events as files in no order of time, two of them in a micro-batch."""
    events = A.table(spark, sf, "events")
    events.repartition(FILES, "event_id").write.parquet(f"{folder}/events")
    return open_stream(spark, f"{folder}/events", events.schema, files_per_trigger=FILES_AT_ONCE)


def q_stream_hourly_signals(spark: SparkSession, sf: str) -> DataFrame:
    folder = A.folder(A.configure(spark), "hourly")
    messages = A.finish(A.signals_from(_event_stream(spark, sf, folder), A._places(spark, sf)))
    needed = ("created_at_local", "province", "pred_any_need", "urgency_score")
    return replay_hourly_signals(messages.select(*needed), folder)


def q_stream_closed_hours(spark: SparkSession, sf: str) -> DataFrame:
    """The events in no order of time, through state that closes hours; late rows count."""
    folder = A.folder(A.configure(spark), "closing")
    messages = A.finish(A.signals_from(_event_stream(spark, sf, folder), A._places(spark, sf)))
    needed = ("created_at_local", "province", "pred_any_need", "urgency_score")
    close_hours(messages.select(*needed), folder).awaitTermination()
    return hours_so_far(spark, folder).drop("late_rows", "open")


def q_stream_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    """The ranking of all hours after the last micro-batch; a compaction lies in between."""
    folder = A.folder(A.configure(spark), "ranking")
    messages = A.finish(A.signals_from(_event_stream(spark, sf, folder), A._places(spark, sf)))
    needed = ("created_at_local", "province", "district", "pred_any_need", "urgency_score")
    index = A.geo_index(spark, sf)
    rank_hourly(messages.select(*needed), folder, index, level="district", compact_every=3).awaitTermination()
    return current_ranking(spark, folder)


def q_stream_clean(spark: SparkSession, sf: str) -> DataFrame:
    folder = A.folder(A.configure(spark), "clean")
    cleaned = prepare(A.raw_cells_from(_event_stream(spark, sf, folder), A._places(spark, sf)))
    append_to(cleaned, f"{folder}/out", f"{folder}/state").awaitTermination()
    return _prepared_view(spark.read.parquet(f"{folder}/out"))


# --- scoring ------------------------------------------------------------------


def counting_model(n_labels: int) -> Callable[[], scoring.Model]:
    """Loader of a stand-in classifier: logits are small integers from length and letters.

    All parts are nested functions, so they reach the workers by value.
    """

    def load() -> scoring.Model:
        def logits(texts: list[str]) -> np.ndarray:
            size = np.array([[len(t), t.count("a")] for t in texts], dtype=np.int64)
            return (size[:, :1] * np.arange(1, n_labels + 1) + size[:, 1:]) % 13 - 6.0

        return logits

    return load


def q_score_batch(spark: SparkSession, sf: str) -> DataFrame:
    docs = A.table(spark, sf, "documents").select("doc_id", "text")
    scored = scoring.score_batch(docs, counting_model(len(A.LABELS)), A.LABELS, text_column="text")
    labelled = scoring.score_postprocess(scoring.apply_thresholds(scored))
    return labelled.select("doc_id", F.array_join("predicted", ",").alias("predicted"))


def q_linear_scorer(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.linear_scorer(A.table(spark, sf, "embeddings"), A.weights())
    return scored.select("vec_id", *[(F.col(f"logit_{x}") > 0).alias(f"positive_{x}") for x in A.LABELS])


def q_apply_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.apply_thresholds(A.plain_signals(spark, sf))
    return scored.select("id", F.array_join("predicted", ",").alias("predicted"))


def q_score_postprocess(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.apply_thresholds(A.plain_signals(spark, sf))
    final = scoring.score_postprocess(scored, "tweet_clean", compose=True)
    return final.select("id", F.array_join("predicted", ",").alias("predicted"))


def q_score_detail(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_detail(A.plain_signals(spark, sf))


QUERIES: dict[str, Query] = {
    # sources and sinks
    "load_predictions": q_load_predictions,
    "load_gazetteer": q_load_gazetteer,
    "publish_predictions": q_publish_predictions,
    # projections
    "labels_long": q_labels_long,
    "labels_long_discovered": q_labels_long_discovered,
    "fix_mojibake": q_fix_mojibake,
    "normalize_location": q_normalize_location,
    "parse_created_at": q_parse_created_at,
    "derive_date_time": q_derive_date_time,
    "parse_date_forms": q_parse_date_forms,
    "unreadable_times": q_unreadable_times,
    "hour_bucket": q_hour_bucket,
    "coerce_numeric": q_coerce_numeric,
    "info_signal": q_info_signal,
    "info_signal_documents": q_info_signal_documents,
    "info_rule_conversations": q_info_rule_conversations,
    "info_postprocess": q_info_postprocess,
    "label_sums_beyond_int": q_label_sums_beyond_int,
    "label_count_any_need": q_label_count_any_need,
    "row_labels": q_row_labels,
    "pretty_label": q_pretty_label,
    "clean_text": q_clean_text,
    "location_label": q_location_label,
    # filters
    "filter_date_range": filtered(
        Filters(start_date=dt.date(2024, 1, 5), end_date=dt.date(2024, 1, 12)), "date"
    ),
    "filter_province": filtered(Filters(provinces=("ASIA", "EUROPE")), "province"),
    "filter_district": filtered(Filters(districts=("NATION_3", "NATION_21")), "district"),
    "filter_neighborhood": filtered(Filters(neighborhoods=("N2", "N6")), "neighborhood"),
    "filter_urgency_min": filtered(Filters(urgency_min=3.0), "urgency_score"),
    "filter_labels_any": filtered(Filters(labels=("saglik", "barinma", "no_such_label"))),
    "filter_labels_all": filtered(Filters(labels=("gida_su", "altyapi"), label_mode="ALL")),
    "filter_search": q_filter_search,
    "filter_search_ligatures": q_filter_search_ligatures,
    "filter_search_published": q_filter_search_published,
    "filter_search_regex": q_filter_search_regex,
    "hotspots_published": q_hotspots_published,
    "summary_published": q_summary_published,
    "replaced_days": q_replaced_days,
    "filter_any_need": filtered(Filters(any_need=True)),
    "filter_hour": q_filter_hour,
    "filter_during": q_filter_during,
    "filter_combined": filtered(COMBINED, "date", "province", "district", "urgency_score"),
    # places
    "geocode_province": located("province"),
    "geocode_district": located("district"),
    "geocode_neighborhood": located("neighborhood"),
    "geocode_level_used": q_geocode_level_used,
    "geocode_stored": q_geocode_stored,
    "gazetteer_neighborhoods": partial(q_gazetteer, gazetteer_neighborhoods),
    "gazetteer_districts": partial(q_gazetteer, gazetteer_districts),
    "gazetteer_provinces": partial(q_gazetteer, gazetteer_provinces),
    "province_counts": on_signals(agg.province_counts),
    "province_map": on_signals(agg.province_map, centroids=A.CENTROIDS),
    "province_ranking": on_signals(
        agg.province_ranking, None, n=2, centroids={"ASIA": (1.0, 2.0), "EUROPE": (3.0, 4.0), "AFRICA": (5.0, 6.0)}
    ),
    # labels, time, totals
    "label_counts": on_signals(agg.label_counts),
    "prevalence": on_signals(agg.prevalence),
    "prevalence_declared": on_signals(agg.prevalence, PICKED, METADATA),
    "temporal_daily": on_signals(agg.temporal_daily),
    "temporal_counts": on_signals(agg.temporal_counts),
    "summary": on_signals(agg.summary),
    "options": on_dataset(agg.options, METADATA),
    "distinct_locations": on_dataset(agg.distinct_values, column="district"),
    "hours": on_signals(agg.hours),
    "default_hour": on_signals(agg.default_hour, None),
    "hour_label_counts": on_signals(agg.hour_label_counts, None),
    "hour_cursor": on_signals(agg.hour_cursor),
    "provenance_check": on_dataset(agg.provenance_check, METADATA),
    "provenance_published": q_provenance_published,
    "provenance_duplicates": q_provenance_duplicates,
    "without_duplicates": q_without_duplicates,
    # hotspots
    "hotspot_signal_count_rows": on_signals(hot.signals, None, level="district", mode="count_rows"),
    "hotspot_signal_any_need": on_signals(hot.signals, PICKED, level="neighborhood", mode="count_any_need"),
    "hotspot_signal_urgency": on_signals(hot.signals, None, level="province", mode="sum_urgency"),
    "hotspots_all_levels": on_signals(hot.all_levels, None),
    "hotspot_rank": timeline_part("province", "count_rows", "signal", "rank"),
    "hotspot_share": timeline_part("province", "sum_urgency", "signal", "share_pct"),
    "hotspot_severity": q_hotspot_severity,
    "hotspots": on_places(hot.hotspots, PICKED, level="neighborhood"),
    "hotspots_timeline": on_places(hot.hotspots_timeline, level="district"),
    "hotspot_stats": on_places(hot.hotspot_stats, level="neighborhood"),
    "hour_delta": on_places(hot.hour_delta, level="province"),
    "hour_delta_parity": on_places(hot.hour_delta, PICKED, level="district", parity=True),
    "top_hotspots": q_top_hotspots,
    "hotspots_known_hour": q_hotspots_known_hour,
    # messages and reports
    "top_messages": q_top_messages,
    "top_messages_many": q_top_messages_many,
    "ticker": q_ticker,
    "message_list": on_signals(msg.message_list),
    "overview": q_overview,
    # streaming
    "stream_hourly_signals": q_stream_hourly_signals,
    "stream_closed_hours": q_stream_closed_hours,
    "stream_hotspots": q_stream_hotspots,
    "stream_clean": q_stream_clean,
    # scoring
    "score_batch": q_score_batch,
    "apply_thresholds": q_apply_thresholds,
    "score_postprocess": q_score_postprocess,
    "score_detail": q_score_detail,
    "linear_scorer": q_linear_scorer,
}

FLAGSHIP = "hotspots"
