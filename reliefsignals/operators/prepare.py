"""From raw cells to a typed message table.

Works on batch and streaming frames: every step is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, TimestampNTZType, TimestampType

from reliefsignals import fixed_values as fv
from reliefsignals.functions.clock import DATE_FORMAT, TIME_FORMAT, parse_utc, to_local
from reliefsignals.functions.labels import name_of, total
from reliefsignals.functions.numbers import count_or_zero, number_or_null
from reliefsignals.functions.places import PLACE_COLUMNS
from reliefsignals.functions.text import fix_mojibake, matches_info_rule, normalize_location, rule_text
from reliefsignals.schema import LabelSchema, Metadata, discover_schema, is_flag_column


def normalize_places(df: DataFrame) -> DataFrame:
    return df.withColumns({c: normalize_location(F.col(c)) for c in PLACE_COLUMNS if c in df.columns})


def add_timestamps(df: DataFrame, *, day_first: bool = False) -> DataFrame:
    """``created_at_parsed`` (UTC) and ``created_at_local`` (wall clock) from ``created_at``.

    ``day_first`` reads 02/06/2023 as 2 June, by default it is 6 February.
    """
    if "created_at" not in df.columns:
        nothing = F.lit(None)
        return df.withColumns(
            {
                "created_at_parsed": nothing.cast("timestamp"),
                "created_at_local": nothing.cast("timestamp_ntz"),
            }
        )
    if isinstance(df.schema["created_at"].dataType, (TimestampType, TimestampNTZType)):
        utc = F.col("created_at").cast("timestamp")
    else:
        utc = parse_utc(F.col("created_at"), day_first=day_first)
    return df.withColumn("created_at_parsed", utc).withColumn(
        "created_at_local", to_local(F.col("created_at_parsed"))
    )


def unreadable_times(raw: DataFrame, *, day_first: bool = False) -> DataFrame:
    """One row: how many ``created_at`` cells there are, how many are empty and how many no form fits."""
    df = add_timestamps(raw, day_first=day_first)
    empty = F.trim(F.coalesce(F.col("created_at").cast("string"), F.lit(""))) == ""
    return df.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(empty).alias("empty"),
        F.count_if(~empty & F.col("created_at_parsed").isNull()).alias("unreadable"),
    )


def add_date_time(df: DataFrame) -> DataFrame:
    """Text columns ``date`` and ``time``: kept if present, else from the local wall clock."""

    def value(name: str, pattern: str) -> Column:
        if name in df.columns:
            return fix_mojibake(F.col(name).cast("string"))
        return F.coalesce(F.date_format("created_at_local", pattern), F.lit(""))

    return df.withColumns({"date": value("date", DATE_FORMAT), "time": value("time", TIME_FORMAT)})


def _flag_columns(df: DataFrame, schema: LabelSchema) -> list[str]:
    mapped = set(schema.pred.values())
    return [c for c in df.columns if is_flag_column(c) or c in mapped]


def as_count(df: DataFrame, name: str) -> Column:
    """The column as bigint; text is read leniently, numbers are only cast."""
    if isinstance(df.schema[name].dataType, StringType):
        return count_or_zero(F.col(name))
    return F.coalesce(F.col(name).try_cast("bigint"), F.lit(0).cast("bigint"))


def as_number(df: DataFrame, name: str) -> Column:
    """The column as double; text is read leniently, numbers are only cast."""
    if isinstance(df.schema[name].dataType, NumericType):
        return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    return number_or_null(F.col(name))


def coerce_numbers(df: DataFrame, schema: LabelSchema) -> DataFrame:
    """Urgency to double (bad = 0), flags to bigint (bad = 0), scores to double (bad = null)."""
    flags = set(_flag_columns(df, schema))
    scores = set(schema.prob.values())
    changes = {}
    for c in df.columns:
        if c == "urgency_score":
            changes[c] = F.coalesce(as_number(df, c), F.lit(0.0))
        elif c in flags:
            changes[c] = as_count(df, c)
        elif c in scores or c.startswith("prob_"):
            changes[c] = as_number(df, c)
    return df.withColumns(changes) if changes else df


def apply_info_rule(df: DataFrame, *, enabled: bool = True, compose: bool = False) -> DataFrame:
    """Set the information-sharing flag where score and text both suggest it.

    Adds ``postprocess_info_v1_added``.  Frames that lack a column it needs are
    returned unchanged.  Only rows that pass the cheap tests have their text searched.
    """
    pred, prob = f"pred_{fv.INFO_LABEL}", f"prob_{fv.INFO_LABEL}"
    if not enabled or not {"tweet_clean", pred, prob} <= set(df.columns):
        return df
    candidate = (as_count(df, pred) == 0) & (F.coalesce(as_number(df, prob), F.lit(0.0)) >= fv.INFO_MIN_PROB)
    text = F.when(candidate, rule_text(F.col("tweet_clean"), compose=compose))
    added = F.coalesce(matches_info_rule(F.col("_rule_text")), F.lit(False))
    # Separate steps, so that the text is cleaned once per row and searched once per pattern.
    return (
        df.withColumn("_rule_text", text)
        .withColumn("postprocess_info_v1_added", added.cast("int"))
        .withColumn(pred, F.when(F.col("postprocess_info_v1_added") == 1, F.lit(1).cast("bigint")).otherwise(as_count(df, pred)))
        .drop("_rule_text")
    )


def count_labels(df: DataFrame, schema: LabelSchema) -> DataFrame:
    """``pred_label_count`` and ``pred_any_need`` from the flags, else from existing columns."""
    flags = _flag_columns(df, schema)
    if flags:
        count = total(flags)
    elif "pred_label_count" in df.columns:
        count = as_count(df, "pred_label_count")
    elif "pred_any_need" in df.columns:
        return df.withColumn("pred_any_need", as_count(df, "pred_any_need"))
    else:
        return df
    return df.withColumns({"pred_label_count": count, "pred_any_need": (count > 0).cast("int")})


def prepare(
    raw: DataFrame,
    metadata: Metadata | None = None,
    *,
    info_rule: bool = True,
    compose: bool = False,
    day_first: bool = False,
) -> DataFrame:
    """The whole cleaning chain.  ``compose=True`` also NFC-normalises the rule text.

    The steps are ordered so that Spark can merge them into few projections.
    """
    schema = discover_schema(raw.columns, metadata)
    df = add_timestamps(coerce_numbers(normalize_places(raw), schema), day_first=day_first)
    df = add_date_time(apply_info_rule(df, enabled=info_rule, compose=compose))
    return count_labels(df, schema)


def labels_long(df: DataFrame, schema: LabelSchema, id_column: str = "id") -> DataFrame:
    """One row per message and label: ``id, label, label_name, pred, prob``."""
    entries = [
        F.struct(
            F.lit(x).alias("label"),
            F.lit(name_of(x)).alias("label_name"),
            (F.col(schema.pred[x]) if x in schema.pred else F.lit(None)).cast("bigint").alias("pred"),
            (F.col(schema.prob[x]) if x in schema.prob else F.lit(None)).cast("double").alias("prob"),
        )
        for x in schema.labels
    ]
    return df.select(F.col(id_column).alias("id"), F.inline(F.array(*entries)))
