"""Lists of single messages.  All are top-k plans: no full sort, no collect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefsignals import fixed_values as fv
from reliefsignals.functions.labels import label_names, row_labels
from reliefsignals.functions.text import collapse_whitespace, ellipsize, strip
from reliefsignals.operators.filters import Filters, apply_filters
from reliefsignals.schema import Dataset
from reliefsignals.sources.search import narrowed


def _urgency() -> Column:
    return F.coalesce(F.col("urgency_score").cast("double"), F.lit(0.0))


def _most_urgent(df: DataFrame, *then: str) -> list[Column]:
    """Sort order: urgency and the columns in ``then`` descending, id decides ties."""
    keys = [F.desc(c) for c in then if c in df.columns]
    if "urgency_score" in df.columns:
        keys.insert(0, _urgency().desc())
    return [*keys, *[F.col(c) for c in ("id",) if c in df.columns]]


def top_messages(dataset: Dataset, filters: Filters | None = None, limit: int = fv.TOP_MESSAGES_DEFAULT) -> DataFrame:
    """The ``limit`` most urgent messages with cleaned text, their labels and the labels' names."""
    if limit <= 0:
        raise ValueError(f"limit must be positive, not {limit}")
    df = apply_filters(narrowed(dataset, filters).frame, dataset.schema, filters)
    top = df.orderBy(*_most_urgent(df, "pred_label_count")).limit(limit)

    def text(name: str) -> Column:
        return collapse_whitespace(F.col(name).cast("string")) if name in df.columns else F.lit("")

    bodies = [F.nullif(F.col(c), F.lit("")) for c in ("tweet_clean", "tweet") if c in df.columns]
    body = F.coalesce(*bodies, F.lit("")) if bodies else F.lit("")
    urgency = _urgency() if "urgency_score" in df.columns else F.lit(0.0)
    return top.select(
        *[text(c).alias(c) for c in ("id", "date", "time", "province", "district", "neighborhood")],
        collapse_whitespace(body).alias("text"),
        urgency.alias("urgency"),
        row_labels(dataset.schema).alias("labels"),
        label_names(row_labels(dataset.schema)).alias("label_names"),
    )


def ticker(dataset: Dataset, filters: Filters | None = None, n: int = fv.TICKER_ITEMS) -> DataFrame:
    """Short one-line items: the ``n`` most urgent messages that have a text."""
    df = apply_filters(narrowed(dataset, filters).frame, dataset.schema, filters)
    if "tweet_clean" not in df.columns:
        return df.where(F.lit(False)).select(*[F.lit("").alias(c) for c in ("id", "text", "province")])
    order = _most_urgent(df)
    line = F.replace(strip(F.coalesce("tweet_clean", F.lit(""))), F.lit("\n"), F.lit(" "))
    province = strip(F.col("province")) if "province" in df.columns else F.lit("")
    items = df.withColumn("line", line).where("line != ''")
    return items.orderBy(*order).limit(n).select(
        "id",
        ellipsize(F.col("line"), fv.TICKER_CHARS).alias("text"),
        province.alias("province"),
        row_labels(dataset.schema, fv.TICKER_LABELS).alias("labels"),
    )


def message_list(dataset: Dataset, filters: Filters | None = None, n: int = fv.MESSAGE_LIST_ROWS) -> DataFrame:
    """The first ``n`` messages by id with the display columns and the label flags."""
    df = apply_filters(narrowed(dataset, filters).frame, dataset.schema, filters)
    shown = ("date", "time", "province", "district", "neighborhood", "urgency_score", "tweet_clean")
    flags = [dataset.schema.pred[x] for x in dataset.schema.flagged]
    ordered = df.orderBy("id") if "id" in df.columns else df
    return ordered.limit(n).select(*[c for c in shown if c in df.columns], *flags)
