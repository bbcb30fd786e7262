"""Additive measures of messages, the common input of all counting operators.

A measure frame has the key columns ``date_value, hour, province, district,
neighborhood``, a flag ``matched`` (does the message pass the filters) and additive
columns.  A frame of single messages and one that ``compact`` has already summed up
have the same columns, so an operator may run on either: alone it reads messages
once; in a report many operators share one small pre-aggregated frame.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefsignals.functions.clock import hour_start
from reliefsignals.functions.places import PLACE_COLUMNS
from reliefsignals.operators.filters import Filters, apply_filters, date_value
from reliefsignals.schema import Dataset, Published
from reliefsignals.sources.search import narrowed

KEYS = ("date_value", "hour", *PLACE_COLUMNS)


@dataclass(frozen=True)
class Measures:
    """A measure frame and the dataset it came from.

    ``whole`` tells whether messages that fail the filters are still in the frame.
    """

    frame: DataFrame
    dataset: Dataset
    whole: bool

    @property
    def matched(self) -> DataFrame:
        return self.frame.where("matched") if self.whole else self.frame

    def flag(self, label: str) -> str:
        """Name of the column that counts a label's positives."""
        return f"flag_{self.dataset.schema.labels.index(label)}"

    @property
    def flags(self) -> dict[str, str]:
        return {x: self.flag(x) for x in self.dataset.schema.flagged}


def answered_by_sums(source: Dataset | Measures, filters: Filters | None) -> bool:
    """Whether the stored sums of a published table give the measures under these filters.

    They do where the filters ask for days and places only: these are keys of the sums.  Labels,
    urgency, need and text are properties of single messages.
    """
    if not isinstance(source, Published) or source.sums is None or not source.untouched:
        return False
    f = filters or Filters()
    return not (f.labels or f.any_need or f.search_regex or (f.search or "").strip()) and f.urgency_min is None


def _from_sums(source: Published, filters: Filters | None, whole: bool) -> Measures:
    f, sums = filters or Filters(), source.sums
    named = sums.withColumnRenamed("date_value", "date")
    terms = f.terms(named, source.schema)
    if whole:
        matched = F.lit(True)
        for term in terms:
            matched = matched & term
        return Measures(named.withColumn("matched", F.coalesce(matched, F.lit(False))).withColumnRenamed("date", "date_value"), source, True)
    for term in terms:
        named = named.where(term)
    return Measures(named.withColumn("matched", F.lit(True)).withColumnRenamed("date", "date_value"), source, False)


def measure(source: Dataset | Measures, filters: Filters | None = None, *, whole: bool = False) -> Measures:
    """The measures of messages; with ``whole`` the filters only mark rows.

    Of a published table, sums are taken in the place of messages where they can answer.
    """
    if isinstance(source, Measures):
        return source
    if answered_by_sums(source, filters):
        return _from_sums(source, filters, whole)
    if not whole:
        source = narrowed(source, filters)
    df, schema = source.frame, source.schema
    matched = F.lit(True)
    if whole and filters is not None:
        matched = filters.predicate(df, schema)
    elif filters is not None:
        df = apply_filters(df, schema, filters)

    def have(name: str, value: Column, default: Column) -> Column:
        return value if name in df.columns else default

    zero = F.lit(0.0)
    no_time = F.lit(None).cast("timestamp")
    urgency = have("urgency_score", F.coalesce(F.col("urgency_score").cast("double"), zero), zero)
    needs = have("pred_any_need", F.coalesce(F.col("pred_any_need"), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    columns = {
        "date_value": date_value(df) if {"date", "created_at_local"} & set(df.columns) else no_time.cast("date"),
        "hour": have("created_at_local", hour_start(F.col("created_at_local")), no_time),
        **{c: F.col(c) for c in PLACE_COLUMNS if c in df.columns},
        "matched": matched,
        "n_rows": F.lit(1).cast("long"),
        "n_needs": needs,
        # Without the column every message counts as a signal.
        "n_need_rows": have("pred_any_need", (needs == 1).cast("long"), F.lit(1).cast("long")),
        "urgency": urgency,
        "urgency_top": urgency,
    }
    result = Measures(df, source, whole)
    columns |= {result.flag(x): F.col(schema.pred[x]).cast("long") for x in schema.flagged}
    return Measures(df.select(*[v.alias(k) for k, v in columns.items()]), source, whole)


def compact(m: Measures, keys: Sequence[str]) -> Measures:
    """Sum the measures per distinct ``keys`` (and ``matched``)."""
    sums = ["n_rows", "n_needs", "n_need_rows", "urgency", *m.flags.values()]
    keys = [k for k in keys if k in m.frame.columns]
    marks = ["matched"] if m.whole else []
    frame = m.frame.groupBy(*keys, *marks).agg(
        *[F.sum(c).alias(c) for c in sums], F.max("urgency_top").alias("urgency_top")
    )
    return Measures(frame if m.whole else frame.withColumn("matched", F.lit(True)), m.dataset, m.whole)


def summed(dataset: Dataset) -> DataFrame:
    """The table of sums that is published beside the messages: one row per hour and place."""
    messages = Dataset(dataset.frame, dataset.schema, dataset.metadata, dataset.name, dataset.kind)
    return compact(measure(messages), KEYS).frame.drop("matched")
