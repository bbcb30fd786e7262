"""Message filters: one typed bundle that compiles to one boolean column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from reliefsignals.functions.clock import iso_text
from reliefsignals.functions.labels import total
from reliefsignals.functions.text import fold
from reliefsignals.schema import Dataset, LabelSchema


def date_value(df: DataFrame) -> Column:
    """The message date: the ``date`` column if there is one, else the local wall clock's."""
    if "date" not in df.columns:
        return F.col("created_at_local").cast("date")
    if isinstance(df.schema["date"].dataType, DateType):
        return F.col("date")
    text = F.col("date")
    # A plain ISO date takes one cast; other forms are taken apart only if that fails.
    return F.coalesce(text.try_cast("date"), iso_text(text).try_cast("date"))


@dataclass(frozen=True)
class Filters:
    """Conditions that must all hold; an unset one does not restrict.

    ``search`` is a literal caseless text; ``search_regex`` is a lower-cased pattern.
    """

    start_date: dt.date | None = None
    end_date: dt.date | None = None
    provinces: tuple[str, ...] = ()
    districts: tuple[str, ...] = ()
    neighborhoods: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    label_mode: str = "ANY"
    urgency_min: float | None = None
    search: str | None = None
    search_regex: str | None = None
    any_need: bool = False

    def _date_terms(self, df: DataFrame) -> list[Column]:
        day = date_value(df)
        lower = [] if self.start_date is None else [day >= F.lit(self.start_date)]
        upper = [] if self.end_date is None else [day <= F.lit(self.end_date)]
        return lower + upper

    def _place_terms(self, df: DataFrame) -> list[Column]:
        wanted = {
            "province": self.provinces,
            "district": self.districts,
            "neighborhood": self.neighborhoods,
        }
        return [F.col(c).isin(*v) for c, v in wanted.items() if v and c in df.columns]

    def _urgency_terms(self, df: DataFrame) -> list[Column]:
        # A missing urgency counts as 0.  Written so that the scan can use it.
        if self.urgency_min is None or "urgency_score" not in df.columns:
            return []
        enough = F.col("urgency_score") >= F.lit(float(self.urgency_min))
        return [enough if self.urgency_min > 0 else F.col("urgency_score").isNull() | enough]

    def _label_terms(self, df: DataFrame, schema: LabelSchema) -> list[Column]:
        picked = [schema.pred[x] for x in self.labels if schema.pred.get(x) in df.columns]
        if not picked:
            return []
        hits = total(picked)
        return [hits == len(picked) if self.label_mode.upper() == "ALL" else hits > 0]

    def _text_terms(self, df: DataFrame) -> list[Column]:
        texts = [F.col(c) for c in ("tweet_clean", "tweet") if c in df.columns]
        needle = (self.search or "").strip().casefold()
        terms = []
        if needle:
            found = [F.coalesce(fold(t).contains(needle), F.lit(False)) for t in texts]
            terms.append(_any(found))
        if self.search_regex:
            pattern = self.search_regex.lower()
            found = [F.coalesce(F.lower(t).rlike(pattern), F.lit(False)) for t in texts]
            terms.append(_any(found))
        return terms

    def terms(self, df: DataFrame, schema: LabelSchema) -> list[Column]:
        """The single conditions, cheap ones first and text search last."""
        need = [F.col("pred_any_need") == 1] if self.any_need and "pred_any_need" in df.columns else []
        return [
            *self._date_terms(df),
            *self._place_terms(df),
            *self._urgency_terms(df),
            *need,
            *self._label_terms(df, schema),
            *self._text_terms(df),
        ]

    def predicate(self, df: DataFrame, schema: LabelSchema) -> Column:
        """One condition that is true or false, never null."""
        result: Column | None = None
        for term in self.terms(df, schema):
            result = term if result is None else result & term
        return F.lit(True) if result is None else F.coalesce(result, F.lit(False))


def _any(conditions: Sequence[Column]) -> Column:
    result = F.lit(False)
    for c in conditions:
        result = result | c
    return result


def apply_filters(df: DataFrame, schema: LabelSchema, filters: Filters | None) -> DataFrame:
    """Keep the matching messages.

    The terms go to ``where`` one by one, not as one wrapped condition, so that each
    can be pushed to the scan; ``where`` drops null like false.
    """
    for term in filters.terms(df, schema) if filters else []:
        df = df.where(term)
    return df


def during(dataset: Dataset, hour: str) -> Dataset:
    """The messages of one wall-clock hour, given as text like ``2023-02-06T04:00:00``.

    A plain range on the time stamp, which the scan uses to skip row groups, and on a
    published table the local day, which prunes its folders: the way to look at a known
    hour of a large table without reading the others.
    """
    start = dt.datetime.fromisoformat(hour).replace(minute=0, second=0, microsecond=0)
    at, frame = F.col("created_at_local"), dataset.frame
    low, high = (F.lit(str(t)).cast("timestamp_ntz") for t in (start, start + dt.timedelta(hours=1)))
    if "local_day" in frame.columns:
        frame = frame.where(F.col("local_day") == F.lit(start.date()))
    return replace(dataset, frame=frame.where((at >= low) & (at < high)))
