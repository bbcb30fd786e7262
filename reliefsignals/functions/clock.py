"""Time stamps: parsing, local wall clock, hour buckets.

The session time zone is UTC (``session.configure``), so a plain timestamp shows
UTC fields and a timestamp without zone holds the local wall clock.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefsignals.fixed_values import LOCAL_ZONE
from reliefsignals.functions.text import fix_mojibake

DATE_FORMAT = "yyyy-MM-dd"
TIME_FORMAT = "HH:mm:ss"
HOUR_FORMAT = "yyyy-MM-dd'T'HH':00:00'"

# Tried in turn after the other forms; a leading weekday name is dropped first.
OTHER_FORMATS = ("MMM dd HH:mm:ss Z yyyy",)

WEEKDAY = r"^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? "
_REST = r"(?:[ T,]+(.*))?$"
_YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _REST
_COMPACT = r"^(\d{4})(\d{2})(\d{2})" + _REST
_NUMERIC = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _REST
_MONTH_NAMED = r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})" + _REST
_DAY_NAMED = r"^(\d{1,2})[- ]([A-Za-z]{3})[a-z]*\.?,?[- ](\d{4})" + _REST
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _iso(text: Column, day_first: bool) -> Column:
    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    def joined(pattern: str, year: Column, month: Column, day: Column) -> Column:
        date = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        return F.when(text.rlike(pattern), F.trim(F.concat_ws(" ", date, group(pattern, 4))))

    def month(name: Column) -> Column:
        at = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(name))
        return F.when(at > 0, at.cast("string")).otherwise(F.lit("0"))

    a, b = group(_NUMERIC, 1), group(_NUMERIC, 2)
    day_leads = b.try_cast("int") <= 12 if day_first else a.try_cast("int") > 12
    return F.coalesce(
        *[joined(p, group(p, 1), group(p, 2), group(p, 3)) for p in (_YEAR_FIRST, _COMPACT)],
        joined(_NUMERIC, group(_NUMERIC, 3), F.when(day_leads, b).otherwise(a), F.when(day_leads, a).otherwise(b)),
        joined(_MONTH_NAMED, group(_MONTH_NAMED, 3), month(group(_MONTH_NAMED, 1)), group(_MONTH_NAMED, 2)),
        joined(_DAY_NAMED, group(_DAY_NAMED, 3), month(group(_DAY_NAMED, 2)), group(_DAY_NAMED, 1)),
    )


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value's expression in the plan one time only."""
    return F.element_at(F.transform(F.array(value), body), 1)


def iso_text(text: Column, *, day_first: bool = False) -> Column:
    """A date text of a known form as ``year-month-day rest``, else null.

    Known are year-month-day with ``- / .`` or without marks, three numbers with the year
    last, and English month names.  With the year last the month comes first, or the day
    with ``day_first``; a first number above 12 is the day in any case, a second one the
    month never.
    """
    return _once(text, lambda t: _iso(t, day_first))


def parse_utc(c: Column, formats: Sequence[str] = OTHER_FORMATS, *, day_first: bool = False) -> Column:
    """UTC timestamp of a text; texts without a zone are UTC; unreadable ones null.

    Plain ISO texts take one cast; only what that cannot read is taken apart
    (``iso_text``, where ``day_first`` is explained).
    """

    def other(undated: Column) -> Column:
        read = [F.try_to_timestamp(undated, F.lit(f)) for f in formats]
        return F.coalesce(_iso(undated, day_first).try_cast("timestamp"), *read)

    text = fix_mojibake(c)
    iso = F.when(text.rlike(r"^\d{4}-"), text.try_cast("timestamp"))
    return F.coalesce(iso, _once(F.regexp_replace(text, WEEKDAY, ""), other))


def to_local(utc: Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall clock of ``zone`` as a timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz"))


def hour_start(local: Column) -> Column:
    """Start of the wall-clock hour; grouping on it is cheaper than on text."""
    return F.date_trunc("hour", local)


def hour_text(c: Column) -> Column:
    return F.date_format(c, HOUR_FORMAT)
