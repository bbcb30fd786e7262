"""Lenient text-to-number conversion: bad cells become null or zero, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_or_null(c: Column) -> Column:
    """Double, or null for anything that is no number.

    The JVM also reads type suffixes ("1d", "2f") and the word NaN; both are refused.  The
    cast comes first; only the last character of what it read is looked at, where "inf"
    is the one number that ends like a suffix.
    """
    text = c.cast("string")
    value = F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))
    last = F.right(F.rtrim(text, F.lit(" \t\n\r\f\v")), F.lit(1))
    suffixed = last.isin("d", "D") | (last.isin("f", "F") & (F.abs(value) < F.lit(float("inf"))))
    return F.when(~suffixed, value)


def number_or_zero(c: Column) -> Column:
    return F.coalesce(number_or_null(c), F.lit(0.0))


def count_or_zero(c: Column) -> Column:
    """Integer part of a number as bigint, 0 when missing or unreadable."""
    return F.coalesce(number_or_null(c).try_cast("bigint"), F.lit(0).cast("bigint"))
