"""Expressions over place columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefsignals.functions.text import collapse_whitespace

PLACE_COLUMNS = ("province", "district", "neighborhood")


def location_label(parts: Sequence[Column], *, skip_empty: bool = True) -> Column:
    """``province / district / neighborhood``; empty parts are left out by default."""
    texts = [collapse_whitespace(p) for p in parts]
    if skip_empty:
        texts = [F.nullif(t, F.lit("")) for t in texts]
    return F.concat_ws(" / ", *texts)
