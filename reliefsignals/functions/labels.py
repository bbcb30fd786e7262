"""Expressions over the label columns of one row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefsignals.fixed_values import LABEL_NAMES
from reliefsignals.schema import LabelSchema


def total(columns: Iterable[str]) -> Column:
    """Sum of integer columns given by name, as bigint; 0 for none."""
    return F.expr(" + ".join(f"cast(`{c}` AS bigint)" for c in columns) or "0L")


def label_name(label: Column) -> Column:
    """Display name of a label; unknown labels show blanks for underscores."""
    names = F.create_map(*[F.lit(x) for pair in LABEL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, label), F.replace(label, F.lit("_"), F.lit(" ")))


def label_names(labels: Column) -> Column:
    """Display names of an array of labels."""
    return F.transform(labels, label_name)


def name_of(label: str) -> str:
    """Display name of a label known on the driver."""
    return LABEL_NAMES.get(label, label.replace("_", " "))


def row_labels(schema: LabelSchema, max_labels: int | None = None) -> Column:
    """Array of the labels set in a row, in schema order."""
    hits = [F.when(F.col(schema.pred[x]) == 1, F.lit(x)) for x in schema.flagged]
    if not hits:
        return F.array().cast("array<string>")
    found = F.array_compact(F.array(*hits))
    return found if max_labels is None else F.slice(found, 1, max_labels)
