"""Label schema: which columns of a prediction table belong to which label."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from reliefsignals.fixed_values import CANONICAL_KIND, DEFAULT_KIND, DEFAULT_LABELS, RESERVED_PRED_COLUMNS

Metadata = Mapping[str, Any]


@dataclass(frozen=True)
class LabelSchema:
    """Labels in display order and the column that holds each one's flag / score."""

    labels: tuple[str, ...]
    pred: Mapping[str, str]
    prob: Mapping[str, str]

    @property
    def flagged(self) -> tuple[str, ...]:
        """Labels that have a 0/1 column."""
        return tuple(label for label in self.labels if label in self.pred)

    @property
    def scored(self) -> tuple[str, ...]:
        """Labels that have a probability column."""
        return tuple(label for label in self.labels if label in self.prob)


def is_flag_column(name: str) -> bool:
    return name.startswith("pred_") and name not in RESERVED_PRED_COLUMNS


def _named_map(metadata: Metadata, key: str) -> Mapping[str, Any]:
    value = metadata.get(key)
    return value if isinstance(value, Mapping) else {}


def discover_schema(columns: Iterable[str], metadata: Metadata | None = None) -> LabelSchema:
    """Find the labels from metadata, the default list and the header.  Runs no job."""
    columns = list(columns)
    metadata = metadata or {}
    declared = [x for x in metadata.get("labels") or [] if isinstance(x, str) and x.strip()]
    from_header = [c.removeprefix("pred_") for c in columns if is_flag_column(c)]
    candidates = dict.fromkeys([*declared, *DEFAULT_LABELS, *from_header])

    def locate(label: str, renames: Mapping[str, Any], prefix: str) -> str | None:
        choices = (renames.get(label), f"{prefix}_{label}")
        return next((c for c in choices if isinstance(c, str) and c in columns), None)

    pred_renames = _named_map(metadata, "label_to_pred_column")
    prob_renames = _named_map(metadata, "label_to_prob_column")
    pred = {x: c for x in candidates if (c := locate(x, pred_renames, "pred"))}
    prob = {x: c for x in candidates if (c := locate(x, prob_renames, "prob"))}
    return LabelSchema(tuple(x for x in candidates if x in pred or x in prob), pred, prob)


@dataclass(frozen=True)
class Dataset:
    """A prepared message table with its label schema and side-car metadata.

    ``kind`` is what the table's owner says it is; the metadata may state it as ``kind``, or
    as ``canonical`` for the final table.
    """

    frame: DataFrame
    schema: LabelSchema
    metadata: Metadata = field(default_factory=dict)
    name: str = ""
    kind: str = DEFAULT_KIND

    @classmethod
    def of(cls, frame: DataFrame, metadata: Metadata | None = None, name: str = "", kind: str | None = None) -> Dataset:
        facts = metadata or {}
        stated = kind or facts.get("kind") or (CANONICAL_KIND if facts.get("canonical") else DEFAULT_KIND)
        return cls(frame, discover_schema(frame.columns, facts), facts, name, stated)

    def declared_int(self, key: str) -> int | None:
        """An integer from the metadata, or None when absent or not a number."""
        try:
            return int(self.metadata[key])
        except (KeyError, TypeError, ValueError):
            return None

    def declared_positives(self, label: str) -> int | None:
        value = _named_map(self.metadata, "pred_positives").get(label)
        return None if value is None else int(value)


@dataclass(frozen=True)
class Published(Dataset):
    """A published table: its messages, their sums per hour and place, and text signatures.

    Sums and signatures stand for ``whole``, the frame of all messages; once ``frame`` is another
    one (``during``, a projection), they are left alone.
    """

    whole: DataFrame | None = None
    sums: DataFrame | None = None
    signatures: DataFrame | None = None
    #: The messages of some files only, by their names in the signatures.
    of_files: Callable[[list[str]], DataFrame] | None = None

    @property
    def untouched(self) -> bool:
        return self.frame is self.whole
