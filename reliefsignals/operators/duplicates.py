"""Rows of equal content: counted, removed, and held against what the metadata declares.

Both steps work in two phases. Contents are hashed and the hashes counted, so one hash per task and
content is shuffled, however many copies there are. Only rows whose hash occurs again are compared
by their content; two contents that share a hash are told apart there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefsignals.schema import Dataset


def content_hash(columns: Sequence[str]) -> Column:
    """A 64-bit hash of the columns. A null is marked, for the hash function skips it."""
    marked = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(len(columns)), *marked)


def _suspects(hashed: DataFrame) -> DataFrame:
    """The hashes that occur more than once."""
    return hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")


def duplicate_counts(df: DataFrame, content: Sequence[str]) -> DataFrame:
    """One row: ``n_rows, n_contents, n_repeated, largest``.

    ``n_repeated`` is rows less contents: what goes if one row of each content stays. ``largest``
    is the number of rows of the most frequent content. Null equals null. An empty table has zeros.
    """
    hashed = df.select(content_hash(content).alias("_hash"), *content)
    per_hash = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("n"))
    alone = per_hash.where("n = 1").select(F.lit(1).cast("long").alias("n"))
    # Beyond the first phase only contents whose hash repeats are read again.
    again = hashed.join(_suspects(hashed), "_hash", "left_semi").groupBy("_hash", *content)
    several = again.agg(F.count(F.lit(1)).alias("n")).select("n")
    return alone.union(several).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_contents"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("n_repeated"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest"),
    )


def without_duplicates(df: DataFrame, content: Sequence[str], id_column: str = "id") -> DataFrame:
    """The rows with the smallest id of their content, all columns.

    What decides is one hash and id per repeated content; texts are compared among rows whose hash
    repeats only. Rows that share content and id all stay, and so do rows of repeated content
    without an id, if no row of that content has one.
    """
    hashed = df.withColumn("_hash", content_hash(content))
    slim = hashed.select("_hash", F.col(id_column).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(content)])
    keys = [f"_c{i}" for i in range(len(content))]
    again = slim.join(_suspects(hashed), "_hash", "left_semi")
    first = again.groupBy("_hash", *keys).agg(F.min("_id").alias("_first"))
    # A hash may stand for several contents: each of their firsts stays.
    kept = first.groupBy("_hash").agg(F.collect_set("_first").alias("_firsts"), F.count(F.lit(1)).alias("_contents"))
    joined = hashed.join(kept, "_hash", "left")
    stays = F.col("_firsts").isNull() | F.array_contains("_firsts", F.col(id_column)) | (F.size("_firsts") < F.col("_contents")) & F.col(id_column).isNull()
    return joined.where(F.coalesce(stays, F.lit(False))).select(*df.columns)


def duplicate_check(dataset: Dataset, content: Sequence[str], before: DataFrame | None = None) -> DataFrame:
    """Counted against declared figures of a deduplication, as ``provenance_check`` has them.

    ``rows_before`` and ``duplicate_rows_removed`` are counted in ``before``, the table as it was
    (null without one), ``rows_after`` and ``duplicate_rows_left`` in the data set. What is
    declared to be free of duplicates has none left.
    """
    names = ("n_rows", "n_repeated")
    after = duplicate_counts(dataset.frame, content).select(*[F.col(c).alias(f"after_{c}") for c in names])
    if before is None:
        counted = after.withColumns({f"before_{c}": F.lit(None).cast("long") for c in names})
    else:
        # One row each: nothing grows here.
        first = duplicate_counts(before, content).select(F.lit(1).alias("_one"), *[F.col(c).alias(f"before_{c}") for c in names])
        counted = after.withColumn("_one", F.lit(1)).join(first, "_one")
    removed = dataset.declared_int("duplicate_rows_removed")
    lines = [
        ("rows_before", "before_n_rows", dataset.declared_int("rows_before")),
        ("rows_after", "after_n_rows", dataset.declared_int("rows_after")),
        ("duplicate_rows_removed", "before_n_repeated", removed),
        ("duplicate_rows_left", "after_n_repeated", None if removed is None else 0),
    ]
    rows = [
        F.struct(
            F.lit(item).alias("item"),
            F.col(c).alias("counted"),
            F.lit(declared).cast("long").alias("declared"),
            F.coalesce(F.col(c) != F.lit(declared).cast("long"), F.lit(False)).alias("differs"),
        )
        for item, c, declared in lines
    ]
    return counted.select(F.inline(F.array(*rows)))
