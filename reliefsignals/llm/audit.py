"""Filter interaction audit: what each filter removes, in every order of the filters.

A row's failures are a mask with one bit for each filter. Rows are counted per part (source) and
mask, with the good and the toxic ones among them: at most ``2 ** 5`` cells per part, summed on
the map side. All subsets of filters are then visited in the order of the Gray code, so that each
step toggles one filter only. A cell has a counter of its active failures; where that leaves 0
the cell's rows leave the running survivors, where it comes back to 0 they return. The survivors
of the 32 subsets are stored, and a step of an order is the difference of two of them.

The filters, as failure conditions (words are runs of anything but ASCII white space):

- A: fewer than ``LEAST_WORDS`` words
- B: less than ``LEAST_DISTINCT`` % of the words are distinct
- C: more than ``MOST_CAPITALS`` % of the code points are ``[A-Z]``
- D: the text has one of ``MARKS``
- E: the text is that of a row with a smaller id, in the whole table

Equal texts are found by their SHA-256. Rows are first counted per text, part and id, so a text
that a third of all rows share is a few numbers from each task; what is joined afterwards are
texts and parts.

Null texts are empty: they fail A, and E if an empty text has a smaller id. Rows without an id
are neither smaller nor larger than others and never fail E. Rows with equal id and text don't
fail because of each other. A null part is the part ``''``. Labels that repeat an id count once,
an id without a label is neither good nor toxic. An empty table has no parts and gives no rows.
Very long texts are one row's work; only their digest is shuffled. Columns other than those
named are not looked at, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
MARKS = "#$%&*|"
SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("n", "good", "toxic")
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> list[Column]:
    """The conditions A to D on a text that is not null."""
    words = F.array_remove(F.split(text, SPACE), "")
    many, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return [
        many < LEAST_WORDS,
        distinct * 100 < many * LEAST_DISTINCT,
        capitals * 100 > F.char_length(text).cast("long") * MOST_CAPITALS,
        text.rlike(f"[{MARKS}]"),
    ]


def _mask(conditions: list[Column]) -> Column:
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def cells(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: the rows of each part by what they fail."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        _mask(text_failures(text)).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("long")).alias("is_good"), F.max((F.col("toxic") == 1).cast("long")).alias("is_toxic")
    )
    known = rows.join(marked.filter("is_good = 1 OR is_toxic = 1"), "id", "left")
    of_id = known.groupBy("digest", "part", "mask", "id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("is_good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("is_toxic", F.lit(0))).alias("toxic"),
    )
    numbers = F.struct(*MEASURES)
    of_text = of_id.groupBy("digest", "part", "mask").agg(
        *[F.sum(m).alias(m) for m in MEASURES],
        *[F.sum(F.when(F.col("id").isNull(), F.col(m)).otherwise(0)).alias(f"free_{m}") for m in MEASURES],
        F.min("id").alias("least"),
        F.min_by(numbers, F.col("id")).alias("at_least"),
    )
    firsts = of_text.groupBy("digest").agg(F.min("least").alias("first"))
    placed = of_text.join(firsts, "digest")
    passing = {
        m: F.col(f"free_{m}") + F.when(F.col("least") == F.col("first"), F.col("at_least")[m]).otherwise(0) for m in MEASURES
    }
    unlike = F.struct(F.col("mask"), *[c.alias(m) for m, c in passing.items()])
    alike = F.struct((F.col("mask") + (1 << 4)).alias("mask"), *[(F.col(m) - c).alias(m) for m, c in passing.items()])
    both = placed.select("part", F.inline(F.array(unlike, alike)))
    return both.groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])


def survivors(counts: np.ndarray) -> np.ndarray:
    """Rows that pass all filters of a subset, for every subset, from rows by mask of failures.

    ``counts`` has a row for each mask and a column for each measure.
    """
    masks = np.arange(len(counts))
    failing, running, subset = np.zeros(len(counts), int), counts.sum(axis=0), 0
    states = np.empty_like(counts)
    states[0] = running
    for step in range(1, len(counts)):
        toggled = step & -step
        hit = (masks & toggled) > 0
        if subset & toggled:
            failing[hit] -= 1
            running = running + counts[hit & (failing == 0)].sum(axis=0)
        else:
            running = running - counts[hit & (failing == 0)].sum(axis=0)
            failing[hit] += 1
        subset ^= toggled
        states[subset] = running
    return states


def orders(counts: np.ndarray, letters: str = LETTERS) -> pd.DataFrame:
    """One row per order and step from the rows by mask of one part."""
    states, bits = survivors(counts), {x: 1 << i for i, x in enumerate(letters)}
    masks, k = np.arange(len(counts)), len(letters)
    fails = {x: int(counts[(masks & b) > 0, 0].sum()) for x, b in bits.items()}
    shapley = {x: 0 for x in letters}
    for before in masks:
        size = int(before).bit_count()
        for x, b in bits.items():
            if not before & b:
                shapley[x] += factorial(size) * factorial(k - 1 - size) * int(states[before, 0] - states[before | b, 0])
    rows = []
    for order in permutations(letters):
        before = 0
        for step, x in enumerate(order, 1):
            after = before | bits[x]
            removed, good, toxic = (int(v) for v in states[before] - states[after])
            only = int(counts[bits[x], 0])
            rows.append(("".join(order), step, int(states[after, 0]), removed, fails[x] - removed, only, good, toxic, shapley[x]))
            before = after
    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return pd.DataFrame(rows, columns=names)


def audit(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step; see ``RESULT``. Rows without a removal are there too."""

    def of_part(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << len(LETTERS), len(MEASURES)), np.int64)
        counts[group["mask"].to_numpy()] = group[list(MEASURES)].to_numpy(np.int64)
        found = orders(counts)
        found.insert(0, "part", group["part"].iloc[0])
        return found

    return cells(documents, labels, part).groupBy("part").applyInPandas(of_part, RESULT)
