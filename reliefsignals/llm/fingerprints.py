"""Document fingerprints: threshold-scaled sketches, with DataFrame functions only.

A fingerprint retains every shingle hash below a fixed fraction of all hashes. Sketches of
the same fraction merge by union, and a finer one is reduced to a coarser one by dropping
hashes, so the containment of a short text in a very long one can be estimated from the two
sketches alone. The fraction is one of ``2 ** -LEVELS[i]``: texts of few distinct shingles take
the whole set (a sketch of the common fraction would be empty for most of them), larger ones
coarser sketches of some 32 hashes at least; comparisons are made at the coarser fraction of the two.

Shingles are five lower-cased words (runs of anything but white space); a text with fewer
words has its whole sequence as one shingle, a text without words an empty sketch. A null text
is empty. Equal texts have equal fingerprints. A text without words has likeness 1 to another one,
0 to texts with words. Where nothing of two texts with words is left at the common fraction, their
likeness is null; so is the containment of a text of which nothing is left there.

The fingerprint's text form is ``<level>:<hashes in hexadecimal, ascending, comma between>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliefsignals.llm.bounds import free_name

WIDTH = 5
#: (fewest distinct shingles, level): the sketch keeps hashes whose upper ``level`` bits are 0.
LEVELS = ((0, 0), (64, 1), (128, 2), (256, 3), (512, 4), (1024, 5))
#: Documents that one run of neighbours holds, about, and the most runs.
RUN_ROWS = 4_000
MOST_RUNS = 1_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def at_level(hashes: Column, level: Column) -> Column:
    """The hashes whose upper ``level`` bits are 0."""
    limits = F.array(*[F.lit((2**63 >> x) - 1) for x in range(LEVELS[-1][1] + 1)])
    return F.filter(hashes, lambda v: F.shiftrightunsigned(v, 1) <= F.get(limits, level))


def sketch(text: Column) -> Column:
    """Struct of ``level`` and ``hashes`` (ascending, unsigned below the level's fraction)."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def of_words(h: Column) -> Column:
        n = F.size(h)
        many = F.when(n >= WIDTH, n - (WIDTH - 1)).otherwise(F.when(n > 0, 1).otherwise(0))
        place = F.filter(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: i <= many)
        shingles = F.when(
            n >= WIDTH, F.transform(place, lambda i: F.xxhash64(*[F.get(h, i + (j - 1)) for j in range(WIDTH)]))
        ).otherwise(F.transform(place, lambda i: F.xxhash64(h)))
        return _let(F.array_distinct(shingles), of_shingles)

    def of_shingles(s: Column) -> Column:
        level = F.lit(LEVELS[0][1])
        for least, deeper in LEVELS[1:]:
            level = F.when(F.size(s) >= least, deeper).otherwise(level)
        return _let(level, lambda x: F.struct(x.alias("level"), F.array_sort(at_level(s, x)).alias("hashes")))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of_words)


def as_text(found: Column) -> Column:
    return F.concat(found["level"].cast("string"), F.lit(":"), F.array_join(F.transform(found["hashes"], lambda v: F.lower(F.hex(v))), ","))


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together, at the coarser level."""
    level = F.greatest(a["level"], b["level"])
    return F.struct(level.alias("level"), F.array_sort(F.array_union(at_level(a["hashes"], level), at_level(b["hashes"], level))).alias("hashes"))


def _wordless(x: Column) -> Column:
    return (x["level"] == 0) & (F.size(x["hashes"]) == 0)


def _compared(a: Column, b: Column, result) -> Column:
    """``result`` of the shared and both numbers of hashes at the common level; where it is null, what wordless texts decide."""

    def sizes(x: Column) -> Column:
        common = F.size(F.array_intersect(x["a"], x["b"])).cast("double")
        return result(common, F.size(x["a"]).cast("double"), F.size(x["b"]).cast("double"))

    level = F.greatest(a["level"], b["level"])
    value = _let(F.struct(at_level(a["hashes"], level).alias("a"), at_level(b["hashes"], level).alias("b")), sizes)
    none, nothing = _wordless(a), _wordless(b)
    return F.coalesce(value, F.when(none & nothing, 1.0).when(none | nothing, 0.0))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1; null if both have words and no hash at the common level."""
    return _compared(a, b, lambda c, n, m: F.when(n + m > 0, c / F.greatest(n + m - c, F.lit(1.0))))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has, 0 to 1; null if none of the first's is seen at the common level."""
    return _compared(a, b, lambda c, n, m: F.when(n > 0, c / F.greatest(n, F.lit(1.0))))


def with_next(documents: DataFrame, columns: list[str], ties: list[str], key: str = "doc_id") -> DataFrame:
    """Each document with ``next_<column>`` of the document with the next smaller key; the smallest is followed by the largest.

    Documents are cut into runs of keys at measured quantiles, which are keys that occur. The
    rows of a run's upper edge are given to the run above as well, where they only serve as the
    last row's successor; the rows of the largest key serve the lowest run so. Repeated keys
    follow each other in the order of ``ties``. A null key is smaller than all others.
    """
    k, run, guest = (free_name(documents, x) for x in ("k", "run", "guest"))
    rows = documents.withColumn(k, F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))))
    n, top = rows.agg(F.count(F.lit(1)), F.max(k)).first()
    runs = min(MOST_RUNS, max(8, (n or 0) // RUN_ROWS))
    cuts = rows.agg(F.percentile_approx(k, [i / runs for i in range(1, runs)], 100 * runs)).first()[0] or []
    edges = sorted({c for c in cuts if c != top})
    literal = F.array(*[F.lit(x).cast("long") for x in edges]) if edges else F.array().cast("array<bigint>")
    own = F.size(F.filter(literal, lambda e: e < F.col(k)))
    places = F.array(F.struct(own.alias("r"), F.lit(0).alias("g")))
    above = F.when(F.array_contains(literal, F.col(k)), F.array(F.struct((own + 1).alias("r"), F.lit(1).alias("g"))))
    below = F.when(F.col(k) == F.lit(top), F.array(F.struct(F.lit(0).alias("r"), F.lit(2).alias("g"))))
    none = F.array().cast("array<struct<r:int,g:int>>")
    rows = rows.select("*", F.inline(F.concat(places, F.coalesce(above, none), F.coalesce(below, none))).alias(run, guest))
    order = Window.partitionBy(run).orderBy(F.col(guest) == 2, F.col(k).desc(), *ties)
    out = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return out.filter(F.col(guest) == 0).drop(k, run, guest)


def fingerprints(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they and their neighbours are."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), sketch(text).alias("own"))
    rows = with_next(rows, ["text", "own"], ["text"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next_own").alias("next"))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "own", sketch(F.col("edited")).alias("changed"), "next"
    )
    own, changed, following = F.col("own"), F.col("changed"), F.col("next")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(own).alias("fingerprint"),
        as_text(changed).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        containment(own, changed).alias("contained_in_edited"),
    )
