"""Mixing sources to target weights by Poisson replication.

A source that holds ``n`` documents and shall give ``target`` rows has the mean repetition
rate ``target / n``. Each document draws a number of copies from the Poisson distribution
with that mean: a hash of its id and the seed is a number between 0 and 1, and the
distribution function is inverted there. Documents are exploded by their counts and all rows
are dealt over all partitions and ordered there by a hash of id, copy and seed: a global
shuffle that repeats exactly.

Rates have no cap. A null source is a source of its own. Documents with a weight of 0, or
without one, give no rows. Null and repeated ids draw like any other: rows with one id have
one count. Empty texts are rows like others. Only per-source numbers are held by the driver
or broadcast; that side is measured (``broadcast_if_few``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefsignals.llm.bounds import broadcast_if_few, free_name

SEED = 20260401
#: Exponent of the default weights: a source's share of rows to this power.
TEMPERATURE = 0.5
#: Rates above it are drawn as a sum of Poisson parts, so that exp(-rate) stays representable.
PART = 16.0


def uniform(key: Column, seed: int, *more: Column) -> Column:
    """A number in [0, 1) from the MD5 of seed and key, 52 bits."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")), *more)
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def distribution(rate: Column) -> Column:
    """Values of the Poisson distribution function at 0, 1, 2, ... up to all but 1e-16."""
    last = F.ceil(rate + 10.0 * F.sqrt(rate) + 20.0).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["c"])


def default_weights(counts: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    return counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))


def rates(documents: DataFrame, source: str = "source", weights: DataFrame | None = None, total: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """Per source: rows, weight and mean repetition rate. ``total`` rows are aimed at, by default as many as there are."""
    counts = documents.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = default_weights(counts, temperature)
    else:
        given = weights.select(F.col("source").alias("s"), F.col("weight").cast("double").alias("weight")).filter("weight > 0")
        weighted = counts.join(given, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    weights_sum, rows = weighted.agg(F.sum("weight"), F.sum("n")).first()
    aim = F.lit(float(rows or 0) if total is None else float(total))
    rate = aim * F.col("weight") / F.lit(weights_sum or 1.0) / F.col("n").cast("double")
    return weighted.select("source", "n", "weight", rate.alias("rate"))


def replicated(documents: DataFrame, per_source: DataFrame, source: str = "source", key: str = "doc_id", seed: int = SEED, copy: str = "copy", order: str = "mix_key") -> DataFrame:
    """The documents, each as often as it draws, with its copy number and shuffle key, unordered."""
    names = [free_name(documents, x) for x in ("s", "parts", "cdf", "n_copies")]
    s, parts, cdf, many = names
    part = F.ceil(F.col("rate") / F.lit(PART)).cast("int")
    table = per_source.select(
        F.col("source").alias(s), part.alias(parts), distribution(F.col("rate") / part.cast("double")).alias(cdf)
    )
    numbers = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda i: uniform(F.col(key), seed, i.cast("string")))
    draws = F.transform(numbers, lambda u: F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    drawn = documents.join(broadcast_if_few(table), F.col(source).eqNullSafe(F.col(s)))
    drawn = drawn.withColumn(many, F.aggregate(draws, F.lit(0), lambda a, b: a + b)).filter(F.col(many) > 0)
    rows = drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many))))
    return rows.withColumn(order, F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col(copy).cast("string")), "UTF-8"))).drop(*names)


def mixed(documents: DataFrame, weights: DataFrame | None = None, source: str = "source", key: str = "doc_id", total: int | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The mixture, dealt at random over all partitions and in random order within each.

    It has the columns of the documents, ``copy`` and ``mix_key``. Rows are dealt by a hash of
    the key, so no partition depends on sources or on where a document came from.
    """
    copy, order = free_name(documents, "copy"), free_name(documents, "mix_key")
    rows = replicated(documents, rates(documents, source, weights, total, temperature), source, key, seed, copy, order)
    return rows.repartition(F.col(order)).sortWithinPartitions(order)
