"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL updates.

A text is cut into words and runs of one mark. Its features are its single tokens and its
pairs of neighbours, hashed into ``2 ** BITS`` places; a pair of equal tokens is one feature
of its own ("repeats itself"), whatever the token. Counts are damped (log1p) and scaled to
length one, so texts of any length compare. The score is the logistic function of a sparse
dot product with the weights.

Training takes at most about ``MAX_LABELLED`` labelled rows, chosen by a hash of their id,
as stated by the parameter; every unlabelled row is left out and every row is scored. The
labelled rows are dealt to shards, each shard is passed ``EPOCHS`` times by the
follow-the-regularised-leader rule, and the shards' weights are averaged in Spark. Only the
averaged weights, at most ``2 ** BITS`` numbers, come to the driver.

Null and empty texts have no features: their score is that of the intercept. Rows without a
label (null) are not learned from. Repeated rows count as often as they occur. Without any
labelled row all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefsignals.llm import blocks
from reliefsignals.llm.bounds import free_name, with_small_reads

BITS = 18
MAX_LABELLED = 20_000
SHARD_ROWS = 5_000
EPOCHS = 6
KEEP_SCORE = 0.3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.001, 0.0


def features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and values of each text's features; the last place is the intercept."""
    data, offsets = blocks.text_bytes(texts)
    classes, powers, shift = blocks.byte_classes("token"), blocks.Powers(), np.uint64(64 - bits)
    repeat = blocks.mixed(np.full(1, 77, np.uint64))[0]
    for first, last in blocks.spans_of_documents(offsets, blocks.WORDS_CHUNK):
        start = offsets[first]
        h, at = blocks.tokens(data[start : offsets[last]], offsets[first : last + 1] - start, classes, powers)
        pairs = blocks.mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        pairs[h[:-1] == h[1:]] = repeat
        single, pairs = (h >> shift).astype(np.int64), (pairs >> shift).astype(np.int64)
        for low, high in zip(at[:-1], at[1:]):
            place, count = np.unique(np.concatenate((single[low:high], pairs[low : max(low, high - 1)])), return_counts=True)
            value = np.log1p(count)
            if len(value):
                value /= np.sqrt(np.dot(value, value))
            yield np.append(place, 1 << bits), np.append(value, 1.0)


def follow_the_leader(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after FTRL-proximal updates over the examples, in their order."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for place, value, label in examples:
            zi, ni = z[place], n[place]
            w = weights(zi, ni)
            g = (1.0 / (1.0 + np.exp(-np.dot(w, value))) - label) * value
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[place], n[place] = zi + g - step * w, ni + g * g
    return weights(z, n)


def train(labelled: DataFrame, label: str = "label", text: str = "text", key: str = "doc_id", bits: int = BITS) -> np.ndarray:
    """Averaged weights from a frame of labelled texts (see ``sampled`` for the bound)."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("int").alias("y")).filter("y is not null")
    shards = max(1, -(-rows.count() // SHARD_ROWS))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(o=blocks.mixed(group["k"].fillna(0).to_numpy(np.int64).view(np.uint64))).sort_values(["o", "y", "t"])
        x = features(pa.array(group["t"], pa.large_string(), from_pandas=True), bits)
        w = follow_the_leader([(p, v, y) for (p, v), y in zip(x, group["y"].tolist())], bits)
        place = np.flatnonzero(w)
        return pd.DataFrame({"place": place, "weight": w[place]})

    fitted = (
        rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "k"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(fit, "place bigint, weight double")
        .groupBy("place")
        .agg((F.sum("weight") / F.lit(float(shards))).alias("weight"))
    )
    # As an Arrow table: as rows the weights take ten times the memory in the driver.
    weights, table = np.zeros((1 << bits) + 1), fitted.toArrow()
    weights[table["place"].to_numpy()] = table["weight"].to_numpy()
    return weights


def sampled(labels: DataFrame, key: str = "doc_id", limit: int = MAX_LABELLED) -> DataFrame:
    """About ``limit`` rows of the labels at most, by a hash of their key; all of them if fewer."""
    n = labels.count()
    return labels if n <= limit else labels.filter(F.pmod(F.xxhash64(F.lit(2), F.col(key)), F.lit(n)) < limit)


def scorer(spark: SparkSession, weights: np.ndarray, bits: int = BITS) -> Callable[[Column], Column]:
    """A function from a text column to its score, between 0 and 1."""
    sent = spark.sparkContext.broadcast(weights)

    def score(column: pa.Array) -> pa.Array:
        w = sent.value
        logit = np.fromiter((np.dot(w[p], v) for p, v in features(column, bits)), float)
        return pa.array(1.0 / (1.0 + np.exp(-logit)), pa.float64())

    return F.arrow_udf(score, "double")


def held_out(key: str | Column = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fitted_scorer(spark: SparkSession, documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Callable[[Column], Column]:
    """Learn ``labels.quality`` from the documents that are not held out."""
    with_small_reads(spark)
    known = labels.select("doc_id", F.col("quality").alias("label")).filter(F.col("label").isNotNull() & ~held_out())
    chosen = F.broadcast(sampled(known, limit=limit))
    return scorer(spark, train(documents.select("doc_id", "text").join(chosen, "doc_id")))


def scores(spark: SparkSession, documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    score = fitted_scorer(spark, documents, labels, limit)
    rows = documents.select("doc_id", held_out().alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= KEEP_SCORE).cast("int"))


def of_quality(spark: SparkSession, documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """The documents, all columns, whose score is at least ``KEEP_SCORE``."""
    score, name = fitted_scorer(spark, documents, labels, limit), free_name(documents, "score")
    return documents.withColumn(name, score(F.col("text"))).filter(F.col(name) >= KEEP_SCORE).drop(name)
