"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are partitioned by the number of their shingles, and a partition decides how long its
sketches are. Of an item with ``n`` shingles at least ``ceil(t * n)`` must lie in a document; if it
keeps ``n - ceil(t * n) + 1`` of them, one of these lies there too. Partitions of small items keep
that many, the smallest hashes, and miss nothing. Where it would be more than ``permutations``,
items keep the shingle that is smallest under each of so many hash functions, and one of which a
share ``t`` lies in a document is missed with probability ``(1 - t) ** permutations`` at most
(2e-10 at 0.75 and 16). However long the document is does not matter, because the item's side alone
is sampled. A document with a kept shingle is a candidate, verified with the whole sets.

Words are runs of letters and digits of the lower-cased text; a shingle has five of them. An item
of one to four words is one shingle of its own length, and documents are read in runs of that
length as well, so it is found inside longer documents; a partition of such items asks for the
width, so none costs anything if there are none.

Null and empty texts have no words and match nothing; a very long text is read in one piece.
Repeated documents each match; repeated items are separate items. An empty table of documents or of
items gives no matches. Clashing or extra columns of either side are not looked at, or kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefsignals.llm import blocks
from reliefsignals.llm.bounds import free_name, with_small_reads, written

WIDTH = 5
THRESHOLD = 0.75
PERMUTATIONS = 16
#: Items that are sent to the executors at once. A larger benchmark takes several passes, and what
#: one pass finds is written before the next is sent.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 32_000_000

MATCH = "array<struct<item_id: bigint, n_shared: bigint, n_item: bigint>>"


def _words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed words of runs of whole texts, with the offsets of the texts among them."""
    data, offsets = blocks.text_bytes(texts)
    classes, powers = blocks.byte_classes("word"), blocks.Powers()
    for first, last in blocks.spans_of_documents(offsets, blocks.WORDS_CHUNK):
        start = offsets[first]
        yield blocks.tokens(data[start : offsets[last]], offsets[first : last + 1] - start, classes, powers)


def _sets(texts: pa.Array, widths: list[int]) -> Iterator[np.ndarray]:
    """Of each text all its shingles of these widths; a text with fewer words is one shingle."""
    for words, at in _words(texts):
        made = [blocks.shingles(words, at, w) for w in widths]
        for i in range(len(at) - 1):
            parts = [values[bounds[i] : bounds[i + 1]] for values, bounds in made]
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)


class _Index:
    """Sketches of a block of items, by size, and their whole sets."""

    def __init__(self, ids: list, texts: list, width: int, permutations: int, threshold: float) -> None:
        column = pa.array(texts, pa.large_string())
        counts = np.concatenate([np.diff(at) for _, at in _words(column)]) if texts else np.zeros(0, int)
        #: Widths in which documents are read: that of shingles, and of items with fewer words.
        self.widths = [width, *sorted({int(c) for c in counts if 0 < c < width})]
        # Hashes depend on the width, so a short item is read in the width in which documents are.
        made = {w: list(_sets(column, [w])) for w in self.widths}
        sets = [np.unique(made[min(int(c), width) or width][k]) for k, c in enumerate(counts)]
        self.items = [(i, s) for i, s in zip(ids, sets) if len(s)]
        seeds = blocks.mixed(np.arange(1, permutations + 1, dtype=np.uint64))
        by_size: dict[int, list[int]] = {}
        for k, (_, s) in enumerate(self.items):
            by_size.setdefault(len(s).bit_length(), []).append(k)
        keys, owners = [], []
        for size, partition in by_size.items():
            largest = (1 << size) - 1
            certain = largest - math.ceil(threshold * largest) + 1
            for k in partition:
                s = self.items[k][1]
                if certain <= permutations:
                    kept = s[np.argsort(blocks.mixed(s ^ seeds[0]))[:certain]]
                else:
                    kept = np.unique([s[np.argmin(blocks.mixed(s ^ x))] for x in seeds])
                keys.append(kept)
                owners.append(np.full(len(kept), k))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], (np.concatenate(owners)[order] if owners else np.zeros(0, int))
        # About one in sixteen values that are no key passes this test.
        bits = min(24, max(16, (16 * len(keys)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True

    def matches(self, values: np.ndarray, threshold: float) -> list[dict]:
        likely = values[self.seen[(values >> self.shift).astype(np.int64)]]
        if not len(likely):
            return []
        low, high = np.searchsorted(self.keys, likely, "left"), np.searchsorted(self.keys, likely, "right")
        found = {int(k) for a, b in zip(low, high) if b > a for k in self.owners[a:b]}
        if not found:
            return []
        whole, out = np.unique(values), []
        for k in sorted(found):
            item, s = self.items[k]
            shared = int(np.isin(s, whole, assume_unique=True).sum())
            if shared >= threshold * len(s):
                out.append({"item_id": item, "n_shared": shared, "n_item": len(s)})
        return out


def _matcher(spark: SparkSession, ids: list, texts: list, threshold: float, width: int, permutations: int):
    sent = spark.sparkContext.broadcast((ids, texts))
    kept: dict[str, _Index] = {}
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())]))

    def match(column: pa.Array) -> pa.Array:
        if "index" not in kept:
            kept["index"] = _Index(*sent.value, width, permutations, threshold)
        index = kept["index"]
        return pa.array([index.matches(x, threshold) for x in _sets(column, index.widths)], kind)

    # Spark would evaluate a deterministic function a second time, to filter before exploding.
    return F.arrow_udf(match, MATCH).asNondeterministic()


def matchers(
    spark: SparkSession,
    items: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    width: int = WIDTH,
    permutations: int = PERMUTATIONS,
    block_items: int = BLOCK_ITEMS,
) -> Iterator[tuple[Callable[[Column], Column], bool]]:
    """For each block of items a function from a text column to the items contained, as an array of
    structs, and whether it is the last.

    Blocks have at most ``block_items`` items and about ``BLOCK_CHARS`` characters; the driver holds
    one at a time. Items with a null id keep the null.
    """
    with_small_reads(spark)
    wanted = items.select(F.col(item_id).cast("long").alias("i"), F.lower(F.col(item_text)).alias("t"))
    block, chars = [], 0

    def made() -> Callable[[Column], Column]:
        find = _matcher(spark, [r[0] for r in block], [r[1] for r in block], threshold, width, permutations)
        return lambda text: find(F.lower(text))

    for row in wanted.toLocalIterator():
        if len(block) == block_items or chars > BLOCK_CHARS:
            yield made(), False
            block, chars = [], 0
        block.append(row)
        chars += len(row[1] or "")
    yield made(), True


def contamination(spark: SparkSession, documents: DataFrame, items: DataFrame, id_column: str = "doc_id", **settings) -> DataFrame:
    """One row per document and contained item: ``doc_id, item_id, n_shared, n_item, containment``."""
    found = None
    for find, last in matchers(spark, items, **settings):
        rows = documents.select(F.col(id_column).alias("doc_id"), find(F.col("text")).alias("m")).select("doc_id", F.inline("m"))
        rows = rows if last else written(spark, rows, "contamination")
        found = rows if found is None else found.union(rows)
    return found.withColumn("containment", F.col("n_shared").cast("double") / F.col("n_item").cast("double"))


def without_contaminated(spark: SparkSession, documents: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents, all columns, that contain no benchmark item."""
    name = free_name(documents, "found")
    for find, last in matchers(spark, items, **settings):
        kept = documents.withColumn(name, F.size(find(F.col("text")))).filter(F.col(name) == 0).drop(name)
        documents = kept if last else written(spark, kept, "decontaminated")
    return documents
