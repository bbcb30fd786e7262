"""Removal of repeated passages by a distributed difference-cover suffix sort, cut at 50 bytes.

Only the first ``WINDOW`` bytes of suffixes are ever compared, so the suffixes need to be
sorted to that depth and no further. The difference cover has the period ``PERIOD`` rather
than 3: any two positions have an equal shift below ``PERIOD`` that takes both into the cover
``COVER``, a perfect difference set. This makes the sample small (6 positions of 31) and one
level of recursion enough.

1. Exact copies of a whole text are settled by a hash of the text; one original goes on.
2. The sampled suffixes are named by their first ``NAME = WINDOW - PERIOD + 1`` bytes and sorted
   by name in ranges. Names that occur in two originals or more are kept, as a Bloom filter.
3. Recursion: a suffix of any residue can only agree with another to ``WINDOW`` bytes if a
   sampled suffix in its first ``PERIOD`` positions has a repeated name. Those suffixes are
   merged: dealt to ranges as runs of text, named there by ``WINDOW`` bytes and sorted by name.
   Of adjacent equal names all but those of the smallest document start a repeated passage.
4. Starts go back to their documents, where overlapping passages become maximal runs.

Names are 64-bit hashes of the bytes, not ranks: equality is all that is asked of them. No
document, passage or name is left out or capped. Ranges of names, and with them tasks, grow
with the text; rows between tasks hold packed runs, so a passage of a million documents is
many numbers but few rows.

A null text has no bytes. Texts under ``WINDOW`` bytes are never cut. Repeated rows with one id
are one document's copies: they do not cut each other but are cut alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefsignals.llm import blocks, repeats
from reliefsignals.llm.bounds import broadcast_if_few, with_small_batches, written

WINDOW = 50
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
NAME = WINDOW - PERIOD + 1
#: Spans that are sent to every executor at most when texts are cut.
SENT_SPANS = 2_000_000


def _positions(offsets: np.ndarray) -> np.ndarray:
    """Position of each byte in its document."""
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


def _room(offsets: np.ndarray, width: int) -> np.ndarray:
    """Whether ``width`` bytes of the same document start at each byte."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(offsets[-1]) + width <= ends


def _sample(offsets: np.ndarray) -> np.ndarray:
    covered = np.zeros(PERIOD, bool)
    covered[list(COVER)] = True
    return covered[_positions(offsets) % PERIOD] & _room(offsets, NAME)


def _padded(data: np.ndarray, width: int) -> np.ndarray:
    return blocks.window_hashes(np.concatenate((data, np.zeros(width - 1, np.uint8))), width)


def _runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = blocks.text_bytes(column)
    for first, last in blocks.spans_of_documents(offsets):
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


def _sampled_names(texts: DataFrame, ranges: int) -> DataFrame:
    schema = pa.schema([("range", pa.int32()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches):
            names = []
            for _, data, offsets in _runs(batch.column(0)):
                at = np.flatnonzero(_sample(offsets))
                hashes, cuts = _padded(data, NAME)[at], np.searchsorted(at, offsets)
                names += [np.unique(hashes[low:high]) for low, high in zip(cuts[:-1], cuts[1:]) if high > low]
            if names:
                rows = list(repeats.split(np.concatenate(names), ranges, 2))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    return texts.mapInArrow(run, "range int, packed binary")


_RUNS = "range int, docs binary, each binary, starts binary, counts binary, texts binary"


def _least(grams: np.ndarray) -> np.ndarray:
    """For each position the smallest of the ``PERIOD`` hashes from there on."""
    size, least = 1, np.concatenate((grams, np.full(PERIOD - 1, 2**64 - 1, np.uint64)))
    while 2 * size <= PERIOD:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    return np.minimum(least[: len(grams)], least[PERIOD - size : PERIOD - size + len(grams)])


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before in any column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, ...`` of each run, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(lengths.sum())


def _packed(target: np.ndarray, docs: np.ndarray, starts: np.ndarray, counts: np.ndarray, text: np.ndarray | None = None) -> Iterator[tuple]:
    """One row per target with its runs ``(doc, start, count)``, and their bytes one after the other."""
    order = np.argsort(target, kind="stable")
    if text is not None:
        lengths = counts + (WINDOW - 1)
        text = text[_spread((np.cumsum(lengths) - lengths)[order], lengths[order])]
        ends = np.concatenate(([0], np.cumsum(lengths[order])))
    target, docs, starts, counts = target[order], docs[order], starts[order], counts[order]
    cuts = np.append(np.flatnonzero(_firsts(target)), len(target))
    for low, high in zip(cuts[:-1], cuts[1:]):  # none for no rows
        d, new = docs[low:high], np.flatnonzero(_firsts(docs[low:high]))
        yield (
            int(target[low]),
            repeats.planes(d[new]),
            repeats.planes(np.diff(np.append(new, len(d))).astype(np.uint32)),
            repeats.planes(np.diff(starts[low:high].astype(np.uint32), prepend=np.uint32(0))),
            repeats.planes(counts[low:high].astype(np.uint32)),
            b"" if text is None else repeats.planes(text[ends[low] : ends[high]]),
        )


def _unpacked(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and count of all runs of a group of rows."""
    docs = [np.repeat(repeats.from_planes(d, np.int64), repeats.from_planes(n, np.uint32)) for d, n in zip(group["docs"], group["each"])]
    starts = [np.cumsum(repeats.from_planes(s, np.uint32), dtype=np.uint32) for s in group["starts"]]
    counts = [repeats.from_planes(c, np.uint32) for c in group["counts"]]
    return np.concatenate(docs), np.concatenate(starts).astype(np.int64), np.concatenate(counts).astype(np.int64)


def _known_later(names: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs whose whole text a smaller document of the same part has too."""
    order = np.lexsort((docs, names))
    first = np.flatnonzero(_firsts(names[order]))
    least = np.repeat(docs[order][first], np.diff(np.append(first, len(names))))
    later = np.zeros(len(names), bool)
    later[order] = docs[order] > least
    # The names of a run's first and last suffix cover all its bytes up to this length.
    return later & (counts <= WINDOW)


def _suffix_runs(originals: DataFrame, sent: Broadcast, ranges: int, parts_of_docs: int) -> DataFrame:
    """All suffixes that may start a repeated passage, cut at ``WINDOW`` bytes.

    Suffixes that follow each other and have the same smallest hash of ``NAME`` bytes go to
    one place as one run of text, which is a few bytes for each. Equal suffixes have equal
    smallest hashes, so they meet. Of equal runs in one part of the input only that of the
    smallest document is sent: the others are known to be repeated, and go on as such under
    a number above the ranges. A passage that every document has is thus one run per part.
    """
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    schema = pa.schema([("range", pa.int32()), *[(x, pa.binary()) for x in ("docs", "each", "starts", "counts", "texts")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_repeated = repeats.Repeated.of(sent.value)
        for batch in blocks.slices(batches):
            ids, parts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), []
            for first, data, offsets in _runs(batch.column(1)):
                if not len(data):
                    continue
                grams, known = _padded(data, NAME), np.zeros(len(data) + PERIOD, np.int32)
                at = np.flatnonzero(_sample(offsets))
                known[at] = names_repeated.contains(grams[at])
                total = np.concatenate(([0], np.cumsum(known, dtype=np.int32)))
                near = total[PERIOD : PERIOD + len(data)] - total[: len(data)] > 0
                at = np.flatnonzero(near & _room(offsets, WINDOW))
                if not len(at):
                    continue
                doc, key = np.searchsorted(offsets, at, "right") - 1, blocks.mixed(_least(grams)[at] + np.uint64(1))
                new = np.flatnonzero(_firsts(at - np.arange(len(at)), key, doc))
                counts, start = np.diff(np.append(new, len(at))), at[new]
                text, windows = data[_spread(start, counts + (WINDOW - 1))], _padded(data, WINDOW)
                names = blocks.mixed(windows[start] + blocks.mixed(windows[start + counts - 1]) + counts.astype(np.uint64))
                parts.append(((key[new] >> shift).astype(np.int32), ids[first + doc[new]], start - offsets[doc[new]], counts, text, names))
            if parts:
                target, docs, starts, counts, text, names = [np.concatenate(x) for x in zip(*parts)]
                later = _known_later(names, docs, counts)
                text = text[np.repeat(~later, counts + (WINDOW - 1))]
                known = ranges + _part(docs[later], parts_of_docs)
                rows = list(_packed(target[~later], docs[~later], starts[~later], counts[~later], text))
                rows += list(_packed(known, docs[later], starts[later], counts[later]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    return originals.mapInArrow(run, _RUNS)


def _part(docs: np.ndarray, parts: int) -> np.ndarray:
    return (blocks.mixed(docs.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _passage_starts(runs: DataFrame, ranges: int, parts: int) -> DataFrame:
    """Suffixes that also occur in a smaller document, as runs, dealt by document."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        if group["range"].iloc[0] >= ranges:
            return group.assign(range=group["range"] - ranges)
        docs, starts, counts = _unpacked(group)
        text = np.concatenate([repeats.from_planes(x, np.uint8) for x in group["texts"]])
        lengths = counts + (WINDOW - 1)
        names = blocks.window_hashes(text, WINDOW)[_spread(np.cumsum(lengths) - lengths, counts)]
        docs, starts = np.repeat(docs, counts), _spread(starts, counts)
        order = np.argsort(names)
        first = np.flatnonzero(_firsts(names[order]))
        least = np.repeat(np.minimum.reduceat(docs[order], first), np.diff(np.append(first, len(names))))
        later = np.zeros(len(names), bool)
        later[order] = docs[order] > least
        docs, starts = docs[later], starts[later]
        if not len(docs):
            return pd.DataFrame([], columns=["range", "docs", "each", "starts", "counts", "texts"])
        new = np.flatnonzero(_firsts(docs, starts - np.arange(len(starts))))
        counts = np.diff(np.append(new, len(docs)))
        docs, starts = docs[new], starts[new]
        return pd.DataFrame(list(_packed(_part(docs, parts), docs, starts, counts)), columns=["range", "docs", "each", "starts", "counts", "texts"])

    return runs.groupBy("range").applyInPandas(compare, _RUNS)


def _spans(starts: DataFrame) -> DataFrame:
    """``doc_id, starts, ends``: maximal runs of bytes to remove, in order."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        docs, starts, counts = _unpacked(group)
        ends = starts + counts + (WINDOW - 1)
        order = np.lexsort((starts, docs))
        docs, starts, ends = docs[order], starts[order], ends[order]
        # Runs start in order and none is longer than the furthest end so far, kept per document.
        shift = (np.cumsum(_firsts(docs)) - 1) * (int(ends.max()) + 1)
        furthest = np.maximum.accumulate(ends + shift) - shift
        new = _firsts(docs)
        new[1:] |= starts[1:] > furthest[:-1]
        low = np.flatnonzero(new)
        begins, last, owner = starts[low], furthest[np.append(low[1:], len(starts)) - 1], docs[low]
        cuts = np.append(np.flatnonzero(_firsts(owner)), len(owner))
        rows = [(int(owner[a]), begins[a:b].tolist(), last[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]
        return pd.DataFrame(rows, columns=["doc_id", "starts", "ends"])

    return starts.groupBy("range").applyInPandas(merge, "doc_id bigint, starts array<int>, ends array<int>")


def repeated_spans(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """``doc_id, starts, ends`` of all documents (``doc_id, text``) with passages of smaller documents.

    A null id counts as smaller than all others.
    """
    with_small_batches(spark)
    slim = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = slim.filter(F.octet_length("text") >= WINDOW).select(
        "doc_id", F.octet_length("text").alias("size"), F.sha2(F.encode("text", "UTF-8"), 256).alias("h")
    )
    firsts = hashed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    copies = written(spark, hashed.join(firsts, "h").filter("doc_id > first").select("doc_id", "size"), "copies")
    originals = slim.join(broadcast_if_few(copies.select("doc_id")), "doc_id", "left_anti")

    ranges = repeats.ranges_for(slim)
    (found,) = repeats.repeated(_sampled_names(originals.select("text"), ranges), ranges, (2,))
    sent = spark.sparkContext.broadcast(found.plain())
    del found
    parts = max(16, ranges // 8)
    runs = _suffix_runs(originals.select("doc_id", "text"), sent, ranges, parts)
    spans = _spans(_passage_starts(runs, ranges, parts))
    whole = copies.distinct().select("doc_id", F.array(F.lit(0)).alias("starts"), F.array(F.col("size").cast("int")).alias("ends"))
    found = written(spark, spans.union(whole), "spans")
    sent.destroy()
    return found


def without_repeats(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) of every document."""
    spans = repeated_spans(spark, documents)
    total = spans.agg(F.sum(F.size("starts"))).first()[0] or 0
    sent = broadcast_if_few(spans) if total <= SENT_SPANS else spans
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = documents.select("doc_id", data.alias("data"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"))
    joined = rows.join(sent.withColumnRenamed("doc_id", "key"), "key", "left")
    size, n = F.octet_length("data").cast("long"), F.size("starts")

    def keep(kept, i):
        begin = F.when(i == 0, 0).otherwise(F.get("ends", i - 1))
        end = F.when(i == n, F.octet_length("data")).otherwise(F.get("starts", i))
        return F.concat(kept, F.substring("data", begin + 1, end - begin))

    rest = F.aggregate(F.sequence(F.lit(0), n), F.lit(b""), keep)
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return joined.select(
        "doc_id",
        size.alias("n_bytes"),
        F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"),
        F.when(F.col("starts").isNull(), 0).otherwise(n).cast("long").alias("n_spans"),
        F.when(F.col("starts").isNull(), F.col("data")).otherwise(rest).alias("kept"),
    )


def digests(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    cut = without_repeats(spark, documents)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
