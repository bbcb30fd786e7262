"""Data skipping for text search: Bloom signatures of folded trigrams per block of rows.

A block is a run of neighbouring rows of one file, cut after about ``BLOCK_BYTES`` of text. Its
signature has a bit for every three bytes in a row that occur in its case-folded texts. A text that
contains the searched one contains all its trigrams, so a block that lacks one of their bits holds
no match. Only the files of the blocks that are left are opened, and in them only the blocks'
ranges of time are read: published files are sorted by time, so row groups and pages are skipped.
On what has been read, the search itself decides.

Signatures are about 1.5 % of the text. They never lose a match; shared bits only widen the choice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructType, TimestampNTZType

from reliefsignals.functions.text import fold
from reliefsignals.operators.filters import Filters
from reliefsignals.schema import Dataset, Published

BITS = 1 << 15
BLOCK_BYTES = 1 << 18
BLOCK_ROWS = 4096
#: Blocks named in a plan at most. Where more may match, the text is too common to skip anything.
MOST_BLOCKS = 2_000
#: Ranges of time in a plan at most; those with the smallest gaps between them are joined.
MOST_RANGES = 64
TEXTS = ("tweet_clean", "tweet")
TIME = "created_at_local"

SIGNATURE = (
    StructType()
    .add("file", StringType())
    .add("n_rows", LongType())
    .add("first", TimestampNTZType())
    .add("last", TimestampNTZType())
    .add("untimed", BooleanType())
    .add("bits", ArrayType(LongType()))
)


def _trigrams(bits: int) -> Callable[[bytes], np.ndarray]:
    shift = np.uint32(33 - bits.bit_length())

    # Nested, so that it travels to the workers by value and they need no package.
    def positions(data: bytes) -> np.ndarray:
        """The bits that stand for the trigrams of a text's bytes; those with a zero byte have none."""
        a = np.frombuffer(data, np.uint8).astype(np.uint32)
        if len(a) < 3:
            return np.zeros(0, np.uint32)
        x, y, z = a[:-2], a[1:-1], a[2:]
        grams = (x << np.uint32(16) | y << np.uint32(8) | z)[(x > 0) & (y > 0) & (z > 0)]
        return (grams * np.uint32(2654435761)) >> shift

    return positions


trigram_bits = _trigrams(BITS)


def signatures(messages: DataFrame, day: str = "local_day") -> DataFrame:
    """A row per block of a table's files: file, rows, range of time, signature, and the day it lies in.

    The folding is done by Spark; only folded texts go to Python, in the order of the files.
    """
    texts = [c for c in TEXTS if c in messages.columns]
    time = F.col(TIME) if TIME in messages.columns else F.lit(None)
    # A zero byte keeps the two texts of a row apart.
    folded = F.concat_ws("\0", *[fold(F.col(c)) for c in texts]) if texts else F.lit("")
    rows = messages.select(
        F.regexp_extract("_metadata.file_path", "/(version=[^/]*/.*)$", 1).alias("file"), time.cast("timestamp_ntz").alias("t"), folded.alias("text"), F.col(day).alias(day)
    )
    kinds = [("file", pa.string()), ("n_rows", pa.int64()), ("first", pa.timestamp("us")), ("last", pa.timestamp("us"))]
    schema = pa.schema([*kinds, ("untimed", pa.bool_()), ("bits", pa.list_(pa.int64())), (day, pa.date32())])
    bits, block_bytes, block_rows, positions = BITS, BLOCK_BYTES, BLOCK_ROWS, trigram_bits

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held)
        marks = np.zeros(bits, np.uint8)
        marks[positions("\0\0".join(part["text"].to_pylist()).encode())] = 1
        span = pc.min_max(part["t"]).as_py()
        words = np.packbits(marks, bitorder="little").view(np.int64)
        values = [part["file"][0].as_py(), part.num_rows, span["min"], span["max"], part["t"].null_count > 0, words.tolist(), part[day][0].as_py()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, many = [], 0, 0
        for batch in batches:
            files, days = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            lengths = pc.binary_length(batch.column(2)).to_pylist()
            first = 0
            for i in range(batch.num_rows + 1):
                last = i == batch.num_rows
                new = not last and held and i == first and (files[i], days[i]) != (held[0].column(0)[0].as_py(), held[0].column(3)[0].as_py())
                turn = not last and i > first and (files[i], days[i]) != (files[i - 1], days[i - 1])
                full = size >= block_bytes or many >= block_rows
                if (last or turn or full) and i > first:
                    held.append(batch.slice(first, i - first))
                    first = i
                if held and (new or turn or full):
                    yield row(held)
                    held, size, many = [], 0, 0
                if not last:
                    size, many = size + lengths[i], many + 1
        if held:
            yield row(held)

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SIGNATURE.fields)
    return rows.mapInArrow(run, f"{names}, {day} date")


def needle_of(filters: Filters | None) -> bytes:
    return ((filters.search if filters else None) or "").strip().casefold().encode()


def may_contain(bits: Column, needle: bytes) -> Column:
    """Whether a block with these bits may hold a text with the needle in it."""
    words: dict[int, int] = {}
    for p in np.unique(trigram_bits(needle)).tolist():
        words[p >> 6] = words.get(p >> 6, 0) | 1 << (p & 63)
    found = F.lit(True)
    for word, mask in words.items():
        mask = F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")
        found = found & (F.element_at(bits, word + 1).bitwiseAND(mask) == mask)
    return found


def blocks_for(dataset: Published, filters: Filters) -> DataFrame:
    """The blocks that may hold a match: ``file, n_rows, first, last, untimed``."""
    return dataset.signatures.where(may_contain(F.col("bits"), needle_of(filters))).drop("bits")


def _ranges(spans: list[tuple], most: int) -> list[tuple]:
    """The spans, joined where they overlap and, beyond so many, across the smallest gaps."""
    joined: list[list] = []
    for low, high in sorted(spans):
        if joined and low <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    if len(joined) > most:
        gaps = sorted(range(1, len(joined)), key=lambda i: joined[i - 1][1] - joined[i][0])[: most - 1]
        cuts = [0, *sorted(gaps), len(joined)]
        joined = [[joined[a][0], joined[b - 1][1]] for a, b in zip(cuts, cuts[1:])]
    return [tuple(x) for x in joined]


def narrowed(dataset: Dataset, filters: Filters | None) -> Dataset:
    """The dataset with only the files and times that may hold a match of ``filters.search``.

    It is the dataset itself where there are no signatures, no text of three bytes is searched,
    or more than ``MOST_BLOCKS`` blocks may match.
    """
    if not isinstance(dataset, Published) or dataset.signatures is None or not dataset.untouched:
        return dataset
    if not len(trigram_bits(needle_of(filters))):
        return dataset
    found = blocks_for(dataset, filters).limit(MOST_BLOCKS + 1).collect()
    if len(found) > MOST_BLOCKS:
        return dataset
    # Spark gives the names of files as parts of addresses.
    files = sorted({unquote(r.file) for r in found})
    frame = dataset.of_files(files)
    if TIME in frame.columns and files:
        inside = F.lit(False)
        for low, high in _ranges([(r.first, r.last) for r in found if r.first is not None], MOST_RANGES):
            inside = inside | F.col(TIME).between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))
        if any(r.untimed for r in found):
            inside = inside | F.col(TIME).isNull()
        frame = frame.where(inside)
    return replace(dataset, frame=frame)
