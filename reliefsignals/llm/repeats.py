"""Which hashes repeat in the corpus, as Bloom filters of fixed size.

Map tasks send the hashes of their rows in packed runs, one per range of hashes; one task per
range counts them exactly and returns its slice of the filter. The filter has ``2 ** BITS``
bits whatever the input, so it may be collected and broadcast. Bits are shared between
hashes: a lookup may say "repeated" of a hash that is not, never the other way round. Users of
the filter decide exactly afterwards, so a full filter costs time, not results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefsignals.llm import blocks

#: 16 MB of bits.
BITS = 27
#: Bits that stand for one hash.
PROBES = 3
#: Bits that tell the hashes of one range apart; callers with whole texts behind them send fewer.
NAME_BITS = 32
#: Text bytes that one range of hashes stands for.
RANGE_BYTES = 4_000_000
MOST_RANGES = 1 << 20


def ranges_for(documents: DataFrame, text: str = "text") -> int:
    """Number of hash ranges, a power of two, in proportion to all text bytes."""
    total = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return 1 << min(MOST_RANGES.bit_length() - 1, max(4, (total // RANGE_BYTES).bit_length()))


def planes(values: np.ndarray) -> bytes:
    """Compressed integers: bytes of equal weight side by side, after their number."""
    body = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def from_planes(packed: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    body = np.frombuffer(pa.decompress(packed[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(body.reshape(size, n).T).view(kind).ravel()


def _names(hashes: np.ndarray, bits: int, name_bits: int) -> np.ndarray:
    """The ``name_bits`` bits below the ``bits`` of the range number."""
    return (hashes >> np.uint64(64 - name_bits - bits)) & np.uint64((1 << name_bits) - 1)


def split(hashes: np.ndarray, ranges: int, level: int, name_bits: int = NAME_BITS) -> Iterator[tuple[int, bytes]]:
    """Runs of sorted hashes, ``name_bits`` bits below the range number, as ``(range, packed)``.

    A hash is sent ``level`` times at most: that decides whether it reaches the level just as
    well, and a hash of every document is a few numbers from each part. Hashes of one name count
    together, so fewer bits only make more of them look repeated.
    """
    bits = ranges.bit_length() - 1
    ordered, many = np.unique(hashes, return_counts=True)
    ordered = np.repeat(ordered, np.minimum(many, level))
    cuts = np.searchsorted(ordered, np.arange(ranges, dtype=np.uint64) << np.uint64(64 - bits))
    cuts = np.append(cuts, len(ordered))
    names = _names(ordered, bits, name_bits).astype(np.uint32)
    for r in np.flatnonzero(np.diff(cuts)):
        run = names[cuts[r] : cuts[r + 1]]
        yield int(r), planes(np.diff(run, prepend=np.uint32(0)))


def _places(names: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The ``PROBES`` bits that stand for a hash in the slice of its range."""
    spread = blocks.mixed(names.astype(np.uint64))
    for probe in range(PROBES):
        yield (blocks.mixed(spread + np.uint64(probe)) >> np.uint64(64 - width)).astype(np.int64)


class Repeated:
    """Hashes that occur so often at least; one slice of ``2 ** width`` bits for each range."""

    def __init__(self, ranges: int, width: int, name_bits: int = NAME_BITS) -> None:
        self.bits, self.width, self.name_bits = ranges.bit_length() - 1, width, name_bits
        self.marks = np.zeros(ranges << (width - 3), np.uint8)

    def plain(self) -> tuple[int, int, bytes, int]:
        """What ``of`` makes the same filter from, compressed: workers need no class of this package to read it."""
        return 1 << self.bits, self.width, pa.compress(self.marks, codec="zstd", asbytes=True), self.name_bits

    @classmethod
    def of(cls, plain: tuple[int, int, bytes, int]) -> Repeated:
        one = cls.__new__(cls)
        one.bits, one.width, one.name_bits = plain[0].bit_length() - 1, plain[1], plain[3]
        one.marks = np.frombuffer(pa.decompress(plain[2], plain[0] << (plain[1] - 3), codec="zstd", asbytes=True), np.uint8)
        return one

    def fill(self, number: int, part: pa.Buffer) -> None:
        size = 1 << (self.width - 3)
        self.marks[number * size : (number + 1) * size] = np.frombuffer(pa.decompress(part, size, codec="zstd"), np.uint8)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        names = _names(hashes, self.bits, self.name_bits)
        base = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) << self.width
        found = np.ones(len(hashes), bool)
        for place in _places(names, self.width):
            at = base + place
            found &= (self.marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return found


def repeated(runs: DataFrame, ranges: int, levels: tuple[int, ...], bits: int = BITS, name_bits: int = NAME_BITS) -> list[Repeated]:
    """For each level, the hashes that occur so often at least. ``runs``: ``range, packed``, split with ``name_bits``."""
    width = max(3, bits - (ranges.bit_length() - 1))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(np.concatenate([np.cumsum(from_planes(p, np.uint32), dtype=np.uint32) for p in group["packed"]]))
        first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        many = np.diff(np.append(first, len(names)))
        slices = []
        for level in levels:
            marks = np.zeros(1 << width, np.uint8)
            for place in _places(names[first[many >= level]], width):
                marks[place] = 1
            slices.append(pa.compress(np.packbits(marks), codec="zstd", asbytes=True))
        return pd.DataFrame({"range": [int(group["range"].iloc[0])], "slices": [slices]})

    whole = [Repeated(ranges, width, name_bits) for _ in levels]
    # Slices pass the driver's JVM compressed and as Arrow batches: its heap grows by arrays of half a MB and more.
    for batch in runs.groupBy("range").applyInPandas(count, "range int, slices array<binary>").toArrow().to_batches():
        for number, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
            for one, part in zip(whole, parts.values):
                one.fill(number, part.as_buffer())
    return whole
