"""Hashing of whole Arrow text columns with numpy: words, shingles, byte windows.

A column is handled as one byte array with document offsets, so the cost per document is
small and no Python object is made per word. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
#: Text bytes that are cut into words at once: each takes some 60 bytes of arrays meanwhile.
WORDS_CHUNK = 1 << 17
#: Text bytes that a task turns into hashes before it passes them on.
SLICE_BYTES = 8_000_000
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=_U) * _U(_ODD)) | _U(1)


def byte_classes(kind: str) -> np.ndarray:
    """Class of each byte; 0 separates, a change of class starts a new token.

    ``space``: everything but ASCII white space is one class. ``word``: ASCII letters, digits
    and all bytes of other letters are one class, the rest separates. ``token``: as ``word``,
    but each mark is a class of its own, so that runs of one mark are tokens.
    """
    classes = np.zeros(256, np.uint8)
    white = [0x20, *range(0x09, 0x0E)]
    if kind == "space":
        classes[:] = 1
    else:
        if kind == "token":
            classes[:] = np.maximum(2, np.arange(256))
        for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
            classes[low : high + 1] = 1
    classes[white] = 0
    return classes


def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offsets of the texts; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``SLICE_BYTES`` each, which bounds what a task holds at once."""
    held, size = [], 0
    for batch in batches:
        rows = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
        for first in range(0, batch.num_rows, rows):
            held.append(batch.slice(first, rows))
            size += held[-1].nbytes
            if size >= SLICE_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def spans_of_documents(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``size`` bytes; a longer document is a run by itself."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


class Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, as long as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, WORDS_CHUNK)
            self.up = np.concatenate(([_U(1)], np.cumprod(np.full(n, _ODD, _U))))
            self.down = np.concatenate(([_U(1)], np.cumprod(np.full(n, pow(_ODD, -1, 2**64), _U))))


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, and the offsets of the documents among them."""
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    powers.to(n)
    kind = classes[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    edges = np.flatnonzero(edge)
    starts, ends = edges[:-1], edges[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    total = np.concatenate(([_U(0)], np.cumsum(BYTE_VALUES[data] * powers.up[:n])))
    hashes = mixed((total[ends] - total[starts]) * powers.down[starts] + (ends - starts).astype(_U))
    return hashes, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row within each document and the documents' offsets.

    A document with fewer words, but at least one, has its whole sequence as one shingle.
    """
    counts = np.diff(offsets)
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(many)))
    first = np.repeat(offsets[:-1] - bounds[:-1], many) + np.arange(bounds[-1])
    length = np.repeat(np.minimum(counts, width), many)
    h = np.zeros(len(first), _U)
    padded = np.concatenate((words, np.zeros(width, _U)))
    for j in range(width):
        h = h * _U(_ODD) + np.where(j < length, padded[first + j], _U(0))
    return mixed(h + length.astype(_U)), bounds


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes that start at each position but the last ``width - 1``."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out, done, part, size = None, 0, BYTE_VALUES[data], 1
    while True:
        if width & size:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * _U(pow(_ODD, size, 2**64)) + piece
            done += size
        if size * 2 > width:
            return mixed(out)
        part = part[:-size] * _U(pow(_ODD, size, 2**64)) + part[size:]
        size *= 2
