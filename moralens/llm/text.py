"""Word hashes and byte views of Arrow text columns, vectorised over whole batches.

A batch is cut into slices of bounded bytes, so that memory follows the slice and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so powers of it have inverses modulo 2^64
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def free_name(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it, so that a helper column takes no one's place."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def normalised(text: Column) -> Column:
    """Lower-cased words (letters, marks and digits) joined by single spaces; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base & ((1 << 64) - 1), dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins and ends in them. NULL is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return flat, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay near ``limit``; a longer row is a range of its own."""
    start = 0
    n = len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def words_of(text: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without spaces) of some rows, and where each begins and ends.

    ``rows`` are the rows' offsets in ``text``; no word crosses them.
    """
    solid = text != 32
    # a row's first byte starts a word even where the row before ended in one
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    edge = rows[:-1][(rows[:-1] < len(text))]
    starts[edge] = solid[edge]
    begins = np.flatnonzero(starts)
    breaks = np.zeros(len(text) + 1, dtype=bool)
    breaks[:-1] |= ~solid
    breaks[rows] = True
    stops = np.flatnonzero(breaks)
    ends = stops[np.searchsorted(stops, begins, side="right")]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(text)), out=sums[1:])
        hashes = (sums[ends] - sums[begins]) * powers(BASE_INVERSE, len(text))[begins]
    return mixed(hashes), begins, ends


def word_hashes(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a slice, and row offsets into them.

    ``flat`` and ``offsets`` belong to the batch: ``offsets[0]`` is where the slice's first row begins.
    """
    rows = offsets - int(offsets[0])
    hashes, begins, _ = words_of(flat[int(offsets[0]) : int(offsets[-1])], rows)
    return hashes, np.searchsorted(begins, rows)


def windows_of(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words that stay inside a row, and where each run begins."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            total = total * np.uint64(BASE) + hashes[i : i + n]
    row_end = np.repeat(rows[1:], np.diff(rows))[:n]
    at = np.flatnonzero(np.arange(n) + size <= row_end)
    return mixed(total[at]), at
