"""Numpy helpers on the bytes of whole Arrow batches, shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18  # texts are handled in slices of about this many bytes; one longer text is a slice of its own
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64; short ones are kept."""
    kept = _POWERS.get(int(base))
    if kept is not None and len(kept) >= n:
        return kept[:n]
    made = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
    made[0] = 1
    made = np.cumprod(made)
    if len(made) <= 4 * SLICE_BYTES:
        _POWERS[int(base)] = made
    return made[:n]


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Running polynomial hash: ``span_hash`` gets that of any stretch from two of its values."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(table[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit hashes of the stretches ``data[start:end]``, alike wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start])


def gram_hash(prefix: np.ndarray, q: int) -> np.ndarray:
    """``span_hash`` of all stretches of ``q`` bytes, by their start."""
    n = max(0, len(prefix) - q)
    return mix((prefix[q:] - prefix[:n]) * powers(BASE_INVERSE, len(prefix))[:n]) if n else np.empty(0, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), bounds


def slices(bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``size`` bytes each, one row at least."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets within them)`` for each slice of a string column."""
    data, bounds = text_bytes(column)
    for first, last in slices(bounds, size):
        yield first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]


def tidy() -> None:
    """Give memory that a worker no longer uses back to the machine, for the next stage of another kind."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        found = ctypes.CDLL("libc.so.6")
        return found if hasattr(found, "malloc_trim") else None
    except OSError:  # another C library, which keeps house itself
        return None


_LIBC = _libc()
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


SMALLER = {  # settings that hold rows back in memory, and what they may be at most
    BATCH_SETTING: BATCH_BYTES,
    "parquet.block.size": 8 << 20,
    "spark.sql.parquet.columnarReaderBatchSize": 1024,
}


def small_batches(spark) -> None:
    """Let what a task holds of long texts be small: batches on their way to Python of about 4 MB, row groups of 8 MB, 1,024 rows
    read at once, where the session allows more. Otherwise a task keeps several copies of 64 MB. No result depends on it.
    """
    for name, most in SMALLER.items():
        held = spark.conf.get(name, None)
        if held is None or not held.rstrip("b").isdigit() or int(held.rstrip("b")) > most:
            spark.conf.set(name, str(most))


def arrow_schema(ddl: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(ddl.items()))
