"""Vectorised splitting of Arrow text columns into hashed words.

All functions work on chunks of a few MB of UTF-8 bytes, so the memory of a task
does not depend on the size of its Arrow batches (one longer text is a chunk of
its own)."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BYTES = np.random.default_rng(20231).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(k: int, n: int) -> np.ndarray:
    """The first n powers of the base (k=0) or of its inverse (k=1), modulo 2**64."""
    if len(_powers[k]) < n:
        steps = np.full(max(n, CHUNK + CHUNK // 4), (_BASE, _INVERSE)[k], np.uint64)
        steps[0] = 1
        _powers[k] = np.cumprod(steps)
    return _powers[k][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def utf8(column: pa.Array) -> pa.Array:
    """The column as large strings, null as empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    return pc.fill_null(column, "")


def chunked(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets within them) of slices of a column."""
    column = utf8(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


#: Bytes that separate words when only white space does.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that separate words of letters and digits; multi-byte characters see below.
MARKS = np.ones(256, bool)
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass
class Words:
    """Words of consecutive texts: hash, owning row, and byte span in ``data``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of the first word of each row, and the end
    hash: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split(data: np.ndarray, offsets: np.ndarray, letters: bool) -> Words:
    """Words of the texts in ``data``; ASCII upper case counts as lower case.

    letters=False: runs of anything but space and 0x09-0x0D. letters=True: runs of
    letters and digits, where characters of U+0080-U+00BF, U+2000-U+207F and
    U+3000-U+303F separate too (callers lower-case such texts before)."""
    n, rows = len(data), len(offsets) - 1
    flat = np.full(n + rows, 0x20, np.uint8)
    lengths = np.diff(offsets)
    flat[np.arange(n) + np.repeat(np.arange(rows), lengths)] = data
    flat = _LOWER[flat]
    gap = (MARKS if letters else SPACES)[flat]
    if letters and n:
        two = np.flatnonzero(flat == 0xC2)
        for back in range(2):
            gap[np.minimum(two + back, n + rows - 1)] = True
        lead = np.flatnonzero((flat == 0xE2) | (flat == 0xE3))
        if len(lead):
            after = flat[np.minimum(lead + 1, n + rows - 1)]
            lead = lead[(after == 0x80) | ((after == 0x81) & (flat[lead] == 0xE2))]
            for back in range(3):
                gap[np.minimum(lead + back, n + rows - 1)] = True
    step = np.diff(np.concatenate(([0], (~gap).view(np.int8), [0])))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    first = np.searchsorted(start, offsets + np.arange(rows + 1))
    sums = np.empty(n + rows + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[flat] * _power(0, n + rows), out=sums[1:])
    code = (sums[end] - sums[start]) * _power(1, n + rows + 1)[start]
    return Words(flat, start, end, first, mixed(code))


PLACES = np.random.default_rng(20232).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(code: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word runs of one word sequence; of a shorter one, of all its words."""
    n = min(n, len(code))
    if not n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(code) - n + 1, np.uint64)
    for j in range(n):
        out += code[j : len(code) - n + 1 + j] * PLACES[j]
    return mixed(out + np.uint64(n))


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(utf8(column))


def signed(code: np.ndarray) -> np.ndarray:
    return code.view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, where a task makes Python strings of their texts."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def released(run: Callable) -> Callable:
    """A task's function after which the memory that it has freed goes back to the system, as
    Python workers are used again and would keep it."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return whole


#: Rows of texts that a Python task gets at a time, where :func:`small_batches` was called.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let the session send tables to Python tasks in batches of at most so many rows (a smaller
    setting stays): a batch is outside the heap of an executor and in its Python worker at once, and
    one of Spark's own 10,000 texts may have hundreds of MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def unused(names: list[str], wanted: str) -> str:
    """A column name that a table with these doesn't have, whatever their case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
