"""Array forms of text that the operators share: UTF-8 blocks, words, rolling hashes.

Arrow hands a task whole batches of documents; :func:`text_blocks` cuts them into
blocks of a bounded number of bytes (one very long document makes a block alone),
so the 8-byte work arrays of a block stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BLOCK_BYTES = 1 << 20
#: Bytes of rows in an Arrow batch, where the session sets no bound.
BATCH_BYTES = 8 << 20
_BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def byte_table(seed: int = 1) -> np.ndarray:
    """A random 64-bit weight for each byte value."""
    return mix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000003 + 12345))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the rolling-hash base and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


class RollingHash:
    """Hashes of any byte ranges of one block from a single prefix sum."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        up, self._down = powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(byte_table(seed)[data] * up[: len(data)], out=self._sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._down[start]

    def grams(self, size: int) -> np.ndarray:
        """Hashes of the ``size`` bytes at each place that has as many."""
        n = len(self._sums) - size
        return (self._sums[size:] - self._sums[:n]) * self._down[:n]


def batch_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows, about ``limit`` bytes each."""
    if not len(column):
        return
    data, offsets = batch_text(column)
    row = 0
    while row < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(offsets) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def small_batches(spark: SparkSession) -> dict[str, str]:
    """The setting that bounds Arrow batches by bytes, where the session has none; 10,000 long texts would else be held at once."""
    return {_BATCH_BOUND: str(BATCH_BYTES)} if spark.conf.get(_BATCH_BOUND, None) is None else {}


def _mask(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Bytes of white space that end a word; every other byte belongs to one.
SPACE = _mask(b"\x09\x0a\x0b\x0c\x0d\x20")
#: Bytes that are no letter or digit; bytes above 127 count as letters.
PUNCTUATION = _mask(bytes(i for i in range(128) if not chr(i).isalnum()))
#: Maps A-Z to a-z and nothing else.
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of a block, and where each row's words begin in them."""
    inside = ~gap[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    cuts = offsets[:-1]
    opens = inside & ~_cut(before[:-1], cuts)
    closes = inside & ~_cut(after[1:], offsets[1:] - 1)
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, offsets)


def _cut(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    flags = flags.copy()
    flags[at[(at >= 0) & (at < len(flags))]] = False
    return flags
