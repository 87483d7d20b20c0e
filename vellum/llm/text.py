"""Vectorised word splitting and hashing over Arrow text columns."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word is a run of bytes that are none of 0x20 and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _SEQ = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
#: Bytes that are hashed at a time.
CHUNK = 1 << 16
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers[base] = (np.cumprod(up), np.cumprod(down))
    up, down = _powers[base]
    return up[: n + 1], down[: n + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls being empty, and where each text starts and ends."""
    column = pc.fill_null(column, "") if column.null_count else column
    if not isinstance(column, pa.StringArray):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each text's first word (one more entry than texts)."""
    inside = NOT_SPACE[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][at[:-1] < len(raw)]] = False
    ends = at[1:][at[1:] > 0]
    after[ends - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, at, "left")


def _range_names(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray, base: int) -> np.ndarray:
    """Polynomials over byte ranges in ascending order, chunk by chunk so that little memory is touched."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        low, high = int(start[i]), int(end[j - 1])
        up, down = _power(base, high - low) if high - low <= 2 * CHUNK else _long_power(base, high - low)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[raw[low:high]] * up[:-1], out=total[1:])
        s = start[i:j] - low
        out[i:j] = (total[end[i:j] - low] - total[s]) * down[s]
        i = j
    return out


def _long_power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As _power, for a single long range; not kept."""
    up, down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of every word's bytes."""
    return mix(_range_names(raw, start, end, _BYTE, _BASE) + (end - start).astype(np.uint64))


def piece_names(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of byte ranges."""
    return word_hashes(raw, start, end), _range_names(raw, start, end, _BYTE2, _SEQ)


class Sequences:
    """Names of word sequences, each in constant time."""

    def __init__(self, names: np.ndarray) -> None:
        self.up, self.down = _power(_SEQ, len(names))
        self.total = np.zeros(len(names) + 1, np.uint64)
        np.cumsum(names * self.up[:-1], out=self.total[1:])

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return mix((self.total[at + length] - self.total[at]) * self.down[at])


def release_memory() -> None:
    """Gives memory that arrays have left back to the system; a reused worker would else keep it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def pieces(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one holds about `limit` bytes of text, or a single longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        row = 0
        while row < batch.num_rows:
            to = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield batch.slice(row, to - row)
            row = to
    release_memory()
