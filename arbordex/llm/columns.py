"""Arrow text columns as numpy buffers, and hashes over them.

Every operator of this subpackage reads its texts here: a null text is an empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
#: Bytes of text that one numpy pass takes on; a longer single text is a pass of its own.
PASS_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}
_libc = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def release() -> None:
    """Give freed memory back to the system; idle Python workers otherwise keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; short tables are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base & MASK, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 4 * PASS_BYTES:
            _powers[base] = have
    return have[:n]


class Rolling:
    """Hashes of the runs values[s:e], equal for equal runs wherever they stand."""

    def __init__(self, values: np.ndarray, lane: int = 0):
        base = _BASE[lane] | 5
        n = len(values)
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * powers(base, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, end to end, and each text's offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(data: np.ndarray, offsets: np.ndarray, size: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, offsets) of about `size` bytes; whole texts only."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of several texts.

    hashes: one 64-bit hash a word; first: for each text the index of its first word, and the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = _LOWER[data]
        n = len(data)
        solid = np.zeros(n + 2, dtype=bool)
        solid[1:-1] = ~_SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
        ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
        self.first = np.searchsorted(starts, offsets)
        self.hashes = Rolling(_TABLE[data]).of(starts, ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _TABLE[data]


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order that sorts by the keys, first key first, and where each run of equal keys begins in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    if not len(order):
        return order, np.zeros(0, np.int64)
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)
