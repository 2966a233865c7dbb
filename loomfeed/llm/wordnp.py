"""Words of many texts at once as numpy arrays: bounds and 64-bit hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MASK = (1 << 64) - 1
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd multipliers of the rolling sums
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        a = np.full(max(n + 1, 1 << 16), base, np.uint64)
        a[0] = 1
        have = _powers[base] = np.multiply.accumulate(a)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each [start, end): the sum of values[start + k] * base ** k, modulo 2 ** 64."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * _power(base, n)[:n], out=total[1:])
    inverse = pow(base, -1, 1 << 64)
    return (total[ends] - total[starts]) * _power(inverse, n)[starts]


def slices(column: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts with about `size` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends (bytes) of all words, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1] | edge[1:-1]
    last = solid
    last[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off, "left")


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[data]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return mix(_rolled(data.astype(np.uint64) + np.uint64(1), _BYTE, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, in order; the last n - 1 words start none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(h) - n + 1)
    return mix(_rolled(h, _WORD, at, at + n))


def sequences(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each whole word sequence h[bounds[i]:bounds[i + 1]]."""
    return mix(_rolled(h, _WORD, bounds[:-1], bounds[1:]) + (bounds[1:] - bounds[:-1]).astype(np.uint64))


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
