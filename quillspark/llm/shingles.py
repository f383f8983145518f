"""Character shingles of many lines at once, in numpy over Arrow batches: a plain form of what lines does
in DataFrame functions, for comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .bytes_of import utf8
from .exchange import mix

#: Bytes of lines that are looked at in one step.
STEP_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A 64-bit value for each UTF-16 unit.
_UNIT = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def steps(column: pa.Array, most_rows: int = 1 << 30) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, units) of runs of rows of a column of UTF-16BE lines, none of them empty;
    offsets are in units."""
    ends, raw = utf8(column)
    units, ends = raw.view(">u2"), ends // 2
    first, rows = 0, len(ends) - 1
    while first < rows:
        last = max(first + 1, min(first + most_rows, int(np.searchsorted(ends, ends[first] + STEP_BYTES // 2, side="right")) - 1))
        yield first, ends[first : last + 1] - ends[first], units[ends[first] : ends[last]]
        first = last


def _runs(value: np.ndarray, size: int) -> np.ndarray:
    """Polynomials of all runs of size values, wherever they begin: runs of 1, 2, 4, ... values are
    put together as the bits of size say."""
    whole, reach, width, power, left = None, 0, 1, int(_BASE), size
    have = value
    while True:
        if left & 1:
            if whole is None:
                whole, reach = have, width
            else:
                n = max(0, len(value) - width - reach + 1)
                whole, reach = whole[:n] * np.uint64(power) + have[reach : reach + n], reach + width
        left >>= 1
        if not left:
            return whole
        have = have[: max(0, len(have) - width)] * np.uint64(power) + have[width:]
        width, power = 2 * width, power * power % (1 << 64)


def hashes(offsets: np.ndarray, units: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, hash): the 64-bit hashes of all runs of size units of each line, line after line, and
    where those of each line begin; a shorter line is one shingle as a whole. The upper bits of a
    hash depend on all of its units' values, the lowest on few bits of them: use the upper ones."""
    length = np.diff(offsets)
    n = np.maximum(length - size + 1, 1)
    begin = np.cumsum(n) - n
    value = _UNIT[units]
    inside = np.ones(len(value), bool)  # of a run that ends in its line
    for k in range(1, size):
        inside[np.maximum(offsets[1:] - k, 0)] = False
    whole = _runs(value, size)
    h = whole[inside[: len(whole)]]
    short = np.flatnonzero(length < size)
    if len(short):
        alone = np.empty(len(short), np.uint64)
        for i, x in enumerate(short):
            t = int(length[x])
            for v in value[offsets[x] : offsets[x + 1]].tolist():
                t = (t * int(_BASE) + v) % (1 << 64)
            alone[i] = t
        h = np.insert(h, begin[short] - np.arange(len(short)), alone)
    return begin, h


def distinct(begin: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """For runs of 256 lines, the different hashes of each, ascending by line: the line's number in
    the upper 8 bits, and of the hash 56."""
    n, out = np.diff(np.append(begin, len(h))), []
    for a in range(0, len(begin), 256):
        b = min(a + 256, len(begin))
        key = np.repeat(np.arange(b - a, dtype=np.uint64), n[a:b]) << np.uint64(56)
        key |= h[begin[a] : begin[b] if b < len(begin) else len(h)] >> np.uint64(8)
        key.sort()
        out.append(key[np.append(True, key[1:] != key[:-1])])
    return out


def per_line(keys: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount((keys >> np.uint64(56)).astype(np.int64), minlength=rows)


def minima(begin: np.ndarray, h: np.ndarray, factors: list[tuple[int, int]]) -> np.ndarray:
    """A row for each line, a column for each function: the least value of its shingles."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begin), len(factors)), np.int64)
    for k, (a, b) in enumerate(factors):
        out[:, k] = np.minimum.reduceat((x ^ np.uint32(b)) * np.uint32(2 * a + 1), begin)
    return out


def bitmaps(begin: np.ndarray, h: np.ndarray, words: int) -> np.ndarray:
    """A row for each line: words longs (a power of two), with a bit set for each value of the upper
    bits of its hashes."""
    out = np.zeros((len(begin), words), np.int64)
    n = np.diff(np.append(begin, len(h)))
    bit = (h >> np.uint64(64 - (64 * words - 1).bit_length())).astype(np.int64)
    for a in range(0, len(begin), 256):  # as many as stay in the cache
        b = min(a + 256, len(begin))
        low, high = begin[a], begin[b] if b < len(begin) else len(h)
        seen = np.zeros((b - a, 64 * words), bool)
        seen[np.repeat(np.arange(b - a), n[a:b]), bit[low:high]] = True
        out[a:b] = np.packbits(seen, axis=1, bitorder="little").view("<i8")
    return out


def shared(a: pa.Array, b: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of lines a[i] and b[i]: their different shingles, and how many they share."""
    counts = [np.zeros(len(a), np.int64) for _ in range(3)]
    for first in range(0, len(a), 256):
        rows, keys = min(256, len(a) - first), []
        for column in (a, b):
            begin, h, done = [], [], 0
            for _, offsets, units in steps(column.slice(first, rows)):
                at, x = hashes(offsets, units, size)
                begin.append(at + done)
                h.append(x)
                done += len(x)
            keys += distinct(np.concatenate(begin), np.concatenate(h))
        both = np.concatenate(keys)
        both.sort()
        keys.append(both[1:][both[1:] == both[:-1]])
        for total, k in zip(counts, keys, strict=True):
            total[first : first + rows] = per_line(k, rows)
    return tuple(counts)
