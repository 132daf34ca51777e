"""Words and rolling hashes of many texts at once, as numpy operations on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text handled at once; a longer text is handled alone and whole.
SLICE = 1 << 19

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z only
SAME = np.arange(256, dtype=np.uint8)
#: Characters of words between white space, and of alphanumeric words; other scripts' bytes count as letters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    return _powers(1 << max(16, (n - 1).bit_length()), base)[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash, one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(max(1, len(values)))[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal contents give equal hashes, wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix((prefix[ends] - prefix[starts]) * powers(int(starts.max()) + 1, _INVERSE)[starts] + (ends - starts).astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 bounds of its texts; null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of consecutive texts that together hold about ``most`` bytes."""
    data, bounds = buffers(column)
    at, n = 0, len(bounds) - 1
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in byte positions, and for each text the index of its first word (n+1 bounds)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    start = inside & np.concatenate(([True], ~inside[:-1])) | inside & edge[:-1]
    end = inside & np.concatenate((~inside[1:], [True])) | inside & edge[1:]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds)
