"""Vectorised byte-level text work: word spans, Rabin-Karp hashes of spans and windows.

Everything runs on whole Arrow batches with numpy; no Python code runs per word.
Hashes are 64-bit polynomial (Rabin-Karp) values modulo 2**64 followed by a bijective
mixer, and depend on nothing but the bytes, so every executor computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
MASK = (1 << 64) - 1
CHUNK = 512 << 10
KEPT = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators where punctuation does not count: every ASCII byte but letters and digits.
PLAIN = np.ones(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; up to `KEPT` of them stay for reuse."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = n if n > KEPT else min(KEPT, max(n, 1 << 16, 0 if have is None else 2 * len(have[0])))
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = (both[0], both[1])
        if size <= KEPT:
            _POWERS[base] = have
    return have


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay under limit; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the maximal runs of bytes outside `gaps` (09-0D and 20), and each row's first word (n + 1)."""
    solid = ~gaps[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    gap = np.empty(n + 1, bool)
    gap[0] = gap[n] = True
    np.logical_not(solid, out=gap[:n] if n else gap[:0])
    before = np.empty(n, bool)
    if n:
        before[0] = True
        before[1:] = gap[: n - 1]
    gap[n] = True
    start = np.flatnonzero(solid & (before | edge[:n]))
    end = np.flatnonzero(solid & (gap[1:] | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of each byte span, from one prefix sum over all bytes."""
    n = len(data)
    up, down = powers(BASE, n + 1)
    prefix = np.zeros(n + 1, U64)
    if n:
        np.cumsum(_BYTE[data] * up[:n], out=prefix[1:])
    h = (prefix[end] - prefix[start]) * down[start]
    return mix(h + (end - start).astype(U64) * U64(WORD_BASE))


def window_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` consecutive word hashes (rows are not regarded)."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U64)
    up, down = powers(WORD_BASE, n + 1)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(hashes * up[:n], out=prefix[1:])
    return mix((prefix[width:] - prefix[: n - width + 1]) * down[: n - width + 1])


def inside(first: np.ndarray, width: int) -> np.ndarray:
    """Which windows of `width` words lie within one row; first: each row's first word (n + 1)."""
    total = int(first[-1])
    if total < width:
        return np.zeros(0, bool)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return row[width - 1 :] == row[: total - width + 1]
