"""Vectorised byte-text helpers shared by the Arrow-batch operators.

Everything here works on one small slice of a partition: an Arrow string
column is viewed as a flat ``uint8`` buffer plus offsets, without a Python
object per row, and slices are cut so that temporaries stay bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_SEED = 0x9E3779B97F4A7C15

#: ASCII lower-casing and the separators x20, x09-x0D, as byte tables.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def random_u64(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit values (splitmix64 of a seed)."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(_SEED)
        return mix64(z)


def mix64(z: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit words."""
    z = z ^ (z >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z = z * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


BYTE_CODE = random_u64(256, 7)


def utf8_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=len(col) + 1, offset=col.offset * 8)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes and at most ``rows`` rows; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n, i + (rows or n))
        yield i, j
        i = j


class PrefixHasher:
    """64-bit polynomial hashes of arbitrary substrings of one buffer.

    ``of(s, e)`` equals for equal substrings wherever they stand; the value
    is finalised with the length, so it may be used as a 64-bit key.
    """

    BASE = 0xD1342543DE82EF95
    _pow = np.ones(1, dtype=np.uint64)
    _inv = np.ones(1, dtype=np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._pow) < n:
            m = 1 << max(16, int(n - 1).bit_length())
            inv = pow(cls.BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                cls._pow = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, cls.BASE, np.uint64))])
                cls._inv = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, inv, np.uint64))])

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._grow(n + 1)
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_CODE[data] * self._pow[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.prefix[end] - self.prefix[start]) * self._inv[start]
            return mix64(h + (end - start).astype(np.uint64) * np.uint64(_SEED))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (maximal runs of non-separators) of each row of a slice.

    ``offsets`` are relative to ``data``. Returns start, end and row of every
    word; words never cross rows.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    start = np.flatnonzero(begin)
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:n]
    end = np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row
