"""Compressed bitmaps over dense integer ids.

Ids are cut into chunks of 65,536. A sparse chunk is a sorted array of 16-bit
values, a dense one a bit array of 8 KB; each is kept in whichever form is
smaller, so a bitmap never takes more than about two bytes an id.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 16
ARRAY_MAX = 4096  # above this many ids the bit array is smaller


def _pack(low: np.ndarray) -> np.ndarray:
    """The smaller form of one chunk's sorted distinct 16-bit values."""
    if len(low) <= ARRAY_MAX:
        return low.astype(np.uint16)
    bits = np.zeros(CHUNK, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little")


def _is_bits(c: np.ndarray) -> bool:
    return c.dtype == np.uint8


def _values(c: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(c, bitorder="little")) if _is_bits(c) else c.astype(np.int64)


class Bitmap:
    """An immutable set of non-negative integers."""

    __slots__ = ("chunks",)

    def __init__(self, chunks: dict[int, np.ndarray] | None = None):
        self.chunks = chunks or {}

    @classmethod
    def of(cls, ids: np.ndarray) -> Bitmap:
        ids = np.unique(np.asarray(ids, np.int64))
        if not len(ids):
            return cls()
        high = ids >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(part[0] >> 16): _pack(part & (CHUNK - 1)) for part in np.split(ids, cuts)})

    def __or__(self, other: Bitmap) -> Bitmap:
        out = dict(self.chunks)
        for k, c in other.chunks.items():
            mine = out.get(k)
            if mine is None:
                out[k] = c
            elif _is_bits(mine) and _is_bits(c):
                out[k] = mine | c
            else:
                out[k] = _pack(np.union1d(_values(mine), _values(c)))
        return Bitmap(out)

    def and_not(self, other: Bitmap) -> Bitmap:
        out = {}
        for k, c in self.chunks.items():
            theirs = other.chunks.get(k)
            if theirs is None:
                out[k] = c
                continue
            if _is_bits(c) and _is_bits(theirs):
                left = _values(c & ~theirs)
            elif _is_bits(theirs):
                v = _values(c)
                left = v[(theirs[v >> 3] >> (v & 7).astype(np.uint8)) & 1 == 0]
            else:
                left = np.setdiff1d(_values(c), _values(theirs), assume_unique=True)
            if len(left):
                out[k] = _pack(left)
        return Bitmap(out)

    def decode(self) -> np.ndarray:
        """The ids, ascending."""
        if not self.chunks:
            return np.zeros(0, np.int64)
        return np.concatenate([_values(c) + (k << 16) for k, c in sorted(self.chunks.items())])

    def __len__(self) -> int:
        return sum(int(np.unpackbits(c).sum()) if _is_bits(c) else len(c) for c in self.chunks.values())

    def nbytes(self) -> int:
        return sum(c.nbytes for c in self.chunks.values())
