"""Wavelet matrix over token ids: one bit plane per binary digit, with rank and select support.

Plane k holds digit k (highest first) of the ids in the order left by the planes before it: a stable
partition that puts zeros first.  Counts of ones are kept for every block of 512 bits, so a rank reads one
count and at most 64 bytes.
"""

from __future__ import annotations

import numpy as np

BLOCK_BYTES = 64
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class WaveletMatrix:
    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        for k in range(width - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << k)) != 0
            bits = np.packbits(one, bitorder="little")
            planes.append(bits)
            ranks.append(cls._ranks(bits))
            low = len(ids) - int(np.count_nonzero(one))
            zeros.append(low)
            after = np.empty_like(ids)
            np.compress(~one, ids, out=after[:low])
            np.compress(one, ids, out=after[low:])
            ids = after
        return cls(len(ids), zeros, planes, ranks)

    @staticmethod
    def _ranks(bits: np.ndarray) -> np.ndarray:
        ones = np.add.reduceat(POPCOUNT[bits], np.arange(0, len(bits), BLOCK_BYTES), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        return np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype(np.uint32)

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (i & 7) & 1

    def _rank1(self, k: int, i: int) -> int:
        block = (i >> 3) // BLOCK_BYTES
        part = self.planes[k][block * BLOCK_BYTES : i >> 3]
        ones = int(self.ranks[k][block]) + int(POPCOUNT[part].sum())
        return ones + (int(POPCOUNT[self.planes[k][i >> 3] & ((1 << (i & 7)) - 1)]) if i & 7 else 0)

    def _select(self, k: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) digit ``bit`` in plane k."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(k, mid + 1)
            if (ones if bit else mid + 1 - ones) > nth:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        value = 0
        for k in range(len(self.planes)):
            bit = self._bit(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + self._rank1(k, i) if bit else i - self._rank1(k, i)
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` among [lo, hi) stand after the last plane."""
        width = len(self.planes)
        if token < 0 or token >> width:
            return 0, 0
        for k in range(width):
            a, b = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (width - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` among the first i ids."""
        lo, hi = self._range(token, 0, i)
        return hi - lo

    def select(self, token: int, nth: int) -> int:
        """Place of the nth (from 0) occurrence of ``token``."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= nth < hi - lo:
            raise IndexError(nth)
        i = lo + nth
        for k in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def decode(self, dtype=np.uint32) -> np.ndarray:
        """All ids in order: the planes' partitions undone from the last one up."""
        ids = np.zeros(self.n, dtype)
        for k in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little").astype(bool)
            back = np.empty_like(ids)
            back[np.flatnonzero(~one)] = ids[: self.zeros[k]]
            back[np.flatnonzero(one)] = ids[self.zeros[k] :] | dtype(1 << (len(self.planes) - 1 - k))
            ids = back
        return ids
