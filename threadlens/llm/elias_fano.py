"""Elias-Fano coding of non-decreasing integers, with vectorised access and search.

A value's low ``l`` bits are packed; its high part is coded in unary in a bit vector with a rank directory. With n values
below u, that takes about 2 + log2(u / n) bits each. The arrays are plain, so that they can be mapped from a file.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """``values``: non-decreasing, below ``universe``."""
    n = len(values)
    low_bits = max(0, int(max(1, universe) // max(1, n)).bit_length() - 1)
    values = values.astype(np.uint64)
    bits = np.zeros(-(-(n + (max(1, universe) >> low_bits) + 2) // 64) * 64, np.uint8)
    bits[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
    high = np.packbits(bits, bitorder="little").view("<u8")
    low = np.zeros(-(-n * low_bits // 64) + 2, np.uint64)
    if low_bits and n:
        part, at = values & np.uint64((1 << low_bits) - 1), np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        _or_into(low, word, part << shift)
        over = shift + np.uint64(low_bits) > np.uint64(64)
        _or_into(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
    ones = np.bitwise_count(high).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(ones)])
    return {"meta": np.array([n, low_bits], np.int64), "low": low, "high": high, "before": before.astype(np.uint32 if n < 1 << 32 else np.uint64)}


def _or_into(out: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    """out[at] |= x for non-decreasing ``at``."""
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 0]))
        out[at[first]] |= np.bitwise_or.reduceat(x, first)


def _select_in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The position of the r-th (from 0) set bit of each word."""
    at = np.zeros(len(x), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
        go = r >= n
        r = r - n * go
        x = x >> (go * width).astype(np.uint64)
        at += width * go
    return at


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.low_bits = (int(x) for x in arrays["meta"])
        self.low, self.high, self.before = arrays["low"], arrays["high"], arrays["before"]
        self.zeros = None

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> shift
        over = shift + np.uint64(self.low_bits) > np.uint64(64)
        x = np.where(over, x | (self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63))), x)
        return (x & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def _select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, i.astype(self.before.dtype), "right") - 1
        return 64 * word + _select_in_word(self.high[word], i - self.before[word].astype(np.int64))

    def _select0(self, i: np.ndarray) -> np.ndarray:
        if self.zeros is None:
            self.zeros = 64 * np.arange(len(self.before)) - self.before.astype(np.int64)
        word = np.searchsorted(self.zeros, i, "right") - 1
        return 64 * word + _select_in_word(~self.high[word], i - self.zeros[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at these indices."""
        return ((self._select1(i) - i) << self.low_bits) | self.lows(i)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the first value that is not below each of ``x`` (n if there is none), and whether it is equal."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high, low = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        most = 64 * len(self.high) - self.n - 1  # zeros there are
        beyond = high > most - 1
        high = np.minimum(high, most - 1)
        end = self._select0(high) - high
        # the values of the high part before: in ascending queries, mostly the same words of the bit vector
        lo = np.where(high > 0, self._select0(np.maximum(high - 1, 0)) - np.maximum(high - 1, 0), 0)
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while open_.size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.lows(mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        equal = (lo < end) & ~beyond
        some = np.flatnonzero(equal)
        equal[some] = self.lows(lo[some]) == low[some]
        return np.where(beyond, self.n, lo), equal
