"""Elias-Fano sequences of unsigned numbers, queried many at a time over memory-mapped arrays."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ZEROS = np.array([8 - bin(b).count("1") for b in range(256)], np.uint8)
#: position of the j-th zero of a byte, 8 where there are fewer
_NTH = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    _z = [i for i in range(8) if not _b >> i & 1]
    _NTH[_b, : len(_z)] = _z


def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a sorted sequence below `universe`: low bits packed, high bits in unary, zeros counted before each word."""
    n = len(values)
    bits = max(0, min(63, (universe // max(n, 1)).bit_length() - 1))
    values = values.astype(_U)
    low = np.zeros((n * bits + 63) // 64 + 1, _U)
    if bits and n:
        part = values & _U((1 << bits) - 1)
        at = np.arange(n, dtype=np.int64) * bits
        word, off = at >> 6, (at & 63).astype(_U)
        np.bitwise_or.at(low, word, part << off)
        over = np.flatnonzero((at & 63) + bits > 64)
        np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - off[over]))
    top = values >> _U(bits)
    ones = top.astype(np.int64) + np.arange(n)
    length = n + (int(universe - 1) >> bits) + 2
    high = np.zeros((length + 63) // 64, _U)
    np.bitwise_or.at(high, ones >> 6, _U(1) << (ones & 63).astype(_U))
    zeros = _ZEROS[high.view(np.uint8)].reshape(-1, 8).sum(1, dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(zeros)]).astype(np.uint32)
    return {"head": np.array([n, bits], np.int64), "low": low, "high": high, "before": before}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in arrays["head"])
        self.low, self.high, self.before = arrays["low"], arrays["high"], arrays["before"]

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0) of the unary part."""
        word = np.searchsorted(self.before, k.astype(np.uint32), "right") - 1
        word = np.minimum(word, len(self.high) - 1)
        rest = k - self.before[word]
        raw = self.high[word].view(np.uint8).reshape(-1, 8)
        sums = np.cumsum(_ZEROS[raw], axis=1, dtype=np.int64)
        byte = np.minimum((sums <= rest[:, None]).sum(1), 7)
        rows = np.arange(len(k))
        rest = rest - np.where(byte > 0, sums[rows, byte - 1], 0)
        return word * 64 + byte * 8 + _NTH[raw[rows, byte], np.clip(rest, 0, 7)]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i * self.bits
        word, off = at >> 6, (at & 63).astype(_U)
        out = self.low[word] >> off
        over = off + _U(self.bits) > 64
        out[over] |= self.low[word[over] + 1] << (_U(64) - off[over])
        return out & _U((1 << self.bits) - 1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element that is x or more; n if there is none."""
        if not self.n or not len(x):
            return np.full(len(x), self.n, np.int64)
        x = x.astype(_U)
        h = (x >> _U(self.bits)).astype(np.int64)
        last = int(self.before[-1]) - 1
        beyond = h > last
        h = np.minimum(h, last)
        hi = self._zero(h) - h
        lo = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) - (h - 1), 0)
        part = x & _U((1 << self.bits) - 1) if self.bits else np.zeros(len(x), _U)
        lo, hi = np.minimum(lo, self.n), np.minimum(hi, self.n)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < part[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        lo[beyond] = self.n
        return lo

    def select(self, i: np.ndarray) -> np.ndarray:
        """Elements at the given indexes."""
        if not len(i):
            return np.zeros(0, _U)
        ones = np.arange(0, len(self.high) + 1, dtype=np.int64) * 64 - self.before.astype(np.int64)
        word = np.searchsorted(ones, i, "right") - 1
        rest = i - ones[word]
        raw = (~self.high[word]).view(np.uint8).reshape(-1, 8)
        sums = np.cumsum(_ZEROS[raw], axis=1, dtype=np.int64)
        byte = np.minimum((sums <= rest[:, None]).sum(1), 7)
        rows = np.arange(len(i))
        rest = rest - np.where(byte > 0, sums[rows, byte - 1], 0)
        place = word * 64 + byte * 8 + _NTH[raw[rows, byte], np.clip(rest, 0, 7)]
        return ((place - i).astype(_U) << _U(self.bits)) | self._low(i)

    def index(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, -1 where it isn't there."""
        at = self.successor(x)
        out = np.full(len(x), -1, np.int64)
        some = np.flatnonzero(at < self.n)
        hit = self.select(at[some]) == x[some].astype(_U)
        out[some[hit]] = at[some[hit]]
        return out
