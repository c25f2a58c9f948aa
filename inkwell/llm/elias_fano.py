"""Monotone sequences by Elias and Fano, kept in one block of memory, with successor search over many keys at once."""

from __future__ import annotations

import mmap

import numpy as np

_ONE, _64 = np.uint64(1), np.uint64(64)


def mapped(*arrays: np.ndarray) -> list[np.ndarray]:
    """Copies of the arrays that lie side by side in one memory map of their own."""
    sizes = [-(-a.nbytes // 8) * 8 for a in arrays]
    block, at, out = mmap.mmap(-1, sum(sizes) + 8), 0, []
    for a, size in zip(arrays, sizes, strict=True):
        view = np.frombuffer(block, a.dtype, len(a), at)
        view[:] = a
        out.append(view)
        at += size
    return out


_IN_BYTE = np.array([[next((i for i in range(8) if b >> i & 1 and (b & (1 << i) - 1).bit_count() == r), 8) for r in range(8)] for b in range(256)], np.int64).reshape(-1)
_EACH = np.uint64(0x0101010101010101)


def selected(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place in each 64-bit word of its set bit number k: by sums of the bytes' bits, then by a table."""
    a = x - ((x >> _ONE) & np.uint64(0x5555555555555555))
    a = (a & np.uint64(0x3333333333333333)) + ((a >> np.uint64(2)) & np.uint64(0x3333333333333333))
    sums = ((a + (a >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH
    tops = np.uint64(0x8080808080808080)
    byte = np.bitwise_count((((k.astype(np.uint64) * _EACH) | tops) - sums) & tops).astype(np.int64)
    by = (byte * 8).astype(np.uint64)
    rank = k - ((sums << np.uint64(8)) >> by & np.uint64(255)).astype(np.int64)
    return byte * 8 + _IN_BYTE[(x >> by & np.uint64(255)).astype(np.int64) * 8 + rank]


AT_ONCE = 1 << 14  # keys that are searched together, whose work arrays stay in a core's cache


class EliasFano:
    """A sorted array of 64-bit numbers: the low bits of each as they are, the high ones in unary.

    ``ones`` and ``zeros`` count the bits before each word of the unary part, from which a bucket of equal high bits is found
    without reading others.
    """

    def __init__(self, values: np.ndarray):
        v = np.ascontiguousarray(values, np.uint64)
        self.n = len(v)
        top = int(v[-1]) if self.n else 0
        self.bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        high = v >> np.uint64(self.bits)
        self.buckets = int(high[-1]) + 1 if self.n else 0
        places = high + np.arange(self.n, dtype=np.uint64)
        unary = np.zeros((self.n + self.buckets) // 64 + 1, np.uint64)
        np.bitwise_or.at(unary, (places >> np.uint64(6)).astype(np.int64), _ONE << (places & np.uint64(63)))
        ones = np.zeros(len(unary) + 1, np.int64)
        np.cumsum(np.bitwise_count(unary), out=ones[1:])
        low = np.zeros(self.n * self.bits // 64 + 2, np.uint64)
        if self.bits:
            rest = v & np.uint64((1 << self.bits) - 1)
            bit = np.arange(self.n, dtype=np.uint64) * np.uint64(self.bits)
            word, by = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            np.bitwise_or.at(low, word, rest << by)
            over = by > 0
            np.bitwise_or.at(low, word[over] + 1, rest[over] >> (_64 - by[over]))
        self.unary, self.ones, self.zeros, self.low = mapped(unary, ones, np.arange(len(ones), dtype=np.int64) * 64 - ones, low)

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.bits
        if self.bits <= 57:  # within eight bytes from any byte on
            bytes_ = np.ndarray((self.low.nbytes - 7,), "<u8", self.low, strides=(1,))
            return (bytes_[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)
        word, by = bit >> 6, (bit & 63).astype(np.uint64)
        x = (self.low[word] >> by) | np.where(by > 0, self.low[word + 1] << ((_64 - by) & np.uint64(63)), np.uint64(0))
        return x & np.uint64((1 << self.bits) - 1)

    def _ends(self, bucket: np.ndarray) -> np.ndarray:
        """How many elements stand in the buckets up to each given one: what precedes its zero."""
        word = np.searchsorted(self.zeros, bucket, "right") - 1
        return word * 64 + selected(~self.unary[word], bucket - self.zeros[word]) - bucket

    def successor(self, keys: np.ndarray) -> np.ndarray:
        """The place of the first element that isn't below each key; n where there is none."""
        keys = np.asarray(keys, np.uint64)
        high = keys >> np.uint64(self.bits)
        out = np.full(len(keys), self.n, np.int64)
        inside = np.flatnonzero(high < np.uint64(self.buckets))
        bucket, low = high[inside].astype(np.int64), keys[inside] & np.uint64((1 << self.bits) - 1)
        end = self._ends(bucket)
        begin = np.where(bucket > 0, self._ends(np.maximum(bucket - 1, 0)), 0)
        open_ = np.flatnonzero(begin < end) if self.bits else np.zeros(0, np.int64)
        last = end.copy()
        while len(open_):
            mid = (begin[open_] + end[open_]) // 2
            less = self._low(mid) < low[open_]
            begin[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]
            open_ = open_[begin[open_] < end[open_]]
        out[inside] = np.minimum(begin, last)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements at places ``i``: their bucket is found by bisection over the counts of set bits."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + selected(self.unary[word], i - self.ones[word])
        return ((at - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1: its bucket by one search for a zero, then bisection over the low bits of that bucket."""
        keys = np.asarray(keys, np.uint64)
        return np.concatenate([self._found(keys[i : i + AT_ONCE]) for i in range(0, len(keys), AT_ONCE)] or [np.zeros(0, np.int64)])

    def _found(self, keys: np.ndarray) -> np.ndarray:
        high = keys >> np.uint64(self.bits)
        out = np.full(len(keys), -1, np.int64)
        inside = np.flatnonzero(high < np.uint64(self.buckets))
        bucket, low = high[inside].astype(np.int64), keys[inside] & np.uint64((1 << self.bits) - 1)
        begin = np.where(bucket > 0, self._ends(np.maximum(bucket - 1, 0)), 0)
        end = begin + self._run(begin + bucket)
        wide = np.flatnonzero(end - begin >= 64)
        end[wide] = self._ends(bucket[wide])
        open_ = np.flatnonzero(begin < end)
        last = end.copy()
        while len(open_):
            b, e = begin[open_], end[open_]
            mid = (b + e) >> 1
            less = self._low(mid) < low[open_]
            b, e = np.where(less, mid + 1, b), np.where(less, e, mid)
            begin[open_], end[open_] = b, e
            open_ = open_[b < e]
        some = np.flatnonzero(begin < last)
        hit = some[self._low(begin[some]) == low[some]]
        out[inside[hit]] = begin[hit]
        return out

    def _run(self, at: np.ndarray) -> np.ndarray:
        """How many set bits follow one another in the unary part from each place on; 64 where there are more."""
        word, by = at >> 6, (at & 63).astype(np.uint64)
        x = self.unary[word] >> by
        x |= np.where(by > 0, self.unary[np.minimum(word + 1, len(self.unary) - 1)] << ((_64 - by) & np.uint64(63)), np.uint64(0))
        return np.bitwise_count(x & ~(x + _ONE)).astype(np.int64)
