"""Elias-Fano sequences over numpy arrays: compact, searched in bulk, readable from a memory map.

A sorted sequence of n values below u keeps ``l = log2(u / n)`` low bits of each value packed, and
the high parts in unary: a one per value after as many zeros as its high part. Directories count
the zeros and ones before each 64-bit word, which makes select a binary search and one word's bits.

``ranges`` makes the values of many sorted ranges one increasing sequence: each range goes on where the
one before ended, so a value is found by a successor search relative to its range, between two pointers.
"""

from __future__ import annotations

import numpy as np

_ONE, _W, _BYTE = np.uint64(1), np.uint64(63), np.uint64(8)
_EACH, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Place of the k-th one of a byte, at eight times the byte plus k (0 where there are fewer).
_PLACE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8).ravel()


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values below 2**width side by side in 64-bit words, with a word to spare."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & _W
        values = values.astype(np.uint64)
        np.bitwise_or.at(out, word, values << shift)
        spill = shift > np.uint64(64 - width)
        np.bitwise_or.at(out, word[spill] + 1, values[spill] >> (np.uint64(64) - shift[spill]))
    return out


def get_bits(words: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & _W
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & _W), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


def select_bit(bits: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one with the given rank in each 64-bit word: first its byte, by the ones up to each byte, then a table."""
    upto = np.bitwise_count(bits.view(np.uint8)).view(np.uint64) * _EACH
    byte = np.bitwise_count(((rank * _EACH) | _TOPS) - upto & _TOPS).astype(np.uint64) * _BYTE
    left = rank - ((upto << _BYTE) >> byte & np.uint64(255))
    return byte + _PLACE[((bits >> byte & np.uint64(255)) * _BYTE + left).astype(np.int64)]


class EliasFano:
    """``low``, ``high``, ``zeros`` and ``ones`` are arrays, in memory or mapped."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros, self.ones = n, width, low, high, zeros, ones

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        top = (values >> np.uint64(width)).astype(np.int64)
        ones = top + np.arange(n)
        size = n + (universe >> width) + 3
        high = np.zeros(size // 64 + 1, np.uint64)
        np.bitwise_or.at(high, ones >> 6, _ONE << (ones & 63).astype(np.uint64))
        before = np.cumsum(np.bitwise_count(high), dtype=np.int64) - np.bitwise_count(high)
        kind = np.uint32 if size < 1 << 32 else np.uint64
        return cls(n, width, pack_bits(values & np.uint64((1 << width) - 1), width), high, (np.arange(len(high)) * 64 - before).astype(kind), before.astype(kind))

    @classmethod
    def ranges(cls, values: np.ndarray, first: np.ndarray) -> EliasFano:
        """Of the sorted values of each range ``first[i]:first[i + 1]``; search with ``find_in``."""
        sizes = np.diff(first)
        last = np.zeros(len(sizes), np.int64)
        last[sizes > 0] = values[first[1:][sizes > 0] - 1] + 1
        base = np.cumsum(last) - last
        return cls.build(values + 1 + np.repeat(base, sizes), int(last.sum()) + 1)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "zeros": self.zeros, "ones": self.ones}

    def _select(self, rank: np.ndarray, before: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the bit with the given rank among ones or zeros; ``before`` counts them before each word."""
        word = np.searchsorted(before, rank.astype(before.dtype), "right") - 1
        left = (rank - before[word].astype(np.int64)).astype(np.uint64)
        bits = self.high[word] if ones else ~self.high[word]
        return word * 64 + select_bit(bits, left).astype(np.int64)

    def _next_zero(self, place: np.ndarray) -> np.ndarray:
        """Place of the zero that follows each given zero of the high bits, which is not the last."""
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        rest = (~self.high[word] >> shift) >> _ONE  # what comes after it in its word
        out = place + 1 + np.bitwise_count((rest & (~rest + _ONE)) - _ONE)
        beyond = np.flatnonzero(rest == 0)
        if len(beyond):
            out[beyond] = self._select(self.zeros[word[beyond] + 1].astype(np.int64), self.zeros, False)
        return out

    def base(self, begin: np.ndarray) -> np.ndarray:
        """Where the ranges of a sequence of ``ranges`` that begin at the given indexes go on from."""
        base = np.zeros(len(begin), np.uint64)
        later = begin > 0
        base[later] = self.get(begin[later] - 1)
        return base

    def find_in(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Index of each value inside its range of a sequence of ``ranges``, -1 where the range lacks it."""
        out = np.full(len(values), -1, np.int64)
        values, size = values.astype(np.uint64) + np.uint64(1) + base, end - begin
        for k in range(2):  # most ranges are this short
            some = np.flatnonzero((size <= 2) & (size > k) & (out < 0))
            at = begin[some] + k
            hit = self.get(at) == values[some]
            out[some[hit]] = at[hit]
        long = np.flatnonzero(size > 2)
        out[long] = self.find(values[long], begin[long], end[long])
        return out

    def find(self, values: np.ndarray, least: np.ndarray | None = None, most: np.ndarray | None = None) -> np.ndarray:
        """Index of each value by successor search, -1 where the sequence (from ``least`` up to ``most``) has no such value."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = values.astype(np.uint64)
        top = (values >> np.uint64(self.width)).astype(np.int64)
        low = values & np.uint64((1 << self.width) - 1)
        live = np.flatnonzero(top < 64 * len(self.high) - self.n)  # as many zeros
        top, low = top[live], low[live]
        # the values with the same high part lie between two zeros; among them by halving
        begin = np.zeros(len(live), np.int64)
        some = top > 0
        begin[some] = self._select(top[some] - 1, self.zeros, False) + 1 - top[some]
        end = np.zeros(len(live), np.int64)
        end[some] = self._next_zero(begin[some] - 1 + top[some])
        end[~some] = self._select(top[~some], self.zeros, False)
        end = np.minimum(end - top, self.n)
        if least is not None:
            begin, end = np.maximum(begin, least[live]), np.minimum(end, most[live])
        last = end.copy()
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            middle = (begin[open_] + end[open_]) >> 1
            less = get_bits(self.low, middle, self.width) < low[open_]
            begin[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[begin[open_] < end[open_]]
        found = np.flatnonzero(begin < last)
        found = found[get_bits(self.low, begin[found], self.width) == low[found]]
        out[live[found]] = begin[found]
        return out

    def get(self, index: np.ndarray) -> np.ndarray:
        """Values at the given indexes."""
        top = self._select(index, self.ones, True) - index
        return (top.astype(np.uint64) << np.uint64(self.width)) | get_bits(self.low, index, self.width)
