"""Vectorised text helpers for Arrow batches: blocks, words, hashes, per-document sums.

Everything works on the UTF-8 bytes of many documents at once, so the cost per document is a
share of a few numpy calls. Blocks are cut by bytes, which bounds memory whatever the row sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Space and the control characters 0x09-0x0D end a word.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random 64-bit value for each byte, and the base of polynomial hashes.
RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, dtype=np.uint64)


class Block:
    """Rows ``lo:hi`` of a batch with the bytes of their texts; a null text has no bytes."""

    __slots__ = ("data", "hi", "lo", "offsets")

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo


def text_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array and the offset of each row (one more than rows)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if array.null_count:
        null = array.is_null().to_numpy(zero_copy_only=False)
        if (np.diff(off)[null] > 0).any():
            parts = [raw[a:b] for a, b, n in zip(off[:-1], off[1:], null, strict=True) if not n]
            sizes = np.where(null, 0, np.diff(off))
            return (np.concatenate(parts) if parts else raw[:0]), np.concatenate([[0], np.cumsum(sizes)])
    return raw[off[0] : off[-1]], off - off[0]


def blocks(array, most: int = 1 << 20) -> Iterator[Block]:
    """Cut an array into blocks of about ``most`` bytes; a longer text is a block of its own."""
    data, off = text_bytes(array)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield Block(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 2 * len(_powers)), BASE, dtype=np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers


def runs_of(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true; a run never crosses an offset."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    prev = np.empty_like(flag)
    prev[0], prev[1:] = False, flag[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(flag)]
    prev[cuts] = False
    starts = np.flatnonzero(flag & ~prev)
    nxt = np.empty_like(flag)
    nxt[-1], nxt[:-1] = False, flag[1:]
    cuts = cuts[cuts > 0] - 1
    nxt[cuts] = False
    return starts, np.flatnonzero(flag & ~nxt) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span of bytes, the same in every task."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    pos = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    value = RANDOM[data[pos + np.repeat(starts, sizes)]]
    value *= powers(int(sizes.max()))[pos]
    return mix(np.add.reduceat(value, first) ^ sizes.astype(np.uint64))


def owner(offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted starts: the row of each, and the offset of each row's first start (one more than rows)."""
    first = np.searchsorted(starts, offsets)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``, zero for empty rows."""
    total = np.concatenate([np.zeros(1, np.int64 if values.dtype.kind in "bui" else np.float64), np.cumsum(values, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)])
    return total[first[1:]] - total[first[:-1]]


class Words:
    """The words of a block: spans, hashes, and where each document's words begin."""

    __slots__ = ("ends", "first", "hashes", "row", "starts")

    def __init__(self, block: Block, separators: np.ndarray = SPACE, data: np.ndarray | None = None):
        data = block.data if data is None else data
        self.starts, self.ends = runs_of(~separators[data], block.offsets)
        self.hashes = span_hashes(data, self.starts, self.ends)
        self.row, self.first = owner(block.offsets, self.starts)


def windows(codes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every run of n codes and a mask of those that lie inside one row."""
    h = codes.copy()
    for j in range(1, n):
        h = h[: len(h) - 1] * BASE + codes[j : j + len(h) - 1] if len(h) > 1 else h[:0]
    count = np.diff(first)
    left = np.repeat(first[1:], count) - np.arange(len(codes))
    return mix(h), left[: len(h)] >= n
