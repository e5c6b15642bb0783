"""Elias-Fano coding of ascending integers, for many look-ups at once.

A value's low bits are stored as they are, its high part in unary: bit (high + i) is set for value i. A directory has
the number of set bits before each 64-bit word. Arrays are plain, so a mapped file serves as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ONE = np.uint64(1)
#: Place of the r-th set bit of each byte.
PLACE = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    _set = [k for k in range(8) if _byte >> k & 1]
    PLACE[_byte, : len(_set)] = _set


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits each, one after the other, with eight spare bytes."""
    out = np.zeros((len(values) * width + 7) // 8 + 8, np.uint8)
    for begin in range(0, len(values), 1 << 16):  # a multiple of 8 values: whole bytes
        part = values[begin : begin + (1 << 16)]
        bits = (part[:, None] >> np.arange(width, dtype=np.uint64) & ONE).astype(np.uint8)
        packed = np.packbits(bits.ravel(), bitorder="little")
        out[begin * width // 8 : begin * width // 8 + len(packed)] = packed
    return out


@dataclass
class EliasFano:
    n: int
    width: int
    low: np.ndarray
    high: np.ndarray
    rank: np.ndarray
    clear: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """Of ascending values below ``universe``."""
        n = len(values)
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        place = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        words = ((universe >> width) + n + 64) // 64 + 1
        high = np.zeros(words, np.uint64)
        word, first = np.unique(place >> 6, return_index=True)
        if n:
            high[word] = np.bitwise_or.reduceat(ONE << (place & 63).astype(np.uint64), first)
        rank = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.uint32)[:-1]]).astype(np.uint32)
        return cls(n, width, _pack(values & np.uint64((1 << width) - 1), width), high, rank)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}_shape": np.array([self.n, self.width], np.int64), f"{name}_low": self.low, f"{name}_high": self.high, f"{name}_rank": self.rank}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = arrays[f"{name}_shape"].view(np.int64).tolist()
        return cls(n, width, arrays[f"{name}_low"], arrays[f"{name}_high"].view(np.uint64), arrays[f"{name}_rank"].view(np.uint32))

    def _clear(self) -> np.ndarray:
        """Clear bits before each word."""
        if self.clear is None:
            self.clear = np.arange(len(self.rank)) * 64 - self.rank
        return self.clear

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        words = np.ndarray((len(self.low) - 7,), np.uint64, self.low, strides=(1,))  # the eight bytes from any byte on
        return words[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << self.width) - 1)

    def _select(self, r: np.ndarray, zero: bool) -> np.ndarray:
        """Place of the r-th (from 0) clear or set bit."""
        before = self._clear() if zero else self.rank
        word = np.searchsorted(before, r, "right") - 1
        left = (r - before[word]).astype(np.int64)
        bits = self.high[word]
        bits = ~bits if zero else bits
        place = word * 64
        for half in (32, 16, 8):  # the half of what is left that has the bit
            lower = bits & np.uint64((1 << half) - 1)
            count = np.bitwise_count(lower)
            above = left >= count
            left -= np.where(above, count, 0)
            place += np.where(above, half, 0)
            bits = np.where(above, bits >> np.uint64(half), lower)
        return place + PLACE[(bits & np.uint64(0xFF)).astype(np.int64), np.minimum(left, 7)]

    def _run(self, place: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Set bits from each place to the next clear bit, the ``zero``-th one: seen in the 64 bits from there on, if it is there."""
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        after = self.high[np.minimum(word + 1, len(self.high) - 1)]
        bits = self.high[word] >> shift | after << ONE << (np.uint64(63) - shift)
        run = np.bitwise_count((bits ^ (bits + ONE)) >> ONE).astype(np.int64)
        long = np.flatnonzero(run > 62)
        run[long] = self._select(zero[long], zero=True) - place[long]
        return run

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values by index."""
        high = self._select(i, zero=False) - i
        return high << self.width | self._low(i).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1: the successor search in the range of its high part."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        low = values & np.uint64((1 << self.width) - 1)
        if (high[1:] >= high[:-1]).all():  # ascending values need no sort
            new = np.concatenate([[True], high[1:] != high[:-1]])[: len(high)]
            different, back = high[new], np.cumsum(new) - 1
        else:
            different, back = np.unique(high, return_inverse=True)
        place = np.where(different > 0, self._select(np.maximum(different - 1, 0), zero=True) + 1, 0)
        start = place - different
        lo, hi = start[back], (start + self._run(place, different))[back]
        limit = hi.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):
            middle = (lo[active] + hi[active]) >> 1
            less = self._low(middle) < low[active]
            lo[active] = np.where(less, middle + 1, lo[active])
            hi[active] = np.where(less, hi[active], middle)
            active = active[lo[active] < hi[active]]
        out = np.full(len(values), -1, np.int64)
        inside = np.flatnonzero(lo < limit)
        same = self._low(lo[inside]) == low[inside]
        out[inside[same]] = lo[inside[same]]
        return out
