"""Whole texts as byte arrays: words, lines and their hashes for a batch of rows at once."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; a longer text is handled alone and whole.
STEP = 1 << 20
#: Bytes of a range whose hash comes from running sums.
SHORT = 64

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words that are runs without white space.
DARK = ~WHITE
#: Bytes of words of lower-case letters, digits and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SALT = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << 16 if n <= 1 << 16 else max(n, STEP + STEP // 4)
        for k, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the machine, which a worker that waits for its next task would keep (as far as the C library can)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Hasher:
    """Hashes of any byte ranges of one buffer.

    Ranges of up to SHORT bytes come from running sums modulo 2**64, whose first collisions by structure (strings and
    complements in the order of Thue and Morse) need 1,024 bytes. Longer ranges are hashed byte by byte (XXH3).
    """

    def __init__(self, buffer: np.ndarray):
        up, self.down = powers(len(buffer) + 1)
        self.buffer = buffer
        self.sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(_SALT[buffer] * up[: len(buffer)], out=self.sums[1:])

    def rolling(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """From running sums whatever the length: for choices that no result rests on."""
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = self.rolling(start, end)
        long = np.flatnonzero(end - start > SHORT)
        if len(long):
            data = memoryview(np.ascontiguousarray(self.buffer))
            ranges = zip(start[long].tolist(), end[long].tolist(), strict=True)
            out[long] = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in ranges), np.uint64, len(long))
        return out


class Texts:
    """Some rows' texts in one buffer; text i is ``data[at[i]:at[i + 1]]``."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False):
        self.data, self.at = LOWER[data] if lower else data, at

    def __len__(self) -> int:
        return len(self.at) - 1

    def runs(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes of a kind, none across texts; the first run of each text."""
        n = len(self.data)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = kind[self.data]
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        edges = self.at[1:-1]
        edges = np.unique(edges[(edges > 0) & (edges < n)])
        edges = edges[(inside[edges] == 1) & (inside[edges + 1] == 1)]
        if len(edges):  # a run that goes on in the next text
            starts, ends = np.sort(np.concatenate([starts, edges])), np.sort(np.concatenate([ends, edges]))
        return starts, ends, np.searchsorted(starts, self.at)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines split at newlines; the first line of each text."""
        cuts = np.flatnonzero(self.data == 0x0A)
        starts = np.sort(np.concatenate([self.at[:-1], cuts + 1]))
        ends = np.sort(np.concatenate([cuts, self.at[1:]]))
        first = np.searchsorted(cuts, self.at) + np.arange(len(self.at))
        return starts, ends, first


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, at - at[0]


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", lower: bool = False, size: int = STEP) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches with about ``size`` bytes of text each, never part of a text."""
    for batch in batches:
        data, at = text_buffer(batch.column(column))
        begin = 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, "right")) - 1)
            yield batch.slice(begin, end - begin), Texts(data[at[begin] : at[end]], at[begin : end + 1] - at[begin], lower)
            begin = end
    batch = data = at = None
    give_back()


def group_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of values; group i is ``values[first[i]:first[i + 1]]``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def planes(values: np.ndarray) -> bytes:
    """Values with all first bytes first, then all second bytes and so on: small ones compress well."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values as differences."""
    return planes(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "u8"), dtype=np.uint64)


def find(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value is in the sorted ones, and whether it is there."""
    if not len(sorted_values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return at, sorted_values[at] == wanted
