"""Vectorised work on the UTF-8 bytes of many texts at once.

All arithmetic is modulo 2**64.  A word's hash is a polynomial over its bytes, a window's hash a
polynomial over the hashes of its words; both come from running sums, so their cost does not depend
on the length of the word or window.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

#: Odd 64-bit multipliers of the two polynomials.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
MASK = (1 << 64) - 1

SLICE_BYTES = 512 << 10


#: What a worker keeps from one task to the next: of one operator only, the last that kept something.
_memory: dict = {}


def forget_all_but(of: str) -> None:
    if _memory.get("of") != of:
        _memory.clear()
        _memory["of"] = of


def remembered(of: str, key, make: Callable):
    """What ``make`` gives, kept in this worker for the operator ``of`` until another operator has a task here."""
    forget_all_but(of)
    if key not in _memory:
        _memory[key] = make()
    return _memory[key]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, before which what other operators have kept in this worker goes, and after which the worker gives what it no longer
    uses back to the system: workers outlive their tasks and idle beside the next stage's."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_all_but(run.__module__)
        yield from run(batches)
        _powers.cache_clear()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
            trim(0)

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(8)
def _powers(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(10, int(n - 1).bit_length() if n > 1 else 1))[:n]


@lru_cache(1)
def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and the offsets of its rows; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least: bounds the arrays made from them."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def byte_class(*ranges: tuple[int, int], invert: bool = False) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return ~out if invert else out


#: Words of letters, digits and everything beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Words of everything but ASCII white space.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D), invert=True)
#: Maps A-Z to a-z and leaves other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """The words of rows lo..hi: byte spans, row of each word, hash of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = False):
        self.rows = len(offsets) - 1
        base = int(offsets[0])
        self.data = data[base : int(offsets[-1])]
        self.offsets = offsets - base
        inside = kind[self.data]
        left = np.empty_like(inside)
        n = len(inside)
        if n:
            left[0] = False
            left[1:] = inside[:-1]
            begins = self.offsets[:-1]
            left[begins[begins < n]] = False
            right = np.empty_like(inside)
            right[-1] = False
            right[:-1] = inside[1:]
            ends = self.offsets[1:]
            right[ends[ends > 0] - 1] = False
            self.start = np.flatnonzero(inside & ~left)
            self.end = np.flatnonzero(inside & ~right) + 1
        else:
            self.start = self.end = np.empty(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)  # word offsets of rows
        self.first[-1] = len(self.start)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)
        codes = byte_codes()[LOWER] if lower else byte_codes()
        run = np.zeros(n + 1, np.uint64)
        if n:
            np.cumsum(codes[self.data] * powers(BYTE_BASE, n), out=run[1:])
        inverse = powers(pow(BYTE_BASE, -1, 1 << 64), n + 1)
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix((run[self.end] - run[self.start]) * inverse[self.start] + size)

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``k`` words inside one row."""
        n = len(self.start)
        if n < k:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.row[k - 1 :] == self.row[: n - k + 1])
        return at, self.spans(at, at + k)

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the words first..last (exclusive) for each pair."""
        n = len(self.start)
        if not hasattr(self, "_run"):
            self._run = np.zeros(n + 1, np.uint64)
            np.cumsum(self.hash * powers(WORD_BASE, max(n, 1))[:n], out=self._run[1:])
        inverse = powers(pow(WORD_BASE, -1, 1 << 64), n + 1)
        return mix((self._run[last] - self._run[first]) * inverse[first] + (last - first).astype(np.uint64))


def words_of(col: pa.Array, kind: np.ndarray, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    data, offsets = buffers(col)
    for lo, hi in slices(offsets, limit):
        yield lo, hi, Words(data, offsets[lo : hi + 1], kind, lower)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+counts[i]-1 of every i, one after another."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - shift, counts)
