"""Texts as sequences of white-space chunks, and per-worker caches of what a chunk is worth.

A tokenizer, a character model or a shape depends on one chunk at a time, and the chunks of a corpus
repeat; so each slice of texts is dictionary-encoded by Arrow and only new chunks are worked on.
Caches hold a bounded number of entries, those last asked for; they change no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyroom.llm.arrays import buffers, ragged, slices

SLICE_BYTES = 4 << 20
CACHE_ENTRIES = 250_000
WORK_CHUNKS = 20_000


class Ragged:
    """A growing array of rows of numbers."""

    def __init__(self, dtype):
        self.flat, self.used = np.empty(1 << 16, dtype), 0
        self.offsets, self.rows = np.zeros(1 << 14, np.int64), 0

    def _room(self, numbers: int, rows: int) -> tuple[int, int]:
        """Makes room for so many; where numbers and rows will end."""
        need, many = self.used + numbers, self.rows + rows
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(2 * need - self.used, self.flat.dtype)])
        if many + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets[: self.rows + 1], np.empty(2 * many, np.int64)])
        return need, many

    def extend(self, rows: list | np.ndarray | tuple[np.ndarray, np.ndarray]) -> None:
        """``rows``: lists of numbers or their bytes, a matrix with a row for each, or all numbers and how many each row has."""
        if isinstance(rows, tuple):
            flat, sizes = rows
            need, many = self._room(int(sizes.sum()), len(sizes))
            self.flat[self.used : need] = flat
            self.offsets[self.rows + 1 : many + 1] = self.used + np.cumsum(sizes)
            self.used, self.rows = need, many
            return
        packed = len(rows) > 0 and isinstance(rows[0], bytes)
        sizes = np.full(len(rows), rows.shape[1]) if isinstance(rows, np.ndarray) else np.fromiter(map(len, rows), np.int64, len(rows)) // (self.flat.itemsize if packed else 1)
        need, many = self._room(int(sizes.sum()), len(rows))
        self.flat[self.used : need] = np.frombuffer(b"".join(rows), self.flat.dtype) if packed else rows.ravel() if isinstance(rows, np.ndarray) else np.fromiter((x for r in rows for x in r), self.flat.dtype, need - self.used)
        self.offsets[self.rows + 1 : many + 1] = self.used + np.cumsum(sizes)
        self.used, self.rows = need, many


class Cache:
    """Rows of numbers by chunk.  ``work`` gets new chunks and returns a row for each.

    Two generations of half of ``limit`` chunks: what is asked for moves to the younger; when that is full, the older goes."""

    def __init__(self, work: Callable[[list[str]], list], dtype=np.uint32, limit: int = CACHE_ENTRIES):
        self.work, self.dtype, self.limit = work, dtype, limit
        self.index: dict[str, int] = {}
        self.table = Ragged(dtype)
        self.old: tuple[dict[str, int], Ragged] = {}, Ragged(dtype)

    def _add(self, chunks: list[str], rows) -> np.ndarray:
        first = self.table.rows
        self.table.extend(rows)
        self.index.update(zip(chunks, range(first, first + len(chunks))))
        return np.arange(first, first + len(chunks))

    def places(self, chunks: list[str]) -> np.ndarray:
        """The table's row of each of some distinct chunks."""
        if self.index and len(self.index) + len(chunks) > self.limit // 2:
            self.old = self.index, self.table
            self.index, self.table = {}, Ragged(self.dtype)
        get, known = self.index.get, self.old[0].get
        at = np.fromiter((get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        if len(new) and self.old[0]:
            before = np.fromiter((known(chunks[i], -1) for i in new.tolist()), np.int64, len(new))
            again, table = new[before >= 0], self.old[1]
            starts, sizes = table.offsets[before[before >= 0]], np.diff(table.offsets[: table.rows + 1])[before[before >= 0]]
            at[again] = self._add([chunks[i] for i in again.tolist()], (table.flat[ragged(starts, sizes)], sizes))
            new = new[before < 0]
        for i in range(0, len(new), WORK_CHUNKS):  # bounds what the work holds at once
            some = new[i : i + WORK_CHUNKS]
            fresh = [chunks[k] for k in some.tolist()]
            at[some] = self._add(fresh, self.work(fresh))
        return at

    def expand(self, chunks: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the sequence ``codes`` of chunks, and how many each chunk gave."""
        at = self.places(chunks)[codes] if len(chunks) else np.empty(0, np.int64)
        starts, counts = self.table.offsets[at], self.table.offsets[at + 1] - self.table.offsets[at]
        return self.table.flat[ragged(starts, counts)], counts


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of rows offsets[i] .. offsets[i+1]-1, each by itself; zeros for empty segments."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def chunked(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[str]]]:
    """For slices of rows: lo, hi, chunk offsets of the rows, chunk codes, the distinct chunks."""
    for lo, hi, at, codes, chunks in coded(col, limit):
        yield lo, hi, at, codes, chunks.to_numpy(zero_copy_only=False).tolist()


def coded(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """``chunked`` with the distinct chunks as an array of large strings."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "")
    _, offsets = buffers(col)
    for lo, hi in slices(offsets, limit):
        part = pc.ascii_split_whitespace(col[lo:hi].cast(pa.large_string()))
        at = part.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = part.values[at[0] : at[-1]].dictionary_encode()
        yield lo, hi, at - at[0], distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64), distinct.dictionary
