"""A bounded per-process memo from text chunks to their encoded ids, what worker processes keep and give back, and readers of batches in parts."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: What an entry takes beside its chunk's characters and its ids, about.
ENTRY_BYTES = 250


class Memo(dict):
    """chunk -> ids as little-endian 32-bit bytes, encoded when first met. Chunks of more than `longest` characters are not
    kept, and a memo that has come to about `most` bytes starts over, which bounds its size."""

    def __init__(self, encode: Callable[[str], list[int]], most: int = 192 << 20, longest: int = 64):
        super().__init__()
        self.encode, self.most, self.longest, self.held = encode, most, longest, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(chunk), "<u4").tobytes()
        if len(chunk) <= self.longest:
            self.held += ENTRY_BYTES + 4 * len(chunk) + len(ids)
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[chunk] = ids
        return ids


_kept: list = []
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def kept(load: Callable) -> Callable:
    """lru_cache(2) of a loader of tokenisers, whose results a worker keeps between tasks until a task of an operator without any begins."""
    cached = lru_cache(2)(load)
    _kept.append(cached)
    return cached


def release() -> None:
    """Drops what kept() loaders hold: workers serve the tasks of all operators, one after the other, until the application ends."""
    held = [c for c in _kept if c.cache_info().currsize]
    for c in held:
        c.cache_clear()
    if held:
        gc.collect()  # a tokeniser and its memo refer to each other


def give_back() -> None:
    """Memory that was freed goes to the system; this process, which may wait for a long time, would keep much of it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function on a task's batches between release() and give_back()."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        give_back()
        yield from run(batches)
        give_back()

    return tidied


def tidily(work: Callable, *args):
    """work(*args), for one group of rows, between release() and give_back()."""
    release()
    out = work(*args)
    give_back()
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int = 2_000_000) -> Iterable[pa.RecordBatch]:
    """Row ranges of a batch with about `limit` bytes in a string or binary column (at least one row each)."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def runs(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterable[tuple[tuple, pa.RecordBatch]]:
    """Rows with equal values (none null) in all of the columns that follow each other in a batch, with those values."""
    for batch in batches:
        if batch.num_rows:
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in columns:
                x = batch.column(c).to_numpy(zero_copy_only=False)
                new[1:] |= x[1:] != x[:-1]
            cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield tuple(batch.column(c)[a].as_py() for c in columns), batch.slice(a, b - a)
