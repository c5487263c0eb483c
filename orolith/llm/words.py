"""Words of many texts at once: runs of bytes between separators, found by table lookups on Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def table_of(members: Iterator[int]) -> np.ndarray:
    """A table of 256 flags, true for the given byte values."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def slices(batch: pa.RecordBatch, text: int, size: int) -> Iterator[pa.RecordBatch]:
    """batch in consecutive parts whose texts (column number `text`, binary) have at most `size` bytes, or one row."""
    at, ends = 0, bounds(batch.column(text))[1][1:]
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array and where each text begins in them, the end last; nulls are empty."""
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def words(texts: pa.Array, apart: np.ndarray, change: np.ndarray | None = None) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words, count of words of each text): words are the runs of bytes that are not `apart`, in order
    and dictionary encoded. `change` replaces bytes by a table of 256."""
    data, at = bounds(texts)
    gap = apart[data]
    starts_after, ends_before = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
    starts_after[1:], ends_before[:-1] = gap, gap
    starts_after[at], ends_before[at] = True, True
    first = np.flatnonzero(~gap & starts_after[:-1])
    last = np.flatnonzero(~gap & ends_before[1:])
    kept = data[~gap]
    if change is not None:
        kept = change[kept]
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first + 1, out=offsets[1:])
    out = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    return out.dictionary_encode(), np.diff(np.searchsorted(first, at))
