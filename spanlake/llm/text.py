"""Vectorised splitting and hashing of words over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D (``[^\\x20\\x09-\\x0D]+``);
these bytes never occur inside a UTF-8 sequence, so words are cut on the raw buffer.
Null texts have no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), element-wise."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


class Words(NamedTuple):
    """Words of a run of documents: word ``j`` is ``data[starts[j]:ends[j]]``; document ``d``
    has words ``first[d]`` up to ``first[d + 1]``.  In ``data`` words of one document are
    joined by exactly one space."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def raw_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row (nulls are empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1]
    off = off.astype(np.int64) if len(off) else np.zeros(1, np.int64)
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0]:off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def split_words(arr: pa.Array, lower: bool = False, breaks: np.ndarray = SPACE) -> Words:
    """Words of every row, cut at the bytes of ``breaks`` and copied into a buffer where they are joined by one space."""
    raw, off = raw_bytes(arr)
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(raw, z, z, np.zeros(len(off), np.int64))
    word = ~breaks[raw]
    begins = np.zeros(n + 1, bool)
    begins[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | begins[1:n]
    starts = np.flatnonzero(start)
    end = word.copy()
    end[:-1] &= ~word[1:] | begins[1:n]
    ends = np.flatnonzero(end) + 1
    keep = word.copy()
    keep[1:] |= word[:-1]  # one separator after each word
    data = raw[keep]
    data = np.where(breaks[data], np.uint8(0x20), LOWER[data] if lower else data)
    at = np.cumsum(keep) - keep
    return Words(data, at[starts], at[ends - 1] + 1, np.searchsorted(starts, off))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word: multilinear over its bytes, finalised with its length."""
    n = len(w.starts)
    if n == 0:
        return np.zeros(0, U64)
    size = w.ends - w.starts
    value = np.where(SPACE[w.data], U64(0), _BYTE[w.data])
    place = np.arange(len(w.data), dtype=np.int64) - np.repeat(w.starts, np.diff(np.append(w.starts, len(w.data))))
    keys = mix(np.arange(1, int(place.max()) + 2, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
    value *= keys[place]
    return mix(np.add.reduceat(value, w.starts) ^ (size.astype(U64) * U64(0xA24BAED4963EE407)))


def give_back() -> None:
    """Return memory that a worker has freed but still holds: workers live on, from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    total = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, int(total[to - 1])
    give_back()


def crc_mod(ids: list, mod: int = 5) -> np.ndarray:
    """crc32 of each id written as text, modulo ``mod``; a null id counts as the empty text."""
    import zlib
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % mod for i in ids), np.int64, len(ids))
