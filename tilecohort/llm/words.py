"""Vectorised word handling for Arrow text batches.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``; since
those six are ASCII, splitting UTF-8 bytes and splitting code points agree.
Everything here works on one slice of one partition (a few MB of text), so
memory does not depend on the size of the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: True for the bytes that separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Maps A-Z to a-z and leaves other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U64 = np.uint64
#: glibc's call that returns free heap pages; other C libraries lack it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_TABLES: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public SplitMix64 generator: a bijection of 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """The first n odd 64-bit multipliers of a seed."""
    have = _TABLES.get(seed)
    if have is None or len(have) < n:
        size = max(256, 1 << (int(n) - 1).bit_length() if n else 1)
        steps = np.arange(1, size + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
        have = _TABLES[seed] = mix64(steps + U64(seed * 0x632BE59BD9B4E019 % 2**64)) | U64(1)
    return have[:n]


@dataclass
class Words:
    """The words of a slice of texts.

    data, offsets: bytes of the texts, and where each begins (n + 1 entries).
    starts, ends: byte range of each word; bounds: first word of each text (n + 1 entries).
    codes: index of each word in ``vocab``, the distinct words of the slice.
    """

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    codes: np.ndarray
    vocab: pa.Array

    @property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array over given bytes."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def split(texts: pa.Array, *, lower: bool = False, table: np.ndarray | None = None) -> Words:
    """Words of every text; with lower, A-Z count as a-z. A table of 256 ASCII-preserving bytes replaces bytes first."""
    data, offsets = raw(texts)
    if lower or table is not None:
        data = (LOWER if table is None else table)[data]
    space = SPACE[data]
    word = ~space
    edge = np.empty(len(data), dtype=bool)
    edge[:1] = True
    edge[1:] = space[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge & word)
    edge[-1:] = True
    edge[:-1] = space[1:]
    inner = offsets[1:-1]
    edge[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(edge & word) + 1
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    coded = binary_array(data[word], at).dictionary_encode()
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)


def word_hashes(vocab: pa.Array, seed: int = 1) -> np.ndarray:
    """64-bit hash of each entry: a multilinear sum over its bytes, then mixed with its length."""
    data, at = raw(vocab)
    lengths = np.diff(at)
    if not len(lengths):
        return np.zeros(0, U64)
    place = np.arange(len(data)) - np.repeat(at[:-1], lengths)
    terms = (data.astype(U64) + U64(1)) * multipliers(int(lengths.max(initial=0)) or 1, seed)[place]
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(terms, out=total[1:])
    return mix64(total[at[1:]] - total[at[:-1]] + lengths.astype(U64) * U64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, size: int, seed: int = 2) -> np.ndarray:
    """Hash of every run of size consecutive entries (len - size + 1 of them, over text borders too)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for j, m in enumerate(multipliers(size, seed)):
        total += hashes[j : j + n] * m
    return mix64(total)


def inside(bounds: np.ndarray, size: int) -> np.ndarray:
    """Which of the windows of ``windows(.., size)`` lie within one text; bounds as in Words."""
    n = int(bounds[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.zeros(n + size + 1, np.int32)
    first, last = bounds[:-1], bounds[1:] - size + 1
    fits = last > first
    np.add.at(ok, first[fits], 1)
    np.add.at(ok, last[fits], -1)
    return np.cumsum(ok)[:n] > 0


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice has about ``size`` bytes of text (one row at least); after the last, free memory goes back."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, at = raw(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, side="right")) - 1)
            yield batch.slice(begin, min(end, n) - begin)
            begin = end
        del batch
    give_back()


def give_back() -> None:
    """Returns what this worker's allocators hold without use; a worker lives on and would keep its task's peak."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values over each text; bounds as in Words."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def joined(w: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): the words, or those that ``keep`` selects, each followed by one space, and where each stands."""
    starts, ends = (w.starts, w.ends) if keep is None else (w.starts[keep], w.ends[keep])
    size = ends - starts
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    out = np.full(at[-1], 0x20, np.uint8)
    before = np.cumsum(size) - size
    place = np.arange(int(size.sum()))
    out[np.repeat(at[:-1] - before, size) + place] = w.data[np.repeat(starts - before, size) + place]
    return out, at[:-1], at[:-1] + size
