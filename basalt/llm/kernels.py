"""Vectorised text kernels over Arrow buffers: word splitting, hashing and shingles in numpy.

A word's hash is a polynomial over its bytes modulo 2**64, taken from one prefix sum over the whole
chunk, then mixed. All positions are relative to the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Also every ASCII character that is neither a letter nor a digit.
PUNCT = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x + U((seed * _BASE + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        t = np.full(n + 1, base, U)
        t[0] = 1
        out.append(np.cumprod(t, dtype=U))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _power_tables(max(CHUNK, 1 << max(1, n).bit_length()))


@dataclass
class Words:
    """Words of a chunk of documents: ``first[d]:first[d + 1]`` are those of document d."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(buf: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK, fold: np.ndarray = LOWER) -> Words:
    """Split the documents ``buf[offsets[d]:offsets[d + 1]]`` and hash each word."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64))
    solid = ~blank[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    power, inverse = _powers(n)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum((fold[buf].astype(U) + U(1)) * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash for each run of k consecutive words, regardless of document borders."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out += hashes[j : j + n] * U((2 * j + 1) * _BASE & (2**64 - 1) | 1)
    return mix(out, seed + k)


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Of the runs of k words, those that lie in one document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc[: len(doc) - k + 1] == doc[k - 1 :] if len(doc) >= k else np.zeros(0, bool)


def shingle_sets(w: Words, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each document; fewer than k words are one shingle, none are none."""
    g = grams(w.hashes, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(grams(w.hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def sequence_keys(w: Words) -> np.ndarray:
    """A 128-bit key of each document's word sequence, as an (n, 2) array."""
    n = len(w.first) - 1
    place = np.arange(len(w.hashes), dtype=np.int64) - np.repeat(w.first[:-1], np.diff(w.first))
    out = np.zeros((n, 2), U)
    for c in (0, 1):
        sums = np.zeros(len(w.hashes) + 1, U)
        np.cumsum(mix(w.hashes ^ mix(place.astype(U), 11 + c), 21 + c), out=sums[1:])
        out[:, c] = mix(sums[w.first[1:]] - sums[w.first[:-1]] + np.diff(w.first).astype(U), 31 + c)
    return out


def keys_to_arrow(keys: np.ndarray) -> pa.Array:
    """Rows of an (n, m) array of unsigned words as fixed-length binary values."""
    keys = np.ascontiguousarray(keys)
    size = keys.dtype.itemsize * (keys.shape[1] if keys.ndim > 1 else 1)
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * size
    return pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(keys.tobytes())])


def binary_rows(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The inverse of keys_to_arrow."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), kind)
    _, where, data = column.buffers()
    lo = int(np.frombuffer(where, np.int32)[column.offset])
    return np.frombuffer(data, np.uint8)[lo : lo + len(column) * width * np.dtype(kind).itemsize].view(kind).reshape(len(column), width)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
