"""Vectorised words of Arrow text columns: hashes, rows and lines in one pass over the bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
#: Bytes of text handled at a time; numpy holds a few eight-byte arrays of that length.
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words split at white space, and of lower-cased words of letters, digits and non-ASCII.
SPACED = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = U64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a little-endian word; bytes from which a string is hashed at once.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words in order: ``hash``, ``row`` of the column, ``line`` in the row, ``start``/``end`` in ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    line: np.ndarray | None
    start: np.ndarray
    end: np.ndarray
    n_rows: int

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the n + 1 offsets of rows in them; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(offs) == 0 or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the texts of each take about ``limit`` bytes (one row at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def words_of(column: pa.Array, inside: np.ndarray = SPACED, fold: np.ndarray | None = None, lines: bool = False) -> Words:
    """All words of a text column: maximal runs of ``inside`` bytes, optionally mapped by ``fold`` first."""
    data, offs = bytes_of(column)
    n = len(offs) - 1
    if fold is not None:
        data = fold[data]
    is_word = inside[data]
    first, last = is_word.copy(), is_word.copy()
    if len(data):
        first[1:] &= ~is_word[:-1]
        last[:-1] &= ~is_word[1:]
        filled = offs[:-1][offs[1:] > offs[:-1]]
        first[filled] = is_word[filled]
        last[filled[1:] - 1] = is_word[filled[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(start, offs)))
    line = None
    if lines:
        breaks = np.flatnonzero(data == 10)
        passed = np.cumsum(np.bincount(np.searchsorted(start, breaks), minlength=len(start) + 1))[: len(start)]
        line = passed - np.searchsorted(breaks, offs[:-1])[row]
    return Words(data, offs, hashes(data, start, end - start), row, line, start, end, n)


def hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of byte strings of ``data``, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix(length.astype(U64) * _BASE ^ (eight[start] & _HEAD[np.minimum(length, 8)]))
    at = np.flatnonzero(length > 8)
    k = 8
    while len(at) and k < _LONG:
        out[at] = mix(out[at] ^ (eight[start[at] + k] & _HEAD[np.minimum(length[at] - k, 8)]))
        k += 8
        at = at[length[at] > k]
    for i in at.tolist():
        out[i] = out[i] ^ U64(xxhash.xxh3_64_intdigest(data[start[i] + k : start[i] + length[i]].tobytes()))
    return out


def combine(parts: np.ndarray, begin: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Order-sensitive hash of consecutive runs of 64-bit values; empty runs give the hash of nothing."""
    out = np.zeros(len(begin), U64)
    some = length > 0
    if some.any():
        place = np.arange(len(parts)) - np.repeat(begin[some], length[some])
        value = mix(parts + U64(seed)) * (mix(place.astype(U64) + U64(seed)) | U64(1))
        out[some] = np.add.reduceat(value, begin[some])
    return mix(out ^ (length.astype(U64) * _BASE) ^ U64(seed))


def runs(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each row's run in a sorted row index."""
    length = np.bincount(row, minlength=n)
    return np.concatenate([[0], np.cumsum(length)[:-1]]) if n else np.zeros(0, np.int64), length
