"""Vectorised word handling on the UTF-8 bytes of Arrow string columns.

Words are maximal runs of bytes outside a separator table. All separators used here are ASCII, so bytes and
code points agree. The words of a block are told apart exactly, by a dictionary of their bytes. A distinct word has 128 bits of hash: its
bytes go through a mixer eight at a time (no sum or polynomial, whose collisions could be built in), and long words through BLAKE2b.
Shingles combine their words' hashes through the mixer too. All depend on nothing but the bytes, so every worker and every run
computes the same ones. Hashes propose; where equality decides a result, callers compare the words themselves.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

U64 = np.uint64
#: Words of more bytes are hashed one by one.
SHORT = 32
#: Masks that leave the first 0 to 8 bytes of a little-endian word of memory.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)


def _separators(keep) -> np.ndarray:
    table = np.ones(256, bool)
    table[keep] = False
    return table


#: ``[^\x20\x09-\x0D]+``
SPACE = _separators([b for b in range(256) if b not in (0x20, 9, 10, 11, 12, 13)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
ALNUM = _separators([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Words:
    """starts and ends in the block's bytes; row i has the words ptr[i]:ptr[i+1]. Word i is ``distinct[codes[i]]``."""

    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray
    codes: np.ndarray
    distinct: pa.Array

    @functools.cached_property
    def _digests(self) -> np.ndarray:
        return word_digests(self.distinct)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        """The first 64 bits of each word's hash."""
        return self._digests[self.codes, 0]

    @functools.cached_property
    def seconds(self) -> np.ndarray:
        """The other 64 bits."""
        return self._digests[self.codes, 1]


class Vocabulary:
    """Some words, numbered from 1 in the order of their hashes. Numbers are by equality of bytes."""

    def __init__(self, words: list[bytes]):
        some = pa.array(sorted(set(words)), pa.large_binary())
        first = word_digests(some)[:, 0]
        order = np.argsort(first, kind="stable")
        self.words, self.first = some.take(pa.array(order)), first[order]
        self.apart = bool((self.first[1:] != self.first[:-1]).all())

    def numbers(self, w: Words) -> np.ndarray:
        """The number of every word of a block, 0 for those that aren't here."""
        if not len(self.words) or not len(w.distinct):
            return np.zeros(len(w.codes), np.int64)
        if not self.apart:  # two words share 64 bits
            return (pc.fill_null(pc.index_in(w.distinct, self.words), -1).to_numpy() + 1).astype(np.int64)[w.codes]
        at = np.searchsorted(self.first, w._digests[:, 0])
        at[at == len(self.first)] = 0
        maybe = np.flatnonzero(self.first[at] == w._digests[:, 0])
        same = pc.equal(self.words.take(pa.array(at[maybe])), w.distinct.take(pa.array(maybe))).to_numpy(zero_copy_only=False)
        out = np.zeros(len(w.distinct), np.int64)
        out[maybe[same]] = at[maybe[same]] + 1
        return out[w.codes]


def word_digests(words: pa.Array, cut: int | None = None) -> np.ndarray:
    """128-bit hashes (n, 2) of words, or of their first ``cut`` bytes (SHORT at most)."""
    n = len(words)
    out = np.empty((n, 2), U64)
    if not n:
        return out
    _, offsets, data = words.buffers()
    offs = np.frombuffer(offsets, np.int64)[words.offset : words.offset + n + 1]
    padded = np.zeros(int(offs[-1]) + 8, np.uint8)
    padded[:-8] = np.frombuffer(data, np.uint8)[: offs[-1]]
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view(U64), (len(padded) - 7,), (1,))
    length = np.diff(offs) if cut is None else np.minimum(np.diff(offs), cut)
    out[:, 0], out[:, 1] = mix(length.astype(U64) ^ U64(0x452821E638D01377)), mix(length.astype(U64) ^ U64(0xBE5466CF34E90C6C))
    for at in range(0, SHORT, 8):
        some = np.flatnonzero((length > at) & (length <= SHORT))
        lane = lanes[offs[some] + at] & _FIRST[np.minimum(length[some] - at, 8)]
        out[some, 0], out[some, 1] = joined(out[some, 0], lane), joined(out[some, 1], lane)
    for i in np.flatnonzero(length > SHORT).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(words[i].as_buffer(), digest_size=16).digest(), U64)
    return out


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive row groups of about ``size`` bytes."""
    data, offs = raw(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, separators: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = flat.dictionary_encode()
    return Words(starts, ends, np.searchsorted(starts, offs), coded.indices.to_numpy(), coded.dictionary)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs; the order counts."""
    return mix(mix(a * U64(0x9E3779B97F4A7C15) + U64(0x1F83D9ABFB41BD6B)) ^ b)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values, put together from those of 1, 2, 4, ... values."""
    out, have, part, size = None, 0, h, 1
    while True:
        if k & size:
            out = part if out is None else joined(out[: max(0, len(part) - have)], part[have:])
            have += size
        size *= 2
        if size > k:
            return mix(out ^ U64(k))
        part = joined(part[: max(0, len(part) - size // 2)], part[size // 2 :])


def grams(hashes: np.ndarray, ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles that lie in one row, the word each begins at, and row pointers into both."""
    counts = np.maximum(np.diff(ptr) - k + 1, 0)
    gptr = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(gptr[-1]) + np.repeat(ptr[:-1] - gptr[:-1], counts)
    out = np.empty(len(at), U64)
    step = BLOCK_BYTES // 4
    for i in range(0, len(at), step):
        some = at[i : i + step]
        out[i : i + step] = rolling(hashes[some[0] : some[-1] + k], k)[some - some[0]]
    return out, at, gptr


def as_long(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def lists(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values, kind))
