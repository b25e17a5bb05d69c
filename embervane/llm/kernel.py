"""Vectorised text kernels on Arrow buffers, shared by the text operators.

A *word* is a maximal run of ASCII letters and digits and of non-ASCII characters other
than the punctuation blocks U+0080-U+00BF (without the letters among them), U+00D7, U+00F7,
U+2000-U+207F and U+3000-U+303F, after lower-casing.  Words are hashed to 64 bits without
making a Python object of any of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text and rows that one numpy pass takes at once; a longer document is taken whole.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 4096

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240117))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_ASCII_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold about ``limit`` bytes (one row at least), of ``SLICE_ROWS`` rows at most."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece, part = np.cumsum(size, dtype=np.int64) // limit, np.arange(n) // SLICE_ROWS
    cuts = [0, *(np.flatnonzero(np.diff(piece) | np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, start of each row and the end) of a string array, or of a large binary one without nulls; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type) and not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_mask(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words."""
    ok = _ASCII_WORD[data]
    if not len(data) or data.max() < 128:
        return ok
    n = len(data)
    lead = np.flatnonzero(data == 0xC2)
    lead = lead[lead + 1 < n]
    lead = lead[~np.isin(data[lead + 1], (0xAA, 0xB5, 0xBA))]
    more = np.flatnonzero(data == 0xC3)
    more = more[more + 1 < n]
    more = more[(data[more + 1] == 0x97) | (data[more + 1] == 0xB7)]
    two = np.concatenate([lead, more])
    ok[two] = ok[two + 1] = False
    for first, seconds in ((0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
        lead = np.flatnonzero(data == first)
        lead = lead[lead + 2 < n]
        lead = lead[np.isin(data[lead + 1], seconds)]
        ok[lead] = ok[lead + 1] = ok[lead + 2] = False
    return ok


@dataclass
class Words:
    """The words of a run of rows: byte ranges, hashes, and where each row's words begin."""

    data: np.ndarray
    row_at: np.ndarray
    mask: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray  # rows + 1
    hash: np.ndarray | None = None

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def split_words(texts: pa.Array, lower: bool = True, hashed: bool = True) -> Words:
    data, row_at = buffers(pc.utf8_lower(texts) if lower else texts)
    ok = word_mask(data)
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[row_at] = True
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    if n:
        before[1:] = ok[:-1]
        after[:-1] = ok[1:]
    before &= ~edge[:n]
    after &= ~edge[1:]
    start = np.flatnonzero(ok & ~before)
    end = np.flatnonzero(ok & ~after) + 1
    w = Words(data, row_at, ok, start, end, np.searchsorted(start, row_at))
    if hashed:
        w.hash = hash_ranges(data, start, end)
    return w


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint ascending byte ranges."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    at = np.cumsum(size) - size
    idx = np.arange(int(size.sum()), dtype=np.int64)
    place = idx - np.repeat(at, size)
    value = _BYTE[data[idx + np.repeat(start - at, size)]]
    value *= _PLACE[place & 63]
    return mix(np.add.reduceat(value, at) + size.astype(U64))


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start of each row) of the word n-grams; a row of fewer than n words, but one at least, has one gram of them all."""
    h, at = words.hash, words.at
    count = np.diff(at)
    k = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_at = np.concatenate([[0], np.cumsum(k)])
    size = int(out_at[-1])
    first = np.arange(size, dtype=np.int64) + np.repeat(at[:-1] - out_at[:-1], k)
    full = np.repeat(np.minimum(count, n), k)
    out = np.full(size, 0x9E3779B97F4A7C15, U64)
    last = max(len(h) - 1, 0)
    for j in range(n):
        x = out * U64(0x100000001B3) + h[np.minimum(first + j, last)] if len(h) else out
        out = np.where(j < full, x, out)
    return mix(out), out_at


def group_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups bounded by ``at``; empty groups give 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
