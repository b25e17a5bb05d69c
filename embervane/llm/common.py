"""Helpers of the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.llm import kernel as K
from embervane.session import prepare

BatchMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def map_arrow(df: DataFrame, f: BatchMap, schema: str) -> DataFrame:
    """mapInArrow() of ``f``; a worker gives what a task has used back to the system before its next one."""
    prepare(df.sparkSession)

    def g(batches):
        try:
            yield from f(batches)
        finally:
            released_memory()

    return df.mapInArrow(g, schema)


def released_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not this C library: it keeps its free memory


def fresh(df: DataFrame) -> str:
    """A name that no column of ``df`` has, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, "__own"
    while name in taken:
        name += "_"
    return name


def per_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Recuts sorted batches so that no run of equal keys is divided."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k, k[-1]))
        if last == 0 and held and held[-1].column(key)[-1].as_py() == k[0]:
            held.append(b)
            continue
        if last:
            held.append(b.slice(0, last))
        if held:
            yield pa.Table.from_batches(held)
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


#: Bits of a filter for each id, and of all of it at most: 16 MB.
FILTER_BITS_PER_ID, FILTER_BITS = 16, 1 << 27
_HASHES = 4


class IdFilter:
    """A Bloom filter of ids: it may take an id for one of them that isn't, but never the other way."""

    def __init__(self, bits: int):
        self.words = np.zeros(bits // 64, np.uint64)
        self.bits = bits

    @staticmethod
    def places(ids: np.ndarray, bits: int) -> np.ndarray:
        h = ids.astype(np.int64, copy=False).view(np.uint64)
        return np.stack([K.mix(h + K.U64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) & K.U64(bits - 1) for k in range(_HASHES)])

    def may_have(self, ids: np.ndarray) -> np.ndarray:
        at = self.places(ids, self.bits)
        return ((self.words[(at >> K.U64(6)).astype(np.int64)] >> (at & K.U64(63)) & K.U64(1)) == 1).all(axis=0)


def id_filter(rows: DataFrame, column: str, most_bits: int | None = None) -> IdFilter:
    """The filter of a bigint column's values, of ``FILTER_BITS_PER_ID`` bits each and ``FILTER_BITS`` in all at most; a fuller filter is wrong more often, which costs its users rows, not results."""
    most = most_bits or FILTER_BITS
    bits = min(most, 1 << max(12, (FILTER_BITS_PER_ID * rows.count() - 1).bit_length()))

    def f(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            if len(ids):
                at = np.unique(IdFilter.places(ids, bits))
                word, first = np.unique(at >> K.U64(6), return_index=True)
                mask = np.bitwise_or.reduceat(K.U64(1) << (at & K.U64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])

    some = map_arrow(rows.select(F.col(column).alias("id")).where("id IS NOT NULL"), f, "word bigint, mask bigint")
    got = some.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = IdFilter(bits)
    out.words[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return out
