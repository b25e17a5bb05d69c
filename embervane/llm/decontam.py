"""Benchmark decontamination: seeds that edits can't all hit, exact edit verification.

Texts are compared as sequences of words (kernel.py: case, punctuation and white space don't count)
under the edit distance of whole words.  An item of m words that counts as contained with at most k
edits is cut into k + 1 pieces of m // (k + 1) words (four, for long items at ``TAU``).  Each edit,
whatever its kind, changes one piece at most, so any occurrence holds a piece unchanged.  Pieces are
hashed and looked up at every word of every document; whatever meets one is verified exactly, over all
words that an occurrence about that piece can reach.  So nothing within the distance is missed, at any
length, and the distances are the least there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.llm import kernel as K
from embervane.llm.common import map_arrow

#: An item counts as contained where at most this share of its words is edited.
TAU = 0.2
#: Bytes of the items' texts (each counted as 8 more) that are indexed in one pass over the documents; more of them take more passes.  The index of one pass is sent to every executor: at most some 25 times these bytes, about 3 times for prose.
BYTES_AT_ONCE = 4 << 20


class ItemIndex:
    """The benchmark items of one pass, their pieces hashed for search."""

    def __init__(self, ids: list[int], texts: list[str], tau: float = TAU):
        words = K.split_words(pa.array(texts, pa.large_string()))
        self.ids = np.array(ids, np.int64)
        self.words = [words.hash[a:b] for a, b in zip(words.at, words.at[1:])]
        self.tau = tau
        pieces: dict[int, list[tuple[int, int]]] = {}
        for item, own in enumerate(self.words):
            if len(own):
                n = min(self.limit(item) + 1, len(own))
                width = len(own) // n
                pieces.setdefault(width, []).extend((item, k * width) for k in range(n))
        #: By width: keys of the pieces, ascending, the item and offset of each, and by the low bits of a key whether some piece has it.
        self.pieces = {}
        for width, own in sorted(pieces.items()):
            item, offset = np.array(own, np.int64).T
            key = window_keys(words.hash, width)[words.at[item] + offset]
            order = np.argsort(key, kind="stable")
            maybe = np.zeros(1 << max(16, (16 * len(key)).bit_length()), bool)
            maybe[key & K.U64(len(maybe) - 1)] = True
            self.pieces[width] = key[order], item[order], offset[order], maybe

    def limit(self, item: int) -> int:
        return int(self.tau * len(self.words[item]) + 1e-9)

    def candidates(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, first word where the item would begin, from the row's first) of every piece met, each once and in order."""
        out = []
        for width, (keys, item, offset, maybe) in self.pieces.items():
            if len(h) < width:
                continue
            key = window_keys(h, width)
            w = np.flatnonzero(maybe[key & K.U64(len(maybe) - 1)])
            r = np.searchsorted(at, w, "right") - 1
            within = w + width <= at[r + 1]
            w, r = w[within], r[within]
            lo = np.searchsorted(keys, key[w])
            n = np.searchsorted(keys, key[w], "right") - lo
            at_key = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            w, r = np.repeat(w, n), np.repeat(r, n)
            out.append(np.stack([r, item[at_key], w - at[r] - offset[at_key]]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.unique(np.concatenate(out, axis=1), axis=1))

    def matches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, distance): the items that each row contains, with their least verified distance."""
        words = K.split_words(texts)
        best: dict[tuple[int, int], int] = {}
        #: Of one row and item, beginnings so near that the words they reach overlap are verified in one run.
        runs: list[tuple[int, int, list[int]]] = []
        for row, item, first in zip(*(x.tolist() for x in self.candidates(words.hash, words.at))):
            if runs and runs[-1][:2] == (row, item) and first - runs[-1][2][-1] <= len(self.words[item]) + 2 * self.limit(item):
                runs[-1][2].append(first)
            else:
                runs.append((row, item, [first]))
        for row, item, firsts in runs:
            if best.get((row, item)) == 0:
                continue
            own, limit = self.words[item], self.limit(item)
            begin, end = words.at[row], words.at[row + 1]
            exact = (begin + first for first in firsts if first >= 0 and begin + first + len(own) <= end)
            if any((words.hash[x : x + len(own)] == own).all() for x in exact):
                d = 0
            else:
                a, b = begin + max(0, firsts[0] - limit), min(end, begin + firsts[-1] + len(own) + limit)
                d = least_edits(own.tolist(), words.hash[a:b].tolist())
            if d <= limit and d < best.get((row, item), limit + 1):
                best[row, item] = d
        got = sorted((r, i, d) for (r, i), d in best.items())
        return tuple(np.array(x, np.int64) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 3


def window_keys(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the windows of ``width`` words at each word, up to the last that fits."""
    key = np.zeros(len(h) - width + 1, K.U64)
    for j in range(width):
        key *= K.U64(0x100000001B3)
        key += h[j : j + len(key)]
    return K.mix(key)


def least_edits(pattern: list[int], text: list[int]) -> int:
    """The least edit distance of the pattern to any substring of the text (bit-parallel, one step a symbol of the text)."""
    m = len(pattern)
    where: dict[int, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << m) - 1
    top = 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = where.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        up = (minus | ~(across | plus)) & full
        down = plus & across
        score += bool(up & top) - bool(down & top)
        eq |= minus
        up = up << 1 & full
        down = down << 1 & full
        plus = (down | ~(eq | up)) & full
        minus = up & eq
        best = min(best, score)
    return best


def _indexes(items: DataFrame, tau: float, at_once: int) -> Iterator[ItemIndex]:
    """One index for each ``at_once`` bytes of items, one item at least: what is sent to the executors is bounded, whatever the items' number and length."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct().toLocalIterator():
        more = len(r[1].encode()) + 8
        if ids and size + more > at_once:
            yield ItemIndex(ids, texts, tau)
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += more
    if ids:
        yield ItemIndex(ids, texts, tau)


def contained_items(docs: DataFrame, items: DataFrame, tau: float = TAU, at_once: int = BYTES_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, distance): items found in documents with at most ``tau`` of their words edited; distance in words.

    Each pair once, with its least distance over repeated rows.  Rows with null id or text, texts and
    items without words, and other columns don't matter.  No items or no documents give no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = None
    for index in _indexes(items, tau, at_once):
        shared = spark.sparkContext.broadcast(index)

        def f(batches, shared=shared):
            for batch in batches:
                for b in K.text_slices(batch, "text"):
                    row, item, d = shared.value.matches(b.column("text"))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(shared.value.ids[item]), pa.array(d.astype(np.int32))], ["doc_id", "item_id", "distance"])

        part = map_arrow(own, f, "doc_id bigint, item_id bigint, distance int")
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "doc_id bigint, item_id bigint, distance int")
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def without_contaminated(docs: DataFrame, items: DataFrame, tau: float = TAU, at_once: int = BYTES_AT_ONCE) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text contains no item.

    Null, empty and wordless texts contain none and stay, as do rows with null ids that contain none; of repeated
    rows all stay or all go.  A text is compared whole, however long.  Without items every row stays; an empty
    table stays empty.
    """
    spark = docs.sparkSession
    for index in _indexes(items, tau, at_once):
        shared = spark.sparkContext.broadcast(index)

        def f(batches, shared=shared):
            for batch in batches:
                for b in K.text_slices(batch, "text"):
                    clean = np.ones(b.num_rows, bool)
                    clean[shared.value.matches(pc.cast(b.column("text"), pa.large_string()))[0]] = False
                    yield b.filter(pa.array(clean))

        docs = map_arrow(docs, f, docs.schema)
    return docs
