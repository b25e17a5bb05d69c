"""N-gram Jaccard self-join by R-trees of group-count vectors.

Every text is the set of its word n-grams (64-bit hashes); rows of equal sets are one *node*.  N-grams are hashed
into groups and the counts by group are the node's point: two sets share at most the sum of their coordinate minima,
and an inner node of an R-tree bounds that sum for all points under it by its upper corner.  Pairs that no bound
rules out are verified on the whole sets.

One tree over a whole corpus would send nearly every query to nearly every node, for unrelated documents of one
length have similar counts.  So ``slices`` first finds candidates, without losing any pair at the threshold; those
links are joined to components, and R-trees over counts of the whole sets answer every member's query.  Components
are cut to chunks by members and n-grams alike.  Blocks give sums and a spanning forest, never their pairs.

The sampled routing to buckets (``_route``, ``_sketches``, ``_bucket_links``) loses some pairs at the threshold; no
query uses it any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.llm import kernel as K
from embervane.llm.common import IdFilter, fresh, id_filter, map_arrow, per_key
from embervane.llm.slices import slice_links
from embervane.operators.components import connected_components
from embervane.session import released, staged

N = 2
THRESHOLD = 0.6
#: Groups of the routing sample, its least size (nodes of fewer n-grams are taken whole), cells of its counts.
ROUTES, SAMPLE, CELLS = 28, 48, 384
#: Where the sample isn't the whole set, a link may fall so far below the threshold in it: over three and a half standard deviations of a sample's Jaccard, so that about one link in 5,000 at the very threshold is lost here.
SLACK = 0.2
#: Members of a bucket that one tree takes; groups of cells by which the rows of a fuller one are parted anew.
BUCKET, PARTS = 4096, 32
#: Points in a leaf and children of a node of the trees; cells of the whole sets' counts; sets and n-grams in a chunk of a block.
FANOUT, FULL_CELLS, CHUNK, CHUNK_GRAMS = 16, 512, 2048, 1 << 20


class CountTree:
    """A packed R-tree over rows of non-negative counts, queried by all of its own rows."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((*(counts[:, j] for j in range(min(3, counts.shape[1]))), sizes))
        self.order, self.counts, self.sizes = order, counts[order], sizes[order].astype(np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # upper corner, least and most size of each node
        hi, lo_n, hi_n = self.counts, self.sizes, self.sizes
        while len(hi) > 1 or not self.levels:
            at = np.arange(0, len(hi), FANOUT)
            hi, lo_n, hi_n = np.maximum.reduceat(hi, at), np.minimum.reduceat(lo_n, at), np.maximum.reduceat(hi_n, at)
            self.levels.append((hi, lo_n, hi_n))

    @staticmethod
    def _may(hi_a, lo_a, hi_b, lo_b, most_a, most_b, t: float) -> np.ndarray:
        """Whether node pairs can hold a pair of Jaccard t: overlap is bounded by the corners' minima and by either size."""
        over = np.minimum(hi_a, hi_b).sum(-1, dtype=np.int64)
        over = np.minimum(over, np.minimum(most_a, most_b))
        return over * (1 + t) >= t * (lo_a + lo_b) - 1e-9

    def pairs(self, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of row pairs (i != j, each once) that the bounds leave."""
        a = b = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, lo_n, hi_n = self.levels[depth]
            keep = np.concatenate([self._may(hi[x], lo_n[x], hi[y], lo_n[y], hi_n[x], hi_n[y], t) for x, y in _cut(a, b, hi.shape[1])]) if len(a) else np.zeros(0, bool)
            a, b = a[keep], b[keep]
            if depth:
                a, b = _children(a, b, len(self.levels[depth - 1][0]))
        for x, y in _cut(a, b, FANOUT * FANOUT * self.counts.shape[1]):
            i, j = _children(x, y, len(self.sizes), strict=True)
            for i, j in _cut(i, j, self.counts.shape[1]):
                keep = self._may(self.counts[i], self.sizes[i], self.counts[j], self.sizes[j], self.sizes[i], self.sizes[j], t)
                if keep.any():
                    yield self.order[i[keep]], self.order[j[keep]]


def _cut(a: np.ndarray, b: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, (1 << 22) // max(width, 1))
    for k in range(0, len(a), step):
        yield a[k : k + step], b[k : k + step]


def _children(a: np.ndarray, b: np.ndarray, n: int, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Child pairs of node pairs a <= b; with strict, i < j only."""
    step = np.arange(FANOUT)
    i = np.broadcast_to((a[:, None] * FANOUT + step)[:, :, None], (len(a), FANOUT, FANOUT)).ravel()
    j = np.broadcast_to((b[:, None] * FANOUT + step)[:, None, :], (len(a), FANOUT, FANOUT)).ravel()
    keep = (i < n) & (j < n) & ((i < j) if strict else (i <= j))
    return i[keep], j[keep]


class Forest:
    """Links of rows joined to a spanning forest."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        """Hooks the larger root to the smaller and halves the paths, until all pairs agree."""
        parent = self.parent
        while True:
            x, y = parent[i], parent[j]
            differ = x != y
            if not differ.any():
                return
            i, j, x, y = i[differ], j[differ], x[differ], y[differ]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while (parent[parent] != parent).any():
                parent[:] = parent[parent]

    def apart(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that aren't joined."""
        differ = self.parent[i] != self.parent[j]
        return i[differ], j[differ]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return child, self.parent[child]


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct n-gram hashes of each row, row bounds)."""
    g, at = K.grams(K.split_words(texts), n)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(len(at)))


def set_prints(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit print of each row's set."""
    total = np.zeros(len(g) + 1, K.U64)
    np.cumsum(K.mix(g), out=total[1:])
    return K.mix((total[at[1:]] - total[at[:-1]]) ^ K.mix(np.diff(at).astype(np.uint64))).view(np.int64)


def _route(g: np.ndarray, at: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the levels at which each row can meet others: (rows, bounds of their keys, keys, packed sample counts, sizes, negative where the sample isn't the whole set)."""
    n = np.diff(at)
    level = np.maximum(0, np.floor(np.log2(np.maximum(n, 1) / SAMPLE))).astype(np.int64)
    above = np.maximum(0, np.floor(np.log2(np.maximum(n / t, 1) / SAMPLE))).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    rank = K.mix(g ^ K.U64(0xA5A5A5A5A5A5A5A5))
    for extra in (0, 1):
        lv = level + extra
        use = (n > 0) & (lv <= above)
        keep = use[row] & ((rank & ((K.U64(1) << lv.astype(np.uint64)[row]) - K.U64(1))) == 0)
        r, h = row[keep], rank[keep]
        if not len(r):
            continue
        rows, r = np.unique(r, return_inverse=True)
        group = ((h >> K.U64(32)) % K.U64(ROUTES)).astype(np.int64)
        cell = ((h >> K.U64(20)) % K.U64(CELLS)).astype(np.int64)
        counts = np.bincount(r * CELLS + cell, minlength=len(rows) * CELLS).reshape(len(rows), CELLS)
        size = np.bincount(r, minlength=len(rows))
        slot = r * ROUTES + group
        order = np.argsort(slot, kind="stable")
        if extra:
            # samples that meet a larger row's differ in fewer n-grams than two of one level: half of the groups do
            order = order[slot[order] % ROUTES < ROUTES // 2]
        if not len(order):
            continue
        slot = slot[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        key = np.add.reduceat(K.mix(h[order]), first)
        doc = slot[first] // ROUTES
        key = K.mix(key ^ K.mix((slot[first] % ROUTES + 1000 * (lv[rows[doc]] + 1)).astype(np.uint64)))
        yield rows, np.searchsorted(doc, np.arange(len(rows) + 1)), key, _pack(counts), np.where(lv[rows] > 0, -size, size)


def _pack(counts: np.ndarray) -> np.ndarray:
    """Which cells have any, a bit each; the size tells how much more there is."""
    return np.packbits(counts > 0, axis=1)


def _unpack(packed: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The cells' counts up to 1 and, as one cell more, what all of them have above that: the sum of minima stays an upper bound."""
    cells = np.unpackbits(packed, axis=1)
    more = np.abs(size.astype(np.int64)) - cells.sum(axis=1, dtype=np.int64)
    kind = np.uint8 if more.max(initial=0) < 256 else np.int64
    return np.concatenate([cells.astype(kind), more[:, None].astype(kind)], axis=1)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows_of(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[start : start + len(column) * width].reshape(-1, width)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


LEVELS = "array<struct<keys:array<bigint>,counts:binary,size:smallint>>"


def _sketches(n: int, t: float):
    def f(batches):
        for batch in batches:
            for b in K.text_slices(batch, "text"):
                g, at = gram_sets(b.column("text"), n)
                some = np.diff(at) > 0
                parts = list(_route(g, at, t))
                rows = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
                order = np.argsort(rows, kind="stable")
                bounds, total = [np.zeros(1, np.int64)], 0
                for p in parts:
                    bounds.append(p[1][1:] + total)
                    total += p[1][-1]
                keys = _lists(np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.uint64), np.concatenate(bounds))
                counts = _fixed(np.concatenate([p[3] for p in parts]) if parts else np.zeros((0, CELLS // 8), np.uint8))
                size = pa.array((np.concatenate([p[4] for p in parts]) if parts else np.zeros(0, np.int64)).astype(np.int16))
                levels = pa.StructArray.from_arrays([keys, counts, size], ["keys", "counts", "size"]).take(pa.array(order))
                per = np.searchsorted(rows[order], np.arange(b.num_rows + 1))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(set_prints(g, at), mask=~some), pa.array(np.diff(at).astype(np.int32)), pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), levels)], ["doc_id", "node", "n", "levels"])

    return f


ROUTED = "a bigint, b bigint, key bigint, node bigint, size int, counts binary, side int"


_NAMES = ["a", "b", "key", "node", "size", "counts", "side"]


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = lambda kind: pa.nulls(len(a), kind)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.binary()), none(pa.int32())], _NAMES)


def _parted(full: pa.Table, step: int) -> Iterator[pa.RecordBatch]:
    """The rows of a bucket that is too full, once for each group of cells that they have any of, keyed by which; every step groups the cells in another way."""
    group = (K.mix(np.arange(CELLS, dtype=np.uint64) + K.U64(1000 * (step + 1))) % K.U64(PARTS)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    there, first = np.unique(group[order], return_index=True)
    weight = K.mix(np.arange(CELLS, dtype=np.uint64) + K.U64(7_000_000 + step))[order]
    for a in range(0, full.num_rows, 1024):
        own = full.slice(a, 1024)
        cells = np.unpackbits(_rows_of(own.column("counts"), CELLS // 8), axis=1)[:, order].astype(np.uint64)
        content = np.add.reduceat(cells * weight, first, axis=1)
        i, j = np.nonzero(np.add.reduceat(cells, first, axis=1))
        key = K.mix(own.column("key").to_numpy().view(np.uint64)[i] ^ K.mix(content[i, j] + there[j].astype(np.uint64)))
        at = pa.array(i)
        one = lambda c: pa.concat_arrays(own.column(c).chunks).take(at)  # noqa: E731, B023
        none = pa.nulls(len(i), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(key.view(np.int64)), one("node"), one("size"), one("counts"), one("side")], _NAMES)


def _full_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table | None, pa.Table | None]]:
    """(whole buckets, rows of buckets of more than ``most`` members) of batches sorted by key; never holds more than a batch and ``most`` rows."""
    rest, hot = None, None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        if hot is not None:
            n = int(np.searchsorted(table.column("key").to_numpy(), hot, "right"))
            if n:
                yield None, table.slice(0, n)
            if n == table.num_rows:
                continue
            table, hot = table.slice(n), None
        if rest is not None:
            table, rest = pa.concat_tables([rest, table]), None
        key = table.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield table.slice(0, last), None
        rest = table.slice(last).combine_chunks()
        if rest.num_rows > most:
            yield None, rest
            hot, rest = int(key[-1]), None
    if rest is not None:
        yield rest, None


def _bucket_links(t: float, most: int | None, step: int = 0):
    """Of each bucket, the links of a forest that joins the members whose samples may be similar; rows of buckets above ``most`` are parted anew.  Without ``most``, buckets are pairs of chunks: of two chunks only pairs across are tried."""

    def f(batches):
        for table, full in _full_runs(batches, most) if most else ((x, None) for x in per_key(batches, "key")):
            if full is not None:
                yield from _parted(full, step)
                continue
            key = table.column("key").to_numpy()
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            length = np.diff(at)
            if most and (length > most).any():
                for k in np.flatnonzero(length > most):
                    yield from _parted(table.slice(int(at[k]), int(length[k])), step)
            many = np.flatnonzero((length > 1) & (length <= (most or len(key))))
            if not len(many):
                continue
            ids, size, side = table.column("node").to_numpy(), table.column("size").to_numpy().astype(np.int64), table.column("side").to_numpy()
            packed = _rows_of(table.column("counts"), CELLS // 8)
            bar = np.where(size < 0, max(t - SLACK, 0.05), t)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            two = many[length[many] == 2]
            if len(two):
                i = at[two]
                x, y = _unpack(packed[i], size[i]), _unpack(packed[i + 1], size[i + 1])
                over = np.minimum(x, y).sum(1, dtype=np.int64)
                ok = (over * (1 + bar[i]) >= bar[i] * (np.abs(size[i]) + np.abs(size[i + 1])) - 1e-9) & (ids[i] != ids[i + 1])
                out.append((ids[i[ok]], ids[i[ok] + 1]))
            for k in many[length[many] > 2]:
                a, b = at[k], at[k + 1]
                forest = Forest(b - a)
                across = not most and side[a:b].min() != side[a:b].max()
                for i, j in CountTree(_unpack(packed[a:b], size[a:b]), np.abs(size[a:b])).pairs(float(bar[a])):
                    if across:
                        keep = side[a + i] != side[a + j]
                        i, j = i[keep], j[keep]
                    forest.link(i, j)
                child, parent = forest.edges()
                out.append((ids[a + child], ids[a + parent]))
            a = np.concatenate([x for x, _ in out])
            b = np.concatenate([y for _, y in out])
            if len(a):
                yield _links(*np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1))

    return f


def _blocks(rows: DataFrame, by: str, chunks: DataFrame) -> DataFrame:
    """``rows`` of (by, node, ...) with (block, side): every group is cut to its number of chunks, and each pair of chunks is a block."""
    own = rows.join(chunks, by).withColumn("__chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")))
    own = own.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    return own.withColumn("block", F.xxhash64(by, F.least("__chunk", "__other"), F.greatest("__chunk", "__other"))).withColumn("side", (F.col("__chunk") > F.col("__other")).cast("int")).drop("__chunk", "__other", "chunks")


def _nodes(n: int):
    """(doc_id, node, n) of each row."""

    def f(batches):
        for batch in batches:
            for b in K.text_slices(batch, "text"):
                g, at = gram_sets(b.column("text"), n)
                size = np.diff(at)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(set_prints(g, at), mask=size == 0), pa.array(size.astype(np.int32))], ["doc_id", "node", "n"])

    return f


def _sets(n: int, linked: IdFilter):
    def f(batches):
        for batch in batches:
            batch = batch.filter(pa.array(linked.may_have(batch.column("doc_id").to_numpy())))
            for b in K.text_slices(batch, "text"):
                g, at = gram_sets(b.column("text"), n)
                # 6 bytes of each hash: two of some 1,000 n-grams are taken for one in a pair of a hundred million
                six = np.ascontiguousarray(K.mix(g).view(np.uint8).reshape(-1, 8)[:, :6])
                yield pa.RecordBatch.from_arrays([pa.array(set_prints(g, at)), pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(at.astype(np.int64) * 6), pa.py_buffer(six)]).cast(pa.binary())], ["node", "grams"])

    return f


def similar_in_block(sets: list[np.ndarray], side: np.ndarray, t: float, forest: Forest | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, Jaccard) of all pairs with Jaccard t or more; of a block of two chunks only pairs across, sides 0 and 1.  With a forest, pairs that it has joined by then are left out."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    cells = min(FULL_CELLS, 1 << max(4, int(np.median(sizes)).bit_length()))
    cell = (K.mix(every ^ K.U64(0x1234567)) % K.U64(cells)).astype(np.int64)
    counts = np.bincount(row * cells + cell, minlength=len(sets) * cells).reshape(len(sets), cells)
    counts = counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.int32)
    _, code = np.unique(every, return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    across = side.min() != side.max()
    mark = np.zeros(int(code.max()) + 1, bool)
    for i, j in CountTree(counts, sizes).pairs(t):
        if across:
            keep = side[i] != side[j]
            i, j = i[keep], j[keep]
        if forest is not None:
            i, j = forest.apart(i, j)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for k in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else ():
            own = code[at[i[k[0]]] : at[i[k[0]] + 1]]
            if forest is not None:
                k = k[forest.parent[i[k]] != forest.parent[j[k]]]
                if not len(k):
                    continue
            mark[own] = True
            for part in np.array_split(k, -(-int(sizes[j[k]].sum()) // (1 << 22)) or 1):
                m = sizes[j[part]]
                idx = np.arange(int(m.sum())) + np.repeat(at[j[part]] - (np.cumsum(m) - m), m)
                both = np.add.reduceat(mark[code[idx]], np.cumsum(m) - m, dtype=np.int64)
                jaccard = both / (m + sizes[i[part]] - both)
                hit = jaccard >= t
                if hit.any():
                    yield i[part][hit], j[part][hit], jaccard[hit]
            mark[own] = False


def _verified_blocks(batches: Iterator[pa.RecordBatch], t: float, counted: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, Forest, Iterator]]:
    """(nodes, weights, a forest for what is found, similar_in_block()) of each block; a node that came twice counts once.  If not counted, pairs that the forest has joined are left out."""
    for table in per_key(batches, "block"):
        block, nodes = table.column("block").to_numpy(), table.column("node").to_numpy()
        side, weight = table.column("side").to_numpy(), table.column("weight").to_numpy()
        data, at_byte = K.buffers(table.column("grams").cast(pa.large_binary()).combine_chunks())

        def grams(x: int) -> np.ndarray:
            six = data[at_byte[x] : at_byte[x + 1]].reshape(-1, 6)
            out = np.zeros((len(six), 8), np.uint8)
            out[:, :6] = six
            return out.view(np.uint64).ravel()

        once = np.ones(len(block), bool)
        once[1:] = (block[1:] != block[:-1]) | (nodes[1:] != nodes[:-1])
        at = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            k = a + np.flatnonzero(once[a:b])
            if len(k) > 1:
                forest = Forest(len(k))
                yield nodes[k], weight[k], forest, similar_in_block([grams(x) for x in k.tolist()], side[k], t, None if counted else forest)


def _sums(t: float, counted: bool = True):
    """(node, n, other): documents that a block's other nodes link to each node (some of them, if not counted), and its parent in the block's forest of links."""

    def f(batches):
        for nodes, weight, forest, found in _verified_blocks(batches, t, counted):
            n = np.zeros(len(nodes), np.int64)
            for i, j, _ in found:
                forest.link(i, j)
                np.add.at(n, i, weight[j])
                np.add.at(n, j, weight[i])
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k]), pa.array(n[k]), pa.array(nodes[forest.parent[k]])], ["node", "n", "other"])

    return f


def _pairs(t: float):
    def f(batches):
        for nodes, _, _, found in _verified_blocks(batches, t):
            for i, j, s in found:
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j]), pa.array(s)], ["a", "b", "jaccard"])

    return f


def _joined(docs: DataFrame, n: int, t: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids: distinct (doc_id, node); nodes: (node, rep, weight); blocks: (block, side, node, weight, grams) of the components of candidate links)."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(map_arrow(own, _nodes(n), "doc_id bigint, node bigint, n int"), "rows")
    ids = rows.groupBy("doc_id", "node", "n").agg(F.count("*").alias("rows"))
    nodes = staged(ids.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("n").alias("n"), F.sum("rows").alias("rows")), "nodes")
    links = staged(slice_links(own.select("text").where("text IS NOT NULL"), n, t, gram_sets, set_prints, Forest), "links")
    released(docs.sparkSession)
    found = staged(connected_components(links), "components").join(nodes, "node")
    big = found.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_GRAMS)).alias("chunks"))
    member = staged(_blocks(found.select("root", "node", "rep", "weight"), "root", big).select("node", "rep", "weight", "block", "side"), "members")
    linked = id_filter(member, "rep")
    sets = map_arrow(own.where("text IS NOT NULL"), _sets(n, linked), "node bigint, grams binary")
    blocks = sets.join(member.drop("rep"), "node").select("block", "side", "node", "weight", "grams")
    released(docs.sparkSession)
    return ids.select("doc_id", "node"), nodes, blocks.repartition(parts, "block").sortWithinPartitions("block", "node")


def similar_texts(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(membership (doc_id, rep), pairs (rep_a, rep_b, jaccard)): documents of one set of n-grams share the least of their ids as representative, and representatives are paired, rep_a < rep_b, where their sets have Jaccard ``threshold`` or more.  Rows without id or words are in neither; of an id with several texts each has its representative."""
    ids, nodes, blocks = _joined(docs, n, threshold)
    pairs = map_arrow(blocks, _pairs(threshold), "a bigint, b bigint, jaccard double")
    rep = lambda c, name: nodes.select(F.col("node").alias(c), F.col("rep").alias(name))
    pairs = pairs.join(rep("a", "x"), "a").join(rep("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "jaccard")
    return ids.join(nodes.select("node", "rep"), "node").select("doc_id", "rep"), pairs


def similarity_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links): for every document its class, the least id of those that links connect it to, and how many other documents it is linked with.

    Two documents are linked where their sets of word n-grams have Jaccard ``threshold`` or more; every document is
    a query.  A text of fewer than n words has one n-gram, of all of them.  Ties at the threshold are links.  Null
    and wordless texts have no links and are a class of their own.  Rows with null id are left out and rows of one
    id are one document: equal ones count once, and one of several texts has the sum of their links and the least of
    their classes.  Other columns are ignored; an empty table gives no rows.
    """
    return _classes(docs, n, threshold)


def _classes(docs: DataFrame, n: int, threshold: float, counted: bool = True) -> DataFrame:
    """similarity_classes(); if not counted, n_links tells only whether there are any, and large classes take no work for each of their pairs."""
    ids, nodes, blocks = _joined(docs, n, threshold)
    ids = staged(ids, "ids")
    sums = staged(map_arrow(blocks, _sums(threshold, counted), "node bigint, n bigint, other bigint"), "sums")
    roots = connected_components(sums.select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = nodes.join(roots, "node", "left").select("node", "rep", "weight", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("rep").alias("class_id"))
    links = sums.groupBy("node").agg(F.sum("n").alias("n"))
    of_node = classes.join(least, "root").join(links, "node", "left").select("node", "class_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    worded = ids.join(of_node, "node").select("doc_id", "class_id", "n_links")
    bare = ids.where("node IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return worded.union(bare).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def without_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns as they are, with one document of each class of similarity_classes() left: that of least id.

    Rows with null id stay, as do null and wordless texts; of rows repeated under one id the first by text stays.
    Only rows that a filter of the ids to leave out takes for such are shuffled.
    """
    gone = staged(_classes(docs, n, threshold, counted=False).where("class_id <> doc_id").select("doc_id"), "duplicates")
    again = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).count().where("count > 1").select("doc_id")
    again = staged(again, "repeated")
    suspects = id_filter(gone.union(again), "doc_id")
    id_at = docs.columns.index("doc_id")

    def cut(suspected: bool):
        def f(batches):
            for b in (x for batch in batches for x in K.text_slices(batch, "text")):
                id = b.column(id_at)
                may = suspects.may_have(id.cast(pa.int64()).fill_null(0).to_numpy()) & id.is_valid().to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(may == suspected))

        return f

    clear, unsure = (map_arrow(docs, cut(x), docs.schema) for x in (False, True))
    mark = fresh(docs)
    unsure = unsure.join(gone.withColumnRenamed("doc_id", mark), F.col("doc_id").cast("bigint") == F.col(mark), "left_anti")
    if not again.isEmpty():
        from pyspark.sql.window import Window

        unsure = unsure.withColumn(mark, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(mark) == 1).drop(mark)
    return clear.unionByName(unsure)
