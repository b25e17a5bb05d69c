"""Candidate pairs of a set similarity join that lose no pair: every set is cut to slices, and slices are joined exactly.

A hash deals all n-grams to ``Q`` slices.  If two sets have o n-grams in common of u, the sums of o - t * u over the
slices is that of the sets, so where Jaccard is t or more there is a slice of which it is t or more as well.  ``Q``
grows with the set, so that a slice has about ``LEAST`` to ``LEAST * STEP`` n-grams whatever the set's size; a set also
takes part among those of the next ``Q`` where a similar set may be so much larger.

All rows of one slice go to one task, which joins them by prefixes: in an order of all n-grams, the rarer first, two
slices with o or more in common have their first two common ones among their first m - o + 2, so pairs of those are
the keys.  Those who meet there are held against each other by parity signatures, which never exceed the symmetric
difference, and then by the slices themselves.  The task keeps n-grams and keys in temporary files and takes ``ROWS``
rows, ``KEYS`` keys and ``PAIRS`` pairs at once.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from embervane.llm import kernel as K
from embervane.llm.common import map_arrow

#: Sets of fewer than LEAST * STEP n-grams have one slice, each STEP times more have STEP times as many slices.
LEAST, STEP = 16, 4
#: N-grams that a task gathers before it gives slices on; rows, keys and pairs that one numpy pass takes at once.
GATHERED, ROWS, KEYS, PAIRS = 1 << 21, 1 << 16, 1 << 21, 1 << 16
#: Counters of the n-grams' frequencies in a slice, at most: they only order n-grams and tell those of one row.
COUNTERS = 1 << 24

BLOBS = "at bigint, nodes binary, sizes binary, lengths binary, grams binary"
_KINDS = {"nodes": np.int64, "sizes": np.int32, "lengths": np.int32, "grams": np.uint32}


def _level(n: np.ndarray) -> np.ndarray:
    """The power of STEP that is the number of slices of sets of n n-grams."""
    out, bound = np.zeros(len(n), np.int64), LEAST * STEP
    while (n >= bound).any():
        out += n >= bound
        bound *= STEP
    return out


def dealt(g: np.ndarray, at: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(slice, row, whether the row only meets larger ones there, 32 bits of hash) of each n-gram, for either level that rows take part in."""
    n = np.diff(at)
    own, above = _level(n), _level(np.floor(n / t + 1e-9).astype(np.int64))
    row = np.repeat(np.arange(len(n)), n)
    rank = K.mix(g ^ K.U64(0x5851F42D4C957F2D))
    short = (rank >> K.U64(32)).astype(np.uint32)
    for level in range(int(own.min(initial=0)), int(above.max(initial=-1)) + 1):
        use = ((own <= level) & (level <= above))[row]
        many = STEP**level
        yield (rank[use] % K.U64(many)).astype(np.int64) + (many - 1) // (STEP - 1), row[use], own[row[use]] < level, short[use]


def sliced(n: int, t: float, gram_sets, set_prints):
    """Batches of texts to rows of BLOBS: of each slice the nodes, their sizes (negative: meets larger sets only), how many n-grams each has there, and these."""

    def given(held):
        parts, nodes, sizes, base = [], [], [], 0
        for g, at in held:
            for s, row, low, short in dealt(g, at, t):
                parts.append((s, row + base, low, short))
            nodes.append(set_prints(g, at))
            sizes.append(np.diff(at))
            base += len(at) - 1
        if not parts:
            return
        s, row, low, short = (np.concatenate([p[k] for p in parts]) for k in range(4))
        nodes, sizes = np.concatenate(nodes), np.concatenate(sizes)
        order = np.lexsort((row, s))
        s, row, low, short = s[order], row[order], low[order], short[order]
        first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (row[1:] != row[:-1])]) if len(s) else np.zeros(0, np.int64)
        length = np.diff(np.r_[first, len(s)]).astype(np.int32)
        of, own = s[first], row[first]
        size = np.where(low[first], -sizes[own], sizes[own]).astype(np.int32)
        cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        by_row, by_gram = np.r_[cut, len(of)], np.r_[first[cut], len(s)]
        column = lambda values, bounds: pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(bounds.astype(np.int64) * values.itemsize), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
        out = pa.RecordBatch.from_arrays([pa.array(of[cut]), column(nodes[own], by_row), column(size, by_row), column(length, by_row), column(short, by_gram)], ["at", *_KINDS])
        for a in range(0, len(cut), 1024):
            yield out.slice(a, 1024)

    def f(batches):
        held, total = [], 0
        for batch in batches:
            for b in K.text_slices(batch, "text"):
                held.append(gram_sets(b.column("text"), n))
                total += len(held[-1][0])
                if total >= GATHERED:
                    yield from given(held)
                    held, total = [], 0
        yield from given(held)

    return f


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each range, one after another."""
    return np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)


@lru_cache(maxsize=256)
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


class Slice:
    """The rows of one slice; n-grams in a file."""

    def __init__(self, t: float):
        self.t, self.file = t, tempfile.TemporaryFile()
        self.held: dict[str, list[np.ndarray]] = {k: [] for k in ("nodes", "sizes", "lengths")}
        self.grams = 0

    def add(self, blob: dict[str, np.ndarray]) -> None:
        for k, v in self.held.items():
            v.append(blob[k])
        self.file.write(blob["grams"].tobytes())
        self.grams += len(blob["grams"])

    def links(self, forest) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes that join all those which may be similar by this slice; ``forest`` makes a Forest."""
        nodes, sizes, length = (np.concatenate(self.held[k]) for k in ("nodes", "sizes", "lengths"))
        self.held.clear()
        if len(nodes) < 2:
            return nodes[:0], nodes[:0]
        self.file.flush()
        grams = np.memmap(self.file, np.uint32, "r", shape=(self.grams,))
        start = np.cumsum(length, dtype=np.int64) - length
        print_, sign, code = self._read(grams, start, length)
        joined = forest(len(nodes))
        # rows of one content are similar here; in the order of their sizes each is joined to the next unless that is too large
        low, size = sizes < 0, np.abs(sizes.astype(np.int64))
        order = np.lexsort((size, length, print_))
        same = (print_[order][1:] == print_[order][:-1]) & (length[order][1:] == length[order][:-1]) & (size[order][:-1] >= self.t * size[order][1:] - 1e-9)
        joined.link(order[:-1][same], order[1:][same])
        first = np.flatnonzero(np.r_[True, ~same])
        one = order[first]
        self.least, self.most = size[one], size[order[np.r_[first[1:] - 1, len(order) - 1]]]
        self.low = np.logical_and.reduceat(low[order], first)
        self.sign, self.length, self.start, self.source = sign[one], length[one].astype(np.int64), start[one], grams
        self.forest = forest(len(one))
        for a, b in self._similar(code):
            self.forest.link(a, b)
        child, parent = self.forest.edges()
        joined.link(one[child], one[parent])
        child, parent = joined.edges()
        differ = nodes[child] != nodes[parent]
        return nodes[child[differ]], nodes[parent[differ]]

    def _read(self, grams, start, length):
        """(print and parity signature of each row's n-grams, the frequency's rank of each counter)."""
        self.mask = min(COUNTERS, 1 << max(10, (4 * len(grams)).bit_length())) - 1
        count = np.zeros(self.mask + 1, np.uint32)
        prints, signs = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        for a in range(0, len(start), ROWS):
            b = min(a + ROWS, len(start))
            g = grams[start[a] : start[b - 1] + length[b - 1]]
            at = start[a:b] - start[a]
            slot, times = np.unique(g & np.uint32(self.mask), return_counts=True)
            count[slot] += times.astype(np.uint32)
            prints[a:b] = np.add.reduceat(K.mix(g.astype(np.uint64)), at)
            signs[a:b] = np.bitwise_xor.reduceat(K.U64(1) << (g >> np.uint32(26)).astype(np.uint64), at)
        # frequencies up to 2,048 are told apart, larger ones by their logarithm
        code = np.minimum(count, 2048)
        big = count > 2048
        code[big] = np.minimum(2048 + 64 * np.log2(count[big] / 2048), 4095).astype(np.uint32)
        return prints, signs, code.astype(np.uint16)

    def _keys(self, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of (key, entity): single n-grams where one in common may do, and all pairs of the prefix otherwise."""
        for a in range(0, len(self.start), ROWS):
            own, m = np.arange(a, min(a + ROWS, len(self.start))), self.length[a : a + ROWS]
            g = np.asarray(self.source[_ranges(self.start[own], m)])
            row = np.repeat(np.arange(len(own)), m)
            # rarer ones first: 16 bits of row, 16 of frequency, 32 of hash
            whole = np.sort(row.astype(np.uint64) << K.U64(48) | code[g & np.uint32(self.mask)].astype(np.uint64) << K.U64(32) | g.astype(np.uint64))
            place = np.arange(len(g)) - np.repeat(np.cumsum(m) - m, m)
            need = np.ceil(self.t * m - 1e-9).astype(np.int64)
            shared = (whole >> K.U64(32) & K.U64(0xFFFF)) > 1
            single = shared & (need[row] == 1) & (place < m[row])
            if single.any():
                yield whole[single] & K.U64(0xFFFFFFFF), own[row[single]]
            kept = shared & (place < (m - need + 2)[row])
            token, of = whole[kept] & K.U64(0xFFFFFFFF), row[kept]
            many = np.bincount(of, minlength=len(own))
            at = np.cumsum(many) - many
            for k in np.unique(many[many > 1]).tolist():
                rows, (i, j) = np.flatnonzero(many == k), _triangle(k)
                for part in np.array_split(rows, -(-len(rows) * len(i) // KEYS)):
                    block = token[at[part][:, None] + np.arange(k)]
                    yield (block[:, i] << K.U64(32) | block[:, j]).ravel(), np.repeat(own[part], len(i))

    def _similar(self, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of entities whose slices have Jaccard t or more; such as the pairs before have joined may be left out."""
        bound = 64 * int(self.length.sum())
        parts = [tempfile.TemporaryFile() for _ in range(min(64, -(-bound // (16 * KEYS))))]
        for key, entity in self._keys(code):
            both = np.stack([key, entity.astype(np.uint64)], axis=1)
            to = (K.mix(key) >> K.U64(40)) % K.U64(len(parts))
            for p, file in enumerate(parts):
                file.write((both[to == p] if len(parts) > 1 else both).tobytes())
        for file in parts:
            size = file.seek(0, 2) // 16
            # a part that came out too large is cut by more of the hash, never by what has one key
            again = -(-size // (2 * KEYS))
            for p in range(again):
                file.seek(0)
                some = []
                for a in range(0, size, KEYS):
                    x = np.frombuffer(file.read(16 * min(KEYS, size - a)), np.uint64).reshape(-1, 2)
                    some.append(x[(K.mix(x[:, 0]) & K.U64(0xFFFFF)) % K.U64(again) == p] if again > 1 else x)
                yield from self._met(np.concatenate(some))
            file.close()

    def _met(self, both: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key = both[:, 0]
        order = np.argsort(key)
        key, entity = key[order], both[order, 1].astype(np.int64)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        many = np.diff(np.r_[first, len(key)])
        del key, order
        held, total = [], 0
        for k in np.unique(many[many > 1]).tolist():
            runs = first[many == k]
            for a, b in self._run_pairs(entity, runs, k):
                apart = self.forest.parent[a] != self.forest.parent[b]
                a, b = self._signed(a[apart], b[apart])
                held.append(a << 32 | b)
                total += len(a)
                if total > PAIRS:
                    yield self._verified(np.concatenate(held))
                    held, total = [], 0
        if held:
            yield self._verified(np.concatenate(held))

    def _run_pairs(self, entity: np.ndarray, runs: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of each run of k entities."""
        if k <= 1024:
            i, j = _triangle(k) if k < 64 else np.triu_indices(k, 1)
            for part in np.array_split(runs, -(-len(runs) * len(i) // PAIRS)):
                block = entity[part[:, None] + np.arange(k)]
                yield block[:, i].ravel(), block[:, j].ravel()
            return
        for at in runs.tolist():
            own = entity[at : at + k]
            own = own[np.argsort(self.least[own], kind="stable")]
            for a in range(0, k, 1024):
                for b in range(a, k, 1024):
                    if self.most[own[a : a + 1024]].max() < self.t * self.least[own[b]] - 1e-9:
                        break
                    x, y = own[a : a + 1024], own[b : b + 1024]
                    i, j = np.triu_indices(len(x), 1) if a == b else np.indices((len(x), len(y))).reshape(2, -1)
                    yield x[i], y[j]

    def _signed(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What sizes and signatures leave of pairs; a < b."""
        m = self.length[a] + self.length[b]
        ok = np.bitwise_count(self.sign[a] ^ self.sign[b]) <= (1 - self.t) / (1 + self.t) * m + 1e-9
        a, b = a[ok], b[ok]
        ok = (self.most[a] >= self.t * self.least[b] - 1e-9) & (self.most[b] >= self.t * self.least[a] - 1e-9) & ~(self.low[a] & self.low[b])
        a, b = a[ok], b[ok]
        return np.minimum(a, b), np.maximum(a, b)

    def _verified(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = np.unique(pairs)
        pairs = pairs[self.forest.parent[pairs >> 32] != self.forest.parent[pairs & 0xFFFFFFFF]]
        found = [pairs[:0]]
        for x in np.array_split(pairs, -(-len(pairs) // ROWS)) if len(pairs) else ():
            a, b = x >> 32, x & 0xFFFFFFFF
            ma, mb = self.length[a], self.length[b]
            pair = np.repeat(np.arange(len(x)), ma + mb)
            at = np.cumsum(ma + mb) - (ma + mb)
            g = np.zeros(len(pair), np.uint64)
            g[_ranges(at, ma)] = self.source[_ranges(self.start[a], ma)]
            g[_ranges(at + ma, mb)] = self.source[_ranges(self.start[b], mb)]
            whole = np.sort(pair.astype(np.uint64) << K.U64(32) | g)
            over = np.bincount(whole[1:][whole[1:] == whole[:-1]] >> K.U64(32), minlength=len(x))
            found.append(x[over * (1 + self.t) >= self.t * (ma + mb) - 1e-9])
        x = np.concatenate(found)
        return x >> 32, x & 0xFFFFFFFF


def _slice_links(t: float, forest):
    def given(one: Slice) -> Iterator[pa.RecordBatch]:
        a, b = one.links(forest)
        one.file.close()
        if len(a):
            a, b = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def f(batches):
        one, now = None, None
        for batch in batches:
            at = batch.column("at").to_pylist()
            for k in range(batch.num_rows):
                if at[k] != now:
                    if one:
                        yield from given(one)
                    one, now = Slice(t), at[k]
                one.add({c: np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in _KINDS.items()})
        if one:
            yield from given(one)

    return f


def slice_links(texts: DataFrame, n: int, t: float, gram_sets, set_prints, forest) -> DataFrame:
    """(a, b) nodes, a > b, whose forest joins every pair of texts of Jaccard ``t`` or more, and some others."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blobs = map_arrow(texts, sliced(n, t, gram_sets, set_prints), BLOBS)
    return map_arrow(blobs.repartition(parts, "at").sortWithinPartitions("at"), _slice_links(t, forest), "a bigint, b bigint")
