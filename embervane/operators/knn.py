"""Exact and compressed top-k search, re-ranking, merging, recall, inverted files.

Queries are cut to units by a hash of the id, and the rows of the base are streamed past every unit, a tile at a
time, so neither side is collected or broadcast and any number of queries is answered exactly.  A unit keeps the k best
of each of its queries alone: products in single precision leave out what can't be among them, by their bound of error,
and the rest is scored in double precision.  Where few queries meet many rows, the base is cut too, and a window takes
the k best of the parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from embervane.functions.codec import Codec, encode, matrix, usable
from embervane.session import prepare, staged

#: Rows of a tile, and queries that meet it in one product: the scores of both stay in a core's cache.
CHUNK, BLOCK = 4096, 256
#: Queries of a unit at most and, where there are enough cores, at least; hits that a unit keeps at most.
QUERIES, FEW, KEPT = 32768, 256, 1 << 22
#: Units for each core.
UNITS = 3
#: Scores are compared at this many decimals, then ids, so ties don't hang on the order of summation.
DECIMALS = 9


def best(hits: DataFrame, k: int) -> DataFrame:
    """(query, rank from 0, id, score): the k best by score, ties by id."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", DECIMALS)), "id")
    return hits.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select("query", "rank", "id", "score")


def merge(parts: list[DataFrame], k: int) -> DataFrame:
    """The k best of several searches of the same queries."""
    every = parts[0].select("query", "id", "score")
    for p in parts[1:]:
        every = every.unionByName(p.select("query", "id", "score"))
    return best(every, k)


def _slim(df: DataFrame, id: str, vec: str, dim: int) -> DataFrame:
    """usable(), in single precision where the table is."""
    kind = df.schema[vec].dataType
    rows = usable(df, id, vec, dim)
    return rows.withColumn("vec", F.col("vec").cast("array<float>")) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else rows


def _cut(rows: int, queries: int, k: int, cores: int) -> tuple[int, int]:
    """(parts of the base, units of queries): as many tasks as keep the cores busy, the base being cut only where queries are few."""
    most = max(1, min(QUERIES, KEPT // max(1, min(k, rows))))
    units = max(1, -(-queries // most), min(UNITS * cores, queries // FEW))
    return (1 if units >= cores else max(1, min(UNITS * cores // units, rows // CHUNK))), units


def _spread(column: str, pieces) -> F.Column:
    return F.pmod(F.xxhash64(column), pieces if isinstance(pieces, F.Column) else F.lit(pieces)).cast("int")


def _streamed(base: DataFrame, queries: DataFrame, parts: int, opened, columns: str) -> DataFrame:
    """``opened(queries)`` of every unit, whose add() gets its base rows by batches and whose close() gives the results.

    Both sides are (unit, id, ...); unit u is worked on in partition u modulo ``parts``, its queries before its rows.
    """
    prepare(base.sparkSession)

    def f(batches):
        unit, asked, run = None, [], None
        for b in batches:
            key = b.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                u, side = divmod(int(key[a]), 2)
                if u != unit:
                    if run is not None:
                        yield from run.close()
                    unit, asked, run = u, [], None
                t = pa.Table.from_batches([b.slice(a, z - a)])
                if side == 0:
                    asked.append(t)
                elif asked or run is not None:
                    if run is None:
                        run, asked = opened(pa.concat_tables(asked).combine_chunks()), []
                    run.add(t)
        if run is not None:
            yield from run.close()

    keyed = lambda df, side: df.withColumn("key", F.col("unit").cast("bigint") * 2 + side).drop("unit")
    both = keyed(queries, 0).unionByName(keyed(base, 1), allowMissingColumns=True)
    placed = both.withColumn("part", F.pmod(F.floor(F.col("key") / 2), F.lit(parts)).cast("int"))
    return placed.repartitionById(parts, "part").drop("part").sortWithinPartitions("key").mapInArrow(f, columns)


def _pairs(base: DataFrame, queries: DataFrame, k: int, opened, columns: str, whole: bool = False) -> tuple[DataFrame, bool]:
    """What ``opened`` gives of all pairs of base rows and queries, the sides being (id, ...), and if units met the whole base, as with ``whole`` they do."""
    cores = base.sparkSession.sparkContext.defaultParallelism
    nb, nq = _cut(base.count(), queries.count(), k, cores)
    nb = 1 if whole else nb
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("unit", _spread("id", nq))
    rows = base.withColumn("unit", every(nq))
    if nb > 1:
        asked = asked.withColumn("part", every(nb)).withColumn("unit", F.col("unit") * nb + F.col("part")).drop("part")
        rows = rows.withColumn("unit", F.col("unit") * nb + _spread("id", nb))
    return _streamed(rows, asked, nq * nb, opened, columns), nb == 1


def _scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if metric == "cosine":
        q = q / np.maximum(np.sqrt((q * q).sum(1)), 1e-30)[:, None]
        x = x / np.maximum(np.sqrt((x * x).sum(1)), 1e-30)[:, None]
    s = q @ x.T
    if metric == "l2":
        return -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * s, 0))
    return s


class _Nearest:
    """The k best of a stream of rows for each of some queries, by score at DECIMALS, then id; repeated rows count each.

    ``also`` are other vectors of the queries, whose product with those of a row goes with its score.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str, exclude_self: bool, chunk: int, also: np.ndarray | None = None):
        self.ids, self.k, self.metric, self.exclude_self, self.chunk, self.also = ids, k, metric, exclude_self, chunk, also
        self.q, self.norm = self._sized(np.asarray(q, np.float64))
        self.square, self.most = self.norm * self.norm, self._greatest(self.norm)
        wide = np.column_stack([self.q, np.ones(len(ids))]) if metric == "l2" else self.q
        with np.errstate(over="ignore"):
            self.fast = {np.float32: wide.astype(np.float32), np.float64: wide}
        #: what a score at DECIMALS must reach: that of the k-th so far
        self.least = np.full(len(ids), -np.inf)
        self.kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)] + ([np.empty(0)] if also is not None else [])
        self.new, self.waiting = [], 0

    def _sized(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.sqrt((x * x).sum(1))
        if self.metric == "cosine":
            x, n = x / np.maximum(n, 1e-30)[:, None], np.where(n > 0, 1.0, n)
        return x, n

    @staticmethod
    def _greatest(n: np.ndarray) -> float:
        return float(np.fmax.reduce(n)) if len(n) else 0.0

    def _score(self, i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.metric == "l2":
            d = self.q[i] - x[j]
            return -np.sqrt(np.einsum("ij,ij->i", d, d))
        return np.einsum("ij,ij->i", self.q[i], x[j])

    def add(self, ids: np.ndarray, x: np.ndarray, other: np.ndarray | None = None) -> None:
        x, n = self._sized(np.asarray(x, np.float64))
        for c in range(0, len(ids), self.chunk):
            z = slice(c, c + self.chunk)
            self._tile(ids[z], x[z], n[z], None if other is None else other[z])

    def _tile(self, ids: np.ndarray, x: np.ndarray, n: np.ndarray, other: np.ndarray | None) -> None:
        far = self._greatest(n)
        kind = np.float32 if max(far, self.most) < 1e15 else np.float64
        rows = np.column_stack([x, -n * n / 2]) if self.metric == "l2" else x
        turned = np.ascontiguousarray(rows, kind).T
        width, began = len(ids), False
        for a in range(0, len(self.ids), BLOCK):
            z = slice(a, a + BLOCK)
            u = self.fast[kind][z] @ turned
            # what single precision may be off, and what rounds alike
            slack = (x.shape[1] + 8) * 2.0**-23 * (self.norm[z] * far + (far * far if self.metric == "l2" else 0)) + 1e-12
            if self.metric == "l2":
                reach = 1e-9 - self.least[z]
                bar, near = (self.square[z] * (1 - 1e-14) - reach * reach) / 2 - slack, (self.norm[z] + far) * 4e-9
            else:
                bar, near = self.least[z] - 1e-9 - slack, 2e-9
            fresh = np.flatnonzero(self.least[z] == -np.inf)
            if len(fresh):
                began = True
                bar[fresh] = -np.inf
                if width >= self.k:
                    v = np.where(np.isnan(u[fresh]), -np.inf, u[fresh])
                    if self.exclude_self:
                        v[self.ids[z][fresh, None] == ids[None, :]] = -np.inf
                    bar[fresh] = (np.partition(v, width - self.k, axis=1)[:, width - self.k].astype(np.float64) - 2 * slack[fresh]) - (near[fresh] if self.metric == "l2" else near)
            m = u >= np.where(np.isnan(bar), -np.inf, bar).astype(kind)[:, None]
            if width % 8:
                at = np.flatnonzero(m)
            else:  # few of eight at a time hold any
                eight = np.flatnonzero(m.reshape(-1).view(np.uint64))
                r, c = np.nonzero(m.reshape(-1, 8)[eight])
                at = eight[r] * 8 + c
            for b in range(0, len(at), 1 << 16):
                i, j = np.divmod(at[b : b + (1 << 16)], width)
                self._take(i + a, ids, x, j, other)
        if began or self.waiting > max(len(self.kept[0]), 1 << 16):
            self.merge()

    def _take(self, i: np.ndarray, ids: np.ndarray, x: np.ndarray, j: np.ndarray, other: np.ndarray | None) -> None:
        if self.exclude_self:
            apart = self.ids[i] != ids[j]
            i, j = i[apart], j[apart]
        s = self._score(i, x, j)
        good = np.round(s, DECIMALS) >= self.least[i]
        i, j, s = i[good], j[good], s[good]
        self.new.append([i, ids[j], s] + ([np.einsum("ij,ij->i", self.also[i], other[j])] if self.also is not None else []))
        self.waiting += len(i)
        if self.waiting > max(1 << 21, 2 * len(self.kept[0])):
            self.merge()

    def merge(self) -> None:
        if not self.new:
            return
        q, id, s, *more = (np.concatenate(v) for v in zip(self.kept, *self.new))
        self.new, self.waiting = [], 0
        self.kept, rank = _first(q, id, s, self.k, more)
        last = rank == self.k - 1
        self.least[self.kept[0][last]] = np.round(self.kept[2][last], DECIMALS)

    def best(self, k: int | None = None, among: int | None = None) -> tuple[np.ndarray, ...]:
        """(place of the query, rank, id, score) of what is kept, or the k best by the products of ``also`` of the first ``among``; repeated queries of one id count as one, the first."""
        self.merge()
        q, id, *s = self.kept
        one, at = np.unique(self.ids, return_inverse=True)
        if len(one) < len(self.ids):
            first = np.full(len(one), len(self.ids))
            np.minimum.at(first, at, np.arange(len(self.ids)))
            (q, id, *s), _ = _first(first[at][q], id, s[0], self.k, s[1:])
        if among is None:
            (q, id, s), rank = _first(q, id, s[0], k or self.k, [])
        else:
            (q, id, _, s), _ = _first(q, id, s[0], among, s[1:])
            (q, id, s), rank = _first(q, id, s, k or self.k, [])
        return q, rank, id, s


def _first(q: np.ndarray, id: np.ndarray, s: np.ndarray, k: int, more: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The k rows of best score, then least id, of each q, in that order, and their ranks."""
    order = _order(q, id, np.round(s, DECIMALS))
    q = q[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    good = rank < k
    order = order[good]
    return [q[good], id[order], s[order], *(m[order] for m in more)], rank[good]


def _order(q: np.ndarray, id: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The order by q, descending rounded score and id; by one whole number for both where scores are small, as cosines are."""
    if not len(q) or np.abs(r).max() > 2 or q.max() >= 1 << 30:
        return np.lexsort((id, -r, q))
    key = (q.astype(np.int64) << 32) - np.rint(r * 10.0**DECIMALS).astype(np.int64)
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    if same.any():
        at = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        tied = order[at]
        order[at] = tied[np.lexsort((id[tied], key[at]))]
    return order


HITS = "query bigint, rank int, id bigint, score double"


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-30)[:, None]


class _Unit:
    """A unit's search of tables; with ``fetch`` that many times k hits are ranked again by the cosine of the vectors themselves."""

    def __init__(self, t: pa.Table, k: int, exclude_self: bool, metric: str, base_matrix, query_matrix, chunk: int, originals=None, fetch: int = 1):
        self.k, self.base_matrix, self.originals = k, base_matrix, originals
        self.search = _Nearest(t.column("id").to_numpy(), query_matrix(t), k * fetch, metric, exclude_self, chunk, None if originals is None else _unit(originals(t)))

    def add(self, t: pa.Table) -> None:
        self.search.add(t.column("id").to_numpy(), self.base_matrix(t), None if self.originals is None else _unit(self.originals(t)))

    def close(self):
        q, rank, id, s = self.search.best() if self.originals is None else self.search.best(self.k, self.search.k)
        for a in range(0, len(q), 1 << 18):
            z = slice(a, a + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(self.search.ids[q[z]]), pa.array(rank[z].astype(np.int32)), pa.array(id[z]), pa.array(s[z])], ["query", "rank", "id", "score"])


def _top(k: int, exclude_self: bool, metric: str, base_matrix, query_matrix, **more):
    chunk = CHUNK
    return lambda t: _Unit(t, k, exclude_self, metric, base_matrix, query_matrix, chunk, **more)


def _found(base: DataFrame, queries: DataFrame, k: int, opened) -> DataFrame:
    hits, whole = _pairs(base, queries, k, opened, HITS)
    return hits if whole else best(hits, k)


def _column(name: str, dim: int):
    return lambda t: matrix(t.column(name).chunk(0) if t.column(name).num_chunks == 1 else pa.concat_arrays(t.column(name).chunks), dim)


def topk(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", dim: int = 64, exclude_self: bool = False, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query, rank, id, score) of the k best of ``base`` for each row of ``queries``; l2 scores are negative distances.

    Rows without id or whole vector of ``dim`` numbers take no part; of repeated rows each counts.  A zero
    vector's cosine is 0.  Fewer than k rows give fewer; an empty side gives none.
    """
    return _found(_slim(base, id, vec, dim), _slim(queries, id, vec, dim), k, _top(k, exclude_self, metric, _column("vec", dim), _column("vec", dim)))


def adc_topk(index: DataFrame, queries: DataFrame, codec: Codec, k: int = 10, metric: str = "cosine", exclude_self: bool = False, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """topk() on the codes of encode(): only codes and norms are moved, and decoded within a block in rotated space."""
    codes = _column("codes", codec.dim)
    base = lambda t: codec.rotated(codes(t)) * t.column("cnorm").to_numpy()[:, None]
    query = lambda t: codec.turn(_column("vec", codec.dim)(t))
    return _found(index.select("id", "codes", "cnorm"), _slim(queries, id, vec, codec.dim), k, _top(k, exclude_self, metric, base, query))


def adc_topk_mixed(parts: list[tuple[Codec, DataFrame]], queries: DataFrame, k: int = 10, metric: str = "cosine", exclude_self: bool = False, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """adc_topk() over parts (codec, index) whose codecs differ in bits alone, in one search: rows carry the place of their codec."""
    codecs = [c for c, _ in parts]
    if len({(c.dim, c.seed, c.family) for c in codecs}) != 1:
        raise ValueError("parts of one search must share dimension and rotation")
    dim, codes = codecs[0].dim, _column("codes", codecs[0].dim)
    rows = None
    for at, (_, index) in enumerate(parts):
        own = index.select("id", "codes", "cnorm", F.lit(at).alias("codec"))
        rows = own if rows is None else rows.unionByName(own)

    def base(t: pa.Table) -> np.ndarray:
        c, at = codes(t), t.column("codec").to_numpy()
        x = np.empty((len(c), dim))
        for j, codec in enumerate(codecs):
            x[at == j] = codec.rotated(c[at == j])
        return x * t.column("cnorm").to_numpy()[:, None]

    query = lambda t: codecs[0].turn(_column("vec", dim)(t))
    return _found(rows, _slim(queries, id, vec, dim), k, _top(k, exclude_self, metric, base, query))


def rerank(hits: DataFrame, originals: DataFrame, queries: DataFrame, k: int, dim: int = 64, id: str = "vec_id", vec: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The k best of a shortlist by the exact metric: two joins by id, no other rows of ``originals`` are touched, and one matrix product a batch."""
    o = usable(originals, id, vec, dim)
    q = usable(queries, id, vec, dim).select(F.col("id").alias("query"), F.col("vec").alias("qv"))

    def f(batches):
        for b in batches:
            a, x = matrix(b.column("qv"), dim), matrix(b.column("vec"), dim)
            s = (a * x).sum(1)
            if metric == "cosine":
                s = s / np.maximum(np.sqrt((a * a).sum(1) * (x * x).sum(1)), 1e-30)
            elif metric == "l2":
                s = -np.sqrt(((a - x) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("query"), b.column("id"), pa.array(s)], ["query", "id", "score"])

    prepare(hits.sparkSession)
    pairs = hits.select("query", "id").join(o, "id").join(q, "query").select("query", "id", "qv", "vec")
    return best(pairs.mapInArrow(f, "query bigint, id bigint, score double"), k)


def search(docs: DataFrame, queries: DataFrame, codec: Codec, k: int = 10, fetch: int = 4, exclude_self: bool = False) -> DataFrame:
    """Compressed search of ``fetch`` times k, re-ranked exactly: within the units, which see both codes and vectors, or by joins where queries are few."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if _cut(docs.count(), queries.count(), k * fetch, cores)[0] > 1:
        return rerank(adc_topk(encode(docs, codec), queries, codec, k * fetch, exclude_self=exclude_self), docs, queries, k, codec.dim)
    own, chunk = _column("vec", codec.dim), CHUNK
    opened = lambda t: _Unit(t, k, exclude_self, "cosine", lambda r: _decoded(codec, own(r)), lambda r: codec.turn(own(r)), chunk, own, fetch)
    return _pairs(_slim(docs, "vec_id", "embedding", codec.dim), _slim(queries, "vec_id", "embedding", codec.dim), k * fetch, opened, HITS, whole=True)[0]


def _decoded(codec: Codec, x: np.ndarray) -> np.ndarray:
    """What codes keep of rows, in rotated space."""
    codes, n = codec.encode(x)
    return codec.rotated(codes) * n[:, None]


class _Sweep:
    """How many of the exact k best of a unit's queries each point (bits, fetch) finds; all points in one pass."""

    def __init__(self, t: pa.Table, points: list[tuple[int, int]], k: int, dim: int, exclude_self: bool, chunk: int):
        self.points, self.k, self.own = points, k, _column("vec", dim)
        ids, x = t.column("id").to_numpy(), self.own(t)
        self.exact = _Nearest(ids, x, k, "cosine", exclude_self, chunk)
        most = {b: max(f for c, f in points if c == b) for b, _ in points}
        self.codecs = {b: Codec(dim, b) for b in most}
        self.found = {b: _Nearest(ids, c.turn(np.asarray(x, np.float64)), k * most[b], "cosine", exclude_self, chunk, _unit(x)) for b, c in self.codecs.items()}

    def add(self, t: pa.Table) -> None:
        ids, x = t.column("id").to_numpy(), self.own(t)
        self.exact.add(ids, x)
        for b, s in self.found.items():
            s.add(ids, _decoded(self.codecs[b], x), _unit(x))

    def close(self):
        q, _, id, _ = self.exact.best()
        out = []
        for b, fetch in self.points:
            p, _, other, _ = self.found[b].best(self.k, self.k * fetch)
            every = np.concatenate([q, p]), np.concatenate([id, other])
            order = np.lexsort(every[::-1])
            a, c = (v[order] for v in every)
            out.append((b, fetch, len(np.unique(q)), int(((a[1:] == a[:-1]) & (c[1:] == c[:-1])).sum())))
        yield pa.RecordBatch.from_pylist([dict(zip(("bits", "times", "queries", "hits"), r)) for r in out], pa.schema([("bits", pa.int32()), ("times", pa.int32()), ("queries", pa.int64()), ("hits", pa.int64())]))


def recall_sweep(df: DataFrame, points: list[tuple[int, int]], k: int = 10, dim: int = 64, exclude_self: bool = True, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(bits, times, recall) of search() of df's rows among themselves by each (bits, fetch), against the exact k best; nulls without rows."""
    chunk, rows = CHUNK, _slim(df, id, vec, dim)
    most = sum(max(f for c, f in points if c == b) for b in {b for b, _ in points}) + 1
    counts, _ = _pairs(rows, rows, k * most, lambda t: _Sweep(t, points, k, dim, exclude_self, chunk), "bits int, times int, queries bigint, hits bigint", whole=True)
    counts = counts.groupBy("bits", "times").agg((F.sum("hits") / F.sum("queries") / F.lit(float(k))).alias("recall"))
    return df.sparkSession.createDataFrame(points, "bits int, times int").join(counts, ["bits", "times"], "left").select("bits", "times", "recall")


def recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query, recall): the share of the exact k best that were found."""
    hit = exact.select("query", "id").join(found.select("query", "id").withColumn("hit", F.lit(1)), ["query", "id"], "left")
    return hit.groupBy("query").agg((F.count("hit") / F.lit(float(k))).alias("recall"))


def hamming_topk(base: DataFrame, queries: DataFrame, k: int = 10, dim: int = 64, exclude_self: bool = False, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k rows of least Hamming distance of sign bits; score is the negative distance."""
    bits = lambda t: np.where(_column("vec", dim)(t) > 0, 1.0, -1.0)
    hits = _found(_slim(base, id, vec, dim), _slim(queries, id, vec, dim), k, _top(k, exclude_self, "dot", bits, bits))
    return hits.withColumn("score", -(F.lit(float(dim)) - F.col("score")) / 2)


def centroids(df: DataFrame, by: str, dim: int = 64, vec: str = "embedding") -> DataFrame:
    """(cell, centroid): the unit mean vector of each group, by one aggregation over all rows."""
    sums = [F.sum(F.get(vec, F.lit(j)).cast("double")).alias(f"s{j}") for j in range(dim)]
    s = df.where(F.col(by).isNotNull() & (F.size(vec) == dim)).groupBy(F.col(by).cast("int").alias("cell")).agg(*sums)
    from embervane.functions.vector import normalize

    return s.select("cell", F.array(*(f"s{j}" for j in range(dim))).alias("c")).select("cell", normalize(F.col("c")).alias("centroid"))


#: Bytes of centroids that are sent to every executor at most; more are met by a shuffle of both sides.
CENTROID_BYTES = 32 << 20


def nearest_cells(df: DataFrame, cells: DataFrame, n: int, dim: int = 64, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query, rank, id, score): of each row the n nearest cells by cosine, ties to the lesser cell."""
    known = cells.select(F.col("cell").cast("bigint").alias("cell"), "centroid")
    if known.count() * dim * 8 > CENTROID_BYTES:
        return topk(known, df.select(F.col(id).alias("cell"), F.col(vec).alias("centroid")), n, "cosine", dim, id="cell", vec="centroid")
    got = known.orderBy("cell").collect()
    c = np.array([r["centroid"] for r in got], np.float64).reshape(-1, dim)
    shared = df.sparkSession.sparkContext.broadcast((np.array([r["cell"] for r in got], np.int64), c))

    def f(batches):
        names, c = shared.value
        for b in batches:
            x = matrix(b.column("vec"), dim)
            keep = min(n, len(names))
            for a in range(0, len(x), 4096):
                s = _scores("cosine", x[a : a + 4096], c)
                order = np.argsort(-np.round(s, DECIMALS), axis=1, kind="stable")[:, :keep]
                rows = np.repeat(b.column("id").to_numpy()[a : a + 4096], keep)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.tile(np.arange(keep, dtype=np.int32), len(s))), pa.array(names[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], ["query", "rank", "id", "score"])

    prepare(df.sparkSession)
    return usable(df, id, vec, dim).mapInArrow(f, "query bigint, rank int, id bigint, score double")


def assign(df: DataFrame, cells: DataFrame, dim: int = 64, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, cell, angle) of each row's nearest centroid by cosine, ties to the least cell."""
    near = nearest_cells(df, cells, 1, dim, id, vec)
    return near.select(F.col("query").alias("id"), F.col("id").cast("int").alias("cell"), F.acos(F.least(F.greatest(F.col("score"), F.lit(-1.0)), F.lit(1.0))).alias("angle"))


def spherical_kmeans(df: DataFrame, k: int, rounds: int = 5, dim: int = 64, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(cell, centroid) after some rounds from the k rows of least id; a cell without rows goes."""
    cells = usable(df, id, vec, dim).orderBy("id").limit(k).select((F.row_number().over(Window.orderBy("id")) - 1).alias("cell"), F.col("vec").alias("centroid"))
    for _ in range(rounds):
        a = assign(df, cells, dim, id, vec).join(usable(df, id, vec, dim), "id")
        cells = staged(centroids(a, "cell", dim, "vec"), "cells")
    return cells


def hierarchical_cells(df: DataFrame, top: int, sub: int, rounds: int = 5, dim: int = 64, id: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(tops (cell, centroid), leaves (cell, top, centroid)): k-means of all rows, then of the rows of each top cell, whose leaves are numbered top * sub + i."""
    tops = staged(spherical_kmeans(df, top, rounds, dim, id, vec), "tops")
    own = staged(assign(df, tops, dim, id, vec).join(usable(df, id, vec, dim), "id").select("id", "vec", F.col("cell").alias("top")), "own")
    # the first rows of each top, by a hash, are its leaves' first centroids
    place = F.row_number().over(Window.partitionBy("top").orderBy(F.xxhash64("id"), "id")) - 1
    leaves = staged(own.withColumn("i", place).where(F.col("i") < sub).select((F.col("top") * sub + F.col("i")).cast("int").alias("cell"), F.col("vec").alias("centroid")), "leaves")
    for _ in range(rounds):
        leaves = staged(centroids(_leaf_of(own, leaves, sub, dim).join(own, "id"), "cell", dim, "vec"), "leaves")
    return tops, leaves.withColumn("top", F.floor(F.col("cell") / sub).cast("int"))


def _leaf_of(own: DataFrame, leaves: DataFrame, sub: int, dim: int) -> DataFrame:
    """(id, cell): the nearest leaf within each row's top cell."""
    got = leaves.orderBy("cell").collect()
    c = np.array([r["centroid"] for r in got], np.float64).reshape(-1, dim)
    if c.nbytes > CENTROID_BYTES:
        raise ValueError(f"{len(c)} leaves are more than {CENTROID_BYTES} bytes: train fewer")
    names = np.array([r["cell"] for r in got], np.int64)
    unit = c / np.maximum(np.sqrt((c * c).sum(1)), 1e-30)[:, None]
    shared = own.sparkSession.sparkContext.broadcast((names, unit))

    def f(batches):
        names, unit = shared.value
        for b in batches:
            s = matrix(b.column("vec"), dim) @ unit.T
            s[b.column("top").to_numpy()[:, None] != names[None, :] // sub] = -np.inf
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(names[s.argmax(1)].astype(np.int32))], ["id", "cell"])

    prepare(own.sparkSession)
    return own.select("id", "vec", "top").mapInArrow(f, "id bigint, cell int")


def assign_hierarchical(df: DataFrame, tops: DataFrame, leaves: DataFrame, sub: int, dim: int = 64, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, cell): of each row the best leaf of its best top cell."""
    own = assign(df, tops, dim, id, vec).join(usable(df, id, vec, dim), "id").select("id", "vec", F.col("cell").alias("top"))
    return _leaf_of(own, leaves.select("cell", "centroid"), sub, dim)


def scan_cells(rows: DataFrame, probes: DataFrame, queries: DataFrame, k: int, dim: int, exclude_self: bool = False, metric: str = "cosine", base_matrix=None, query_matrix=None) -> DataFrame:
    """(query, id, score): of every probe (query, cell) the k best of the cell's rows (cell, id, vec ...), or of a part of them.

    A cell's queries are cut to units, past which its rows are streamed; where few queries meet many rows, the rows are cut too.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    probes = probes.select("query", F.col("cell").cast("int").alias("cell"))
    met = rows.groupBy("cell").agg(F.count("*").alias("rows")).join(probes.groupBy("cell").agg(F.count("*").alias("asked")), "cell").collect()  # a row for each cell
    work = max(1, sum(r["rows"] * r["asked"] for r in met))
    table, units = [], 0
    for r in sorted(met, key=lambda r: (-r["rows"] * r["asked"], r["cell"])):
        share = round(UNITS * cores * r["rows"] * r["asked"] / work)
        most = max(1, min(QUERIES, KEPT // max(1, min(k, r["rows"]))))
        nq = max(1, -(-r["asked"] // most), min(share, r["asked"] // FEW))
        nb = max(1, min(share // nq, r["rows"] // CHUNK))
        table.append((int(r["cell"]), units, nq, nb))
        units += nq * nb
    cut = F.broadcast(spark.createDataFrame(table, "cell int, first bigint, nq int, nb int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = rows.join(cut, "cell").withColumn("q", every("nq")).withColumn("unit", F.col("first") + F.col("q") * F.col("nb") + _spread("id", F.col("nb"))).drop("cell", "first", "nq", "nb", "q")
    asked = probes.join(cut, "cell").join(queries.select(F.col("id").alias("query"), "vec"), "query").withColumn("b", every("nb"))
    asked = asked.select(F.col("query").alias("id"), "vec", (F.col("first") + _spread("query", F.col("nq")) * F.col("nb") + F.col("b")).alias("unit"))
    opened = _top(k, exclude_self, metric, base_matrix or _column("vec", dim), query_matrix or _column("vec", dim))
    return _streamed(base, asked, max(1, min(units, max(UNITS * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))), opened, HITS).select("query", "id", "score")


def ivf_search(df: DataFrame, cells: DataFrame, queries: DataFrame, k: int = 10, nprobe: int = 4, dim: int = 64, exclude_self: bool = False, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query, rank, id, score): the k best of each query's nprobe nearest cells."""
    rows = staged(assign(df, cells, dim, id, vec), "assigned").join(_slim(df, id, vec, dim), "id").select("cell", "id", "vec")
    probes = staged(nearest_cells(queries, cells, nprobe, dim, id, vec).select("query", F.col("id").alias("cell")), "probes")
    return best(scan_cells(rows, probes, _slim(queries, id, vec, dim), k, dim, exclude_self), k)


def ivf_exact(df: DataFrame, cells: DataFrame, queries: DataFrame, k: int = 10, nprobe: int = 4, dim: int = 64, exclude_self: bool = False, id: str = "vec_id", vec: str = "embedding", radius_scale: float = 1.0) -> DataFrame:
    """(query, rank, id, score) as of ``topk`` by cosine: after the nprobe nearest cells, each query goes on to every cell that can hold a better row than its k-th.

    A cell can't where the angle to its centroid, less ``radius_scale`` times the cell's radius, exceeds the angle of
    the k-th; with a scale under 1 fewer cells are opened and some rows may be missed.
    """
    assigned = staged(assign(df, cells, dim, id, vec), "assigned")
    rows = assigned.join(_slim(df, id, vec, dim), "id").select("cell", "id", "vec")
    q = _slim(queries, id, vec, dim)
    probes = staged(nearest_cells(queries, cells, max(1, cells.count()), dim, id, vec), "probes")
    first = staged(best(scan_cells(rows, probes.where(F.col("rank") < nprobe).select("query", F.col("id").alias("cell")), q, k, dim, exclude_self), k), "first")
    angle = lambda c: F.acos(F.least(F.greatest(F.col(c), F.lit(-1.0)), F.lit(1.0)))
    kth = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    radius = assigned.groupBy(F.col("cell").cast("bigint").alias("id")).agg(F.max("angle").alias("radius"))
    # the angle by which scores that round alike may differ near 1
    open_cells = probes.where(F.col("rank") >= nprobe).join(radius, "id").join(kth, "query", "left").where(F.col("kth").isNull() | (angle("score") - radius_scale * F.col("radius") <= angle("kth") + 1e-4))
    return best(first.select("query", "id", "score").union(scan_cells(rows, open_cells.select("query", F.col("id").alias("cell")), q, k, dim, exclude_self)), k)
