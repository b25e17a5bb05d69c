"""Declared-recall search in three verbs.

``ANALYZE INDEX 'path' [WITH (K = 10)]`` measures an index and keeps what it found beside it;
``SELECT id, score FROM 'path' ORDER BY COSINE(:q) LIMIT 10 WITH (RECALL >= 0.95)`` runs at the cheapest measured
point that has the recall; ``EXPLAIN SELECT ...`` tells that point.  ``RERANK = n`` sets it by hand, ``CERTIFY``
adds the index's certificate of ranking.  There is no WHERE: a result is a DataFrame, to be joined and filtered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.functions.codec import decode, usable
from embervane.operators import certificate, hubness, knn
from embervane.operators.index import Log, VectorIndex
from embervane.operators.pca import Principal

_TOKEN = re.compile(r"\s*(?:(?P<text>'[^']*'|\"[^\"]*\")|(?P<number>\d+\.?\d*|\.\d+)|(?P<sign>>=|[=(),;])|(?P<word>:?[A-Za-z_]\w*))")
GRID = (1, 2, 4, 8, 16, 32)


@dataclass(frozen=True)
class Statement:
    verb: str
    path: str
    columns: tuple[str, ...] = ("id", "score")
    metric: str = "cosine"
    k: int = 10
    options: dict = field(default_factory=dict)

    @property
    def recall(self) -> float | None:
        return self.options.get("RECALL")


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int]] = []
        at, text = 0, text.rstrip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or not m[0].strip():
                raise ValueError(f"unreadable at {at}: {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1].upper() if self.at < len(self.tokens) else ""

    def take(self, *wanted: str, kind: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise ValueError(f"ends where {' or '.join(wanted) or kind} is expected")
        found, value, where = self.tokens[self.at]
        if (wanted and value.upper() not in wanted) or (kind and found != kind):
            hint = ": WHERE isn't part of this dialect, join or filter the result" if value.upper() == "WHERE" else ""
            raise ValueError(f"{value!r} at {where} where {' or '.join(wanted) or kind} is expected{hint}")
        self.at += 1
        return value

    def options(self) -> dict:
        out: dict = {}
        if self.peek() != "WITH":
            return out
        self.take("WITH")
        self.take("(")
        while True:
            name = self.take(kind="word").upper()
            if self.peek() in ("=", ">="):
                self.take("=", ">=")
                raw = self.take()
                out[name] = float(raw) if re.fullmatch(r"\d*\.\d+|\d+\.", raw) else int(raw) if raw.isdigit() else raw.strip("'\"")
            else:
                out[name] = True
            if self.take(",", ")") == ")":
                return out


def parse(text: str) -> Statement:
    r = _Reader(text)
    head = r.take("ANALYZE", "EXPLAIN", "SELECT").upper()
    if head == "ANALYZE":
        r.take("INDEX")
        s = Statement("analyze", r.take(kind="text")[1:-1], options=r.options())
    else:
        if head == "EXPLAIN":
            r.take("SELECT")
        columns = [r.take("ID", "SCORE").lower()]
        while r.peek() == ",":
            r.take(",")
            columns.append(r.take("ID", "SCORE").lower())
        r.take("FROM")
        path, metric, k = r.take(kind="text")[1:-1], "cosine", 10
        if r.peek() == "WHERE":
            r.take("ORDER")
        if r.peek() == "ORDER":
            r.take("ORDER")
            r.take("BY")
            metric = r.take("COSINE", "L2", "DOT").lower()
            r.take("(")
            r.take(":Q")
            r.take(")")
        if r.peek() == "LIMIT":
            r.take("LIMIT")
            raw = r.take(kind="number")
            if not raw.isdigit() or not int(raw):
                raise ValueError("LIMIT is a whole number above 0")
            k = int(raw)
        s = Statement("explain" if head == "EXPLAIN" else "select", path, tuple(columns), metric, k, r.options())
    if r.peek():
        raise ValueError(f"nothing is expected after {r.tokens[r.at - 1][1]!r}")
    if s.recall is not None and not 0 < float(s.recall) <= 1:
        raise ValueError("RECALL is above 0 and at most 1")
    return s


def calibrate(index: VectorIndex, originals: DataFrame, queries: DataFrame, k: int, fetches: tuple[int, ...] = GRID) -> DataFrame:
    """(cost, recall) of re-ranking ``cost`` times k (1: no re-ranking), measured on ``queries``: one search of the widest, cut and ranked again for each."""
    from embervane.session import staged

    exact = staged(knn.topk(originals, queries, k, dim=index.codec.dim), "exact")
    far = staged(index.search(queries, k * max(fetches)), "far")
    rows = None
    for c in fetches:
        found = far.where(F.col("rank") < k * c)
        if c > 1:
            found = knn.rerank(found, originals, queries, k, index.codec.dim)
        r = knn.recall(exact, found, k).agg(F.avg("recall").alias("recall")).select(F.lit(c).alias("cost"), "recall")
        rows = r if rows is None else rows.union(r)
    return rows


def geometry(originals: DataFrame, k: int, dim: int, **columns) -> dict:
    """What rows look like, for the reader alone: size, intrinsic dimension by two neighbours, effective rank, components for 90 % of variance, hubs."""
    from embervane.session import staged

    p = Principal.fit(originals, dim, dim, **columns)
    edges = staged(knn.topk(originals, originals, k, "l2", dim, exclude_self=True, **columns), "edges")
    two = edges.where("rank < 2").groupBy("query").agg((-F.max("score")).alias("r1"), (-F.min("score")).alias("r2")).where("r1 > 0").select((F.col("r2") / F.col("r1")).alias("mu")).where("mu > 1")
    bar = two.agg(F.percentile("mu", F.lit(0.9))).first()[0]
    s = two.where(F.col("mu") <= bar).agg(F.count("*").alias("n"), F.sum(F.log("mu")).alias("s")).first() if bar is not None else None
    counts = hubness.census(edges, usable(originals, columns.get("id", "vec_id"), columns.get("vec", "embedding"), dim))
    t = hubness.tail(counts, k).first()
    v = p.eigenvalues
    return {"rows": p.n, "dim": dim, "two_nn_dimension": s["n"] / s["s"] if s and s["s"] else None, "effective_rank": float(v.sum() ** 2 / max((v**2).sum(), 1e-30)), "dims90": p.suggest_dim(0.9), "count_skew": t["skew"], "max_count": t["max_n_k"]}


def _catalog(index: VectorIndex) -> Log:
    return Log(index.spark, f"{index.path}/_stats")


def analyze(s: Statement, index: VectorIndex, originals: DataFrame, queries: DataFrame) -> dict:
    """Measures the index and keeps the result beside it, as of its version."""
    k = int(s.options.get("K", s.k))
    entry = {"k": k, "index_version": index.version, "metric": "cosine", "sweep": [r.asDict() for r in calibrate(index, originals, queries, k).orderBy("cost").collect()], "geometry": geometry(originals, k, index.codec.dim)}
    log = _catalog(index)
    last = log.last()
    log.write((last[0] if last else 0) + 1, entry)
    return entry


def catalog(index: VectorIndex) -> dict | None:
    last = _catalog(index).last()
    return last[1] if last else None


def plan(s: Statement, entry: dict | None) -> dict:
    """The operating point of a statement: by hand, by the catalog, or without a target none; where nothing measured reaches the target, the best, and it says so."""
    sweep = {r["cost"]: r["recall"] for r in entry["sweep"]} if entry else {}
    if "RERANK" in s.options:
        n = max(1, int(s.options["RERANK"]))
        return {"cost": n, "by": "statement", "recall": sweep.get(n), "reachable": True}
    if s.recall is None:
        return {"cost": 1, "by": "default", "recall": sweep.get(1), "reachable": True}
    if not sweep:
        raise RuntimeError(f"a recall target needs measurements: ANALYZE INDEX '{s.path}' first")
    enough = [c for c in sorted(sweep) if sweep[c] >= float(s.recall)]
    cost = enough[0] if enough else max(sweep, key=lambda c: sweep[c])
    return {"cost": cost, "by": "calibration", "recall": sweep[cost], "reachable": bool(enough)}


def warnings(s: Statement, index: VectorIndex, entry: dict | None) -> list[str]:
    out = []
    if entry and entry["k"] != s.k:
        out.append(f"measured at K = {entry['k']}, asked for {s.k}")
    if entry and entry["index_version"] != index.version:
        out.append("the index has changed since it was analysed")
    if entry and s.metric == "l2":
        out.append("measured by cosine, asked by l2")
    return out


def certify(index: VectorIndex, originals: DataFrame, anchors: int = 200, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The index's certificate of ranking, on a sample of anchors by a hash of their ids."""
    codec = index.codec
    live = index.live().orderBy(F.md5(F.col("id").cast("string"))).limit(anchors)
    return certificate.certificate(certificate.pair_distances(usable(originals, id, vec, codec.dim), decode(live, codec)))


def execute(text: str, index: VectorIndex, originals: DataFrame, queries: DataFrame) -> DataFrame:
    """ANALYZE gives (cost, recall), EXPLAIN one row (cost, by, recall, reachable, warnings), SELECT (query, rank, id, score), and with CERTIFY the certificate's columns beside them."""
    s = parse(text)
    spark = index.spark
    if s.verb == "analyze":
        return spark.createDataFrame([(r["cost"], r["recall"]) for r in analyze(s, index, originals, queries)["sweep"]], "cost int, recall double")
    entry = catalog(index)
    p = plan(s, entry)
    if s.verb == "explain":
        return spark.createDataFrame([(p["cost"], p["by"], p["recall"], p["reachable"], warnings(s, index, entry))], "cost int, by string, recall double, reachable boolean, warnings array<string>")
    hits = index.search(queries, s.k * p["cost"], metric=s.metric)
    hits = knn.rerank(hits, originals, queries, s.k, index.codec.dim, metric=s.metric) if p["cost"] > 1 else hits
    hits = hits.select("query", "rank", *s.columns)
    return hits.crossJoin(F.broadcast(certify(index, originals))) if s.options.get("CERTIFY") else hits
