"""Sweeps over compressions, and the one that meets a target."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.functions.codec import usable
from embervane.operators import knn
from embervane.operators.pca import Principal, Quantized
from embervane.operators.stats import ascending_frontier, frontier
from embervane.session import staged

_TARGET = re.compile(r"\s*(cosine|ratio|recall@(\d+))\s*(>=|>|<=|<)\s*([\d.]+)\s*$", re.I)


@dataclass(frozen=True)
class Target:
    metric: str
    k: int
    sign: str
    bar: float

    def met(self, row: dict) -> bool:
        x = row[{"cosine": "mean_cosine", "ratio": "ratio"}.get(self.metric, "recall")]
        return {">": x > self.bar, ">=": x >= self.bar, "<": x < self.bar, "<=": x <= self.bar}[self.sign]


def parse_target(text: str) -> Target:
    """``cosine > 0.95``, ``ratio >= 8`` or ``recall@10 >= 0.9``."""
    m = _TARGET.match(text)
    if not m:
        raise ValueError(f"not a target: {text!r}")
    return Target("recall" if m[2] else m[1].lower(), int(m[2] or 10), m[3], float(m[4]))


def evaluate(df: DataFrame, exact: DataFrame, queries: DataFrame, model: Quantized, k: int, **columns) -> dict:
    """Ratio, mean and least cosine, and recall at k of one compression."""
    back = staged(model.decompress(model.compress(df, **columns)), "back")
    q = model.quality(df, **columns).first()
    found = knn.topk(back, queries, k, dim=len(model.pca.mean), exclude_self=True, id="id", vec="vec") if columns == {} else knn.topk(back.select(F.col("id").alias(columns.get("id", "vec_id")), F.col("vec").alias(columns.get("vec", "embedding"))), queries, k, dim=len(model.pca.mean), exclude_self=True, **columns)
    recall = knn.recall(exact, found, k).agg(F.avg("recall")).first()[0]
    return {"ratio": model.ratio, "mean_cosine": q["mean"], "least_cosine": q["least"], "recall": recall}


def sweep(df: DataFrame, dims: list[int], bits: list[int], dim: int = 64, k: int = 10, weighted: bool = True, share_of_queries: int = 100, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(components, bits, weighted, ratio, mean_cosine, least_cosine, recall) of every combination; queries are the rows whose id is divisible by ``share_of_queries``, against all rows."""
    x = usable(df, id, vec, dim)
    queries = x.where(F.col("id") % share_of_queries == 0)
    base = Principal.fit(df, dim, dim, id=id, vec=vec)
    own = {"id": "id", "vec": "vec"}
    exact = staged(knn.topk(x, queries, k, dim=dim, exclude_self=True, **own), "exact")
    rows = []
    for d in dims:
        pca = Principal(base.n, base.total, base.outer, d)
        for b in bits:
            for w in (False, True) if weighted and d > 2 else (False,):
                model = Quantized.weighted(pca, b) if w else Quantized.uniform(pca, b)
                r = evaluate(x, exact, queries, model, k, **own)
                rows.append((d, b, w, float(r["ratio"]), float(r["mean_cosine"]), float(r["least_cosine"]), float(r["recall"] or 0.0)))
    return df.sparkSession.createDataFrame(rows, "components int, bits int, weighted boolean, ratio double, mean_cosine double, least_cosine double, recall double")


def auto_compress(swept: DataFrame, target: str) -> tuple[dict | None, DataFrame]:
    """(the row of greatest ratio that meets the target, or for a target on the ratio of greatest cosine, else none; the frontier of ratio against cosine)."""
    t = parse_target(target)
    rows = [r.asDict() for r in swept.collect() if t.met(r.asDict())]  # a row for each combination
    best = max(rows, key=lambda r: (r["mean_cosine"], r["ratio"]) if t.metric == "ratio" else (r["ratio"], r["mean_cosine"]), default=None)
    return best, frontier(swept, "ratio", "mean_cosine")


def autotune(swept: DataFrame, least_recall: float) -> tuple[dict | None, DataFrame]:
    """(the row of greatest ratio with that recall, or none; the rows that beat all less compressed ones)."""
    r = swept.where(F.col("recall") >= least_recall).orderBy(F.desc("ratio"), F.desc("recall")).first()
    return r.asDict() if r else None, ascending_frontier(swept, "ratio", "recall")
