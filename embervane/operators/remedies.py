"""Remedies for hubs: local scaling, centring by area, density correction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.functions import vector as V
from embervane.functions.codec import matrix, usable
from embervane.operators.knn import best
from embervane.session import prepare

#: Rows that density is measured against.
DENSITY_SAMPLE = 256


def local_scale(edges: DataFrame) -> DataFrame:
    """(id, r_k): the mean score of each query's nearest neighbours."""
    return edges.groupBy(F.col("query").alias("id")).agg(F.avg("score").alias("r_k"))


def csls(hits: DataFrame, scale: DataFrame, k: int, weight: float = 1.0) -> DataFrame:
    """(query, rank, id, score) by score less ``weight`` times the candidate's r_k; candidates without one keep their score."""
    corrected = hits.join(scale, "id", "left").select("query", "id", (F.col("score") - weight * F.coalesce("r_k", F.lit(0.0))).alias("score"))
    return best(corrected, k)


def centroids(df: DataFrame, area: str, dim: int = 64, vec: str = "embedding") -> DataFrame:
    """(area, centroid): mean vectors, by one aggregation."""
    x = df.where(F.col(area).isNotNull() & (F.size(vec) == dim))
    s = x.groupBy(F.col(area).alias("area")).agg(*(F.avg(F.get(vec, F.lit(j)).cast("double")).alias(f"m{j}") for j in range(dim)))
    return s.select("area", F.array(*(f"m{j}" for j in range(dim))).alias("centroid"))


def centred(df: DataFrame, means: DataFrame, area: str, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, area, vec): vectors less their own area's centroid, of norm 1; an area without a centroid is an error."""
    x = df.select(F.col(id).cast("bigint").alias("id"), F.col(area).alias("area"), F.col(vec).cast("array<double>").alias("v")).join(means, "area", "left")
    d = F.zip_with("v", F.coalesce("centroid", F.raise_error(F.lit("no centroid for an area")).cast("array<double>")), lambda a, b: a - b)
    return x.select("id", "area", V.normalize(d).alias("vec"))


def density(df: DataFrame, sample: int = DENSITY_SAMPLE, dim: int = 64, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, mu, s): mean and deviation of each row's cosine to a fixed sample, the rows of least ids, which is sent to every executor: ``sample`` rows of ``dim`` numbers."""
    x = usable(df, id, vec, dim)
    rows = np.array([r["vec"] for r in x.orderBy("id").limit(sample).collect()]).reshape(-1, dim)
    unit = lambda a: a / np.maximum(np.sqrt((a * a).sum(1)), 1e-30)[:, None]
    shared = df.sparkSession.sparkContext.broadcast(unit(rows))

    def f(batches):
        for b in batches:
            s = unit(matrix(b.column("vec"), dim)) @ shared.value.T
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(s.mean(1)), pa.array(np.maximum(s.std(1), 1e-6))], ["id", "mu", "s"])

    prepare(df.sparkSession)
    return x.mapInArrow(f, "id bigint, mu double, s double")


def density_corrected(hits: DataFrame, of: DataFrame, k: int, scaled: bool = False) -> DataFrame:
    """(query, rank, id, score) by score less the candidate's mean similarity, and with ``scaled`` over its deviation."""
    s = F.col("score") - F.col("mu")
    return best(hits.join(of, "id").select("query", "id", (s / F.col("s") if scaled else s).alias("score")), k)
