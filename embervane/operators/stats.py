"""Moments, principal components, certificates of ranking, agreement, drift, frontiers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embervane.functions.codec import matrix, usable
from embervane.functions.vector import distance
from embervane.session import prepare


def gram(df: DataFrame, dim: int = 64, id: str = "vec_id", vec: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum, sum of outer products): one partial per partition, of a size that the data doesn't change, added up by tree of SQL sums."""

    def f(batches):
        n, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = matrix(b.column("vec"), dim)
            n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        flat = np.concatenate([[n], s, g.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "x"])

    prepare(df.sparkSession)
    rows = usable(df, id, vec, dim).mapInArrow(f, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    flat = np.zeros(1 + dim + dim * dim)
    flat[rows["i"]] = rows["x"]
    return int(flat[0]), flat[1 : dim + 1], flat[dim + 1 :].reshape(dim, dim)


def covariance(df: DataFrame, dim: int = 64, **columns) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance with n - 1); zeros for fewer than two rows."""
    n, s, g = gram(df, dim, **columns)
    mean = s / max(n, 1)
    return mean, (g - n * np.outer(mean, mean)) / (n - 1) if n > 1 else np.zeros((dim, dim))


def principal(df: DataFrame, dim: int = 64, **columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, descending eigenvalues, components as rows)."""
    mean, c = covariance(df, dim, **columns)
    value, vector = np.linalg.eigh(c)
    return mean, value[::-1], vector[:, ::-1].T


def project(df: DataFrame, mean: np.ndarray, components: np.ndarray, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, vec) projected on the components."""
    from embervane.functions.codec import list_column

    def f(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), list_column((matrix(b.column("vec"), len(mean)) - mean) @ components.T, pa.float64())], ["id", "vec"])

    prepare(df.sparkSession)
    return usable(df, id, vec, len(mean)).mapInArrow(f, "id bigint, vec array<double>")


def suggest_dim(eigenvalues: np.ndarray, target: float = 0.95) -> int:
    share = np.cumsum(eigenvalues) / max(eigenvalues.sum(), 1e-30)
    return int(np.searchsorted(share, target - 1e-12) + 1)


def frontier(sweep: DataFrame, gain: str, quality: str) -> DataFrame:
    """The rows whose quality is above that of every row of greater gain."""
    w = Window.orderBy(F.desc(gain), F.desc(quality)).rowsBetween(Window.unboundedPreceding, -1)
    return sweep.withColumn("__best", F.max(quality).over(w)).where(F.col("__best").isNull() | (F.col(quality) > F.col("__best"))).drop("__best")


def ascending_frontier(sweep: DataFrame, gain: str, quality: str) -> DataFrame:
    """The rows whose quality is above that of every row of smaller gain: those that beat all that is less compressed."""
    w = Window.orderBy(gain, F.desc(quality)).rowsBetween(Window.unboundedPreceding, -1)
    return sweep.withColumn("__best", F.max(quality).over(w)).where(F.col("__best").isNull() | (F.col(quality) > F.col("__best"))).drop("__best")


def recommend(sweep: DataFrame, gain: str, quality: str, least: float) -> DataFrame:
    """The row of greatest gain whose quality is ``least`` or more; none, where none is."""
    return sweep.where(F.col(quality) >= least).orderBy(F.desc(gain), F.desc(quality)).limit(1)


def plan_point(sweep: DataFrame, least_recall: float) -> DataFrame:
    """The cheapest row that reaches the recall; where none does, the one of greatest recall."""
    ok = F.col("recall") >= least_recall
    return sweep.orderBy(F.desc(ok), F.when(ok, F.col("cost")).otherwise(-F.col("recall")), "cost").limit(1)


def tangential(pairs: DataFrame, a: str, b: str) -> DataFrame:
    from embervane.functions.vector import tangential_fraction

    t = pairs.select(tangential_fraction(F.col(a), F.col(b)).alias("t")).where("t IS NOT NULL")
    return t.agg(F.percentile("t", F.lit(0.5)).alias("median_fraction"), F.avg("t").alias("mean_fraction"), F.count("*").alias("pairs"))


def shift(df: DataFrame, group: str, dim: int = 64, vec: str = "embedding") -> DataFrame:
    """(group, rows, shift): distance of each group's mean vector from that of all rows."""
    x = df.where(F.col(group).isNotNull() & (F.size(vec) == dim))
    means = [F.avg(F.get(vec, F.lit(j)).cast("double")).alias(f"m{j}") for j in range(dim)]
    pack = F.array(*(f"m{j}" for j in range(dim)))
    every = x.agg(*means).select(pack.alias("m"))
    own = x.groupBy(group).agg(F.count("*").alias("rows"), *means).select(group, "rows", pack.alias("g"))
    return own.crossJoin(F.broadcast(every)).select(group, "rows", distance(F.col("g"), F.col("m")).alias("shift"))


#: Rows of a block of ``rolling``, which a task sorts by itself.
BLOCK = 100_000


def rolling(df: DataFrame, key: str, order: str, value: str, window: int = 1000) -> DataFrame:
    """df's (key, order, value) with n, mean and least of the last ``window`` rows of the key: the monitor's batch twin.

    Rows are ranked by key and order and cut to blocks by rank, each with the ``window`` - 1 rows before it, so a key
    of any size is spread over tasks.  Floating values are summed and compared by window in numpy, others by Spark.
    """
    from embervane.operators.ranks import ranked

    block = max(BLOCK, window)
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).alias("v"))
    kinds = dict(rows.dtypes)
    r = ranked(rows, ["k", "o"], "at").withColumn("at", F.col("at") - 1)
    own = F.floor(F.col("at") / block)
    ahead = F.floor((F.col("at") + window - 1) / block)
    r = r.withColumn("block", F.explode(F.sequence(own, ahead))).withColumn("lead", F.col("block") > own)
    if kinds["v"] not in ("double", "float"):
        w = Window.partitionBy("block", "k").orderBy("at").rowsBetween(-(window - 1), 0)
        out = r.withColumns({"n": F.count("v").over(w), "mean": F.avg("v").over(w), "least": F.min("v").over(w)}).where(~F.col("lead"))
        return out.select(F.col("k").alias(key), F.col("o").alias(order), F.col("v").alias(value), "n", "mean", "least")
    schema = f"k {kinds['k']}, o {kinds['o']}, v {kinds['v']}, n bigint, mean double, least {kinds['v']}"

    def f(t: pa.Table) -> pa.Table:
        t = t.take(pa.compute.sort_indices(t, sort_keys=[("at", "ascending")]))
        code = t.column("k").combine_chunks().dictionary_encode(null_encoding="encode")
        code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
        v = t.column("v").cast(pa.float64()).to_numpy()  # nulls are NaN
        n, mean, least = _rolled(code, v, t.column("v").is_null().to_numpy(), window)
        none = n == 0
        out = pa.table({"k": t.column("k"), "o": t.column("o"), "v": t.column("v"), "n": pa.array(n), "mean": pa.array(mean, mask=none), "least": pa.array(least, mask=none).cast(t.schema.field("v").type)})
        return out.filter(pa.compute.invert(t.column("lead")))

    prepare(df.sparkSession)
    out = r.select("k", "o", "v", "at", "block", "lead").groupBy("block").applyInArrow(f, schema)
    return out.select(F.col("k").alias(key), F.col("o").alias(order), F.col("v").alias(value), "n", "mean", "least")


def _rolled(code: np.ndarray, v: np.ndarray, null: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, mean, least) of the last ``window`` rows of each row's run of equal codes; a mean with NaN is NaN, the least is NaN where there is no other."""
    total, least, n = (np.empty(len(v), kind) for kind in (np.float64, np.float64, np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
    for a, z in zip(cuts, cuts[1:]):
        pad = np.concatenate([np.ones(window - 1, bool), null[a:z]])
        x = np.concatenate([np.zeros(window - 1), v[a:z]])
        summed = np.where(pad, 0.0, x)
        upto = np.concatenate([[0], np.cumsum(~pad)])
        n[a:z] = upto[window:] - upto[:-window]
        low = np.where(pad | np.isnan(x), np.inf, x)
        number = np.concatenate([[0], np.cumsum(~pad & ~np.isnan(x))])
        with np.errstate(invalid="ignore"):
            for b in range(0, z - a, 8192):
                e = min(b + 8192, z - a) + window - 1
                total[a + b : a + e - window + 1] = np.lib.stride_tricks.sliding_window_view(summed[b:e], window).sum(axis=1)
                least[a + b : a + e - window + 1] = np.lib.stride_tricks.sliding_window_view(low[b:e], window).min(axis=1)
        least[a:z][number[window:] == number[:-window]] = np.nan
    with np.errstate(invalid="ignore", divide="ignore"):
        return n, total / n, least


def ks_halves(df: DataFrame, key: str, order: str, value: str, significance: float = 0.05) -> DataFrame:
    """(key, n_old, n_new, ks, critical, drifted): two-sample Kolmogorov-Smirnov of the earlier and the later half of each key's values; fewer than 8 values never drift."""
    x = df.where(F.col(value).isNotNull() & F.col(key).isNotNull())
    n = F.count("*").over(Window.partitionBy(key))
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    x = x.select(key, value, (at > F.floor(n / 2)).alias("new"))
    same = Window.partitionBy(key).orderBy(value)
    every = Window.partitionBy(key)
    one = lambda c: F.when(c, 1).otherwise(0)
    x = x.select(key, F.sum(one(~F.col("new"))).over(same).alias("a"), F.sum(one(F.col("new"))).over(same).alias("b"), F.sum(one(~F.col("new"))).over(every).alias("n_old"), F.sum(one(F.col("new"))).over(every).alias("n_new"))
    s = x.where("n_old > 0 AND n_new > 0").groupBy(key, "n_old", "n_new").agg(F.max(F.abs(F.col("a") / F.col("n_old") - F.col("b") / F.col("n_new"))).alias("ks"))
    c = math.sqrt(-math.log(significance / 2) / 2)
    s = s.withColumn("critical", c * F.sqrt((F.col("n_old") + F.col("n_new")) / (F.col("n_old") * F.col("n_new"))))
    return s.withColumn("drifted", (F.col("ks") > F.col("critical")) & (F.col("n_old") + F.col("n_new") >= 8))


def bootstrap_ci(per_query: DataFrame, column: str = "recall", n_boot: int = 1000, alpha: float = 0.05, id: str = "query") -> DataFrame:
    """One row (mean, lo, hi): the interval of a mean over queries by resampling, each resample drawing a Poisson number of every query by a hash, so that no resample is gathered."""
    u = F.pmod(F.xxhash64(id, "b"), F.lit(1 << 40)) / float(1 << 40)
    upto, drawn = 0.0, F.lit(0)
    for k in range(9):
        upto += math.exp(-1) / math.factorial(k)
        drawn = drawn + F.when(u > upto, 1).otherwise(0)
    x = per_query.select(id, F.col(column).cast("double").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")).select("v", "b", drawn.alias("w"))
    means = x.groupBy("b").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"))
    return per_query.agg(F.avg(column).alias("mean")).crossJoin(ends)
