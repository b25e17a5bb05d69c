"""Which family of quantizers a consumer's rankings survive, spectra of matrices, tapered precision."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.functions.codec import list_column, matrix, usable
from embervane.operators import knn
from embervane.operators.ranks import rank_correlation
from embervane.session import prepare, staged


def displacement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (median_tangential, mean_tangential, median_radial, pairs) of how pairs of vectors differ."""
    from embervane.operators.stats import tangential

    t = tangential(pairs, a, b)
    return t.select(F.col("median_fraction").alias("median_tangential"), F.col("mean_fraction").alias("mean_tangential"), (1 - F.col("median_fraction")).alias("median_radial"), "pairs")


def scored(base: DataFrame, queries: DataFrame, dim: int, metric: str = "dot") -> DataFrame:
    """(query, id, score) of every query with every row, for a small stated set of queries."""
    return knn.topk(base, queries, 1 << 30, metric, dim, id="id", vec="vec").select("query", "id", "score")


def per_channel_proxy(x: DataFrame, dim: int, bits: int = 4) -> DataFrame:
    """(id, vec) after a grid between each channel's least and greatest value: one aggregation of ``dim`` pairs."""
    ends = x.agg(*(F.min(F.get("vec", F.lit(j))).alias(f"l{j}") for j in range(dim)), *(F.max(F.get("vec", F.lit(j))).alias(f"h{j}") for j in range(dim))).first()
    lo, hi = (np.array([ends[f"{c}{j}"] or 0.0 for j in range(dim)]) for c in "lh")
    step = np.maximum(hi - lo, 1e-8) / ((1 << bits) - 1)
    return _mapped(x, dim, lambda v: np.rint((v - lo) / step) * step + lo)


def polar_proxy(x: DataFrame, dim: int, bits: int = 4) -> DataFrame:
    """(id, vec) after a codec of directions."""
    from embervane.functions.codec import Codec

    codec = Codec(dim, bits)
    return _mapped(x, dim, lambda v: codec.decode(*codec.encode(v)))


def _mapped(x: DataFrame, dim: int, f) -> DataFrame:
    def g(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), list_column(f(matrix(b.column("vec"), dim)), pa.float64())], ["id", "vec"])

    prepare(x.sparkSession)
    return x.select("id", "vec").mapInArrow(g, "id bigint, vec array<double>")


def recommend(df: DataFrame, dim: int, bits: int = 4, every: int = 100, id: str = "vec_id", vec: str = "embedding") -> dict:
    """The family, polar or per channel, whose scores rank as the true ones do: Spearman's rho within queries, which are the rows with ids divisible by ``every``, averaged."""
    x = staged(usable(df, id, vec, dim), "probe")
    queries = x.where(F.col("id") % every == 0)
    truth = staged(scored(x, queries, dim), "truth")
    rho = {}
    for name, proxy in (("polar", polar_proxy), ("per_channel", per_channel_proxy)):
        both = staged(truth.join(scored(staged(proxy(x, dim, bits), name), queries, dim).withColumnRenamed("score", "approx"), ["query", "id"]), "both")
        rho[name] = rank_correlation(both, "score", "approx", by="query").agg(F.avg("rho")).first()[0]
    return {**rho, "recommendation": max(rho, key=lambda k: rho[k] if rho[k] is not None else -2.0)}


def spectrum(m: np.ndarray) -> dict[str, float | int]:
    """Effective rank at 95 % of variance and condition number of a matrix that one worker holds."""
    s = np.linalg.svd(m, compute_uv=False)
    share = np.cumsum(s**2) / max(float((s**2).sum()), 1e-30)
    return {"effective_rank": int(np.searchsorted(share, 0.95)) + 1, "condition": float(s[0] / max(s[-1], 1e-30))}


def taper(budget: int, head_bits: int = 4, tails: tuple[float, ...] = (0.5, 0.3, 0.2), most: int = 512) -> list[int]:
    """Bits of components in order, ``budget`` in all: a head at full width, then stretches of 3, 2 and 1, given as shares of the head."""
    head = round(budget / (head_bits + sum(t * b for t, b in zip(tails, (3, 2, 1)))))
    bits = [head_bits] * head + [b for t, b in zip(tails, (3, 2, 1)) for _ in range(round(head * t))]
    while sum(bits) > budget:
        bits.pop()
    return (bits + [1] * (budget - sum(bits)))[:most]


def tapered(x: DataFrame, bits: list[int], dim: int) -> DataFrame:
    """(id, vec) with each component on its own grid between its ends, components beyond the schedule 0."""
    ends = x.agg(*(F.min(F.get("vec", F.lit(j))).alias(f"l{j}") for j in range(dim)), *(F.max(F.get("vec", F.lit(j))).alias(f"h{j}") for j in range(dim))).first()
    lo, hi = (np.array([ends[f"{c}{j}"] or 0.0 for j in range(dim)]) for c in "lh")
    own = np.array([*bits, *[0] * dim][:dim])
    step = np.maximum((hi - lo) / np.maximum(2.0**own - 1, 1), 1e-30)
    return _mapped(x, dim, lambda v: np.where(own > 0, np.clip(np.rint((v - lo) / step), 0, 2.0**own - 1) * step + lo, 0.0))


def block_hashes(profile: dict, tokens: list[int], block: int = 16) -> list[str]:
    """A hash for each whole block of tokens, each over all before it and the profile, so that equal beginnings under one profile share hashes; a profile with unknown fields is an error."""
    if any(v is None for v in profile.values()):
        raise ValueError("a profile with unknown fields has no identity")
    h, out = hashlib.sha256(json.dumps(profile, sort_keys=True).encode()).hexdigest(), []
    for a in range(0, len(tokens) - len(tokens) % block, block):
        h = hashlib.sha256(f"{h}:{json.dumps(tokens[a : a + block])}".encode()).hexdigest()
        out.append(h)
    return out


def compatible(a: dict, b: dict) -> bool:
    """Whether two profiles are the same and complete; one with unknown fields fits nothing, itself included."""
    return a == b and all(v is not None for v in a.values())


def fingerprint(df: DataFrame, *columns: str) -> str:
    """A hash of a table's content, whatever its order and partitions."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    r = df.agg(F.count("*"), F.sum(h), F.sum(F.pmod(h * 31, F.lit(1_000_000_007)))).first()
    return hashlib.sha256(":".join(map(str, r)).encode()).hexdigest()
