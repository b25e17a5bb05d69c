"""Operators on attention caches and weights, as long tables (h, s, d, x): head, position, channel, value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The sixteen levels of four-bit normal floats.
NF4 = (-1.0, -0.6961928009986877, -0.5250730514526367, -0.39491748809814453, -0.28444138169288635, -0.18477343022823334, -0.09105003625154495, 0.0, 0.07958029955625534, 0.16093020141124725, 0.24611230194568634, 0.33791524171829224, 0.44070982933044434, 0.5626170039176941, 0.7229568362236023, 1.0)


def long_table(df: DataFrame, heads: int, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(h, s, d, x) of vectors cut into heads, the row's id being the position."""
    x = df.select(F.col(id).cast("bigint").alias("s"), F.size(vec).alias("n"), F.posexplode(F.col(vec).cast("array<double>")).alias("i", "x"))
    width = F.floor(F.col("n") / heads)
    return x.select(F.floor(F.col("i") / width).cast("int").alias("h"), "s", (F.col("i") % width).cast("int").alias("d"), "x")


def outliers(x: DataFrame, share: float) -> DataFrame:
    """``x`` with outlier: whether a value is among the ``share`` of greatest magnitude of its channel; ties stay in."""
    if share <= 0:
        return x.withColumn("outlier", F.lit(False))
    channel = Window.partitionBy("h", "d")
    n = F.count("*").over(channel)
    place = F.rank().over(channel.orderBy(F.desc(F.abs("x"))))
    return x.withColumn("outlier", place <= F.greatest(F.lit(1), F.round(n * share)))


def per_channel(x: DataFrame, bits: int = 4, kind: str = "uniform", outlier_share: float = 0.0) -> DataFrame:
    """(h, s, d, x, code, y): values of each channel over positions by its own grid, and what they decode to.

    ``uniform`` has 2 ** bits steps from the channel's least to its greatest value; ``nf4`` the normal floats times
    its greatest magnitude; ``nf4_asym`` the same about its mean.  Outliers decode to themselves.  Grids come from
    one aggregation by channel, of as many rows as there are channels.
    """
    g = x.groupBy("h", "d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"))
    x = outliers(x, outlier_share).join(g, ["h", "d"])
    if kind == "uniform":
        top = (1 << bits) - 1
        scale = F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-8)) / top
        code = F.least(F.greatest(F.rint((F.col("x") - F.col("lo")) / scale), F.lit(0.0)), F.lit(float(top))).cast("int")
        y = F.col("lo") + code * scale
    elif kind in ("nf4", "nf4_asym"):
        mid = F.col("mean") if kind == "nf4_asym" else F.lit(0.0)
        most = F.greatest(F.abs(F.col("hi") - mid), F.abs(F.col("lo") - mid), F.lit(1e-8))
        code = nearest((F.col("x") - mid) / most, NF4)
        y = mid + most * F.get(F.array(*map(F.lit, NF4)), code)
    else:
        raise ValueError(f"no such grid: {kind}")
    return x.select("h", "s", "d", "x", code.alias("code"), F.when(F.col("outlier"), F.col("x")).otherwise(y).alias("y"))


def nearest(x: Column, levels: tuple[float, ...]) -> Column:
    """The index of the nearest of ascending levels, the lower of two equally near."""
    middles = [(a + b) / 2 for a, b in zip(levels, levels[1:])]
    return F.size(F.filter(F.array(*map(F.lit, middles)), lambda m: m < x))


def calibrated_levels(x: DataFrame, bits: int = 4, rounds: int = 20) -> DataFrame:
    """(h, d, levels) of least squared error for each channel, by Lloyd's rounds from its quantiles; a level without values stays where it is.  Each round is one aggregation by channel and level."""
    from embervane.session import staged

    n = 1 << bits
    lv = staged(x.groupBy("h", "d").agg(F.sort_array(F.percentile("x", F.array(*(F.lit(i / (n - 1)) for i in range(n))))).alias("levels")), "levels")
    for _ in range(rounds):
        own = x.join(lv, ["h", "d"]).withColumn("i", nearest_of("x", "levels"))
        means = own.groupBy("h", "d", "i").agg(F.avg("x").alias("m")).groupBy("h", "d").agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("means"))
        lv = staged(lv.join(means, ["h", "d"]).select("h", "d", F.sort_array(F.transform("levels", lambda v, i: F.coalesce(F.element_at("means", i), v))).alias("levels")), "levels")
    return lv


def nearest_of(x: str, levels: str) -> Column:
    """The index of the nearest of an ascending array of levels, the lower of two equally near."""
    middles = F.zip_with(F.slice(levels, 1, F.size(levels) - 1), F.slice(levels, 2, F.size(levels) - 1), lambda a, b: (a + b) / 2)
    return F.size(F.filter(middles, lambda m: m < F.col(x)))


def attention_parts(q: DataFrame, k: DataFrame, v: DataFrame, part: Column, width: int) -> DataFrame:
    """(h, part, m, l, d, acc) of online softmax over each part of the positions: greatest score, sum of exponentials, and of exponentials times values; q is (h, d, x) of one query."""
    scores = k.join(F.broadcast(q.select("h", "d", F.col("x").alias("q"))), ["h", "d"]).groupBy("h", "s").agg((F.sum(F.col("x") * F.col("q")) / math.sqrt(width)).alias("score")).withColumn("part", part)
    top = scores.groupBy("h", "part").agg(F.max("score").alias("m"))
    e = scores.join(top, ["h", "part"]).select("h", "s", "part", "m", F.exp(F.col("score") - F.col("m")).alias("e"))
    total = e.groupBy("h", "part", "m").agg(F.sum("e").alias("l"))
    acc = e.join(v, ["h", "s"]).groupBy("h", "part", "d").agg(F.sum(F.col("e") * F.col("x")).alias("acc"))
    return total.join(acc, ["h", "part"])


def merge_parts(parts: DataFrame) -> DataFrame:
    """(h, d, y): the attention of all positions from the states of its parts."""
    top = parts.groupBy("h").agg(F.max("m").alias("top"))
    w = F.exp(F.col("m") - F.col("top"))
    return parts.join(top, "h").groupBy("h", "d").agg((F.sum(F.col("acc") * w) / F.sum(F.col("l") * w)).alias("y"))


def rope_bits(spark, head_dim: int, longest: int, base: float = 10000.0, default: int = 3, boosted: int = 4) -> DataFrame:
    """(d, wavelength, bits): channels whose rotation doesn't come round within ``longest`` positions get more bits."""
    d = spark.range(head_dim).select(F.col("id").cast("int").alias("d"))
    wave = 2 * math.pi * F.pow(F.lit(base), 2 * F.floor(F.col("d") / 2) / head_dim)
    return d.withColumn("wavelength", wave).withColumn("bits", F.when(F.col("wavelength") > longest, boosted).otherwise(default))


def rope_protected(spark, rows: int, head_dim: int, base: float = 10000.0, share: float = 0.125) -> DataFrame:
    """(row, protected): the rows of a key projection whose channels have the longest wavelengths."""
    half = head_dim // 2
    kept = max(1, round(share * half))
    pair = F.pmod(F.pmod(F.col("row"), F.lit(head_dim)), F.lit(half))
    return spark.range(rows).select(F.col("id").alias("row")).withColumn("protected", pair >= half - kept)


def quantized_rows(vec: Column, bits: int) -> Column:
    """An array rounded to symmetric steps of its own greatest magnitude."""
    top = (1 << (bits - 1)) - 1
    scale = F.greatest(F.array_max(F.transform(vec, F.abs)), F.lit(1e-8)) / top
    return F.transform(vec, lambda x: F.least(F.greatest(F.rint(x / scale), F.lit(float(-top - 1))), F.lit(float(top))) * scale)


def decay_gain(a: Column) -> Column:
    """The gain of a recurrence with this decay: 1 / (1 - a)."""
    return 1 / (1 - F.least(F.greatest(a, F.lit(0.0)), F.lit(1 - 1e-9)))


def decay_time_constant(a: Column) -> Column:
    """Steps in which a state falls to 1 / e."""
    return -1 / F.log(F.least(F.greatest(a, F.lit(1e-9)), F.lit(1 - 1e-9)))


def decay_sensitivity(a: Column, steps: int | None = None) -> Column:
    """The derivative of the gain by the decay, over ``steps`` or without end."""
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1 - 1e-9))
    rest = 1 - a
    return 1 / (rest * rest) if steps is None else (1 - F.pow(a, F.lit(steps)) * (1 + steps * rest)) / (rest * rest)


def quantized_decay(df: DataFrame, a: str, bits: int, basis: str = "log_tau") -> DataFrame:
    """``df`` with decay_q: decays rounded on a grid of ``linear`` steps or of steps of log(-log a), which is finest near 1."""
    if basis not in ("linear", "log_tau"):
        raise ValueError("basis is linear or log_tau")
    near = F.least(F.greatest(F.col(a), F.lit(1e-9)), F.lit(1 - 1e-9))
    v = F.col(a) if basis == "linear" else F.log(-F.log(near))
    x = df.withColumn("__v", v)
    g = x.agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    step = F.greatest((F.col("__hi") - F.col("__lo")) / max(2**bits - 1, 1), F.lit(1e-30))
    q = F.rint((F.col("__v") - F.col("__lo")) / step) * step + F.col("__lo")
    back = q if basis == "linear" else F.exp(-F.exp(q))
    return x.crossJoin(F.broadcast(g)).withColumn("decay_q", F.least(F.greatest(back, F.lit(0.0)), F.lit(1 - 1e-9))).drop("__v", "__lo", "__hi")


def decay_report(df: DataFrame, a: str, slow: float = 0.9) -> DataFrame:
    """One row (n_channels, mean_gain, max_gain, slow_channel_fraction)."""
    return df.agg(F.count(a).alias("n_channels"), F.avg(decay_gain(F.col(a))).alias("mean_gain"), F.max(decay_gain(F.col(a))).alias("max_gain"), F.avg(F.when(F.col(a) > slow, 1.0).otherwise(0.0)).alias("slow_channel_fraction"))


def routing_report(df: DataFrame, margin: Column, noise: float | None = None) -> DataFrame:
    """One row (n_tokens, margin_p10, margin_p50, margin_mean, predicted_flip_fraction) of routing margins; a token flips where noise on its logits exceeds its margin."""
    m = df.select(margin.alias("m")).where("m IS NOT NULL")
    flips = F.lit(None).cast("double") if noise is None else F.avg(F.when(F.col("m") < math.sqrt(2) * noise, 1.0).otherwise(0.0))
    return m.agg(F.count("*").alias("n_tokens"), F.percentile("m", F.lit(0.1)).alias("margin_p10"), F.percentile("m", F.lit(0.5)).alias("margin_p50"), F.avg("m").alias("margin_mean"), flips.alias("predicted_flip_fraction"))


def memory_estimate(n_vectors: int, dim: int, bits: int, original_bytes: float = 2.0, norm_bytes: int = 4) -> dict[str, float]:
    """GB of vectors before and after compression, and the ratio."""
    before, after = n_vectors * dim * original_bytes / 1e9, n_vectors * (math.ceil(dim * bits / 8) + norm_bytes) / 1e9
    return {"original_gb": before, "compressed_gb": after, "ratio": before / after if after else float("nan")}


def hot_cold(df: DataFrame, key: str, order: list[str], hot: int) -> DataFrame:
    """``df`` with tier: the state of a cache that keeps ``hot`` rows of a key as they are and, when it has more, moves the oldest half of them to the cold tier, after all rows have come in their order."""
    n = F.count("*").over(Window.partitionBy(key))
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    # with every overflow, at hot + 1 rows, (hot + 1) DIV 2 go
    moved = (hot + 1) // 2
    gone = F.when(n > hot, F.ceil((n - hot) / moved) * moved).otherwise(0)
    return df.withColumn("tier", F.when(at <= gone, "cold").otherwise("hot"))
