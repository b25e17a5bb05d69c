"""Agreement of two models' answers: flips and their significance, churn above a noise floor."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binomial_p(k: int, n: int) -> float:
    """The exact two-sided probability of k of n at 1/2: all outcomes no likelier than k."""
    pmf = [math.comb(n, i) / 2**n for i in range(n + 1)]
    return min(1.0, sum(m for m in pmf if m <= pmf[k] + 1e-12)) if n else 1.0


def mcnemar(regressions: int, recoveries: int) -> tuple[float, float]:
    """(statistic with continuity correction, two-sided p): exact up to 25 flips, the normal tail beyond."""
    flips, gap = regressions + recoveries, abs(regressions - recoveries) - 1
    if not flips:
        return 0.0, 1.0
    p = binomial_p(min(regressions, recoveries), flips) if flips <= 25 else math.erfc(gap / math.sqrt(flips) / math.sqrt(2))
    return max(gap * gap / flips, 0.0), min(1.0, p)


def _share(c: Column) -> Column:
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def flip_rate(df: DataFrame, base: Column, quant: Column) -> DataFrame:
    """One row of two models' correctness over rows that have both: accuracies, share both right, regressions, recoveries, churn, net change, McNemar's statistic and p."""
    both = df.select(base.alias("b"), quant.alias("q")).where("b IS NOT NULL AND q IS NOT NULL")
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    b, q = F.col("b"), F.col("q")
    s = both.agg(F.count("*").alias("n"), one(b & ~q).alias("b10"), one(~b & q).alias("b01"), _share(b).alias("acc_base"), _share(q).alias("acc_quant"), _share(b & q).alias("correctness_agreement")).first()
    n, lost, won = s["n"], s["b10"], s["b01"]
    stat, p = mcnemar(lost, won)
    row = (n, s["acc_base"], s["acc_quant"], s["correctness_agreement"], *((lost / n, won / n, (lost + won) / n, (won - lost) / n) if n else (None,) * 4), stat, p)
    return df.sparkSession.createDataFrame([row], "n bigint, acc_base double, acc_quant double, correctness_agreement double, regressions double, recoveries double, churn double, net_delta double, mcnemar_stat double, mcnemar_p double")


def behavioral_agreement(df: DataFrame, base: Column, quant: Column) -> DataFrame:
    """One row (n, agreement): how often the answers are the same, right or wrong."""
    return df.select(base.alias("b"), quant.alias("q")).where("b IS NOT NULL AND q IS NOT NULL").agg(F.count("*").alias("n"), _share(F.col("b") == F.col("q")).alias("agreement"))


def noise_floor(df: DataFrame, a: Column, b: Column, gold: Column | None = None) -> DataFrame:
    """One row (n, floor_disagreement, floor_churn) of two runs that should be alike; churn, of correctness, only with ``gold``."""
    x = df.select(a.alias("a"), b.alias("b"), (gold if gold is not None else F.lit(None)).alias("g")).where("a IS NOT NULL AND b IS NOT NULL")
    churn = _share((F.col("a") == F.col("g")) != (F.col("b") == F.col("g"))) if gold is not None else F.lit(None).cast("double")
    return x.agg(F.count("*").alias("n"), _share(F.col("a") != F.col("b")).alias("floor_disagreement"), churn.alias("floor_churn"))


def evaluate(df: DataFrame, base: Column, quant: Column, gold: Column, floor: float | None = None) -> DataFrame:
    """flip_rate() against ``gold`` with agreement, disagreement, and their excess over a noise floor in value and z."""
    x = df.select(base.alias("base"), quant.alias("quant"), gold.alias("gold")).dropna()
    flips = flip_rate(x, F.col("base") == F.col("gold"), F.col("quant") == F.col("gold"))
    s = flips.crossJoin(behavioral_agreement(x, F.col("base"), F.col("quant")).select("agreement")).withColumn("disagreement", 1 - F.col("agreement"))
    if floor is None:
        return s.withColumns({"excess": F.lit(None).cast("double"), "excess_z": F.lit(None).cast("double")})
    p = min(max(floor, 1e-9), 1 - 1e-9)
    return s.withColumn("excess", F.col("disagreement") - floor).withColumn("excess_z", F.col("excess") / F.sqrt(F.lit(p * (1 - p)) / F.col("n")))
