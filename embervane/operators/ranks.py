"""Ordinal ranks of a whole table without a window over it: a range partitioning, places within partitions, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.session import staged


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """``df`` with the rank from 1 of each row in the order of ``by``, which should tell rows apart; nulls first."""
    s = staged(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__m", F.monotonically_increasing_id()), "ranks")
    per = s.groupBy(F.shiftright("__m", 33).alias("__p")).count().orderBy("__p").collect()  # a row for each partition
    offsets, upto = [], 0
    for r in per:
        offsets.append((r["__p"], upto))
        upto += r["count"]
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__p bigint, __o bigint")
    place = F.col("__m").bitwiseAND((1 << 33) - 1)
    return s.withColumn("__p", F.shiftright("__m", 33)).join(F.broadcast(table), "__p").withColumn(name, F.col("__o") + place + 1).drop("__m", "__p", "__o")


def rank_correlation(df: DataFrame, a: str, b: str, id: str = "id", by: str | None = None) -> DataFrame:
    """(by,) rho: Spearman's by ordinal ranks, ties by id; with ``by``, within each of its groups, whose ranks are those of the whole less a constant."""
    head = [by] if by else []
    r = ranked(ranked(df.select(*head, id, a, b), [*head, a, id], "ra"), [*head, b, id], "rb")
    return r.groupBy(*head).agg(F.corr(F.col("ra").cast("double"), F.col("rb").cast("double")).alias("rho"))
