"""Streams: event-time aggregates with late data, and a count-based rolling monitor with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windows(events: DataFrame, width: str = "1 hour", late: str = "1 day", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(start, key, n, mean) of tumbling windows; on a stream, rows later than ``late`` are dropped.  Null times go."""
    e = events.where(F.col(ts).isNotNull())
    if e.isStreaming:
        e = e.withWatermark(ts, late)
    return e.groupBy(F.window(ts, width).alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")


def rolling_monitor(values: DataFrame, key: str, order: str, value: str, window: int = 1000, floor: float | None = None) -> DataFrame:
    """(key, seen, n, mean, least, p5, alert) after every micro-batch, from the last ``window`` values of each key; the state holds no more."""

    def f(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = state.get if state.exists else (0, [])
        new = pd.concat(list(frames)).dropna(subset=[value]).sort_values(order)[value].tolist()
        last = (list(last) + new)[-window:]
        state.update((seen + len(new), last))
        if last:
            x = np.array(last)
            yield pd.DataFrame({key: [k[0]], "seen": [seen + len(new)], "n": [len(x)], "mean": [x.mean()], "least": [x.min()], "p5": [np.percentile(x, 5)], "alert": [bool(floor is not None and x.mean() < floor)]})

    kind = values.schema[key].dataType.simpleString()
    return values.select(key, order, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandasWithState(f, f"{key} {kind}, seen bigint, n bigint, mean double, least double, p5 double, alert boolean", "seen bigint, last array<double>", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, exactly once, into a Parquet table of the shared folder, and reads that."""
    import uuid

    from embervane.session import staging_dir

    spark = stream.sparkSession
    at = f"{staging_dir(spark)}/{label}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/data").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/data")


def with_quality(pairs: DataFrame, original: str = "original", reconstructed: str = "reconstructed") -> DataFrame:
    """``pairs`` with cosine, of two vectors, 0 where either is 0, and tangential, the share of their displacement that isn't radial, null where they are equal."""
    from embervane.functions.vector import cosine, tangential_fraction

    a, b = F.col(original), F.col(reconstructed)
    return pairs.withColumn("cosine", cosine(a, b)).withColumn("tangential", tangential_fraction(a, b))


def quality_stats(pairs: DataFrame, key: str, order: str, window: int | None = 1000, floor: float = 0.95, tangential_floor: float = 0.0, drift: bool = True) -> DataFrame:
    """(key, n_total, n_window, mean, least, deviation, p05, median_tangential, drifted, healthy) of the last ``window`` rows (key, order, cosine, tangential) of each key, or of all with None.

    A key drifts where the earlier and the later half of its window differ by a Kolmogorov-Smirnov test; it is
    healthy where the mean is at the floor and the median tangential share at its own.  Without ``drift`` there is no such column.
    """
    from pyspark.sql.window import Window

    from embervane.operators.stats import ks_halves

    own = pairs.where(F.col("cosine").isNotNull() & F.col(key).isNotNull())
    last = own
    if window is not None:
        last = own.withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__at") <= window)
    s = last.groupBy(key).agg(F.count("*").alias("n_window"), F.avg("cosine").alias("mean"), F.min("cosine").alias("least"), F.stddev_pop("cosine").alias("deviation"), F.percentile("cosine", F.lit(0.05)).alias("p05"), F.percentile("tangential", F.lit(0.5)).alias("median_tangential"))
    if window is None:
        s = s.select(key, F.col("n_window").alias("n_total"), *s.columns[1:])
    else:
        s = own.groupBy(key).agg(F.count("*").alias("n_total")).join(s, key)
    if drift:
        s = s.join(ks_halves(last, key, order, "cosine").select(key, "drifted"), key, "left").withColumn("drifted", F.coalesce("drifted", F.lit(False)))
    healthy = (F.col("mean") >= floor) & F.coalesce(F.col("median_tangential") >= tangential_floor, F.lit(True))
    return s.withColumn("healthy", healthy)


def metrics(stats: DataFrame, key: str) -> DataFrame:
    """(key, name, value): quality_stats() as gauges."""
    names = ["mean", "least", "deviation", "p05", "n_total", "median_tangential", "drifted", "healthy"]
    gauges = [F.struct(F.lit(f"embervane_quality_{n}").alias("name"), F.col(n).cast("double").alias("value")) for n in names]
    return stats.select(key, F.explode(F.array(*gauges)).alias("g")).select(key, "g.name", "g.value")


def alerts(stats: DataFrame, key: str, floor: float = 0.95, tangential_floor: float = 0.0) -> DataFrame:
    """(key, reason) of what is wrong."""
    reasons = F.array(F.when(F.col("mean") < floor, F.lit("mean under the floor")), F.when(F.col("median_tangential") < tangential_floor, F.lit("displacements are radial")), F.when(F.col("drifted"), F.lit("drift")))
    return stats.select(key, F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason"))


def store(puts: DataFrame, key: str, at: str, ttl: str, now) -> DataFrame:
    """The live entries of a cache with time to live: of each key the last put, unless it is older than ``ttl`` (seconds, null for ever) at ``now``."""
    last = puts.groupBy(key).agg(F.max_by(F.struct(*puts.columns), at).alias("r")).select("r.*")
    return last.where(F.col(ttl).isNull() | (F.col(at).cast("timestamp") + F.make_dt_interval(secs=F.col(ttl)) > F.lit(now).cast("timestamp")))


def looked_up(requests: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """``requests`` with hit and what the cache has of their key; a miss has nulls."""
    return requests.join(live.withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def hit_counts(found: DataFrame) -> DataFrame:
    """One row (requests, hits, misses, hit_rate)."""
    return found.agg(F.count("*").alias("requests"), F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"), F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("hit_rate"))
