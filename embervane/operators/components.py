"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embervane.session import discard, staged

#: Edges that the driver joins itself at most, 16 bytes each; more of them take rounds of distributed joins.
SMALL = 1 << 20


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node of its component.

    Every round is two hash aggregations and two equi-joins over the edges, staged in the shared
    folder; the number of rounds is about the logarithm of the longest path.  Null ends and loops
    are ignored, so a node that has only loops isn't returned; repeated edges count once; no edges
    give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = staged(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if e.count() <= SMALL:
        return _small(e)
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = staged(small, "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _small(e: DataFrame) -> DataFrame:
    """connected_components() of at most ``SMALL`` distinct edges (u, v), u > v."""
    got = e.toArrow()
    discard(e)
    nodes, ends = np.unique(np.concatenate([got.column("u").to_numpy(), got.column("v").to_numpy()]), return_inverse=True)
    i, j = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        x, y = root[i], root[j]
        differ = x != y
        if not differ.any():
            break
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (root[root] != root).any():
            root = root[root]
    import pyarrow as pa

    table = pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(nodes[root], pa.int64())})
    return e.sparkSession.createDataFrame(table) if len(nodes) else e.sparkSession.createDataFrame([], "node bigint, root bigint")
