"""An inverted-file index kept as a folder: centroids with radii, and rows of codes by cell."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embervane.functions.codec import Codec, encode, usable
from embervane.operators import knn
from embervane.session import staged


class InvertedFile:
    """``path/cells`` has (cell, centroid, radius, rows), ``path/rows`` (id, codes, cnorm, cell), sorted by cell within files, so that a scan of some cells skips the rest by the files' own statistics."""

    def __init__(self, spark: SparkSession, path: str, codec: Codec):
        self.spark, self.path, self.codec = spark, path.rstrip("/"), codec

    @classmethod
    def create(cls, df: DataFrame, path: str, codec: Codec, n_cells: int | None = None, rounds: int = 5, sample: int = 100_000, id: str = "vec_id", vec: str = "embedding") -> InvertedFile:
        """Cells are trained on at most ``sample`` rows, chosen by a hash of their ids; every row is indexed."""
        n = df.count()
        k = n_cells or max(1, round(n**0.5))
        some = df if n <= sample else df.orderBy(F.xxhash64(id)).limit(sample)
        cells = staged(knn.spherical_kmeans(some, min(k, n), rounds, codec.dim, id, vec), "trained")
        self = cls(df.sparkSession, path, codec)
        a = staged(knn.assign(df, cells, codec.dim, id, vec), "assigned")
        rows = encode(df, codec, id, vec).join(a.select("id", "cell"), "id").select("id", "codes", "cnorm", "cell")
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows.repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(f"{self.path}/rows")
        of = a.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
        cells.join(of, "cell", "left").select("cell", "centroid", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("rows", F.lit(0)).alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")
        return self

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def stats(self) -> DataFrame:
        """One row (rows, cells, least, most, mean, empty, radius_degrees)."""
        return self.cells().agg(F.sum("rows").alias("rows"), F.count("*").alias("cells"), F.min("rows").alias("least"), F.max("rows").alias("most"), F.avg("rows").alias("mean"), F.count(F.when(F.col("rows") == 0, 1)).alias("empty"), F.degrees(F.avg("radius")).alias("radius_degrees"))

    def _scan(self, probes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        codec = self.codec
        codes = knn._column("codes", codec.dim)
        base = lambda t: codec.rotated(codes(t).astype(np.int64)) * t.column("cnorm").to_numpy()[:, None]
        query = lambda t: codec.turn(knn._column("vec", codec.dim)(t))
        return knn.scan_cells(self.rows(), probes, queries, k, codec.dim, base_matrix=base, query_matrix=query)

    def _bounds(self, queries: DataFrame, radius_scale: float, id: str, vec: str) -> DataFrame:
        """(query, cell, bound, rank) of every query and cell: the best cosine that a row of the cell may have, with its radius times ``radius_scale``."""
        cells = self.cells().where("rows > 0")
        near = knn.nearest_cells(queries, cells, max(1, cells.count()), self.codec.dim, id, vec)
        angle = F.acos(F.least(F.greatest(F.col("score"), F.lit(-1.0)), F.lit(1.0)))
        b = near.join(F.broadcast(cells.select(F.col("cell").cast("bigint").alias("id"), "radius")), "id").select("query", F.col("id").cast("int").alias("cell"), F.cos(F.greatest(angle - radius_scale * F.col("radius"), F.lit(0.0))).alias("bound"))
        from pyspark.sql.window import Window

        return b.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "cell")) - 1)

    def search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None, first: int = 2, radius_scale: float = 0.5, originals: DataFrame | None = None, fetch: int = 4, id: str = "vec_id", vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
        """(hits, probes): (query, rank, id, score) and the (query, cell) that were scanned.

        With ``nprobe``, that many cells of best bound.  Without, the ``first`` of them, and then all whose bound is
        above the k-th score found; a ``radius_scale`` of 1 makes that the whole truth, less opens fewer cells.
        With ``originals`` the best ``fetch`` times k are ranked again by their vectors.
        """
        n = k * (fetch if originals is not None else 1)
        q = usable(queries, id, vec, self.codec.dim)
        b = staged(self._bounds(queries, radius_scale, id, vec), "bounds")
        probes = b.where(F.col("rank") < (nprobe or first)).select("query", "cell")
        hits = self._scan(probes, q, n)
        if nprobe is None:
            hits = staged(knn.best(hits, n), "first")
            kth = hits.groupBy("query").agg(F.when(F.count("*") >= n, F.min("score")).alias("kth"))
            more = b.where(F.col("rank") >= first).join(kth, "query", "left").where(F.col("kth").isNull() | (F.col("bound") > F.col("kth"))).select("query", "cell")
            hits = hits.select("query", "id", "score").union(self._scan(more, q, n))
            probes = probes.union(more)
        hits = knn.best(hits, n)
        if originals is not None:
            hits = knn.rerank(hits, originals, queries, k, self.codec.dim, id, vec)
        return hits, probes

    def scan_fraction(self, probes: DataFrame) -> DataFrame:
        """One row (cells_probed, rows_scanned, scan_fraction), means over queries."""
        cells = self.cells().select("cell", "rows")
        total = cells.agg(F.sum("rows").alias("n"))
        per = probes.join(F.broadcast(cells), "cell").groupBy("query").agg(F.count("*").alias("cells"), F.sum("rows").alias("scanned"))
        return per.crossJoin(total).agg(F.avg("cells").alias("cells_probed"), F.avg("scanned").alias("rows_scanned"), F.avg(F.col("scanned") / F.col("n")).alias("scan_fraction"))
