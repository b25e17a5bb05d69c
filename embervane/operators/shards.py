"""A sharded index: rows of codes in shards by ranges of ids, a manifest, cells, and which server must be asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embervane.functions.codec import Codec, encode, usable
from embervane.operators import knn
from embervane.operators.index import Log

ROWS = "id bigint, codes array<tinyint>, cnorm double, vrnorm double"


class ShardedIndex:
    """``path/shard=n`` has the rows of a shard; the log's last entry is the manifest: codec, and rows and least and greatest id of each shard."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), Log(spark, path)
        last = self.log.last()
        if last is None:
            raise FileNotFoundError(f"no manifest at {path}")
        self.version, self.manifest = last
        self.codec = Codec(**self.manifest["codec"])

    @classmethod
    def create(cls, df: DataFrame, path: str, codec: Codec, shard_rows: int = 1_000_000, id: str = "vec_id", vec: str = "embedding") -> ShardedIndex:
        """Shards of about ``shard_rows`` rows, ranges of ids, all written by one job."""
        rows = encode(df, codec, id, vec).dropDuplicates(["id"])
        n = max(1, -(-df.count() // shard_rows))
        rows.repartitionByRange(n, "id").withColumn("shard", F.spark_partition_id()).write.mode("overwrite").partitionBy("shard").parquet(f"{path.rstrip('/')}/rows")
        return cls.finalize(df.sparkSession, path, codec)

    @classmethod
    def write_shard(cls, df: DataFrame, path: str, shard: int, codec: Codec, id: str = "vec_id", vec: str = "embedding") -> None:
        """One shard, whole or not at all; written again it replaces itself, so a build may be resumed."""
        encode(df, codec, id, vec).dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{path.rstrip('/')}/rows/shard={shard}")

    @classmethod
    def create_streaming(cls, stream: DataFrame, path: str, codec: Codec, checkpoint: str, id: str = "vec_id", vec: str = "embedding") -> ShardedIndex:
        """A shard for each micro-batch of a stream of vectors; a batch that is run again writes its shard again."""

        def one(batch: DataFrame, number: int) -> None:
            cls.write_shard(batch, path, number, codec, id, vec)

        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start().awaitTermination()
        return cls.finalize(stream.sparkSession, path, codec)

    @classmethod
    def finalize(cls, spark: SparkSession, path: str, codec: Codec) -> ShardedIndex:
        """Writes the manifest of the shards that are there: a row for each."""
        rows = spark.read.schema(f"{ROWS}, shard int").parquet(f"{path.rstrip('/')}/rows")
        shards = [r.asDict() for r in rows.groupBy("shard").agg(F.count("*").alias("rows"), F.min("id").alias("id_min"), F.max("id").alias("id_max")).orderBy("id_min", "shard").collect()]
        log = Log(spark, path)
        last = log.last()
        log.write((last[0] if last else 0) + 1, {"codec": {"dim": codec.dim, "bits": codec.bits, "seed": codec.seed, "family": codec.family}, "shards": shards})
        return cls(spark, path)

    def rows(self, shards: list[int] | None = None) -> DataFrame:
        r = self.spark.read.schema(f"{ROWS}, shard int").parquet(f"{self.path}/rows")
        return r if shards is None else r.where(F.col("shard").isin(shards))

    def missing(self, expected: int) -> list[int]:
        """The shards of 0 to ``expected`` - 1 that the manifest hasn't, to be written by a resumed build."""
        return sorted(set(range(expected)) - {s["shard"] for s in self.manifest["shards"]})

    def stats(self) -> dict:
        return {"shards": len(self.manifest["shards"]), "rows": sum(s["rows"] for s in self.manifest["shards"])}

    def search(self, queries: DataFrame, k: int = 10, shards: list[int] | None = None, **columns) -> DataFrame:
        """(query, rank, id, score) of all shards or some; shards that aren't named aren't read."""
        return knn.adc_topk(self.rows(shards).drop("shard"), queries, self.codec, k, **columns)

    def build_cells(self, df: DataFrame, cells: DataFrame, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
        """(shard, cell, rows, radius): which cells each shard holds, written beside the shards; ``df`` has the vectors."""
        a = knn.assign(df, cells, self.codec.dim, id, vec).join(self.rows().select("id", "shard"), "id")
        a.groupBy("shard", "cell").agg(F.count("*").alias("rows"), F.max("angle").alias("radius")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")
        return self.spark.read.parquet(f"{self.path}/cells")

    def routed(self, queries: DataFrame, cells: DataFrame, nprobe: int, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
        """(query, shard): the shards that hold one of each query's nprobe nearest cells."""
        held = self.spark.read.parquet(f"{self.path}/cells").where("rows > 0").select(F.col("cell").cast("bigint").alias("id"), "shard")
        return knn.nearest_cells(queries, cells, nprobe, self.codec.dim, id, vec).join(held, "id").select("query", "shard").distinct()

    def search_routed(self, queries: DataFrame, cells: DataFrame, k: int = 10, nprobe: int = 4, exclude_self: bool = False, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
        """(query, rank, id, score): each query meets the rows of its routed shards alone."""
        import numpy as np

        codec, q = self.codec, usable(queries, id, vec, self.codec.dim)
        codes = knn._column("codes", codec.dim)
        base = lambda t: codec.rotated(codes(t).astype(np.int64)) * t.column("cnorm").to_numpy()[:, None]
        turned = lambda t: codec.turn(knn._column("vec", codec.dim)(t))
        probes = self.routed(queries, cells, nprobe, id, vec).select("query", F.col("shard").alias("cell"))
        rows = self.rows().select("id", "codes", "cnorm", F.col("shard").alias("cell"))
        return knn.best(knn.scan_cells(rows, probes, q, k, codec.dim, exclude_self, base_matrix=base, query_matrix=turned), k)


def placed(manifest: dict, servers: int) -> dict[int, list[int]]:
    """The shards of each server, dealt in turn."""
    out: dict[int, list[int]] = {s: [] for s in range(servers)}
    for k, shard in enumerate(manifest["shards"]):
        out[k % servers].append(shard["shard"])
    return out


def servers_for(routed: DataFrame, placement: dict[int, list[int]]) -> DataFrame:
    """(query, server) from (query, shard): the servers that must be asked."""
    where = [(shard, server) for server, shards in placement.items() for shard in shards]
    table = routed.sparkSession.createDataFrame(where, "shard int, server int")
    return routed.join(F.broadcast(table), "shard").select("query", "server").distinct()


def scatter_gather(index: ShardedIndex, queries: DataFrame, k: int, placement: dict[int, list[int]], **columns) -> DataFrame:
    """The k best of the servers' own searches: the same as one search of all shards."""
    return knn.merge([index.search(queries, k, shards, **columns) for shards in placement.values() if shards], k)
