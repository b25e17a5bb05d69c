"""A compressed index as a folder of Parquet segments: create, add, delete, compact, search, statistics.

Every change appends a segment, rows or tombstones, and then a log entry that lists all segments; it is written
beside and renamed into place, so a job that dies leaves the last version whole, and no change rewrites old rows.
A row is live where no tombstone of its id is later than it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embervane.functions.codec import Codec, encode
from embervane.operators.knn import adc_topk, rerank

#: What a log entry says of the layout; migrate() takes older ones to it.
LAYOUT = 2


class Log:
    """JSON entries of a folder, numbered; the last whole one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def last(self) -> tuple[int, dict] | None:
        fs, folder = self._at(".")
        if not fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        if not numbers:
            return None
        fs, where = self._at(f"{numbers[-1]:08d}.json")
        stream = fs.open(where)
        try:
            return numbers[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, number: int, entry: dict) -> None:
        fs, part = self._at(f"{number:08d}.{uuid.uuid4().hex}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        _, where = self._at(f"{number:08d}.json")
        if fs.exists(where) or not fs.rename(part, where):
            fs.delete(part, False)
            raise RuntimeError(f"{self.path} was changed by another job")


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path.rstrip("/"), Log(spark, path)
        last = self.log.last()
        if last is None:
            raise FileNotFoundError(f"no index at {path}")
        self.version, entry = last
        self.codec, self.segments, self.layout = Codec(**entry["codec"]), entry["segments"], entry.get("layout", 1)

    @classmethod
    def create(cls, df: DataFrame, path: str, codec: Codec, id: str = "vec_id", vec: str = "embedding") -> VectorIndex:
        """An index of the rows with id and whole vector, one for each id; what was at ``path`` is no longer part of it."""
        self = cls.__new__(cls)
        self.spark, self.path, self.codec, self.log, self.segments, self.layout = df.sparkSession, path.rstrip("/"), codec, Log(df.sparkSession, path), [], LAYOUT
        last = self.log.last()
        self.version = last[0] if last else 0
        self._commit(rows=encode(df, codec, id, vec).dropDuplicates(["id"]))
        return self

    def _commit(self, rows: DataFrame | None = None, tombstones: DataFrame | None = None, only: bool = False) -> None:
        seq = self.version + 1
        segments = [] if only else list(self.segments)
        for kind, df in (("tombstones", tombstones), ("rows", rows)):
            if df is not None:
                name = f"{kind}-{seq:08d}-{uuid.uuid4().hex[:8]}"
                df.write.parquet(f"{self.path}/{name}")
                segments.append({"name": name, "kind": kind, "seq": seq})
        self.log.write(seq, {"codec": {"dim": self.codec.dim, "bits": self.codec.bits, "seed": self.codec.seed, "family": self.codec.family}, "segments": segments, "layout": LAYOUT})
        self.version, self.segments, self.layout = seq, segments, LAYOUT

    def _read(self, kind: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, seq bigint")
        for s in self.segments:
            if s["kind"] == kind:
                out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{s['name']}").withColumn("seq", F.lit(s["seq"]).cast("bigint")))
        return out

    def rows(self) -> DataFrame:
        """(id, codes, cnorm, vrnorm, seq, tomb) of all rows, deleted ones too."""
        gone = self._read("tombstones", "id bigint").groupBy("id").agg(F.max("seq").alias("gone"))
        r = self._read("rows", "id bigint, codes array<tinyint>, cnorm double, vrnorm double").join(gone, "id", "left")
        return r.withColumn("tomb", F.coalesce(F.col("gone") > F.col("seq"), F.lit(False)).cast("int")).drop("gone")

    def live(self) -> DataFrame:
        return self.rows().where("tomb = 0").drop("tomb", "seq")

    def add(self, df: DataFrame, id: str = "vec_id", vec: str = "embedding", upsert: bool = False) -> None:
        """Appends rows; ids that are live already are an error, or replaced by an upsert."""
        new = encode(df, self.codec, id, vec).dropDuplicates(["id"])
        if upsert:
            self._commit(rows=new, tombstones=new.select("id"))
            return
        if not new.select("id").join(self.live().select("id"), "id", "left_semi").isEmpty():
            raise ValueError("ids are in the index already")
        self._commit(rows=new)

    def delete(self, ids: DataFrame, id: str = "id") -> None:
        """Marks rows as deleted; unknown ids are ignored."""
        self._commit(tombstones=ids.select(F.col(id).cast("bigint").alias("id")).where("id IS NOT NULL").distinct())

    def compact(self) -> None:
        """One segment of the live rows; older ones stay for readers of older versions until vacuum()."""
        self._commit(rows=self.live(), only=True)

    def migrate(self) -> int:
        """Takes the log to the present layout; an index of a later one is an error."""
        if self.layout > LAYOUT:
            raise ValueError(f"layout {self.layout} is later than {LAYOUT}")
        if self.layout < LAYOUT:
            self._commit()
        return self.layout

    def vacuum(self) -> int:
        """Removes the segments that the last version doesn't name; the number of them."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs, named, gone = where.getFileSystem(self.spark._jsc.hadoopConfiguration()), {s["name"] for s in self.segments}, 0
        for s in fs.listStatus(where):
            name = s.getPath().getName()
            if name.split("-")[0] in ("rows", "tombstones") and name not in named:
                fs.delete(s.getPath(), True)
                gone += 1
        return gone

    def search(self, queries: DataFrame, k: int = 10, fetch: int = 1, originals: DataFrame | None = None, **columns) -> DataFrame:
        hits = adc_topk(self.live(), queries, self.codec, k * (fetch if originals is not None else 1), **columns)
        return hits if originals is None else rerank(hits, originals, queries, k, self.codec.dim)

    def stats(self) -> DataFrame:
        """One row (rows, live, tombstones, bytes_per_row, ratio) against float vectors."""
        per = self.codec.dim * self.codec.bits / 8 + 4
        return self.rows().agg(F.count("*").alias("rows"), F.coalesce(F.sum(1 - F.col("tomb")), F.lit(0)).alias("live"), F.coalesce(F.sum("tomb"), F.lit(0)).cast("bigint").alias("tombstones")).withColumn("bytes_per_row", F.lit(per)).withColumn("ratio", F.lit(self.codec.dim * 4 / per))

    def info(self) -> dict:
        """What the log says, without reading rows."""
        return {"version": self.version, "layout": self.layout, "dim": self.codec.dim, "bits": self.codec.bits, "segments": len(self.segments), "path": self.path}
