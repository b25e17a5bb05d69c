"""Session helpers: worker imports and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver found it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset on one machine, as in tests, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="embervane-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at.rstrip("/")


def staging_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the driver ends, for results may be read until then."""
    at = f"{shared_dir(spark)}/embervane-{spark.sparkContext.applicationId}"
    if at not in _STAGING:
        _STAGING.add(at)
        atexit.register(_removed, spark._jvm, spark._jsc.hadoopConfiguration(), at)
    return at


_STAGING: set[str] = set()


def _removed(jvm, conf, path: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001 - the JVM may have gone before: then the folder stays
        pass


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and rereads it: the plan is cut, and what is read back survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a staged table that nothing needs any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not path.split(":")[-1].lstrip("/").startswith(root.split(":")[-1].lstrip("/")):
            raise ValueError(f"{path} isn't a staged table")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that are staged and done with, which it else does whenever the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()
