"""Shared storage: cutting lineage and staging tables where every executor can read them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Input that a task gets at most, where rows are dealt out evenly.
SPREAD_BYTES = 1 << 25


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="wakeline-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_out(df: DataFrame) -> DataFrame:
    """Before costly work on each row: deal the input to all cores, as a file of any size may
    be a single row group, which is one task however it is split."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(max(tasks, int(str(size)) // SPREAD_BYTES), 100 * tasks))


#: One short row each: what operators enter, or a batch of ids.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """The side of a join, to be broadcast if its rows were counted and are few."""
    if df.isStreaming or df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return df
    return F.broadcast(df)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in shared storage, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def make_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session is gone by now
        pass


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in shared storage and read it back; also gives the path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
