"""Tumbling buckets on a stream, late rows set aside, and idempotent upserts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, at: str) -> DataFrame:
    """A table of Parquet files as a stream, its time column made a timestamp.

    Streams read folders: a table that is a single file is read as such from its folder.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8)
    if found.isFile():
        reader, path = reader.option("pathGlobFilter", p.getName()), p.getParent().toString()
    return reader.parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def tumbling(rows: DataFrame, at: str, width: str, keys: list[str], delay: str, **values) -> DataFrame:
    """Sums per bucket and key; buckets are final once the watermark has passed them."""
    found = rows.withWatermark(at, delay).groupBy(F.window(at, width).alias("_w"), *keys)
    return found.agg(*[v.alias(k) for k, v in values.items()]).select(F.col("_w.start").alias("bucket"), *keys, *values)


def split_late(batch: DataFrame, at: str, watermark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows of a batch against the stored watermark, one row with `mark`.

    Spark drops late rows silently; here they are kept aside instead.
    """
    marked = batch.crossJoin(F.broadcast(watermark))
    late = F.coalesce(F.col(at) < F.col("mark"), F.lit(False))
    return marked.where(~late).drop("mark"), marked.where(late).drop("mark")


def upsert(sums: DataFrame, more: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Stored sums with a batch's added."""
    both = sums.select(*keys, *values).unionByName(more.select(*keys, *values))
    return both.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """State variables and timers need the store that spills to disk; a query keeps the one it starts with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is there into Parquet beside the checkpoint, and read it."""
    out = f"{checkpoint}-{name}"
    query = (
        stream.writeStream.format("parquet").queryName(name).outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
