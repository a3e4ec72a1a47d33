"""Append-only logs and stores: blobs, exchanges, events, dead letters, exports, live feed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def put_blobs(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Content-addressed rows (hash, body), each content once."""
    return bodies.select(F.sha2(body, 256).alias("hash"), F.col(body).alias("body")).dropDuplicates(["hash"])


def get_blobs(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """Bodies of hashes; null where retention dropped them."""
    return wanted.join(blobs, "hash", "left")


def write_by_day(rows: DataFrame, path: str, at: str = "at") -> None:
    """Append to a table partitioned by date, so that time windows prune whole folders."""
    rows.withColumn("date", F.to_date(at)).repartition("date").write.mode("append").partitionBy("date").parquet(path)


def newest(rows: DataFrame, at: str, key: str, most: int) -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc(key)).limit(most)


def subscribed(events: DataFrame, subjects: list[str]) -> DataFrame:
    return events.where(F.col("subject").isin(subjects))


def deduplicated(envelopes: DataFrame, key: str = "id", at: str = "at") -> DataFrame:
    """Each envelope once: within the watermark on a stream, over the table in batch."""
    if envelopes.isStreaming:
        return envelopes.withWatermark(at, "10 minutes").dropDuplicatesWithinWatermark([key])
    return envelopes.dropDuplicates([key])


def derived_id(parent, label: str, ordinal) -> Column:
    """Id of an event that follows from another: the same on every replay."""
    return F.sha2(F.concat_ws("-", parent, F.lit(label), F.col(ordinal).cast("string") if isinstance(ordinal, str) else ordinal), 256)


def attempts(failures: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(retry, dead) from a log of failures (group, id, at, reason).

    Retries wait twice as long after each failure; those at `most` failures become dead letters.
    """
    n = failures.groupBy("group", "id").agg(F.count("*").alias("attempts"), F.max("at").alias("last_at"), F.max_by("reason", "at").alias("reason"))
    wait = F.pow(F.lit(2.0), F.col("attempts") - 1).cast("long")
    retry = n.where(F.col("attempts") < most).withColumn("retry_at", F.col("last_at") + wait * 1_000_000)
    return retry, n.where(F.col("attempts") >= most)


def replay(events: DataFrame, dead: DataFrame) -> DataFrame:
    """Events of dead letters, to be sent again."""
    return events.join(dead.select("id").distinct(), "id", "left_semi")


# Order of rows in an export of each data set.
EXPORT_ORDER = {
    "transmissions": ["opened_at", "transmission"],
    "edges": ["from", "to", "route"],
    "channels": ["created_at", "channel"],
    "agents": ["created_at", "agent"],
    "alerts": ["opened_at", "alert"],
    "assignments": ["version", "transmission"],
}


def export(rows: DataFrame, data_set: str, path: str, order: list[str] | None = None) -> dict:
    """Write rows in key order as JSON lines with header and trailer files; gives the trailer.

    Rows are range-partitioned and sorted, so the files in name order are in key order.
    The digest is taken per file and then over the files' digests, so no task sees all rows.
    """
    spark = rows.sparkSession
    keys = order or EXPORT_ORDER[data_set]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").json(f"{path}/rows")
    header = {"data_set": data_set, "columns": rows.columns, "order": keys}
    trailer = seal(spark, path) | {"complete": True}
    spark.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    spark.createDataFrame([(json.dumps(trailer),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/trailer")
    return trailer


def seal(spark: SparkSession, path: str) -> dict:
    """Row count and digest of exported rows: one digest per file goes to the driver."""
    lines = spark.read.text(f"{path}/rows").select("value", F.col("_metadata.file_name").alias("file"))
    per = lines.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("d")).orderBy("file").collect()
    return {"rows": sum(r["n"] for r in per), "digest": hashlib.sha256("\n".join(str(r["d"]) for r in per).encode()).hexdigest()}


def changes(notes: DataFrame, after: int) -> DataFrame:
    """Live feed of ids after a cursor, in order. notes: (seq, kind, id)."""
    return notes.where(F.col("seq") > after).orderBy("seq")
