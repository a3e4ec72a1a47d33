"""Exactly-once buckets, the change feed and triage on a stream over the supplied events.

An event comes in the batch of its week, but one in ten comes two batches late. Every second
batch is applied twice, as after a failure.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.sources.storage import checkpoint, new_path, table
from wakeline.streaming import buckets, triage
from wakeline.streaming.ledger import BucketSums, ChangeFeed, Ledger

WEEK, DAY, DELAY = 7 * 86_400_000_000, 86_400_000_000, 3_600_000_000
SCHEMA = "event_id long, event_type string, at long, value double, arrives long"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    arrives = F.floor(at / WEEK) + F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("long"), "event_type", at.alias("at"), "value", arrives.alias("arrives"))


def _fed(rows: DataFrame, store: Ledger) -> None:
    """Batches in order; some are tried again."""
    for number in [r[0] for r in rows.select("arrives").distinct().orderBy("arrives").collect()]:
        for _ in range(1 + number % 2):
            store.apply(rows.where(F.col("arrives") == number), number)


def _buckets(spark: SparkSession, sf_dir: str) -> BucketSums:
    store = BucketSums(spark, new_path(spark, "bucket-sums"), "at", DAY, DELAY, ["event_type"], ["events"], f"{SCHEMA}, events long")
    _fed(_events(spark, sf_dir).withColumn("events", F.lit(1).cast("long")), store)
    return store


def bucket_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint(_buckets(spark, sf_dir).read())


EVENTS = f"""
e AS (SELECT event_id, event_type, epoch_us(ts) AS "at", value, epoch_us(ts) // {WEEK} + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END AS arrives FROM events),
marks AS (SELECT n.arrives, max(e."at") AS mark FROM (SELECT DISTINCT arrives FROM e) n LEFT JOIN e ON e.arrives < n.arrives GROUP BY n.arrives),
told AS (SELECT e.*, "at" - "at" % {DAY} AS bucket, coalesce("at" - "at" % {DAY} + {DAY} <= mark - {DELAY}, false) AS late FROM e JOIN marks USING (arrives))
"""
BUCKET_UPSERTS = f"WITH {EVENTS} SELECT bucket, event_type, count(*) AS events FROM told WHERE NOT late GROUP BY ALL"


def bucket_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoint(_buckets(spark, sf_dir).refused().select("event_id", "event_type", "at", "arrives"))


BUCKET_REFUSALS = f"""WITH {EVENTS} SELECT event_id, event_type, "at", arrives FROM told WHERE late"""


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes by number, as a reader that stopped half way and went on has them."""
    feed = ChangeFeed(spark, new_path(spark, "changes"), ["at", "event_id"], SCHEMA)
    _fed(_events(spark, sf_dir), feed)
    half = feed.last() // 2
    return checkpoint(feed.after(0, half).unionByName(feed.after(half)).select("seq", "event_id", "at"))


CHANGE_FEED = f"""WITH {EVENTS} SELECT row_number() OVER (ORDER BY arrives, "at", event_id) AS seq, event_id, "at" FROM e"""

TTL = 3 * DAY


def _findings(e: DataFrame) -> DataFrame:
    rule, subject = F.concat(F.lit("r"), (F.col("user_id") % 5).cast("string")), F.col("user_id").cast("string")
    return e.where("event_type = 'error'").select(rule.alias("rule"), subject.alias("subject"), F.unix_micros("ts").alias("at"), "ts")


def stream_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of error events by user on a stream, those that its watermark has passed."""
    rules = spark.createDataFrame([(f"r{i}", i != 3) for i in range(4)], "rule string, evaluating boolean")
    rejected = table(spark, sf_dir, "events").where("user_id % 7 = 0").select(F.col("user_id").cast("string").alias("subject"))
    stream = buckets.read_table(spark, f"{sf_dir}/events.parquet", "ts")
    found = triage.triaged(_findings(stream), rules, rejected, TTL, "10 minutes")
    with buckets.disk_state(spark):
        return triage.latest(buckets.run_once(found, f"wakeline_{uuid.uuid4().hex}", new_path(spark, "stream")))


STREAM_TRIAGE = f"""
WITH f AS (
  SELECT 'r' || user_id % 5 AS rule, user_id::VARCHAR AS subject, user_id, epoch_us(ts) AS t FROM events
  WHERE event_type = 'error' AND epoch_us(ts) < (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events WHERE event_type = 'error') - 600000000),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t) AS g FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {TTL} THEN 0 ELSE 1 END AS n FROM f))
SELECT rule, subject, min(t) AS first_at, CASE WHEN user_id % 5 IN (3, 4) THEN 'rule_inactive' WHEN user_id % 7 = 0 THEN 'operator_rejected' ELSE 'opened' END AS outcome,
  count(*) AS occurrences, max(t) AS last_at FROM s GROUP BY rule, subject, user_id, g"""

NAMES = ["bucket_upserts", "bucket_refusals", "change_feed", "stream_triage"]
QUERIES = {n: globals()[n] for n in NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in NAMES}
