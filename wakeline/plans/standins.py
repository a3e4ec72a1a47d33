"""Adapters: the supplied tables seen as the engine's own.

The exchange-shaped inputs do not exist there, so order lines stand for transmissions
between nations, events for accesses of users to the keys in their properties, and
documents for message bodies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.sources.storage import table

DAY = 86_400_000_000


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(transmission, from, to, route, channel, topic, at, bytes) from order lines."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_partkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("from"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("to"))
    # The two big tables meet on the order key; the others are as small as the planner finds them.
    return (
        line.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(s, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("transmission"),
            "from",
            "to",
            F.when(F.col("l_returnflag") == "R", "channel").otherwise("direct").alias("route"),
            (F.col("l_partkey") % 50).alias("channel"),
            F.col("o_orderpriority").alias("topic"),
            F.col("o_orderdate").alias("at"),
            F.col("l_quantity").cast("long").alias("bytes"),
        )
    )


CONTRIBUTIONS = """
contributions AS (
  SELECT l_orderkey * 8 + l_linenumber AS transmission, c_nationkey AS "from", s_nationkey AS "to",
         CASE WHEN l_returnflag = 'R' THEN 'channel' ELSE 'direct' END AS route, l_partkey % 50 AS channel,
         o_orderpriority AS topic, o_orderdate AS "at", l_quantity::BIGINT AS bytes
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey)
"""


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(access, agent, resource, op, at) from events; op is read, write or evidence."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "click", "evidence")
    rows = e.select(
        F.col("event_id").alias("access"),
        F.col("user_id").alias("agent"),
        F.get_json_object("props", "$.k").cast("long").alias("resource"),
        op.alias("op"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
    )
    return rows.where("op IS NOT NULL AND resource IS NOT NULL")


ACCESSES = """
accesses AS (
  SELECT event_id AS access, user_id AS agent, (props->>'$.k')::BIGINT AS resource,
         CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' ELSE 'evidence' END AS op,
         epoch_us(ts) AS "at"
  FROM events WHERE event_type IN ('view', 'purchase', 'click') AND props->>'$.k' IS NOT NULL)
"""


def aliases(spark: SparkSession) -> DataFrame:
    """A few agents merged into others."""
    return spark.createDataFrame([(k, k - 10) for k in range(20, 25)], "id int, canonical int")


ALIASES = "aliases AS (SELECT k AS id, k - 10 AS canonical FROM range(20, 25) t(k))"
