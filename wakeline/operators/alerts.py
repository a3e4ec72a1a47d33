"""Alert rules and their triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.vectors import cosine
from wakeline.sources.storage import small

from .flow import policy_verdict

ACTIVE = ("open", "acknowledged")


def _raised(rows: DataFrame, rule: str, subject: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"), "at")


def new_channel(channels: DataFrame) -> DataFrame:
    return _raised(channels.where("origin = 'discovered'"), "new_channel", "channel")


def policy_traffic(traffic: DataFrame) -> DataFrame:
    """Traffic on channels without review, or not sanctioned."""
    return traffic.withColumn("rule", policy_verdict()).where("rule IS NOT NULL").select("rule", F.col("channel").cast("string").alias("subject"), "at")


def sanctioned_unused(channels: DataFrame) -> DataFrame:
    return _raised(channels.where("policy = 'sanctioned' AND detection IN ('unused', 'dormant')"), "sanctioned_unused", "channel")


def suspected(transmissions: DataFrame) -> DataFrame:
    return _raised(transmissions.where("state = 'suspected'"), "suspected_transmission", "transmission")


def watched_topic(transmissions: DataFrame, watched: DataFrame) -> DataFrame:
    """watched: (topic), chosen by users and so few."""
    return _raised(transmissions.join(small(watched), "topic", "left_semi"), "watched_topic", "transmission")


def semantic_query(docs: DataFrame, query: list[float], least: float) -> DataFrame:
    near = cosine("vector", F.array(*[F.lit(float(v)) for v in query])) >= least
    return _raised(docs.where(near), "semantic_query", "transmission")


def evaluated(*raised: DataFrame) -> DataFrame:
    """All rules' findings together."""
    out = raised[0]
    for more in raised[1:]:
        out = out.unionByName(more)
    return out


def triage(raised: DataFrame, rules: DataFrame, rejected: DataFrame, active: DataFrame) -> DataFrame:
    """Findings by (rule, subject): what becomes of them, with occurrences and times.

    In order: rule_inactive if the rule is missing or not evaluating; operator_rejected if
    the subject was judged false; deduplicated if an alert is active; else opened.
    rules: (rule, evaluating); rejected: (subject); active: (rule, subject, state).
    """
    n = raised.groupBy("rule", "subject").agg(F.count("*").alias("occurrences"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    seen = (
        n.join(rules.select("rule", "evaluating"), "rule", "left")
        .join(rejected.select("subject", F.lit(True).alias("_false")).distinct(), "subject", "left")
        .join(active.where(F.col("state").isin(*ACTIVE)).select("rule", "subject", F.lit(True).alias("_active")).distinct(), ["rule", "subject"], "left")
    )
    outcome = (
        F.when(~F.coalesce("evaluating", F.lit(False)), "rule_inactive")
        .when(F.col("_false"), "operator_rejected")
        .when(F.col("_active"), "deduplicated")
        .otherwise("opened")
    )
    return seen.select("rule", "subject", "occurrences", "first_at", "last_at", outcome.alias("outcome"))


def suppressed(alerts: DataFrame, sanctioned: DataFrame, disabled: DataFrame, rejected: DataFrame) -> DataFrame:
    """Alerts with states after channels were sanctioned, rules disabled, or subjects judged false."""
    hit = (
        alerts.join(sanctioned.select(F.col("channel").cast("string").alias("subject"), F.lit(True).alias("_c")).distinct(), "subject", "left")
        .join(disabled.select("rule", F.lit(True).alias("_r")).distinct(), "rule", "left")
        .join(rejected.select("subject", F.lit(True).alias("_f")).distinct(), "subject", "left")
    )
    off = F.coalesce("_c", "_r", "_f", F.lit(False)) & F.col("state").isin(*ACTIVE)
    return hit.withColumn("state", F.when(off, "suppressed").otherwise(F.col("state"))).drop("_c", "_r", "_f")


def may_resolve(state: Column) -> Column:
    return state == "acknowledged"
