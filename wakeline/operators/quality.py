"""How good the detection is, from operators' verdicts and from known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_verdicts(log: DataFrame) -> DataFrame:
    """Newest revision of each transmission's verdict."""
    return log.groupBy("transmission").agg(F.max_by("verdict", "revision").alias("verdict"))


def strongest_match(found: DataFrame) -> DataFrame:
    """Best class of each transmission's matches (lowest rank) and its first carrier."""
    return found.groupBy("transmission").agg(
        F.min("class_rank").alias("class_rank"), F.min_by("carrier", F.struct("class_rank", "ordinal")).alias("carrier"), F.sum("matched_bytes").alias("matched_bytes")
    )


def detection_quality(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts of genuine, false and unjudged detections per key."""
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("verdict") == "genuine").alias("genuine"),
        F.count_if(F.col("verdict") == "false").alias("false"),
        F.count_if(F.col("verdict").isNull()).alias("unlabelled"),
    )


def scores(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row: hits, misses, false positives, recall and precision."""
    t = truth.select(*keys).distinct().withColumn("_t", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    counted = t.join(p, keys, "full_outer").agg(
        F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("hits"),
        F.count_if(F.col("_p").isNull()).alias("misses"),
        F.count_if(F.col("_t").isNull()).alias("false_positives"),
    )
    return counted.withColumns(
        {
            "recall": F.col("hits") / F.nullif(F.col("hits") + F.col("misses"), F.lit(0)),
            "precision": F.col("hits") / F.nullif(F.col("hits") + F.col("false_positives"), F.lit(0)),
        }
    )
