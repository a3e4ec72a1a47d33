"""Helpers shared by the operators: shared storage, Arrow batches, the word rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.sources.storage import checkpoint, new_path, remove, shared_dir, staged, table

__all__ = ["WORD", "arrow_rows", "as_longs", "as_texts", "checkpoint", "new_path", "remove", "shared_dir", "staged", "table", "word_count"]

# Word rule shared by the quality, near-duplicate and mixing operators.
WORD = r"[^\x20\x09-\x0D]+"


def arrow_rows(spark: SparkSession, rows: int = 500) -> None:
    """Long texts: keep Arrow batches small, so that a Python worker holds few texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def as_texts(df: DataFrame, *cols: str) -> DataFrame:
    """Long columns as decimal text for pandas, which makes floats of longs beside a null."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def as_longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def word_count(text) -> Column:
    """Words of a text column as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
