"""A stored index of winnowed fingerprints: postings of spans, and how many texts hold each.

Two tables, both partitioned by day and bucketed by fingerprint, so that a lookup shuffles
what is looked up and never the index, and a day goes as a folder:

- postings (fp, span, pos, sign, day): +1 when a span is indexed, -1 when it is evicted; what
  counts is the sum. Rows are appended only, and `compact` writes a day's sums anew.
- observed (fp, texts, day): additive counts of the distinct texts of a day that hold a
  fingerprint.

A fingerprint that more than `cutoff` texts within retention hold is neither indexed nor found.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.sources.storage import make_folder, new_path, remove, small, staged

from .provenance import CUTOFF

BUCKETS = 32
COLUMNS = {"postings": "fp long, span long, pos int, sign int, day int", "observed": "fp long, texts long, day int"}


class Postings:
    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, cutoff: int = CUTOFF):
        """The index under a folder, made if it is not there. The number of buckets is fixed when it is made."""
        self.spark, self.buckets, self.cutoff = spark, buckets, cutoff
        self.path, self.names = path or new_path(spark, "postings"), {}
        for kind, columns in COLUMNS.items():
            name = self.names[kind] = f"wakeline_{kind}_{uuid.uuid4().hex}"
            spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (day) "
                f"CLUSTERED BY (fp) SORTED BY (fp) INTO {buckets} BUCKETS LOCATION '{self.path}/{kind}'"
            )
            make_folder(spark, f"{self.path}/{kind}")
            spark.sql(f"MSCK REPAIR TABLE {name}")

    def close(self) -> None:
        """Forget the tables; their files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        # A task holds one bucket, so each day gets a file for it.
        return rows.repartition(self.buckets, "fp")

    def _write(self, kind: str, rows: DataFrame) -> None:
        rows.select(*[c.split()[0] for c in COLUMNS[kind].split(", ")]).write.insertInto(self.names[kind])

    def _append(self, kind: str, rows: DataFrame) -> None:
        self._write(kind, self._bucketed(rows))

    def observe(self, prints: DataFrame) -> None:
        """Count the fingerprints (text, fp, day) of texts, each once a text: all is done where
        the buckets are, so that the prints are shuffled once."""
        held = self._bucketed(prints.select("text", "fp", "day")).distinct()
        self._write("observed", held.groupBy("fp", "day").agg(F.count("*").alias("texts")))

    def frequency(self, since: int) -> DataFrame:
        """(fp, texts) of the days from `since` on: no shuffle, as the table is bucketed."""
        return self.spark.table(self.names["observed"]).where(F.col("day") >= since).groupBy("fp").agg(F.sum("texts").alias("texts"))

    def frequent(self, since: int) -> DataFrame:
        return self.frequency(since).where(F.col("texts") > self.cutoff).select("fp")

    def add(self, prints: DataFrame, since: int) -> None:
        """Index the fingerprints (span, pos, fp, day) of spans, but those too frequent since."""
        kept = prints.join(self.frequent(since), "fp", "left_anti")
        self._append("postings", kept.select("fp", "span", "pos", "day").distinct().withColumn("sign", F.lit(1)))

    def live(self) -> DataFrame:
        """(fp, span, pos, day) of the postings not retracted."""
        rows = self.spark.table(self.names["postings"])
        return rows.groupBy("fp", "span", "pos", "day").agg(F.sum("sign").alias("_n")).where("_n > 0").drop("_n")

    def evict(self, spans: DataFrame) -> None:
        """Retract the postings of spans (span); a second time changes nothing."""
        gone = self.live().join(small(spans.select("span").distinct()), "span", "left_semi")
        held, path = staged(gone.withColumn("sign", F.lit(-1)), "retracted")
        self._append("postings", held)
        remove(self.spark, path)

    def expire(self, before: int) -> None:
        """Drop the days before one from both tables, with all their signs and counts."""
        for kind, name in self.names.items():
            days = [int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {name}").collect()]
            for day in sorted(d for d in days if d < before):
                self.spark.sql(f"ALTER TABLE {name} DROP PARTITION (day = {day})")
                remove(self.spark, f"{self.path}/{kind}/day={day}")

    def compact(self, day: int) -> None:
        """Write the sums of one day in place of its appended rows."""
        held, path = staged(self.live().where(F.col("day") == day).withColumn("sign", F.lit(1)), "compacted")
        name, kept = self.names["postings"], held.count()
        self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (day = {day})")
        remove(self.spark, f"{self.path}/postings/day={day}")
        if kept:
            self._append("postings", held)
        remove(self.spark, path)

    def lookup(self, prints: DataFrame, since: int) -> DataFrame:
        """Hits (fp, span, span_pos, *prints) of fingerprints (fp, pos, ...) on live postings,
        those too frequent since a day left out. Only what is looked up is shuffled."""
        found = self.live().join(self.frequent(since), "fp", "left_anti")
        return found.select("fp", "span", F.col("pos").alias("span_pos")).join(prints, "fp")
