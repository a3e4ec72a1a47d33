"""Triage on a stream against the same on a table, for any cut of the stream."""

import random

import pytest
from pyspark.sql import functions as F

from wakeline.sources.storage import new_path
from wakeline.streaming import buckets, triage

MINUTE = 60_000_000
SCHEMA = "rule string, subject string, at long"


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_table(spark, tmp_path, files):
    rng = random.Random(5)
    rows = [(f"r{rng.randrange(3)}", f"s{rng.randrange(3)}", MINUTE * rng.randrange(1, 1000)) for _ in range(120)]
    # The last finding only moves the watermark past all others, twice so that it is seen.
    rows = sorted(rows, key=lambda r: r[2]) + [("r0", "end", MINUTE * 9000)]
    for i in range(files):
        part = rows[len(rows) * i // files : len(rows) * (i + 1) // files]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    rules = spark.createDataFrame([("r0", True), ("r1", False)], "rule string, evaluating boolean")
    rejected = spark.createDataFrame([("s1",)], "subject string")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = triage.triaged(stream.withColumn("ts", F.timestamp_micros("at")), rules, rejected, 20 * MINUTE)
    with buckets.disk_state(spark):
        got = triage.latest(buckets.run_once(found, f"t{files}", new_path(spark, "triage")))
    columns = ["rule", "subject", "outcome", "occurrences", "first_at", "last_at"]
    want = triage.sessions(spark.createDataFrame([r for r in rows if r[1] != "end"], SCHEMA), rules, rejected, 20 * MINUTE)
    lines = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert lines(want) and lines(got) == lines(want)
