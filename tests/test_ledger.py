"""Stores that take each batch of a stream once."""

import pytest
from pyspark.sql import functions as F

from wakeline.sources.storage import new_path
from wakeline.streaming.ledger import BucketSums, ChangeFeed

SCHEMA = "at long, k string, n long"
BATCHES = [[(1, "a", 1), (12, "a", 2), (25, "b", 3)], [(3, "a", 4), (26, "b", 5), (19, "a", 6)], [], [(41, "b", 7), (24, "b", 8)]]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sums(store):
    return sorted((r["bucket"], r["k"], r["n"]) for r in store.read().collect())


def test_batches_tried_again_change_nothing(spark):
    store = BucketSums(spark, new_path(spark, "t"), "at", 10, 5, ["k"], ["n"], SCHEMA)
    assert sums(store) == []
    for number, rows in enumerate(BATCHES):
        store.apply(frame(spark, rows), number)
        store.apply(frame(spark, rows), number)
    # The mark after the first batch is 25: buckets that end by 20 are closed.
    assert sums(store) == [(0, "a", 1), (10, "a", 2), (20, "b", 16), (40, "b", 7)]
    assert sorted(r["at"] for r in store.refused().collect()) == [3, 19]
    before = sums(store)
    store.compact()
    store.compact()
    assert sums(store) == before
    store.apply(frame(spark, [(45, "b", 1), (29, "b", 1)]), 4)
    assert sums(store) == [*before[:-1], (40, "b", 8)] and store.refused().count() == 3


def test_what_failed_before_its_line_is_not_read(spark, monkeypatch):
    store = BucketSums(spark, new_path(spark, "t"), "at", 10, 5, ["k"], ["n"], SCHEMA)
    store.apply(frame(spark, BATCHES[0]), 0)
    before = sums(store)
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.apply(frame(spark, BATCHES[1]), 1)
        with pytest.raises(OSError):
            store.compact()
    assert sums(store) == before
    store.apply(frame(spark, BATCHES[1]), 1)
    assert sum(n for _, _, n in sums(store)) == 1 + 2 + 3 + 5


def test_a_stream_fills_the_store(spark, tmp_path):
    for i, rows in enumerate(BATCHES):
        frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    store = BucketSums(spark, f"{tmp_path}/store", "at", 10, 5, ["k"], ["n"], SCHEMA)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for _ in range(2):  # started again, it has nothing left to do
        stream.writeStream.foreachBatch(store.sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    total = sum(n for _, _, n in sums(store)) + (store.refused().agg(F.sum("n")).first()[0] or 0)
    assert total == sum(n for rows in BATCHES for _, _, n in rows)


def test_readers_with_different_cursors_meet(spark):
    feed = ChangeFeed(spark, new_path(spark, "t"), ["at"], SCHEMA)
    assert feed.last() == 0 and feed.after(0).count() == 0
    got = {0: [], 1: []}
    for number, rows in enumerate(BATCHES):
        feed.apply(frame(spark, rows).repartition(3), number)
        feed.apply(frame(spark, rows), number)
        if number % 2:  # the second reader wakes rarely, and takes two at a time
            while more := feed.after(len(got[1]), 2).collect():
                got[1] += more
        got[0] += feed.after(len(got[0])).collect()
    assert [r["seq"] for r in got[0]] == list(range(1, 9)) and got[0] == got[1]
    assert [r["at"] for r in got[0]] == [1, 12, 25, 3, 19, 26, 24, 41]
    feed.drop(4)
    assert feed.resync(0) and feed.resync(2) and not feed.resync(3) and not feed.resync(8)
    assert [r["seq"] for r in feed.after(5).collect()] == [6, 7, 8] and feed.last() == 8
    with pytest.raises(LookupError):
        feed.after(1)
    feed.apply(frame(spark, [(50, "c", 1)]), 9)
    assert [r["seq"] for r in feed.after(8).collect()] == [9]
