"""What the review of the fourth round found, on the smallest tables that show it."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wakeline.operators import flow
from wakeline.operators import provenance as P
from wakeline.operators.postings import Postings
from wakeline.plans import index_queries
from wakeline.streaming import buckets, correlator

from .test_operators import MINUTE, START, _stream


def test_a_block_of_identities_is_one_state():
    """what is known of a hundred identities is read and written once, not once for each."""
    calls, held = [], []

    def told(name, value=None):
        calls.append(name)
        return value

    one = correlator.Correlator(flow.Timing(evidence=1000, suspect=1000), {"read": "long"})
    one.handle = SimpleNamespace(registerTimer=lambda ms: calls.append("timer"))
    one.waiting = SimpleNamespace(appendValue=held.append, get=lambda: told("waiting.get", iter(held)), clear=lambda: calls.append("waiting.clear"))
    one.known = SimpleNamespace(get=lambda: told("known.get"), update=lambda value: told("known.update", held.append(value)))
    assert list(one.handleInputRows((0,), iter([Row(read=k, kind="read", at=k) for k in range(100)]), None)) == []
    assert calls == ["timer"] and len(held) == 1
    out = list(one.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10), None))
    assert calls == ["timer", "waiting.get", "known.get", "waiting.clear", "known.update", "timer"]
    assert {(r["read"], r["update"], r["at"]) for r in out} == {(k, u, k + at) for k in range(100) for u, at in (("opened", 0), ("suspected", 1000), ("discarded", 2000))}
    assert sorted(held[1][0]) == list(range(100))


def test_blocks_agree_with_batch(spark, tmp_path):
    """identities that share a state, some without a number, in batches of any cut."""
    rng, events = random.Random(6), []
    for k in [*range(60), None]:
        at = rng.randrange(0, 200)
        events.append((k, "read", at))
        events += [(k, "evidence", at + rng.choice((0, 1, 2, 3, 20, 32, 33, 60, 90))) for _ in range(rng.randrange(4))]
    events.append((99, "read", 400))
    rows = spark.createDataFrame([(k, kind, START + m * MINUTE) for k, kind, m in events], "k long, kind string, at long")
    stream = _stream(spark, rows, ((0, 30), (30, 35), (35, 120), (120, 401)), str(tmp_path / "in"))
    with buckets.disk_state(spark):
        got = buckets.run_once(correlator.correlated(stream, ["k"], flow.Timing(), block=F.floor(F.col("k") / 16)), "blocks", str(tmp_path / "check"))
    batch = flow.correlations(rows.where("kind = 'read'").drop("kind"), rows.where("kind = 'evidence'").drop("kind"), ["k"], F.lit(START + 399 * MINUTE), flow.Timing())
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


@pytest.mark.parametrize("most", [0, P.BROADCAST_GRAMS])
def test_prints_that_are_asked_for(spark, sf_dir, tmp_path, most):
    """the same rows as all prints joined with those asked for, whether these are broadcast or not."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    spark.createDataFrame([(None, None), (None, "x"), (-1, "é" * 60)], "doc_id long, text string").write.parquet(f"{tmp_path}/odd")
    # Read back, as a table of unknown size is cut into very many tasks.
    odd = docs.select("doc_id", "text").unionByName(spark.read.parquet(f"{tmp_path}/odd"))
    asked = P.winnowed(items, "item_id", "text", portable=True).select("fp").unionByName(spark.createDataFrame([(None,)], "fp long"))
    every = P.winnowed(odd, "doc_id", "text", portable=True)
    want = sorted(map(tuple, every.join(asked.distinct(), "fp", "left_semi").select("doc_id", "pos", "fp").collect()), key=repr)
    assert want and sorted(map(tuple, P.winnowed_among(odd, "doc_id", "text", asked, most).collect()), key=repr) == want
    assert P.winnowed_among(odd, "doc_id", "text", asked.where("fp < 0"), most).count() == 0


@pytest.mark.parametrize("name", ["postings_lookup", "postings_frequency"])
def test_prints_that_no_span_has_are_not_stored(spark, sf_dir, monkeypatch, name):
    """what is stored and sent follows the prints that items and documents share."""
    told, observe = [], Postings.observe
    monkeypatch.setattr(Postings, "observe", lambda index, prints: told.append(prints.count()) or observe(index, prints))
    index_queries.QUERIES[name](spark, sf_dir)
    docs, items = (P.winnowed(spark.read.parquet(f"{sf_dir}/{t}.parquet"), k, "text", portable=True) for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert told == [docs.join(items.select("fp").distinct(), "fp", "left_semi").count()] and told[0] < docs.count() / 10


def test_prints_are_shuffled_once(spark):
    """a text is counted where the bucket is."""
    rows = spark.createDataFrame([(t, t % 7, t % 3) for t in range(90)] * 2, "text long, fp long, day int")
    index, sent = Postings(spark, buckets=4), []
    index._write = lambda kind, counted: sent.append(counted)
    index.observe(rows)
    index.close()
    assert sum(r["texts"] for r in sent[0].collect()) == 90
    assert sent[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") == 1
