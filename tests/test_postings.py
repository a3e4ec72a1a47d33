"""The stored postings index against an index rebuilt from what is live, the named grams
against all grams, and the sweep against places one by one."""

import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import provenance as P
from wakeline.operators.postings import Postings
from wakeline.plans import text_queries


def prints(spark, rows, *names):
    return spark.createDataFrame(rows, ", ".join(f"{n} long" if n in ("fp", "span", "text") else f"{n} int" for n in names))


def hits(index, asked, since):
    return sorted(tuple(r) for r in index.lookup(asked, since).select("fp", "span", "span_pos", "pos").collect())


def test_index_equals_one_rebuilt_from_the_live_spans(spark):
    rng = random.Random(2)
    spans = sorted({(rng.randrange(30), rng.randrange(9), s, s % 5) for s in range(40) for _ in range(6)})
    seen = sorted({(t, rng.randrange(30), t % 5) for t in range(60) for _ in range(3)})
    asked = prints(spark, [(f, 7) for f in range(30)], "fp", "pos")
    index = Postings(spark, buckets=4, cutoff=5)
    try:
        index.observe(prints(spark, seen, "text", "fp", "day"))
        index.add(prints(spark, spans, "fp", "pos", "span", "day"), 0)
        for _ in range(2):  # a second retraction changes nothing
            index.evict(prints(spark, [(s,) for s in range(0, 40, 3)], "span"))
        index.compact(4)
        index.expire(2)
        often = lambda since: {f for f in range(30) if len({t for t, g, d in seen if g == f and d >= since}) > 5}
        want = sorted((f, s, p, 7) for f, p, s, d in spans if f not in often(0) | often(2) and s % 3 and d >= 2)
        assert want and hits(index, asked, 2) == want
        assert {r["fp"]: r["texts"] for r in index.frequency(2).collect()} == {
            f: n for f in range(30) if (n := len({t for t, g, d in seen if g == f and d >= 2}))
        }
        # Opened again, it is the same; an index anew over the live spans gives the same hits.
        again, anew = Postings(spark, index.path, buckets=4, cutoff=5), Postings(spark, buckets=4, cutoff=5)
        assert hits(again, asked, 2) == want
        anew.observe(prints(spark, [x for x in seen if x[2] >= 2], "text", "fp", "day"))
        anew.add(again.live(), 2)
        assert hits(anew, asked, 2) == want
        again.close()
        anew.close()
    finally:
        index.close()


def test_lookup_shuffles_what_is_looked_up_and_not_the_index(spark):
    index = Postings(spark, buckets=4)
    try:
        index.add(prints(spark, [(f, 0, 1, 1) for f in range(50)], "fp", "pos", "span", "day"), 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = index.lookup(prints(spark, [(3, 1)], "fp", "pos"), 0)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        index.close()


def test_empty_index_finds_nothing(spark):
    index = Postings(spark, buckets=2)
    index.expire(9)
    index.evict(prints(spark, [(1,)], "span"))
    assert hits(index, prints(spark, [(1, 1)], "fp", "pos"), 0) == []
    index.close()


def test_names_go_with_grams():
    text = "the quick brown fox jumps over the lazy dog and runs away from the brown fox jumps over the lazy dog again " * 2
    names = P.gram_names(text, 32)
    assert len(names) == len(text) - 31 and len(P.gram_names("short", 32)) == 0
    by = {}
    for i, n in enumerate(names.tolist()):
        assert by.setdefault(text[i : i + 32], n) == n
    assert len(set(names.tolist())) < len(by) / 3


def test_shared_grams_beyond_the_bound_equal_those_within(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (None, "x"), (-1, "é" * 60)], "doc_id long, text string"))
    near, far = (P.shared_grams(odd, "doc_id", "text", items, "text", most=m) for m in (P.BROADCAST_GRAMS, 0))
    rows = [sorted(tuple(r) for r in x.collect()) for x in (near, far)]
    assert rows[0] and rows[0] == rows[1]


@pytest.fixture
def no_broadcast_of_grams(monkeypatch):
    real = P.shared_grams
    monkeypatch.setattr(P, "shared_grams", lambda *a: real(*a, most=0))


def test_copied_runs_without_the_broadcast(spark, sf_dir, no_broadcast_of_grams, request):
    far = sorted(tuple(r) for r in text_queries.copied_runs(spark, sf_dir).collect())
    request.getfixturevalue("monkeypatch").undo()
    assert far and far == sorted(tuple(r) for r in text_queries.copied_runs(spark, sf_dir).collect())


def test_owner_of_every_place(spark):
    rng = random.Random(7)
    runs = [(t, rng.randrange(6), a, a + rng.randrange(0, 25)) for t in range(8) for _ in range(rng.randrange(1, 14)) for a in [rng.randrange(60)]]
    df = spark.createDataFrame([*runs, (None, 1, 0, 5)], "text long, input long, start long, end long")
    want = []
    for t in range(8):
        of = {}
        for _, i, a, b in (r for r in runs if r[0] == t):
            for p in range(a, b):
                of[p] = min(i, of.get(p, i))
        for p in sorted(of):
            if want and want[-1][0] == t and want[-1][1] == of[p] and want[-1][3] == p:
                want[-1] = (*want[-1][:3], p + 1)
            else:
                want.append((t, of[p], p, p + 1))
    assert sorted(tuple(r) for r in P.owned(df.repartition(3)).collect()) == sorted(want)
    assert P.owned(df.where(F.lit(False))).count() == 0
