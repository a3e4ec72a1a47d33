"""What the review of the third round found, on the smallest tables that show it."""

import datetime
import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wakeline.functions import decode, text
from wakeline.operators import flow, identity
from wakeline.plans import action_queries, graph_queries
from wakeline.sources import storage


def largest_node(df, metric="numOutputRows"):
    """Most rows that a node of the executed plan put out, or shuffled."""
    df.collect()
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
            continue
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            nodes.append(node.plan())
        found = node.metrics().get(metric)
        most = max(most, found.get().value() if found.isDefined() else 0)
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return most


def test_resolution_does_not_pair_exchanges_with_holders(spark):
    """an account that all hold brings two rows, not one for each exchange and holder."""
    one = F.lit("account").alias("kind"), F.lit("v").alias("value")
    found = identity.resolution(spark.range(100).select(F.col("id").alias("exchange"), *one), spark.range(100).select(F.col("id").alias("agent"), *one))
    assert largest_node(found) < 1000
    assert {(r["agent"], r["outcome"]) for r in found.collect()} == {(0, "merge")}


def test_unmerge_names_a_merge_of_other_agents(spark, tmp_path):
    """an unmerge reverts its merge whichever agent of the user it names."""
    pick = random.Random(1)
    rows = [(n, pick.randrange(60), "view") for n in range(700)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    expected = {tuple(r) for r in con.execute(f"SELECT seq, action, subject, outcome, after FROM ({action_queries.AGENT_ACTIONS})").fetchall()}
    found = action_queries.agent_actions(spark, str(tmp_path)).select("seq", "action", "subject", "outcome", "after")
    assert {tuple(r) for r in found.collect()} == expected


@pytest.fixture(scope="module")
def one_key(spark, tmp_path_factory):
    """Writes of a hundred users and later reads of a hundred others, all of one key within a day."""
    path, start = str(tmp_path_factory.mktemp("one_key")), datetime.datetime(2024, 1, 1, 1)
    rows = [(n, start + datetime.timedelta(minutes=n), n, "purchase" if n < 100 else "view", '{"k": 1}') for n in range(200)]
    rows += [(n + 200, start + datetime.timedelta(minutes=n + 2), n, "click", '{"k": 1}') for n in range(150, 160)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string").write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name, rows", [("correlator_updates", 30_000), ("first_delivery", 10_000), ("transmission_states", 10_000), ("channel_listing", 1)])
def test_pairs_are_not_shuffled(spark, one_key, name, rows):
    """F4, F7, F8, F9: 200 accesses make 10,000 pairs, of which none is sent on."""
    found = graph_queries.QUERIES[name](spark, one_key)
    assert largest_node(found, "shuffleRecordsWritten") < 2000
    assert 1 <= found.count() <= rows


def test_pairs_of_a_resource_come_together(spark):
    """few reads are not broadcast to writes in order of time, whose pairs change resource with each write."""
    at = lambda late: f"{flow.DAY} + (id + {late}) * 1000 AS "
    writes = spark.range(200).selectExpr("id AS write", "id AS writer", "id % 10 AS resource", at(0) + "write_at")
    reads = spark.range(200).selectExpr("id AS read", "id + 200 AS reader", "id % 10 AS resource", at(200) + "read_at")
    parts = flow.co_access(writes, reads, flow.DAY).select("resource", "write", "read").rdd.glom().collect()
    assert sum(len(p) for p in parts) == 10 * 20 * 20
    by_write = {}
    for part in parts:
        resources = [r["resource"] for r in part]
        assert sum(a != b for a, b in itertools.pairwise(resources)) == max(0, len(set(resources)) - 1)
        for r in part:
            by_write.setdefault((r["resource"], r["write"]), []).append(r["read"])
    assert len(by_write) == 200 and len({(k[0], *v) for k, v in by_write.items()}) == 10


@pytest.mark.parametrize("window, slots", [(10, 8), (40, 8), (3, 8), (17, 4), (10, 1)])
def test_slots_lose_no_pair(spark, window, slots):
    """also where the window is no multiple of the slots."""
    writes = spark.range(60).selectExpr("id AS write", "id % 7 AS writer", "id % 2 AS resource", "id AS write_at")
    reads = spark.range(60).selectExpr("id AS read", "id % 5 AS reader", "id % 2 AS resource", "id AS read_at")
    found = [tuple(r) for r in flow.co_access(writes, reads, window, slots).select("write", "read", "lag").collect()]
    expected = [(w, r, r - w) for w in range(60) for r in range(w + 1, min(60, w + window + 1)) if w % 2 == r % 2 and w % 7 != r % 5]
    assert sorted(found) == expected


def test_stream_holds_a_state_for_a_read(spark, one_key):
    """the writers before a read share its state."""
    rows = graph_queries._correlator_events(spark, one_key)
    assert rows.where("kind = 'read'").count() == 100


def test_transmissions_cut_anywhere(monkeypatch):
    """F8, F9: batches and portions of any size give the same transmissions."""
    pick = np.random.default_rng(3)
    rows = pd.DataFrame({"resource": pick.integers(0, 3, 400), "_kind": pick.integers(0, 2, 400), "agent": pick.integers(0, 9, 400), "at": pick.integers(0, 300, 400)})
    rows = rows.assign(_block=0, evidence_at=rows["at"]).sort_values(["resource", "_block", "_kind", "agent", "at"])
    expected: dict[tuple, list[int]] = {}
    for w in rows[rows["_kind"] == 0].itertuples():
        for r in rows[rows["_kind"] == 1].itertuples():
            if w.resource == r.resource and w.agent != r.agent and 0 < r.at - w.at <= 40:
                expected.setdefault((r.agent, w.agent, r.resource), []).append(r.at)
    expected = {(*k, min(v), len(v), min(v)) for k, v in expected.items()}
    for batch, held, block in ((400, 1 << 20, 1 << 14), (7, 5, 3), (1, 1, 0)):
        monkeypatch.setattr(flow, "HELD_PAIRS", held)
        monkeypatch.setattr(flow, "BLOCK_READS", block)
        out = pd.concat(flow._opened((rows[i : i + batch] for i in range(0, 400, batch)), 40))
        assert len(out) == len(expected) and {tuple(r) for r in out.itertuples(index=False)} == expected


def test_one_row_group_is_dealt_out(spark, tmp_path, monkeypatch):
    """an input above the bound in one row group does not stay one task."""
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    monkeypatch.setattr(storage, "SPREAD_BYTES", 1)
    filled = storage.spread_out(spark.read.parquet(f"{tmp_path}/one")).select(F.spark_partition_id()).distinct().count()
    assert filled > 1


@pytest.mark.parametrize("value", ["", "a" * 31, "plain " * 4000, "é" * 60, "日本語 " * 40, "😀" * 40 + "x" * 60, "b\ud800c" * 30])
def test_hashes_by_blocks(value, monkeypatch):
    """grams of a block are digested together, with the digests of MD5, and none alone."""
    import hashlib

    alone, md5 = [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda x: alone.append(len(x)) or md5(x))
    places = range(max(0, len(value) - 31))
    found = text.portable_hashes(value, places, 32)
    assert all(n > 55 for n in alone)
    assert found.tolist() == [int(md5(value[i : i + 32].encode("utf-8", "surrogatepass")).hexdigest()[:15], 16) for i in places]


def test_channels_are_not_broadcast(spark):
    """only the few patterns are, not what was found for every resource."""
    rows = spark.range(100).selectExpr("concat('https://h/', id) AS url", "id AS resource")
    patterns = spark.createDataFrame([("a", "host", "h")], "channel string, kind string, pattern string")
    found = flow.channel_of(rows, patterns, rows.selectExpr("resource", "concat('found-', resource) AS channel"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("BroadcastExchange") == 1


def test_yaml_texts_come_in_small_batches(spark):
    """F16: a worker holds few long texts at once, and a text without escapes as one piece."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = spark.createDataFrame([("plain" * 10,), ("a\\tb\\\\c",), ("bad\\q",), ("end\\",), (None,), ("",)], "v string")
    found = [r[0] for r in rows.coalesce(1).select(decode.yaml_unescape("v")).collect()]
    assert found == ["plain" * 10, "a\tb\\c", None, None, None, ""]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500


def test_a_worker_remembers_a_bounded_number_of_pieces():
    from wakeline.llm import align
    from wakeline.llm.token_files import Encoder

    path = align.paths()[0]
    small, large = Encoder(path, cache=100), Encoder(path)
    for k in range(1000):
        text = f" the word{'abcdefghij'[k % 10] * (k // 10)} the"
        assert small.encode(text) == large.encode(text)
        assert len(small.known) + len(small.known.old) <= 104
    assert align.Tokenizers(*align.paths()).a.cache == align.PIECES_HELD < 1 << 19


def test_units_whose_bytes_are_not_given_back_are_told_apart():
    from wakeline.llm import align

    both = align.Tokenizers(*align.paths())
    # The piece vocabulary has no U+2581 of its own, as it writes a space so.
    units = [" a", " a▁b", " ﬁne", " plain", " café", " ▁"]
    n_a, n_b, ids_a, ids_b, same = both.flat(units)
    assert same.any() and not same.all()
    for k, unit in enumerate(units):
        assert both.flat([unit])[4].tolist() == [same[k]]
    assert n_a.sum() == len(ids_a) and n_b.sum() == len(ids_b)


def test_the_pipelines_workers_remember_fewer_pieces(spark, monkeypatch):
    import corpus_pipeline
    from wakeline.llm import token_files

    asked, encoded = [], token_files.encoded
    monkeypatch.setattr(token_files, "encoded", lambda *a: asked.append(a[3]) or encoded(*a))
    docs = spark.createDataFrame([(1, "some words of a text"), (2, None)], "doc_id long, text string")
    assert corpus_pipeline.token_stage(spark, docs, "").count() == 2
    assert asked == [corpus_pipeline.PIECES_HELD] and asked[0] < token_files.CACHE


def test_triage_sends_rows_and_asks_for_a_state_once():
    from types import SimpleNamespace

    from pyspark.sql import Row

    from wakeline.streaming.triage import Triage

    calls, held = [], []

    def told(name, value):
        calls.append(name)
        return value

    one = Triage(10)
    one.handle = SimpleNamespace(registerTimer=lambda ms: calls.append("timer"))
    one.waiting = SimpleNamespace(appendList=held.extend, get=lambda: told("waiting.get", iter(held)), clear=lambda: calls.append("waiting.clear"))
    one.known = SimpleNamespace(get=lambda: told("known.get", None), clear=lambda: calls.append("known.clear"))
    assert list(one.handleInputRows(("r", "s"), iter([Row(at=5, verdict=None), Row(at=4, verdict=None)]), None)) == []
    out = list(one.handleExpiredTimer(("r", "s"), SimpleNamespace(getCurrentWatermarkInMs=lambda: 1000), None))
    assert [tuple(r) for r in out] == [("r", "s", 1, "opened", 2, 4, 5, 5)]
    assert calls == ["timer", "waiting.get", "known.get", "waiting.clear", "known.clear"]


def test_what_was_shuffled_for_a_staged_table_is_dropped(spark, monkeypatch):
    from wakeline.llm import align

    name, asked, written = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], align.written
    monkeypatch.setattr(align, "written", lambda df, to: asked.append(spark.conf.get(name)) or written(df, to))
    before = spark.conf.get(name, "false")
    docs = spark.createDataFrame([(1, "some words"), (2, "some words")], "doc_id long, text string")
    assert align.align(docs).count() == 2
    assert asked == ["true"] * 4 and spark.conf.get(name) == before
