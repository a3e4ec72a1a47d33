"""Operators that the table queries do not reach, on small rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from wakeline.functions import decode, jsons, text, times, urls
from wakeline.operators import alerts, extraction, filters, flow, governance, identity, paging, provenance, quality, topology
from wakeline.sources import exchanges, logs


def one(spark, column, *values, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_text(spark):
    assert one(spark, text.normalize("v"), " A  \tB ", None) == [" a b ", None]
    assert one(spark, text.wiki_title("v"), "main_page ") == ["Main page"]
    s = "añ😀b" * 400
    (got,) = one(spark, text.shingles("v", 5), s)
    assert [g["gram"] for g in got] == [s[i : i + 5] for i in range(len(s) - 4)] and [g["pos"] for g in got] == list(range(len(s) - 4))
    assert one(spark, text.shingles("v", 5), "abc", "", None) == [[], [], []]
    assert one(spark, text.text_score(["a", "b", "a"], F.split("v", " ")), "a c", "a b") == [0.5, 1.0]


def test_excerpt_cuts_on_characters(spark):
    (r,) = one(spark, text.excerpt(F.col("v"), F.lit(4), F.lit(6), 1), "aéééé😀b")
    assert r["text"] in "aéééé😀b" and "é" in r["text"] and r["elided_before"] + len(r["text"].encode()) + r["elided_after"] == len("aéééé😀b".encode())


@pytest.mark.parametrize(
    "given, want",
    [
        ("HTTP://User@Example.COM:80/a%2fb?z=1&a=2#x", "http://example.com/a%2Fb?a=2&z=1"),
        ("https://h:443", "https://h/"),
        ("https://h:8443/x", "https://h:8443/x"),
        ("nothing", None),
    ],
)
def test_canonical_urls(spark, given, want):
    assert one(spark, urls.canonical("v"), given) == [want]


def test_paths_and_repositories(spark):
    assert one(spark, urls.lexical_path("v"), "/a/./b/../c//d", "../x/..", "a/..", "/..") == ["/a/c/d", "..", ".", "/"]
    assert one(spark, urls.joined_path(F.lit("/w"), "v"), "x/../y", "/z") == ["/w/y", "/z"]
    same = ["git@github.com:Owner/Name.git", "https://github.com/owner/name/", "ssh://git@github.com/owner/name.git"]
    assert one(spark, urls.repository("v"), *same) == ["github.com/owner/name"] * 3
    assert one(spark, urls.with_scheme("v"), "example.com/x", "notes.md", "http://a") == ["https://example.com/x", "notes.md", "http://a"]
    assert one(spark, urls.prefix_of_segments("v", "/a/b"), "/a/b", "/a/b/c", "/a/bc") == [True, True, False]


def test_decoding(spark):
    assert one(spark, decode.base64_layers("v"), "x aGVsbG8gd29ybGQgYWdhaW4= y", "/////////////////w==") == [["hello world again"], []]
    assert one(spark, decode.hex_layers("v"), "68656c6c6f20776f726c64") == [["hello world"]]
    assert one(spark, decode.url_layers("v"), "a hello%20there b") == [["hello there"]]
    assert one(spark, decode.json_layers("v"), '{"k": "one\\ntwo three four"}') == [["one\ntwo three four"]]
    assert one(spark, decode.fold_unicode("v"), "pа​ss") == ["pass"]
    assert one(spark, decode.compatibility("v"), "ﬁ") == ["fi"]
    assert one(spark, decode.yaml_unescape("v"), "a\\tb\\x41\\u00e9", "bad\\q") == ["a\tbAé", None]
    df = spark.createDataFrame([(1, "aGVsbG8lMjB3b3JsZCUyMGFnYWlu")], "id int, t string")
    found = {tuple(r["chain"]): r["text"] for r in decode.layers(df, "id", "t").collect()}
    assert found[("base64",)] == "hello%20world%20again" and found[("base64", "url")] == "hello world again"


def test_canonical_json(spark):
    assert one(spark, jsons.canonical_json("v"), '{"b": 1.0, "a": [1e2, 0.10, 12345678901234567890123]}', "{") == [
        '{"a":[100,0.1,1.2345678901234567890123e+22],"b":1}',
        None,
    ]
    assert one(spark, jsons.pointer("v", "/a/0/x"), '{"a": [{"x": "y"}]}') == ["y"]


def test_times(spark):
    assert one(spark, times.align_down("v", 10), 19, -1, schema="v long") == [10, -10]
    assert one(spark, times.deadline("v", 5), 1, (1 << 63) - 2, schema="v long") == [6, (1 << 63) - 1]
    assert times.check_grid(0, 100, 20, 10) == 5
    for bad in ((0, 100, 30, 10), (5, 100, 10, 10), (0, 10**9, 10, 10), (1, 1, 1, 1)):
        with pytest.raises(ValueError):
            times.check_grid(*bad)


def test_filters(spark):
    rows = spark.createDataFrame([("a", "b", "c1", "channel", "t1", None), ("x", "y", "c2", "direct", "t2", "false")], "from string, to string, channel string, route string, topic string, verdict string")
    count = lambda f: rows.where(f.admits(verdict="verdict")).count()
    assert count(filters.TopologyFilter()) == 2
    assert count(filters.TopologyFilter(agents=("b",))) == 1
    assert count(filters.TopologyFilter(hide_false=True)) == 1
    assert count(filters.TopologyFilter(topics=("t2",), route_kinds=("channel",))) == 0
    versions = spark.createDataFrame([(1, "active"), (2, "fitting")], "version int, state string")
    assert filters.resolve_version(versions) == 1
    with pytest.raises(filters.VersionError):
        filters.resolve_version(versions, 2)
    filters.require("governor", "govern")
    with pytest.raises(PermissionError):
        filters.require("viewer", "operate")


def test_cursors_are_bound_to_requests():
    c = paging.cursor((3, "x"), {"q": 1}, b"k")
    assert paging.from_cursor(c, {"q": 1}, b"k") == (3, "x")
    for request, key in (({"q": 2}, b"k"), ({"q": 1}, b"other")):
        with pytest.raises(ValueError):
            paging.from_cursor(c, request, key)


def test_pages_meet_without_gaps(spark):
    rows = spark.range(25).select((F.col("id") % 4).alias("a"), "id")
    seen, after = [], None
    while page := paging.page(rows, ["a", "id"], 7, after).collect():
        seen += [tuple(r) for r in page]
        after = seen[-1]
    assert seen == sorted(((i % 4, i) for i in range(25)), reverse=True)


def test_topology(spark):
    rows = spark.createDataFrame([(1, 2, "direct", 5), (3, 1, "direct", 7), (1, 3, "direct", 1)], "from long, to long, route string, bytes long")
    alias = spark.createDataFrame([(3, 1)], "id long, canonical long")
    kept = topology.admitted(rows, alias).withColumn("transmissions", F.lit(1))
    assert [tuple(r) for r in topology.edges(kept, ["from", "to"]).collect()] == [(1, 2, 1, 5, 1.0)]
    nodes = topology.with_ancestors(topology.nodes(kept), spark.createDataFrame([(2, 9), (9, 8)], "agent long, parent long"))
    assert {r["agent"]: r["received"] for r in nodes.collect()} == {1: 0, 2: 1, 9: 0, 8: 0}
    versions = spark.createDataFrame([(1, True, False), (2, True, False), (3, False, True), (4, True, False), (5, False, False)], "version int, activated boolean, pinned boolean")
    assert {r["version"] for r in topology.kept_versions(versions, 2).collect()} == {2, 3, 4, 5}


def test_provenance(spark):
    runs = spark.createDataFrame([("t", 1, 0, 10), ("t", 0, 5, 12)], "text string, input int, start long, end long")
    length = spark.createDataFrame([("t", 20)], "text string, length long")
    grams = spark.createDataFrame([("t", p, p) for p in range(20)], "text string, pos long, fp long")
    spans = provenance.classified_spans(grams, runs, length, spark.createDataFrame([(p,) for p in range(12, 20)], "fp long"))
    assert sorted((r["start"], r["end"], r["kind"], r["input"]) for r in spans.collect()) == [(0, 5, "relayed", "1"), (5, 12, "relayed", "0"), (12, 20, "common", None)]
    found = spark.createDataFrame([("l", "a", 0, 100, False), ("l", "b", 10, 20, False), ("l", "c", 90, 120, False), ("l", "d", 5, 9, True)], "layer string, agent string, start int, end int, rare boolean")
    assert [r["agent"] for r in provenance.shadowed(found).collect()] == ["b"]


def test_identity(spark):
    held = spark.createDataFrame([(1, "account", "x"), (2, "account", "x"), (3, "account", "x"), (4, "prompt_fingerprint", "p"), (4, "account", "z")], "agent long, kind string, value string")
    veto = spark.createDataFrame([(1, 3)], "a long, b long")
    assert {r["id"]: r["canonical"] for r in identity.merged_by_evidence(held, veto).collect()} == {2: 1}
    seen = spark.createDataFrame([("e1", "account", "x"), ("e2", "account", "z"), ("e3", "account", "new"), ("e4", "prompt_fingerprint", "p")], "exchange string, kind string, value string")
    assert {r["exchange"]: r["outcome"] for r in identity.resolution(seen, held).collect()} == {"e1": "merge", "e2": "known", "e3": "new", "e4": "known"}
    assert [r["agent"] for r in identity.established(held).collect()] == [4]
    merges = spark.createDataFrame([("a", "b", False), ("b", "c", False), ("x", "y", True)], "source string, target string, reverted boolean")
    assert {r["id"]: r["canonical"] for r in identity.alias_map(merges).collect()} == {"a": "c", "b": "c"}


def test_flow(spark):
    channels = spark.createDataFrame([("c1", "discovered", "http://h/a/x"), ("c2", "discovered", "http://h/a/y"), ("c3", "discovered", "http://h/b")], "channel string, origin string, url string")
    none = spark.createDataFrame([], "kind string, pattern string")
    moved = {r["channel"]: r["new_origin"] for r in flow.promotion(channels, "c1", "path_prefix", "/a").collect()}
    assert moved == {"c1": "declared", "c2": "superseded", "c3": "discovered"}
    assert flow.promotion_check(channels, none, "c1", "path_prefix", "/a") is None
    assert flow.promotion_check(channels, none, "c9", "path_prefix", "/a") == "unknown channel"
    assert flow.promotion_check(channels, none, "c3", "path_prefix", "/a") == "pattern does not hold the channel"
    taken = spark.createDataFrame([("path_prefix", "/a/x")], "kind string, pattern string")
    assert flow.promotion_check(channels, taken, "c1", "path_prefix", "/a") == "pattern overlaps another"
    kin = flow.kinship(spark.createDataFrame([("a", "b"), ("a", "c")], "from string, to string"), spark.createDataFrame([("b", "a")], "agent string, parent string"))
    assert {r["to"]: r["kin"] for r in kin.collect()} == {"b": True, "c": False}


def test_extraction(spark):
    calls = spark.createDataFrame(
        [
            (1, "Read", '{"file_path": "/a/../b.txt"}'),
            (2, "str_replace_editor", '{"command": "create", "path": "n.md"}'),
            (3, "WebFetch", '{"url": "Example.com/x"}'),
            (4, "http_request", '{"url": "https://h/p", "method": "post"}'),
            (5, "mcp__wiki__edit", '{"title": "Main page"}'),
            (6, "Bash", '{"command": "cat a.txt > b.txt && curl -d x https://h/q; git push origin"}'),
            (7, "unknown", "{}"),
        ],
        "call long, tool string, args string",
    )
    found = extraction.identified(calls)
    assert {r["call"] for r in found.collect()} == {1, 2, 3, 4, 5, 6}
    assert {tuple(r) for r in extraction.file_accesses(found).collect()} == {(1, "read", "file:/b.txt"), (2, "write", "file:/n.md")}
    assert {tuple(r) for r in extraction.fetch_accesses(found).collect()} == {(3, "read", "https://example.com/x"), (4, "write", "https://h/p")}
    rules = spark.createDataFrame([("wiki", "edit", "write", "title")], "server string, mcp_tool string, op string, key string")
    assert [tuple(r) for r in extraction.mcp_accesses(found, rules).collect()] == [(5, "write", "mcp:wiki:Main page")]
    steps = {(r["op"], r["kind"], r["target"]) for r in extraction.shell_accesses(found).collect()}
    assert steps == {("write", "file", "b.txt"), ("write", "url", "https://h/q")}
    said = spark.createDataFrame(
        [("success", "git_push", "error: failed to push"), ("success", "http", "HTTP/1.1 404"), ("error", None, ""), (None, None, None), ("success", None, "ok")],
        "status string, command string, text string",
    )
    assert [r[0] for r in said.select(extraction.outcome()).collect()] == ["rejected", "rejected", "rejected", "unknown", "delivered"]


def test_streams_of_events_and_messages(spark):
    body = "﻿event: a\r\ndata: one\r\ndata: two\r\n\r\n: note\n\ndata:x\n\ndata: unfinished"
    rows = exchanges.sse_events(spark.createDataFrame([(1, body)], "k int, body string"), "k", "body").orderBy("seq").collect()
    assert [(r["event"], r["data"]) for r in rows] == [("a", "one\ntwo"), (None, "x")]
    deltas = spark.createDataFrame([(1, 0, 2, "c"), (1, 0, 1, "b"), (1, 0, 0, "a")], "x int, idx int, seq int, text string")
    assert exchanges.reassembled(deltas, ["x", "idx"], "seq", "text").first()["text"] == "abc"
    usage = spark.createDataFrame([(1, 0, '{"input_tokens": 5, "cache_read_input_tokens": 2, "output_tokens": 1}'), (1, 1, '{"output_tokens": 9}')], "x int, seq int, usage string")
    assert tuple(exchanges.merged_usage(usage, "x", "seq", "usage").first()) == (1, 7, 9, 2, 0)
    content = '[{"type":"text","text":"hi"},{"type":"tool_use","id":"t","name":"Read","input":{"a":1}},{"type":"odd","z":1}]'
    parts = one(spark, exchanges.canonical_parts("v"), content, '"plain"')
    assert [p["type"] for p in parts[0]] == ["text", "tool_call", "unknown"] and parts[0][1]["arguments"] == '{"a":1}' and parts[1][0]["text"] == "plain"


def test_ranges_of_argument_strings(spark):
    """Byte ranges between the quotes; keys, empty strings and other values are left out."""
    from wakeline.functions import jsons

    cases = ['{"é" : "ü\\"x", "n": 1, "l": ["a", "", {"in": "b"}], "m": "c"}', '"bare"', "[]", "{no", None]
    got = one(spark, jsons.string_ranges("v"), *cases)
    raw = cases[0].encode()
    assert [(r["key"], raw[r["start"] : r["end"]].decode()) for r in got[0]] == [("é", 'ü\\"x'), ("l", "a"), ("in", "b"), ("m", "c")]
    assert [tuple(r) for r in got[1]] == [(None, 1, 5)] and got[2] == [] and got[3] is None and got[4] is None


def test_blocks_lacking_what_they_need_stay_verbatim(spark):
    content = '[{"type":"text","cache_control":{"type":"e"}},{"type":"redacted_thinking","data":"zz"},{"cache_control":{"type":"e"},"type":"odd"},{"type":"mcp_tool_use","id":"1","name":"n","input":{}}]'
    parts = one(spark, exchanges.canonical_parts("v"), content)[0]
    assert [(p["type"], p["text"]) for p in parts] == [("unknown", '{"type":"text"}'), ("reasoning", "zz"), ("unknown", '{"type":"odd"}'), ("server_call", None)]


def test_logs(spark, tmp_path):
    failures = spark.createDataFrame([("g", "a", 10, "x"), ("g", "a", 20, "y"), ("g", "b", 5, "z")], "group string, id string, at long, reason string")
    retry, dead = logs.attempts(failures, 2)
    assert [r["id"] for r in dead.collect()] == ["a"] and retry.first()["retry_at"] == 1_000_005
    bodies = spark.createDataFrame([("m",), ("m",), ("n",)], "body string")
    assert logs.put_blobs(bodies).count() == 2
    trailer = logs.export(spark.range(100), "agents", str(tmp_path / "x"), ["id"])
    assert trailer["rows"] == 100 and logs.seal(spark, str(tmp_path / "x"))["digest"] == trailer["digest"]


def test_governance_and_alerts(spark):
    log = spark.createDataFrame([("t", "false", 1)], "transmission string, verdict string, revision int")
    wanted = spark.createDataFrame([("t", "false"), ("u", "genuine")], "transmission string, verdict string")
    assert [tuple(r) for r in governance.verdicts_to_append(log, wanted).collect()] == [("u", "genuine", 1)]
    intents = spark.createDataFrame([("i1", "ann", "set_policy"), ("i2", "bob", "set_policy")], "intent string, author string, action string")
    roles = spark.createDataFrame([("ann", "governor"), ("bob", "viewer")], "author string, role string")
    assert {r["intent"]: r["outcome"] for r in governance.audited(intents, roles).collect()} == {"i1": "allowed", "i2": "forbidden"}
    open_ = spark.createDataFrame([("r", "s", "open"), ("r", "x", "resolved")], "rule string, subject string, state string")
    none = spark.createDataFrame([], "channel string")
    off = alerts.suppressed(open_, none, spark.createDataFrame([("r",)], "rule string"), spark.createDataFrame([], "subject string"))
    assert {r["subject"]: r["state"] for r in off.collect()} == {"s": "suppressed", "x": "resolved"}
    m = spark.createDataFrame([("t", 2, "x", 0, 5), ("t", 1, "y", 1, 6), ("t", 1, "z", 2, 7)], "transmission string, class_rank int, carrier string, ordinal int, matched_bytes int")
    assert tuple(quality.strongest_match(m).first()) == ("t", 1, "y", 18)


MINUTE = 60_000_000
START = 1_704_067_200_000_000


def _stream(spark, rows, bounds, path):
    """Rows as a stream whose batches are cut at the bounds (minutes), in order of time."""
    rows = rows.withColumn("ts", F.timestamp_micros("at"))
    for low, high in bounds:
        rows.where((F.col("at") >= START + low * MINUTE) & (F.col("at") < START + high * MINUTE)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_correlator_decides_at_its_windows(spark):
    """Evidence window 2 minutes, suspect window 30 more."""
    cases = {
        "confirmed": ([0, 1, 2], [("opened", 0, 0, 0), ("confirmed", 2, 0, 3)]),
        "late": ([10], [("opened", 0, 0, 0), ("suspected", 2, 0, 0), ("confirmed", 10, 0, 1)]),
        "last moment": ([32, 32, 40], [("opened", 0, 0, 0), ("suspected", 2, 0, 0), ("confirmed", 32, 0, 2), ("extended", 40, 0, 1)]),
        "silent": ([], [("opened", 0, 0, 0), ("suspected", 2, 0, 0), ("discarded", 32, 0, 0)]),
        "reopened": ([33, 50], [("opened", 0, 0, 0), ("suspected", 2, 0, 0), ("discarded", 32, 0, 0), ("opened", 33, 1, 0), ("confirmed", 33, 1, 1), ("extended", 50, 1, 1)]),
        "forgotten": ([31 * 1440], [("opened", 0, 0, 0), ("suspected", 2, 0, 0), ("discarded", 32, 0, 0)]),
    }
    opened = spark.createDataFrame([(k, START) for k in cases], "k string, at long")
    evidence = spark.createDataFrame([(k, START + m * MINUTE) for k, (at, _) in cases.items() for m in at], "k string, at long")
    got = flow.correlations(opened, evidence, ["k"], F.lit(START + 60 * 1440 * MINUTE), flow.Timing()).collect()
    for k, (_, want) in cases.items():
        assert sorted((r["update"], (r["at"] - START) // MINUTE, r["generation"], r["matches"]) for r in got if r["k"] == k) == sorted(want), k


def test_streaming_correlator_agrees_with_batch(spark, tmp_path):
    """Any evidence, in batches of any cut: the updates of the batch form before the watermark."""
    import random

    from wakeline.streaming import buckets, correlator

    rng = random.Random(5)
    events = []
    for k in range(40):
        at = rng.randrange(0, 200)
        events.append((k, "read", at))
        events += [(k, "evidence", at + rng.choice((0, 1, 2, 3, 20, 32, 33, 60, 90))) for _ in range(rng.randrange(4))]
    events.append((99, "read", 400))
    rows = spark.createDataFrame([(k, kind, START + m * MINUTE) for k, kind, m in events], "k long, kind string, at long")
    stream = _stream(spark, rows, ((0, 30), (30, 35), (35, 120), (120, 401)), str(tmp_path / "in"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = buckets.run_once(correlator.correlated(stream, ["k"], flow.Timing()), "updates", str(tmp_path / "check"))
    finally:
        spark.conf.set(name, before)
    batch = flow.correlations(rows.where("kind = 'read'").drop("kind"), rows.where("kind = 'evidence'").drop("kind"), ["k"], F.lit(START + 399 * MINUTE), flow.Timing())
    want = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, got.collect())) == want
    assert {r[2] for r in want} == {"opened", "confirmed", "suspected", "discarded", "extended"} and any(r[1] == 1 for r in want)


def test_held_writes_agree_with_batch(spark, tmp_path):
    """Writes wait for their result on a stream as in batch; without one they settle as unknown."""
    from wakeline.streaming import buckets, correlator

    writes = spark.createDataFrame([(1, START), (2, START), (3, START + 5 * MINUTE), (4, START), (5, START + 300 * MINUTE)], "call long, at long")
    results = spark.createDataFrame([(1, "delivered", START + MINUTE), (2, "rejected", START + MINUTE), (4, "delivered", START + 33 * MINUTE), (6, "delivered", START + 300 * MINUTE)], "call long, outcome string, at long")
    timing = flow.Timing()
    batch = flow.settled_writes(writes.withColumnRenamed("at", "write_at"), results.withColumnRenamed("at", "result_at"), F.lit(START + 299 * MINUTE), timing)
    want = {(r["call"], r["outcome"], (r["released_at"] - START) // MINUTE) for r in batch.collect()}
    assert want == {(1, "delivered", 1), (3, "unknown", 37), (4, "unknown", 32)}
    cuts = ((0, 3), (3, 299), (299, 301))
    w = _stream(spark, writes, cuts, str(tmp_path / "w")).select("call", F.col("ts").alias("write_ts"))
    r = _stream(spark, results, cuts, str(tmp_path / "r")).select("call", "outcome", F.col("ts").alias("result_ts"))
    got = buckets.run_once(correlator.held(w, r, timing), "released", str(tmp_path / "check"))
    assert {(x["call"], x["outcome"], (F_us(x["released_ts"]) - START) // MINUTE) for x in got.collect()} == want


def F_us(at):
    return int(at.replace(tzinfo=datetime.UTC).timestamp() * 1_000_000)
