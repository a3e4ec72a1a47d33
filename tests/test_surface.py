import pytest
from pyspark.sql import functions as F

from wakeline.operators.filters import TopologyFilter
from wakeline.plans.surface import Surface


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    return {
        "transmissions": make([(i, f"a{i % 4}", f"a{(i + 1 + i % 2) % 4}", "channel" if i % 2 else "direct", f"c{i % 3}", 1 if i % 2 else 2, "confirmed" if i % 3 else "suspected", i * 10, 5) for i in range(40)],
                              "transmission long, from string, to string, route string, channel string, topic int, state string, opened_at long, bytes long"),
        "accesses": make([(f"a{i % 4}", f"r{i % 5}", f"c{i % 3}", "read" if i % 2 else "write", i * 10, f"http://h/{i % 5}") for i in range(40)], "agent string, resource string, channel string, op string, at long, url string"),
        "channels": make([(f"c{i}", "discovered" if i else "declared", f"name{i}", f"http://h/{i}", i) for i in range(3)], "channel string, origin string, name string, url string, created_at long"),
        "agents": make([(f"a{i}", "a0" if i else None, "established", f"Label {i}", ["x"], i) for i in range(5)], "agent string, parent string, state string, label string, claims array<string>, created_at long"),
        "agent_aliases": make([("a3", "a2")], "id string, canonical string"),
        "channel_aliases": make([("c2", "c1")], "id string, canonical string"),
        "policies": make([("c1", "sanctioned", 5, 1), ("c1", "unsanctioned", 3, 0)], "channel string, policy string, at long, seq long"),
        "verdicts": make([(1, "false", 1), (1, "genuine", 2), (2, "false", 1)], "transmission long, verdict string, revision long"),
        "matches": make([(1, 1, "s1", "e1", "e2", 1, "tool", 0, 9, 7)], "match long, transmission long, origin string, origin_exchange string, reader_exchange string, class_rank int, carrier string, ordinal int, at long, matched_bytes long"),
        "alerts": make([(1, "open", "c2", 4), (2, "resolved", "c0", 5)], "alert long, state string, channel string, opened_at long"),
        "conversations": make([("v1", "a3", "root", None, 1, False), ("v2", "a1", "fork", "v1", 2, False)], "conversation string, agent string, origin string, parent string, started_at long, replayed boolean"),
        "turns": make([("v1", i, f"e{i}", f"m{i}") for i in range(5)], "conversation string, turn int, exchange string, message string"),
        "bodies": make([(f"m{i}", f"body number {i}") for i in range(4)], "message string, body string"),
        "topic_versions": make([(1, "active")], "version int, state string"),
        "topics": make([(1, 1), (1, 2), (1, 3)], "version int, topic int"),
        "assignments": make([(1, i, 1 if i % 2 else None) for i in range(40)], "version int, transmission long, topic int"),
        "search_docs": make([(i, f"alpha {'beta' if i % 2 else ''}", [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(9)], "id long, body string, vector array<double>"),
        "watermarks": make([(200,)], "through long"),
        "alert_rules": make([("r1", True, "on", False), ("r2", False, "on", True)], "rule string, builtin boolean, status string, stale boolean"),
    }


def test_reads(spark, tables, tmp_path):
    s = Surface(tables, "governor")
    edges, nodes = s.topology(0, 400)
    assert abs(sum(r["share"] for r in edges.collect()) - 1) < 1e-9
    assert all(r["from"] != r["to"] and "a3" not in (r["from"], r["to"]) for r in edges.collect())
    assert {r["agent"] for r in nodes.collect()} >= {"a0", "a1", "a2"}
    judged = s.topology(0, 400, TopologyFilter(hide_false=True))[0].agg(F.sum("transmissions")).first()[0]
    everything = s.topology(0, 400)[0].agg(F.sum("transmissions")).first()[0]
    # Transmission 2 is judged false; 1 was, but is genuine now.
    assert judged == everything - (tables["transmissions"].where("transmission = 2").first()["from"] not in ("a2", "a3"))
    listed = {r["channel"]: r for r in s.channels().collect()}
    assert listed["c1"]["policy"] == "sanctioned" and listed["c1"]["listing"] == "confirmed" and listed["c2"]["transmissions"] == 0
    assert s.channel("c1").count() == 1 and s.policy_history("c1").count() == 2
    first = s.channel_transmissions("c1", size=5).collect()
    request = {"channel": "c1", "confirmed": None}
    rest = s.channel_transmissions("c1", size=5, cursor=s.cursor_after(first[-1], ["opened_at", "transmission"], request)).collect()
    assert rest[0]["opened_at"] < first[-1]["opened_at"]
    assert s.channel_resources("c1", 0, 300).count() > 0
    assert s.agents(text="label 2").first()["agent"] == "a2"
    assert s.agent("a2").first()["aliases"] == ["a3"]
    assert [r["label"] for r in s.agent_names(spark.createDataFrame([("a3",)], "agent string")).collect()] == ["Label 2"]
    assert [r["conversation"] for r in s.conversations(agent="a2").collect()] == ["v1"]
    assert s.conversation("v1").first()["successors"] == ["v2"] and s.conversation("v1").first()["turns"] == 5
    assert {r["exchange"]: r["copied_into"] for r in s.conversation_turns("v1", 1, 2).collect()} == {"e1": 0, "e2": 1}
    assert [r["body"] for r in s.conversation_text("v1", 0, 5, 4).orderBy("turn").collect()] == ["body"] * 4 + [None]
    assert s.part_text("m1", 5, 11).first()["excerpt"]["text"] == "number"
    assert s.alerts(channels=("c1",)).count() == 1 and [r["rule"] for r in s.alert_rules().collect()] == ["r1", "r2"]
    assert s.overview(0, 400).first()["open_alerts"] == 1
    assert s.channel_topology(0, 400, TopologyFilter(topics=(1,))).count() > 0
    assert s.series(0, 400, 100, 10, ["route"]).count() == 8
    assert s.edge_transmissions("a0", "a1", 0, 400).count() > 0
    sizes = {r["topic"]: r["transmissions"] for r in s.topic_sizes().collect()}
    assert sizes[2] == sizes[3] == 0 and sizes[1] > 0 and sizes[None] > 0
    assert s.search("text", "beta").count() == 4 and s.search("hybrid", "beta", [1.0, 0.0], 1).count() == 1
    assert s.detection_quality(0, 400).agg(F.sum("genuine")).first()[0] == 1
    assert s.export("transmissions", str(tmp_path / "x"))["rows"] == 20


def test_roles_are_checked(tables):
    with pytest.raises(PermissionError):
        Surface(tables, "viewer").search("text", "beta")
