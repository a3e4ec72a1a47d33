"""The precision rules on cases made by hand."""

from pyspark.sql import functions as F

from wakeline.operators import precision


def test_live_hits(spark):
    hits = spark.createDataFrame([("s", "a", 5), ("s", "b", 5), ("s", "b", 1), ("s", "b", 9), ("t", "b", 99)], "span string, reader string, read_at long")
    spans = spark.createDataFrame([("s", "a", 2, 9), ("t", "a", 2, None)], "span string, agent string, indexed_at long, expires_at long")
    assert sorted((r["span"], r["reader"], r["read_at"]) for r in precision.live_hits(hits, spans).collect()) == [("s", "b", 5), ("t", "b", 99)]


def test_replays_need_an_earlier_own_text_and_a_carrier_that_can_replay(spark):
    hits = spark.createDataFrame(
        [("r", 5, 1, "tool_result", False), ("r", 5, 2, "tool_result", False), ("r", 5, 1, "user_turn", False), ("r", 5, 1, "user_turn", True), ("r", 2, 1, "tool_result", False)],
        "reader string, read_at long, fp long, carrier string, forwarded boolean",
    )
    own = spark.createDataFrame([("r", 1, 7), ("r", 1, 3), ("q", 2, 0)], "reader string, fp long, at long")
    left = sorted((r["read_at"], r["fp"], r["carrier"], r["forwarded"]) for r in precision.without_replays(hits, own).collect())
    assert left == [(2, 1, "tool_result", False), (5, 1, "user_turn", False), (5, 2, "tool_result", False)]


def test_direct_reads_of_a_forwards_source(spark):
    sources = spark.createDataFrame([("f", p) for p in range(10)], "forward string, fp long")
    only = precision.source_only(sources, sources.where("fp < 4"))
    assert only.count() == 6
    # Layer 1 holds enough of the source's own grams, layer 2 does not, agent q reads nothing.
    reads = spark.createDataFrame([("r", 1, p) for p in (0, 4, 5, 6)] + [("r", 2, p) for p in (1, 4)], "reader string, layer long, fp long")
    hits = spark.createDataFrame([("r", "f", 0), ("r", "f", 1), ("q", "f", 0), ("r", None, 0)], "reader string, forward string, fp long")
    left = {(r["reader"], r["forward"], r["fp"]) for r in precision.without_direct_reads(hits, reads, only, 3).collect()}
    assert left == {("r", "f", 1), ("q", "f", 0), ("r", None, 0)}


def test_whole_tokens_leave_cut_ones_out(spark):
    text = "alpha Bravo charlie x delta"
    rows = spark.createDataFrame([(0, 11), (2, 19), (6, 17), (0, 27), (5, 6)], "start int, end int").withColumn("text", F.lit(text))
    got = [r[0] for r in rows.select(precision.whole_tokens(F.col("text"), F.col("start"), F.col("end"))).collect()]
    assert got == [["alpha", "bravo"], ["bravo", "charlie"], ["bravo"], ["alpha", "bravo", "charlie", "delta"], []]


def test_inherited(spark):
    layer = "see page queue-backpressure here and more words follow"
    runs = spark.createDataFrame(
        [
            ("given", "e", layer, 0, 28, 100),
            ("long", "e", layer, 0, 28, 40),
            ("scattered", "e", layer, 0, 36, 100),
            ("one", "e", layer, 4, 8, 100),
            ("unknown", "x", layer, 0, 28, 100),
        ],
        "match string, exchange string, text string, start int, end int, span_length int",
    )
    given = spark.createDataFrame([("e", 1, "Read the page  Queue-Backpressure now"), ("e", 2, "here")], "exchange string, part int, text string")
    assert [r["match"] for r in precision.inherited(runs, given).collect()] == ["given"]


def test_reader_outputs(spark):
    text = "common " * 12 + "rarity" + " common" * 3
    rows = [("ok", 0, len(text), 1, 1), ("short", 70, len(text) - 8, 1, 1), ("no hit", 0, len(text), 0, 1), ("plain", 0, 84, 1, 1)]
    stretches = spark.createDataFrame(rows, "stretch string, start int, end int, hits int, holders int").withColumn("text", F.lit(text))
    seen = spark.createDataFrame([("common", 90), ("rarity", 3)], "token string, texts long")
    assert [r["stretch"] for r in precision.reader_outputs(stretches, seen).collect()] == ["ok"]
    assert precision.reader_outputs(stretches, seen.withColumn("texts", F.lit(4))).count() == 0
