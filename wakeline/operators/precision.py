"""Rules that withhold matches which another path to the same text explains.

Every rule is a join on the keys it is about; none pairs texts with texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.text import normalize, tokens, trimmed_length
from wakeline.functions.vectors import rarity_bound

from .provenance import LONG_RUN, WINDOW

#: Fewer whole tokens than this tell nothing about where a run came from.
LEAST_TOKENS = 2


def live_hits(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits on spans of other agents, indexed by the time of the read and not yet expired.

    hits: (span, reader, read_at, ...); spans: (span, agent, indexed_at, expires_at), of
    which expires_at may be null.
    """
    held = hits.join(spans, "span")
    alive = (F.col("indexed_at") <= F.col("read_at")) & F.coalesce(F.col("expires_at") > F.col("read_at"), F.lit(True))
    return held.where((F.col("agent") != F.col("reader")) & alive).drop("indexed_at", "expires_at")


def without_replays(hits: DataFrame, own: DataFrame) -> DataFrame:
    """Hits less those whose gram the reader itself had written before.

    Only hits in a tool's result, or on forwarded text, can be replays; a user's turn that
    repeats the reader is a delivery. hits: (reader, read_at, fp, carrier, forwarded, ...);
    own: (reader, fp, at), grams of the readers' own outputs.
    """
    first = own.groupBy("reader", "fp").agg(F.min("at").alias("_own_at"))
    may = (F.col("carrier") == "tool_result") | F.col("forwarded")
    replay = may & F.coalesce(F.col("_own_at") < F.col("read_at"), F.lit(False))
    return hits.join(first, ["reader", "fp"], "left").where(~replay).drop("_own_at")


def source_only(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """(forward, fp): grams of each forward's source that its forwarder's output lacks."""
    return sources.select("forward", "fp").distinct().join(outputs.select("forward", "fp"), ["forward", "fp"], "left_anti")


def without_direct_reads(hits: DataFrame, reads: DataFrame, only: DataFrame, least: int = WINDOW) -> DataFrame:
    """Hits on forwards less those held by a layer in which the reader read the source itself.

    A layer is a direct read of a forward's source if it holds at least `least` grams that
    only the source has. hits: (reader, forward, fp, ...); reads: (reader, layer, fp), the
    reader's own reads; only: (forward, fp) of `source_only`.
    """
    held = reads.select("reader", "layer", "fp").distinct()
    asked = hits.where("forward IS NOT NULL").select("reader", "forward").distinct().join(only, "forward")
    direct = asked.join(held, ["reader", "fp"]).groupBy("reader", "forward", "layer").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    explained = direct.join(held, ["reader", "layer"]).select("reader", "forward", "fp").distinct()
    return hits.join(explained, ["reader", "forward", "fp"], "left_anti")


def whole_tokens(text, start, end) -> Column:
    """Tokens that lie wholly within [start, end) of a text, folded; positions in characters."""
    low, high = F.greatest(start, F.lit(1)), F.least(end + 1, F.length(text))
    # One character of context on either side shows whether the first and last are cut.
    raw = F.substring(text, low.cast("int"), (high - low + 1).cast("int"))
    front = F.when(start > 0, F.regexp_replace(raw, r"^[\p{L}\p{N}]+", "")).otherwise(raw)
    return tokens(normalize(F.when(end < F.length(text), F.regexp_replace(front, r"[\p{L}\p{N}]+\z", "")).otherwise(front)))


def _line(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def inherited(runs: DataFrame, given: DataFrame) -> DataFrame:
    """Matches whose every run the origin's agent had itself been given: (match).

    The match must cover less than half of the origin's span, and every run have two whole
    tokens or more, which stand consecutively in one part of what the agent was given in the
    exchange. runs: (match, exchange, text, start, end, span_length), merged; given:
    (exchange, part, text).
    """
    cut = runs.select("match", "exchange", "start", (F.col("end") - F.col("start")).alias("n"), "span_length", whole_tokens(F.col("text"), F.col("start"), F.col("end")).alias("w"))
    judged = cut.groupBy("match").agg(
        (2 * F.sum("n") < F.max("span_length")).alias("part"), F.min(F.size("w")).alias("least")
    ).where((F.col("least") >= LEAST_TOKENS) & F.col("part"))
    asked = cut.join(judged.select("match"), "match", "left_semi").select("match", "exchange", "start", _line(F.col("w")).alias("line"))
    parts = given.select("exchange", _line(tokens(normalize(F.col("text")))).alias("part"))
    held = asked.join(parts, "exchange", "left").groupBy("match", "start").agg(F.max(F.coalesce(F.contains("part", F.col("line")), F.lit(False))).alias("held"))
    return held.groupBy("match").agg(F.bool_and("held").alias("_all")).where("_all").select("match")


def reader_outputs(stretches: DataFrame, token_frequency: DataFrame, least: int = LONG_RUN) -> DataFrame:
    """Stretches of readers' own outputs that count as matches of the span they repeat: (stretch).

    They must be long, hold a hit, and hold a token in few enough texts for the number of
    the span's holders. stretches: (stretch, text, start, end, hits, holders);
    token_frequency: (token, texts).
    """
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    chars = trimmed_length(normalize(F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))))
    long_ = stretches.where((chars >= least) & (F.col("hits") > 0))
    each = long_.select("stretch", "holders", F.explode(F.array_distinct(whole_tokens(text, start, end))).alias("token"))
    seen = each.join(token_frequency, "token", "left")
    return seen.where(F.coalesce("texts", F.lit(0)) <= rarity_bound(F.col("holders"))).select("stretch").distinct()
