"""Which text came from where: fingerprints, matches, copied runs, and what does not count."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.text import code_points, portable_hashes, rolling_hashes, winnow_places
from wakeline.functions.vectors import rarity_bound
from wakeline.sources.storage import checkpoint, spread_out

GRAM = 32
WINDOW = 16
CUTOFF = 50
HOLDERS = 4
LONG_RUN = 64
BATCH_GRAMS = 1 << 18
#: Eight bytes each in every worker.
BROADCAST_GRAMS = 4_000_000


def _emitted(rows: DataFrame, key: str, text: str, find: Callable[[str], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(key, pos, fp) for the places and hashes that `find` gives of every text."""
    kind = dict(rows.select(key).dtypes)[key]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(part, owners, places, hashes):
            columns = [part.column(0).take(pa.array(np.concatenate(owners))), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(hashes), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, [key, "pos", "fp"])

        for part in parts:
            owners, places, hashes, size = [], [], [], 0
            for i, value in enumerate(part.column(1)):
                at, fp = find(value.as_py() or "")
                if len(at):
                    owners.append(np.full(len(at), i, dtype=np.int64))
                    places.append(at)
                    hashes.append(fp)
                    size += len(at)
                if size >= BATCH_GRAMS:
                    yield closed(part, owners, places, hashes)
                    owners, places, hashes, size = [], [], [], 0
            if size:
                yield closed(part, owners, places, hashes)

    return spread_out(rows.select(key, text)).mapInArrow(run, f"`{key}` {kind}, pos int, fp long")


def grams(rows: DataFrame, key: str, text: str, width: int = GRAM, portable: bool = True) -> DataFrame:
    """(key, pos, fp) of every gram of every text; fp is the portable hash or the rolling one."""

    def find(value: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(max(0, len(value) - width + 1))
        return at, portable_hashes(value, at, width) if portable else rolling_hashes(code_points(value), width)

    return _emitted(rows, key, text, find)


def _known_places(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that are among sorted ones."""
    if not len(known):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)


def shared_grams(rows: DataFrame, key: str, text: str, origins: DataFrame, origin_text: str, width: int = GRAM, most: int = BROADCAST_GRAMS) -> DataFrame:
    """(key, pos, fp) of the grams that some origin text has too, fp being portable.

    If the origins have at most `most` different grams, their rolling hashes are broadcast
    and only grams that meet them leave the row and are hashed again, so that each text is
    read once and a gram that nobody shares is never shuffled. Beyond that a text sends the
    names of its grams, one for some nine of them and each once, gets back those that an
    origin has, and hashes only the grams so named: with the same result.
    """
    own = grams(origins.withColumn("_o", F.lit(0)), "_o", origin_text, width).select("fp").distinct()
    rolled = checkpoint(grams(origins.withColumn("_o", F.lit(0)), "_o", origin_text, width, portable=False).select("fp").distinct())
    if rolled.count() > most:
        return _named_grams(rows, key, text, origins, origin_text, width).join(own, "fp", "left_semi").select(key, "pos", "fp")
    sent = rows.sparkSession.sparkContext.broadcast(np.sort(rolled.toPandas()["fp"].to_numpy(dtype=np.int64)))

    def find(value: str) -> tuple[np.ndarray, np.ndarray]:
        at = _known_places(sent.value, rolling_hashes(code_points(value), width))
        return at, portable_hashes(value, at, width)

    return _emitted(rows, key, text, find).join(own, "fp", "left_semi").select(key, "pos", "fp")


def gram_names(value: str, width: int) -> np.ndarray:
    """A name for every gram: the least hash of the half as long grams within it, so equal
    grams have equal names, and neighbours mostly share theirs."""
    half = max(1, width // 2)
    least, span, wanted = rolling_hashes(code_points(value), half), 1, width - half + 1
    if len(least) < wanted:
        return least[:0]
    while span < wanted:
        step = min(span, wanted - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    return least


def _named_grams(rows: DataFrame, key: str, text: str, origins: DataFrame, origin_text: str, width: int) -> DataFrame:
    """(key, pos, fp) of the grams whose names some origin has."""

    def names(of: DataFrame, by: str, column: str) -> DataFrame:
        def find(value: str) -> tuple[np.ndarray, np.ndarray]:
            found = np.unique(gram_names(value, width))
            return np.zeros(len(found), dtype=np.int64), found

        return _emitted(of, by, column, find).select(by, F.col("fp").alias("name"))

    known = names(origins.withColumn("_o", F.lit(0)), "_o", origin_text).select("name").distinct()
    shared = names(rows, key, text).join(known, "name", "left_semi").groupBy(F.col(key).alias("_key")).agg(F.collect_set("name").alias("names"))
    asked = rows.select(key, text).join(shared, F.col(key).eqNullSafe(F.col("_key"))).select(key, text, "names")
    kind = dict(rows.select(key).dtypes)[key]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                value = part.column(1)[i].as_py()
                at = np.flatnonzero(np.isin(gram_names(value, width), part.column(2)[i].values.to_numpy()))
                owner = part.column(0).take(pa.array(np.full(len(at), i)))
                yield pa.RecordBatch.from_arrays([owner, pa.array(at, pa.int32()), pa.array(portable_hashes(value, at, width), pa.int64())], [key, "pos", "fp"])

    return asked.mapInArrow(run, f"`{key}` {kind}, pos int, fp long")


def winnowed(rows: DataFrame, key: str, text: str, width: int = GRAM, window: int = WINDOW, portable: bool = False) -> DataFrame:
    """(key, pos, fp) of the grams kept by winnowing: the rightmost least hash of every
    window of consecutive grams, each place once; a text with fewer grams than a window
    keeps the rightmost least of them all.

    Everything happens inside the row, so no gram that is not kept is ever shuffled. The
    rolling hash is some ten times cheaper than the portable one, which SQL can repeat.
    """
    return _emitted(rows, key, text, lambda value: _winnow(value, width, window, portable))


def _winnow(value: str, width: int, window: int, portable: bool) -> tuple[np.ndarray, np.ndarray]:
    every = range(max(0, len(value) - width + 1))
    hashes = portable_hashes(value, every, width) if portable else rolling_hashes(code_points(value), width)
    at = winnow_places(hashes, window)
    return at, hashes[at]


def winnowed_among(rows: DataFrame, key: str, text: str, among: DataFrame, most: int = BROADCAST_GRAMS) -> DataFrame:
    """(key, pos, fp) of the portable winnowed grams that are among some (fp). Every text is winnowed
    whole; if those asked for are at most `most`, others do not leave the row, else they go in a join."""
    asked = checkpoint(among.select("fp").where("fp IS NOT NULL").distinct())
    if asked.count() > most:
        return winnowed(rows, key, text, portable=True).join(asked, "fp", "left_semi").select(key, "pos", "fp")
    sent = rows.sparkSession.sparkContext.broadcast(np.sort(asked.toPandas()["fp"].to_numpy(dtype=np.int64)))

    def find(value: str) -> tuple[np.ndarray, np.ndarray]:
        at, hashes = _winnow(value, GRAM, WINDOW, portable=True)
        held = _known_places(sent.value, hashes)
        return at[held], hashes[held]

    return _emitted(rows, key, text, find)


def document_frequency(postings: DataFrame, text_key: str, since: Column | None = None) -> DataFrame:
    """(fp, texts): distinct texts that hold a gram within retention."""
    rows = postings if since is None else postings.where(since)
    return rows.select("fp", text_key).distinct().groupBy("fp").agg(F.count("*").alias("texts"))


def matches(origins: DataFrame, readers: DataFrame, frequency: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """Gram hits of reader texts on origin texts, grams in too many texts left out.

    origins: (origin, pos, fp); readers: (reader, pos, fp). Frequent grams go before the
    join, so no gram can pair more than `cutoff` texts' worth of rows.
    """
    stop = frequency.where(F.col("texts") > cutoff).select("fp")
    left = origins.join(stop, "fp", "left_anti").select("fp", "origin", F.col("pos").alias("origin_pos"))
    return left.join(readers.select("fp", "reader", F.col("pos").alias("reader_pos")), "fp")


def copied_runs(hits: DataFrame, width: int = GRAM) -> DataFrame:
    """Maximal runs of grams consecutive in both texts: islands of equal offset."""
    keys = ["reader", "origin", "offset"]
    rows = hits.select("reader", "origin", "reader_pos", (F.col("reader_pos") - F.col("origin_pos")).alias("offset")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("reader_pos"))
    islands = rows.withColumn("_island", F.col("reader_pos") - rank)
    return (
        islands.groupBy(*keys, "_island")
        .agg(F.min("reader_pos").alias("start"), (F.max("reader_pos") + width).alias("end"), F.count("*").alias("grams"))
        .drop("_island")
    )


def merged_intervals(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching intervals of each key joined."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*keys).orderBy(start, end)
    new = F.when(F.col(start) <= F.max(end).over(before), 0).otherwise(1)
    return (
        rows.withColumn("_new", new)
        .withColumn("_group", F.sum("_new").over(so_far))
        .groupBy(*keys, "_group")
        .agg(F.min(start).alias("start"), F.max(end).alias("end"))
        .drop("_group")
    )


def covered(intervals: DataFrame, keys: list[str]) -> DataFrame:
    return intervals.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def gaps(intervals: DataFrame, keys: list[str], length: DataFrame) -> DataFrame:
    """Complement of merged intervals in [0, length); length: (keys, length), one row each."""
    ends = length.select(*keys, F.col("length").alias("start"), F.col("length").alias("end"))
    all_ = intervals.select(*keys, "start", "end").unionByName(ends.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")}))
    last = F.coalesce(F.lag("end").over(Window.partitionBy(*keys).orderBy("start", "end")), F.lit(0))
    return all_.withColumn("_from", last).where(F.col("_from") < F.col("start")).select(*keys, F.col("_from").alias("start"), F.col("start").alias("end"))


def best_layer(hits: DataFrame, key: list[str]) -> DataFrame:
    """One layer for each match: complete first, then most covered, shortest chain, first layer."""
    rank = F.struct("complete", "covered", (-F.col("chain_length")).alias("c"), (-F.col("layer")).alias("l"))
    columns = [c for c in hits.columns if c not in key]
    return hits.groupBy(*key).agg(F.max_by(F.struct(*columns), rank).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def long_runs(intervals: DataFrame, least: int = LONG_RUN) -> DataFrame:
    return intervals.where(F.col("end") - F.col("start") >= least)


def owned(runs: DataFrame) -> DataFrame:
    """(text, input, start, end): each place of a text given to the least input with a run over
    it, in stretches as long as can be. A sweep over the ends of runs in order of place, with a
    heap of the runs that are open, so that it costs rows and not places."""
    kinds = dict(runs.select("text", "input").dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text, open_, at, held = None, [], 0, None

        def closed(until: float) -> list[tuple]:
            """Stretches up to a place, the last of which is held back as it may go on."""
            nonlocal at, held
            out = []
            while open_ and at < until:
                owner, end = open_[0]
                if end <= at:
                    heapq.heappop(open_)
                    continue
                stop = min(end, until)
                if held and held[1] == owner and held[3] == at:
                    held = (*held[:3], stop)
                else:
                    if held:
                        out.append(held)
                    held = (text, owner, at, stop)
                at = stop
            return out

        def ended() -> list[tuple]:
            nonlocal held
            out = closed(float("inf"))
            out, held = out + ([held] if held else []), None
            return out

        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                if r.text != text:
                    rows += ended()
                    text, at = r.text, 0
                    open_.clear()
                rows += closed(r.start)
                at = max(at, r.start)
                if r.end > r.start:
                    heapq.heappush(open_, (r.input, r.end))
            yield pd.DataFrame(rows, columns=["text", "input", "start", "end"])
        yield pd.DataFrame(ended(), columns=["text", "input", "start", "end"])

    spans = runs.where("text IS NOT NULL AND input IS NOT NULL").select("text", "input", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    in_order = spans.repartition("text").sortWithinPartitions("text", "start")
    return in_order.mapInPandas(run, f"text {kinds['text']}, input {kinds['input']}, start long, end long")


def classified_spans(output: DataFrame, runs: DataFrame, length: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """Spans of an output text: relayed parts, then originated or common gaps.

    Where runs of several inputs overlap, the least input has the place. output: grams
    (text, pos, fp); runs: (text, input, start, end); boilerplate: (fp).
    """
    relayed = owned(runs)
    rest = gaps(relayed, ["text"], length)
    # The last gap that starts at a gram or before it is the only one that may hold it.
    marks = rest.select("text", F.col("start").alias("at"), "start", "end", F.lit(None).cast("long").alias("fp"))
    all_ = marks.unionByName(output.select("text", F.col("pos").cast("long").alias("at"), "fp"), allowMissingColumns=True)
    line = Window.partitionBy("text").orderBy("at", F.col("fp").isNotNull())
    placed = all_.withColumns({c: F.last(c, ignorenulls=True).over(line) for c in ("start", "end")})
    inside = placed.where(F.col("fp").isNotNull() & (F.col("at") < F.col("end"))).select("text", "start", "end", "fp")
    common = boilerplate.select("fp", F.lit(1).alias("_common"))
    kinds = inside.join(common, "fp", "left").groupBy("text", "start", "end").agg(F.bool_and(F.col("_common").isNotNull()).alias("_all"))
    gap_kinds = rest.join(kinds, ["text", "start", "end"], "left").select(
        "text", F.lit(None).cast("string").alias("input"), "start", "end", F.when(F.col("_all"), "common").otherwise("originated").alias("kind")
    )
    return relayed.select("text", F.col("input").cast("string").alias("input"), "start", "end", F.lit("relayed").alias("kind")).unionByName(gap_kinds)


def match_kind(chain="chain", read_text="read_text", origin_text="origin_text", fold="unicode") -> Column:
    """exact, normalized or decoded with its codecs; a fold of letters is no codec. Without a
    chain, text is exact if either side holds the other; semantic where there is no text."""
    c, read, origin = (F.col(x) if isinstance(x, str) else x for x in (chain, read_text, origin_text))
    codecs = F.filter(c, lambda x: x != fold)
    within = (F.contains(origin, read) | F.contains(read, origin)) & (read != "") & (origin != "")
    return (
        F.when(c.isNull(), "semantic")
        .when(F.size(codecs) > 0, F.concat(F.lit("decoded:"), F.array_join(codecs, ">")))
        .when((F.size(c) == 0) & F.coalesce(within, F.lit(False)), "exact")
        .otherwise("normalized")
    )


def spread(postings: DataFrame, holder: str = "agent", least: int = HOLDERS) -> DataFrame:
    """(fp, holders) of grams held by so many agents that they tell nothing."""
    held = postings.select("fp", holder).distinct().groupBy("fp").agg(F.count("*").alias("holders"))
    return held.where(F.col("holders") >= least)


def skeleton(hits: DataFrame, holders: DataFrame, token_frequency: DataFrame) -> DataFrame:
    """Short matches all of whose grams are widely held and cover no token rare enough.

    hits: (match, fp, token, longest); holders: (fp, holders); token_frequency: (token, texts).
    """
    seen = hits.join(holders, "fp").join(token_frequency, "token", "left")
    rare = F.col("texts") <= rarity_bound(F.col("holders"))
    judged = seen.groupBy("match").agg(F.max("longest").alias("longest"), F.max(F.coalesce(rare, F.lit(False))).alias("rare"))
    return judged.where((F.col("longest") < LONG_RUN) & ~F.col("rare")).select("match")


def shadowed(found: DataFrame) -> DataFrame:
    """Short matches inside the extent of another agent that is present in the layer.

    found: (layer, agent, start, end, rare). An agent is present if it has a run of 64 or
    more; a match of an agent without one goes if all its runs lie inside the extent of a
    present agent that covers more, and it holds no rare token.
    """
    per = found.groupBy("layer", "agent").agg(
        F.min("start").alias("low"), F.max("end").alias("high"), F.sum(F.col("end") - F.col("start")).alias("covered"),
        F.max(F.col("end") - F.col("start")).alias("longest"), F.max("rare").alias("rare"),
    )
    present = per.where(F.col("longest") >= LONG_RUN).select(
        "layer", F.col("agent").alias("by"), F.col("low").alias("by_low"), F.col("high").alias("by_high"), F.col("covered").alias("by_covered")
    )
    short = per.where((F.col("longest") < LONG_RUN) & ~F.col("rare"))
    hidden = (F.col("agent") != F.col("by")) & (F.col("low") >= F.col("by_low")) & (F.col("high") <= F.col("by_high")) & (F.col("covered") < F.col("by_covered"))
    return short.join(present, "layer").where(hidden).select("layer", "agent").distinct()


def source_only(source: DataFrame, forwarder: DataFrame) -> DataFrame:
    """Grams of a source that a forwarder's output lacks."""
    return source.select("fp").exceptAll(forwarder.select("fp")).distinct()


def unmatched(semantic: DataFrame, matched: DataFrame, key: list[str]) -> DataFrame:
    """Semantic hits on spans that no fingerprint match has already."""
    return semantic.join(matched.select(*key), key, "left_anti")


def span_states(spans: DataFrame, hits: DataFrame, now: Column, retention: int) -> DataFrame:
    """Spans with first hit, hits, and state; times in microseconds."""
    seen = hits.groupBy("span").agg(F.min("at").alias("first_hit"), F.count("*").alias("hits"))
    state = (
        F.when(F.col("originated_at") < now - retention, "expired")
        .when(F.col("hits") > 0, "propagated")
        .when(F.col("indexed_at").isNotNull(), "indexed")
        .otherwise("originated")
    )
    return spans.join(seen, "span", "left").fillna(0, ["hits"]).withColumn("state", state)
