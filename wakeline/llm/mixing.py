"""Mixing sources to target weights by Sainte-Lague apportionment (operator 7).

Sizes are words. Every source gets a target; equal-token blocks are apportioned to
sources by highest quotients, then each source's blocks to its shards in the same way,
which gives an integer quota per shard. Within a shard, documents lie end to end in
seeded order and are cut into blocks; a quota takes every block the same number of
times and the rest of it takes seeded single blocks once more.

Blocks have 64 words. Sources whose target is under a hundred of them are apportioned
among themselves, in blocks of 16, 4 or 1 word, so that a block is about a hundredth of a
target at most.

A shard holds about `SHARD_WORDS` words and `SHARD_ROWS` documents, so a source with a third
of all rows is many shards, and the running sums within a shard stay small; quotas go to
groups of shards before shards. Only one row per source (its sizes) reaches the driver.

Giving seats while votes / (2 * seats + 1) is largest equals rounding votes / d for the right
divisor d; the seats between the rounding at a close divisor, half a seat a source at most,
and the exact house are settled by their quotients from a heap, ties by source order.

Defined results: null and empty texts have size 0 and take 0; a null source is a source
of its own, ordered last; sources without words have target 0; repeated rows are
documents of their own. The seeded order is by doc_id and a digest of the text, so rows that
share a doc_id or have none are told apart, and reruns agree; rows alike in both are alike in
all that is taken, whichever of them lies first.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, word_count

BLOCK_WORDS = (64, 16, 4, 1)
BLOCKS_LEAST = 100
SHARD_WORDS = 1 << 18
SHARD_ROWS = 1 << 16
SHARDS_GROUP = 4096
REPEATS = 3
# One short row per source; beyond this many the plan is joined by shuffle.
BROADCAST_SOURCES = 100_000
SEED = 7


def targets(sizes: list[int], weights: list[float], most: float = REPEATS) -> list[float]:
    """Share sum(sizes) by weight; none above `most` times its size, the excess reshared."""
    # In order of the share at which each is full, those that are full come first.
    order = sorted((i for i, n in enumerate(sizes) if n > 0), key=lambda i: (sizes[i] / weights[i], i))
    out, left, weight = [0.0] * len(sizes), float(sum(sizes)), math.fsum(weights[i] for i in order)
    for k, i in enumerate(order):
        if left * weights[i] <= most * sizes[i] * weight:
            for j in order[k:]:
                out[j] = left / weight * weights[j]
            break
        out[i] = float(most * sizes[i])
        left -= out[i]
        weight -= weights[i]
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1); ties go to the earlier."""
    total = sum(votes)
    if total <= 0 or seats <= 0:
        return [0] * len(votes)
    got = [max(0, math.floor(v * seats / total + 0.5)) for v in votes]
    step = 1 if sum(got) < seats else -1
    # The next quotient to gain, or the last one gained, of each party, best first.
    bid = (lambda k: (-votes[k] / (2 * got[k] + 1), k)) if step > 0 else (lambda k: (votes[k] / (2 * got[k] - 1), -k))
    queue = [bid(k) for k in range(len(votes)) if step > 0 or got[k]]
    heapq.heapify(queue)
    for _ in range(abs(seats - sum(got))):
        k = abs(queue[0][1])
        got[k] += step
        if step > 0 or got[k]:
            heapq.heapreplace(queue, bid(k))
        else:
            heapq.heappop(queue)
    return got


def block_of(target: float, blocks: tuple[int, ...] = BLOCK_WORDS) -> int:
    """The longest block of which the target is a hundred; else the shortest."""
    return next((b for b in blocks if target >= BLOCKS_LEAST * b), blocks[-1])


def source_plan(sizes: DataFrame, blocks: tuple[int, ...] = BLOCK_WORDS) -> DataFrame:
    """One row per source: its place, sizes, target, block and quota of blocks."""
    spark = sizes.sparkSession
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).collect()
    # Code points order as UTF-8 bytes do.
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    words = [int(r["source_size"]) for r in rows]
    goal = targets(words, [1.0 + i % 3 for i in range(len(rows))])
    own, quota = [block_of(t, blocks) for t in goal], [0] * len(rows)
    for block in blocks:
        of = [i for i, b in enumerate(own) if b == block]
        for i, q in zip(of, sainte_lague([goal[i] for i in of], round(math.fsum(goal[i] for i in of) / block)), strict=True):
            quota[i] = q
    return spark.createDataFrame(
        [(r["source"], n, r["rows"], t, b, q) for r, n, t, b, q in zip(rows, words, goal, own, quota, strict=True)],
        "source string, source_size long, source_rows long, target double, block long, quota long",
    )


def _apportioned(parts: DataFrame, whole: list[str], part: str) -> DataFrame:
    """Sainte-Lague of `quota` over the parts of each whole, votes being their words; adds `got`.

    Rounding at the fair divisor is at most half a seat off per part; the house is met by
    taking from, or giving to, the parts nearest to their next quotient.
    """
    each = Window.partitionBy(*whole)
    ideal = F.col("quota") * F.col("words") / F.sum("words").over(each)
    low = parts.withColumn("_got", F.floor(ideal + 0.5)).withColumn("_over", F.sum("_got").over(each) - F.col("quota"))
    quotient = F.when(
        F.col("_over") > 0, -(F.col("words") / (2 * F.col("_got") - 1))
    ).otherwise(F.col("words") / (2 * F.col("_got") + 1))
    # With too many seats only parts that hold one may give it back.
    order = each.orderBy(F.when((F.col("_over") > 0) & (F.col("_got") == 0), 1).otherwise(0), quotient.desc(), part)
    moved = low.withColumn("_rank", F.row_number().over(order))
    step = F.when(F.col("_rank") > F.abs("_over"), 0).when(F.col("_over") > 0, -1).otherwise(1)
    return moved.withColumn("got", F.greatest(F.col("_got") + step, F.lit(0))).drop("_got", "_over", "_rank")


def shard_quotas(shards: DataFrame, seed: int = SEED) -> DataFrame:
    """How each shard's quota is taken: every block `every` times, and once more those whose
    seeded hash is at most `bar`; shards: (source, shard, words, block, quota)."""
    shards = shards.withColumn("_group", F.floor(F.col("shard") / SHARDS_GROUP))
    groups = shards.groupBy("source", "_group").agg(F.sum("words").alias("words"), F.first("quota").alias("quota"))
    given = _apportioned(groups, ["source"], "_group").select(F.col("source").alias("_s"), F.col("_group").alias("_g"), F.col("got").alias("quota"))
    split = shards.drop("quota").join(given, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_group") == F.col("_g"))).drop("_s", "_g")
    blocks = F.ceil(F.col("words") / F.col("block"))
    quota = _apportioned(split, ["source", "_group"], "shard").withColumn("_q", F.least("got", REPEATS * blocks))
    extra = F.pmod("_q", blocks)
    hashes = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: _block_hash(k, seed)))
    return quota.select(
        "source", "shard", F.floor(F.col("_q") / blocks).alias("every"), F.when(extra > 0, F.element_at(hashes, extra.cast("int"))).alias("bar")
    )


def seeded(*cols, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _block_hash(k: Column, seed: int) -> Column:
    return seeded(k, F.col("source"), F.col("shard"), seed=seed)


def mix(
    docs: DataFrame,
    blocks: tuple[int, ...] = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    shard_rows: int = SHARD_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, and how it is taken:
    `every` times whole, and once more its words in the ranges `once` ([start, end))."""
    sizes = checkpoint(docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("_text")))
    plan = source_plan(sizes, blocks)
    plan = F.broadcast(plan.coalesce(1)) if plan.count() <= BROADCAST_SOURCES else plan
    placed = sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_rows") / shard_rows))
    # A document without words takes nothing wherever it lies.
    place = F.when(F.col("size") > 0, seeded("doc_id", "_text", seed=seed)).otherwise(F.xxhash64(F.monotonically_increasing_id()))
    placed = placed.withColumn("shard", F.pmod(place, n_shards)).withColumn("_mix", seeded("doc_id", "_text", F.lit(1), seed=seed))
    key = ["source", "shard"]
    line = Window.partitionBy(*key).orderBy("_mix", "doc_id", "_text", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("_at", F.coalesce(F.sum("size").over(line), F.lit(0)))
    shards = placed.groupBy(*key).agg(F.sum("size").alias("words"), F.first("block").alias("block"), F.first("quota").alias("quota"))
    quotas = shard_quotas(shards.where("words > 0"), seed).withColumnRenamed("source", "_source").withColumnRenamed("shard", "_shard")
    joined = laid.join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")), "left")
    places = F.sequence(F.expr("_at DIV block"), F.expr("(_at + size - 1) DIV block"))
    chosen = F.when((F.col("size") > 0) & F.col("bar").isNotNull(), F.filter(places, lambda k: _block_hash(k, seed) <= F.col("bar")))
    ranges = joined.withColumn("_k", F.coalesce(chosen, F.array().cast("array<bigint>"))).withColumn(
        "once",
        F.expr("transform(_k, k -> named_struct('start', greatest(k * block - _at, 0L), 'end', least((k + 1) * block - _at, size)))"),
    )
    extra = F.aggregate("once", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    every = F.coalesce(F.col("every"), F.lit(0)).cast("long")
    return ranges.select(
        "doc_id", "source", "size", "source_size", "target",
        (every * F.col("size") + extra).alias("taken"), every.alias("every"), "once",
    )


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
