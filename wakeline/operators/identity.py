"""Who sent an exchange, and which conversation it continues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components

# How much each kind of evidence says, most specific highest; and which are strong.
SPECIFICITY = {
    "harness_agent": 5, "harness_session": 4, "account": 3, "stable_credential": 2, "prompt_fingerprint": 1,
    "rotating_credential": 0,
}
STRONG = ("harness_agent", "harness_session", "account", "stable_credential")


def specificity(kind="kind") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in SPECIFICITY.items() for x in pair]), F.col(kind))


def scope(account="account", credential="stable_credential", upstream="upstream") -> Column:
    """What harness ids are unique within."""
    return F.coalesce(account, credential, upstream)


def deciding(evidence: DataFrame) -> DataFrame:
    """The most specific items of each exchange: (exchange, kind, value)."""
    most = Window.partitionBy("exchange")
    return (
        evidence.withColumn("_s", specificity())
        .withColumn("_most", F.max("_s").over(most))
        .where(F.col("_s") == F.col("_most"))
        .drop("_s", "_most")
    )


def _open(agent_evidence: DataFrame) -> DataFrame:
    """Held evidence that counts: a session only points to agents without any harness-agent evidence."""
    known = agent_evidence.select("agent", "kind", "value")
    named = known.where("kind = 'harness_agent'").select("agent").distinct()
    return known.where("kind <> 'harness_session'").unionByName(known.where("kind = 'harness_session'").join(named, "agent", "left_anti"))


def holders(evidence: DataFrame, agent_evidence: DataFrame) -> DataFrame:
    """Agents that hold an exchange's deciding evidence."""
    return deciding(evidence).join(_open(agent_evidence), ["kind", "value"]).select("exchange", "agent", "kind").distinct()


def resolution(evidence: DataFrame, agent_evidence: DataFrame) -> DataFrame:
    """Per exchange: new, known, merge (two or more by strong evidence) or review (by weak).

    Whether there are none, one or more holders shows from the least and the greatest, so each
    item brings these two, however many agents hold it.
    """
    ends = _open(agent_evidence).groupBy("kind", "value").agg(F.min("agent").alias("least"), F.max("agent").alias("most")).where("least IS NOT NULL")
    held = deciding(evidence).join(ends, ["kind", "value"]).groupBy("exchange").agg(
        F.min("least").alias("agent"), F.max("most").alias("most"), F.max(F.col("kind").isin(*STRONG)).alias("strong")
    )
    outcome = (
        F.when(F.col("agent").isNull(), "new")
        .when(F.col("agent") == F.col("most"), "known")
        .when(F.col("strong"), "merge")
        .otherwise("review")
    )
    return evidence.select("exchange").distinct().join(held, "exchange", "left").select("exchange", "agent", outcome.alias("outcome"))


def established(agent_evidence: DataFrame) -> DataFrame:
    """Agents with two kinds of evidence or more, at least one of them strong."""
    return (
        agent_evidence.groupBy("agent")
        .agg(F.count_distinct("kind").alias("kinds"), F.max(F.col("kind").isin(*STRONG)).alias("strong"))
        .where("kinds >= 2 AND strong")
        .select("agent")
    )


def new_evidence(derived: DataFrame, held: DataFrame) -> DataFrame:
    """Evidence not held yet."""
    return derived.join(held, ["agent", "kind", "value"], "left_anti").distinct()


def merged_by_evidence(agent_evidence: DataFrame, vetoes: DataFrame) -> DataFrame:
    """Alias map (id, canonical) of agents that share strong evidence, vetoed pairs apart.

    agents and vetoes carry long ids. Sharers of one item are linked to its least holder,
    never to each other, so an item of many agents gives as many edges.
    """
    strong = agent_evidence.where(F.col("kind").isin(*STRONG)).select("agent", "kind", "value").distinct()
    least = strong.groupBy("kind", "value").agg(F.min("agent").alias("v"))
    edges = strong.join(least, ["kind", "value"]).where("agent <> v").select(F.col("agent").alias("u"), "v").distinct()
    cut = vetoes.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return components(edges.join(cut, ["u", "v"], "left_anti")).select(F.col("node").alias("id"), F.col("root").alias("canonical"))


def alias_map(merges: DataFrame) -> DataFrame:
    """(id, canonical) from a merge log (source, target, reverted), chains followed to their ends."""
    spark = merges.sparkSession
    merges.where("NOT reverted").select("source", "target").createOrReplaceTempView("_wakeline_merges")
    return spark.sql(
        "WITH RECURSIVE up(id, at, depth) AS (SELECT source, target, 1 FROM _wakeline_merges UNION ALL "
        "SELECT up.id, m.target, up.depth + 1 FROM up JOIN _wakeline_merges m ON up.at = m.source) "
        "SELECT id, max_by(at, depth) AS canonical FROM up GROUP BY id"
    )


def claims(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Latest time of each claim of an agent, over all its aliases."""
    side = aliases.select(F.col("id").alias("agent"), "canonical")
    return rows.join(side, "agent", "left").groupBy(F.coalesce("canonical", "agent").alias("agent"), "claim").agg(F.max("at").alias("at"))


def prompt_fingerprint(roles, texts) -> Column:
    """Digest of the system messages before the first user message, and that message."""
    first = F.array_position(roles, "user").cast("int")
    taken = F.filter(
        F.zip_with(roles, texts, lambda r, t: F.struct(r.alias("role"), t.alias("text"))),
        lambda m, i: ((m["role"] == "system") & (i + 1 < first)) | (i + 1 == first),
    )
    return F.when(first > 0, F.sha2(F.array_join(F.transform(taken, lambda m: m["text"]), "\u001f"), 256))


def prefixes(rows: DataFrame, key: str) -> DataFrame:
    """Every prefix of each history: (key, size, length, hash), hash being two 64-bit sums
    modulo 2 (exclusive or) of the digests of each message with its place.

    A running sum takes as many steps as a history has messages; chaining digests in an
    array would copy the array at each. Equal histories have equal hashes; that different ones
    differ rests on 128 bits and is not verified by their texts.
    """
    each = rows.select(key, F.size("history").alias("size"), F.posexplode("history").alias("i", "m"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    half = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "i", "m")).over(before)
    return each.select(key, "size", (F.col("i") + 1).alias("length"), F.struct(half("a").alias("a"), half("b").alias("b")).alias("hash"))


def longest_prefix(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """For each request the stored conversation with the longest shared prefix.

    requests: (request, history); stored: (conversation, history). Equal hashes mean equal
    prefixes, so the search is an equi-join; `whole` tells whether the conversation's entire
    history is that prefix.
    """
    r, s = prefixes(requests, "request").drop("size"), prefixes(stored, "conversation")
    # One conversation for each prefix is enough: one that ends there before any other, then the least.
    best = s.groupBy("hash", "length").agg(F.min_by(F.struct("conversation", "size"), F.struct(F.col("size"), F.col("conversation"))).alias("c"))
    hit = r.join(best, ["hash", "length"])
    found = hit.groupBy("request").agg(F.max_by(F.struct("c.conversation", "length", "c.size"), "length").alias("b"))
    return found.select("request", "b.conversation", "b.length", (F.col("b.length") == F.col("b.size")).alias("whole"))


def threading(found: DataFrame, requests: DataFrame) -> DataFrame:
    """extends, forks or starts, for every request; requests also say (assistant_within):
    the place of the first assistant message."""
    outcome = (
        F.when(F.col("whole"), "extends")
        .when(F.col("length") >= F.col("assistant_within"), "forks")
        .otherwise("starts")
    )
    return requests.join(found, "request", "left").withColumn("outcome", outcome)


def seen_elsewhere(inputs: DataFrame, history: DataFrame, retention: int) -> DataFrame:
    """Inputs that the agent did not see in another conversation within retention before.

    inputs: (agent, conversation, message, at); history the same. Both pass in order of time
    once: the newest sighting before an input counts if it is of another conversation, else
    the last one before the run of sightings that it ends, so a message seen very often is
    not compared with itself.
    """
    key, columns = ["agent", "message"], inputs.columns
    asked = inputs.select(*key, "conversation", "at", F.lit(0).alias("_kind"), F.struct(*columns).alias("_i"))
    known = history.select(*key, "conversation", "at", F.lit(1).alias("_kind")).distinct()
    before = Window.partitionBy(*key).orderBy("at", "_kind", "conversation").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("_kind") == 1, F.struct("conversation", "at"))
    rows = asked.unionByName(known, allowMissingColumns=True).withColumn("_last", F.last(seen, ignorenulls=True).over(before))
    begins = (F.col("_kind") == 1) & ~F.col("_last.conversation").eqNullSafe(F.col("conversation"))
    rows = rows.withColumn("_run", F.last(F.when(begins, F.struct(F.col("_last.at").alias("at"))), ignorenulls=True).over(before))
    elsewhere = F.when(F.col("_last.conversation") != F.col("conversation"), F.col("_last.at")).otherwise(F.col("_run.at"))
    kept = rows.where((F.col("_kind") == 0) & ~F.coalesce(elsewhere >= F.col("at") - retention, F.lit(False)))
    return kept.select("_i.*").select(*columns)


def turns(rows: DataFrame) -> DataFrame:
    """Turn numbers of a conversation in (ended_at, id) order, however rows arrived."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("conversation").orderBy("ended_at", "exchange")) - 1)


def rethreaded(stored: DataFrame, late: DataFrame) -> DataFrame:
    """Stored turns with late ones put where they belong: (conversation, exchange, ended_at, turn).

    stored: what `turns` gave; late: (conversation, exchange, ended_at), of which those already
    stored are left out. Only turns from a conversation's earliest late one on are numbered
    again, after the turns before it, so old history is not sorted.
    """
    key = F.struct("ended_at", "exchange")
    new = late.select("conversation", "exchange", "ended_at").distinct().join(stored.select("conversation", "exchange"), ["conversation", "exchange"], "left_anti")
    first = new.groupBy("conversation").agg(F.min(key).alias("_first"))
    marked = stored.join(first, "conversation", "left").withColumn("_moved", F.coalesce(key >= F.col("_first"), F.lit(False)))
    kept = marked.where("NOT _moved")
    moved = marked.where("_moved").select("conversation", "exchange", "ended_at").unionByName(new)
    base = kept.groupBy("conversation").agg((F.max("turn") + 1).alias("_base"))
    again = turns(moved).join(base, "conversation", "left")
    columns = ("conversation", "exchange", "ended_at")
    return kept.select(*columns, "turn").unionByName(again.select(*columns, (F.col("turn") + F.coalesce("_base", F.lit(0))).alias("turn")))


def role_runs(rows: DataFrame, key: str, order: str, role: str) -> DataFrame:
    """Maximal runs of one role: (key, run, role, first, last, messages)."""
    by = Window.partitionBy(key).orderBy(order)
    change = F.when(F.lag(role).over(by).eqNullSafe(F.col(role)), 0).otherwise(1)
    return (
        rows.withColumn("_c", change)
        .withColumn("run", F.sum("_c").over(by))
        .groupBy(key, "run", role)
        .agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("messages"))
    )
