"""The agent graph: buckets, edges, nodes, series, and the channel graph.

Facts keep the ids they were attributed to; aliases are resolved when read, a row whose
sender then is its reader counts nowhere, and only then are rows filtered and summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.vectors import share


#: Aliases are merges that operators made, one short row each; beyond this they are joined by shuffle.
BROADCAST_ALIASES = 200_000


def resolve(rows: DataFrame, aliases: DataFrame, *columns: str) -> DataFrame:
    """Map ids in columns through (id, canonical); ids without an alias stay."""
    small = aliases.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES
    for c in columns:
        side = aliases.select(F.col("id").alias(c), F.col("canonical").alias("_canonical"))
        rows = rows.join(F.broadcast(side) if small else side, c, "left")
        rows = rows.withColumn(c, F.coalesce("_canonical", c)).drop("_canonical")
    return rows


def admitted(rows: DataFrame, aliases: DataFrame | None = None, where: Column | None = None, sender: str = "from", reader: str = "to") -> DataFrame:
    """Resolve both ends, drop self-edges, then filter."""
    rows = rows if aliases is None else resolve(rows, aliases, sender, reader)
    rows = rows.where(F.col(sender) != F.col(reader))
    return rows if where is None else rows.where(where)


def buckets(rows: DataFrame, bucket: Column, keys: list[str], bytes_: str = "bytes") -> DataFrame:
    """Contributions summed per bucket and key."""
    return rows.groupBy(bucket.alias("bucket"), *keys).agg(
        F.count("*").alias("transmissions"), F.sum(bytes_).alias("bytes")
    )


def edges(rows: DataFrame, keys: list[str], weight: str = "transmissions") -> DataFrame:
    """Edge totals over bucket rows, with the share of all weight.

    The total is one row, joined back as such: a window over everything would gather all
    edges into one task.
    """
    summed = rows.groupBy(*keys).agg(F.sum("transmissions").alias("transmissions"), F.sum("bytes").alias("bytes"))
    total = rows.agg(F.sum(weight).alias("_total"))
    return summed.crossJoin(F.broadcast(total)).withColumn("share", share(F.col(weight).cast("double"), F.col("_total"))).drop("_total")


def without_false(rows: DataFrame, verdicts: DataFrame, key: str = "transmission") -> DataFrame:
    """Contributions whose latest verdict is not false."""
    wrong = verdicts.where("verdict = 'false'").select(key)
    return rows.join(wrong, key, "left_anti")


def subtracted(rows: DataFrame, false_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored sums less those of false detections; keys that reach zero go."""
    negative = false_rows.withColumns({"transmissions": -F.col("transmissions"), "bytes": -F.col("bytes")})
    both = rows.select(*keys, "transmissions", "bytes").unionByName(negative.select(*keys, "transmissions", "bytes"))
    return (
        both.groupBy(*keys)
        .agg(F.sum("transmissions").alias("transmissions"), F.sum("bytes").alias("bytes"))
        .where("transmissions > 0")
    )


def nodes(edge_rows: DataFrame, sender: str = "from", reader: str = "to") -> DataFrame:
    """Out and in sums of every end of an edge."""
    out = edge_rows.select(F.col(sender).alias("agent"), "transmissions", "bytes", F.lit(0).alias("_t"), F.lit(0).alias("_b"))
    into = edge_rows.select(F.col(reader).alias("agent"), F.lit(0), F.lit(0), F.col("transmissions"), F.col("bytes"))
    return out.union(into).groupBy("agent").agg(
        F.sum("transmissions").alias("sent"), F.sum("bytes").alias("sent_bytes"), F.sum("_t").alias("received"), F.sum("_b").alias("received_bytes")
    )


def with_ancestors(node_rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Nodes and all their ancestors; an ancestor without traffic has zeros.

    parents: (agent, parent). Expressed as a recursive query.
    """
    spark = node_rows.sparkSession
    node_rows.createOrReplaceTempView("_wakeline_nodes")
    parents.createOrReplaceTempView("_wakeline_parents")
    closed = spark.sql(
        "WITH RECURSIVE up(agent) AS (SELECT agent FROM _wakeline_nodes UNION ALL "
        "SELECT p.parent FROM up JOIN _wakeline_parents p ON up.agent = p.agent WHERE p.parent IS NOT NULL) "
        "SELECT DISTINCT agent FROM up"
    )
    sums = [c for c in node_rows.columns if c != "agent"]
    return closed.join(node_rows, "agent", "left").fillna(0, sums)


def overview(edge_rows: DataFrame) -> DataFrame:
    """One row of totals: transmissions, bytes, and distinct channels with traffic."""
    return edge_rows.agg(
        F.sum("transmissions").alias("transmissions"),
        F.sum("bytes").alias("bytes"),
        F.count_distinct(F.when(F.col("route") == "channel", F.col("channel"))).alias("active_channels"),
    )


def queue(alerts: DataFrame, channels: DataFrame) -> DataFrame:
    """One row: open alerts, channels without review, channels without confirmation."""
    a = alerts.agg(F.count_if(F.col("state") == "open").alias("open_alerts"))
    c = channels.agg(
        F.count_if(F.col("policy") == "unreviewed").alias("unreviewed"),
        F.count_if(F.col("listing") == "unconfirmed").alias("unconfirmed"),
    )
    return a.crossJoin(c)


def queue_channels(channels: DataFrame) -> DataFrame:
    """Channels in either queue, once each."""
    unreviewed = channels.where("policy = 'unreviewed'")
    return unreviewed.unionByName(channels.where("listing = 'unconfirmed'")).dropDuplicates(["channel"])


def agent_traffic(agents: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Traffic of listed agents, zero where there is none."""
    sums = [c for c in node_rows.columns if c != "agent"]
    return agents.join(node_rows, "agent", "left").fillna(0, sums)


def access_edges(accesses: DataFrame, weight: str = "accesses") -> DataFrame:
    """(agent, channel, op) sums of accesses with their share."""
    summed = accesses.groupBy("agent", "channel", "op").agg(F.sum(weight).alias(weight))
    total = accesses.agg(F.sum(weight).alias("_total"))
    return summed.crossJoin(F.broadcast(total)).withColumn("share", share(F.col(weight).cast("double"), F.col("_total"))).drop("_total")


def channel_topics(contributions: DataFrame) -> DataFrame:
    """Distinct topics of each channel, self-edges included."""
    return contributions.where("route = 'channel'").groupBy("channel").agg(F.array_sort(F.collect_set("topic")).alias("topics"))


def series(rows: DataFrame, ts: str, start: int, end: int, step: int, groups: list[str], values: dict[str, Column]) -> DataFrame:
    """Zero-filled values per step for every group with traffic in [start, end), in
    microseconds. The grid has at most 10,000 points (see `check_grid`)."""
    spark = rows.sparkSession
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    inside = rows.where((F.col(ts) >= F.timestamp_micros(F.lit(start)).cast("timestamp_ntz")) & (F.col(ts) < F.timestamp_micros(F.lit(end)).cast("timestamp_ntz")))
    found = inside.groupBy(*groups, ((us - start) / step).cast("long").alias("point")).agg(*[v.alias(k) for k, v in values.items()])
    grid = F.broadcast(spark.range((end - start) // step).withColumnRenamed("id", "point"))
    keyed = found.select(*groups).distinct().crossJoin(grid) if groups else grid
    return keyed.join(found, [*groups, "point"], "left").fillna(0, list(values))


def top_edges(edge_rows: DataFrame, weight: str, most: int) -> DataFrame:
    """The heaviest edges in a total order."""
    return edge_rows.orderBy(F.desc(weight), "from", "to").limit(most)


def latest(rows: DataFrame, key: str, order: list, columns: list[str]) -> DataFrame:
    """Newest row of each key from an append-only log."""
    picked = F.max_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy(key).agg(picked.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def kept_versions(versions: DataFrame, keep_last: int) -> DataFrame:
    """Versions retained: the newest active ones, pinned ones, and any newer than those."""
    rank = F.row_number().over(Window.orderBy(F.col("activated").cast("int").desc(), F.desc("version")))
    ranked = versions.withColumn("_rank", rank)
    oldest = versions.where("activated").agg(F.max("version").alias("_newest"))
    return ranked.crossJoin(oldest).where(
        (F.col("activated") & (F.col("_rank") <= keep_last)) | F.col("pinned") | (F.col("version") > F.col("_newest"))
    ).drop("_rank", "_newest")
