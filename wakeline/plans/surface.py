"""The read API: one method for each question, a DataFrame for each answer.

Tables are given by name as DataFrames (see each method for those it reads). Reads map ids
through aliases first; lists are keyset pages, newest first; the caller's role is checked
before anything is read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions import text, times
from wakeline.operators import filters, flow, governance, paging, quality, search, topics, topology
from wakeline.sources import logs


class Surface:
    def __init__(self, tables: Mapping[str, DataFrame], role: str = "viewer", secret: bytes = b"wakeline"):
        self.tables, self.role, self.secret = tables, role, secret

    def _read(self, name: str, permission: str = "view") -> DataFrame:
        filters.require(self.role, permission)
        return self.tables[name]

    def _page(self, rows: DataFrame, keys: list[str], size: int, cursor: str | None, request: dict) -> DataFrame:
        after = paging.from_cursor(cursor, request, self.secret) if cursor else None
        return paging.page(rows, keys, size, after)

    def cursor_after(self, row, keys: list[str], request: dict) -> str:
        """Cursor of the page after a row."""
        return paging.cursor(tuple(row[k] for k in keys), request, self.secret)

    # Channels.

    def _channels(self) -> DataFrame:
        """channels with counts of readers, writers and transmissions, crossing tally and listing."""
        channels, accesses, sent = self._read("channels"), self._read("accesses"), self._read("transmissions")
        aliases = self._read("channel_aliases")
        accesses, sent = topology.resolve(accesses, aliases, "channel"), topology.resolve(sent, aliases, "channel")
        counted = channels.join(flow.channel_counts(accesses, sent), "channel", "left").join(flow.crossing_tally(sent), "channel", "left")
        numbers = ["writers", "readers", "transmissions", "confirmed", "unconfirmed"]
        policy = governance.policy_now(self._read("policies"))
        return counted.fillna(0, numbers).withColumn("listing", flow.listing()).join(policy, "channel", "left").fillna("unreviewed", ["policy"])

    def channel(self, channel) -> DataFrame:
        return self._channels().where(F.col("channel") == channel)

    def channels(self, size: int = 50, cursor: str | None = None, **where) -> DataFrame:
        return self._page(self._channels().where(filters.channel_filter(**where)), ["created_at", "channel"], size, cursor, where)

    def channel_names(self, ids: DataFrame) -> DataFrame:
        """Names of a batch of channels, superseded ones under their successor's."""
        wanted = topology.resolve(ids.withColumn("asked", F.col("channel")), self._read("channel_aliases"), "channel")
        return wanted.join(self._read("channels").select("channel", "name"), "channel")

    def policy_history(self, channel) -> DataFrame:
        return governance.policy_history(self._read("policies"), channel)

    def channel_transmissions(self, channel, confirmed: bool | None = None, size: int = 50, cursor: str | None = None) -> DataFrame:
        cross = F.col("from") != F.col("to")
        rows = self._transmissions().where(cross & filters.transmission_filter(channels=(channel,), confirmed=confirmed))
        return self._page(rows, ["opened_at", "transmission"], size, cursor, {"channel": channel, "confirmed": confirmed})

    def channel_resources(self, channel, start: int, end: int, size: int = 50, cursor: str | None = None) -> DataFrame:
        """A page of a channel's resources used in a window, with accesses by agent and kind."""
        a = self._read("accesses").where(F.col("channel") == channel)
        inside = times.in_window("at", start, end)
        used = a.where(inside).select("resource").distinct()
        page = self._page(used, ["resource"], size, cursor, {"channel": channel, "start": start, "end": end})
        return flow.resource_use(a, page, inside)

    def promotion_preview(self, channel, kind: str, pattern: str) -> tuple[DataFrame, DataFrame]:
        """(effect, coverage) of a promotion, nothing being changed."""
        channels = self._read("channels", "govern")
        return flow.promotion(channels, channel, kind, pattern), flow.coverage(self._read("accesses"), kind, pattern)

    # Agents.

    def _agents(self) -> DataFrame:
        sums = self._transmissions().groupBy("from", "to").agg(F.count("*").alias("transmissions"), F.sum("bytes").alias("bytes"))
        return topology.agent_traffic(self._read("agents"), topology.nodes(sums))

    def agents(self, size: int = 50, cursor: str | None = None, **where) -> DataFrame:
        return self._page(self._agents().where(filters.agent_filter(**where)), ["created_at", "agent"], size, cursor, where)

    def agent(self, agent) -> DataFrame:
        """One agent with its traffic, and the ids merged into it."""
        merged = self._read("agent_aliases").where(F.col("canonical") == agent).agg(F.array_sort(F.collect_list("id")).alias("aliases"))
        return self._agents().where(F.col("agent") == agent).crossJoin(merged)

    def agent_names(self, ids: DataFrame) -> DataFrame:
        wanted = topology.resolve(ids.withColumn("asked", F.col("agent")), self._read("agent_aliases"), "agent")
        return wanted.join(self._read("agents").select("agent", "label"), "agent")

    # Conversations.

    def conversations(self, agent=None, size: int = 50, cursor: str | None = None, **where) -> DataFrame:
        rows = topology.resolve(self._read("conversations"), self._read("agent_aliases"), "agent").where(filters.conversation_filter(**where))
        rows = rows if agent is None else rows.where(F.col("agent") == agent)
        return self._page(rows, ["started_at", "conversation"], size, cursor, where | {"agent": agent})

    def conversation(self, conversation) -> DataFrame:
        """Head of a conversation: its row, turns, and successors."""
        next_ = self._read("conversations").where(F.col("parent") == conversation).agg(F.array_sort(F.collect_list("conversation")).alias("successors"))
        turns = self._read("turns").where(F.col("conversation") == conversation).agg(F.count("*").alias("turns"))
        return self._read("conversations").where(F.col("conversation") == conversation).crossJoin(turns).crossJoin(next_)

    def conversation_turns(self, conversation, first: int, count: int) -> DataFrame:
        """Turns of an index window, with how many matches start or end in each."""
        rows = self._read("turns", "content").where((F.col("conversation") == conversation) & F.col("turn").between(first, first + count - 1))
        m = self._read("matches")
        out = m.groupBy(F.col("origin_exchange").alias("exchange")).agg(F.count("*").alias("copied_from"))
        into = m.groupBy(F.col("reader_exchange").alias("exchange")).agg(F.count("*").alias("copied_into"))
        return rows.join(out, "exchange", "left").join(into, "exchange", "left").fillna(0, ["copied_from", "copied_into"])

    def exchange_turns(self, ids: DataFrame) -> DataFrame:
        return paging.by_ids(self._read("turns"), ids, "exchange")

    def conversation_text(self, conversation, first: int, count: int, most: int) -> DataFrame:
        """Bodies of a window of turns, each cut to `most` characters, its whole length told."""
        rows = self.conversation_turns(conversation, first, count).join(self._read("bodies", "content"), "message", "left")
        return rows.withColumns({"length": F.length("body"), "body": F.left("body", F.lit(most))})

    def part_text(self, message, start: int, end: int, around: int = 0) -> DataFrame:
        body = self._read("bodies", "content").where(F.col("message") == message)
        return body.select("message", text.excerpt("body", F.lit(start), F.lit(end), around).alias("excerpt"))

    # Provenance.

    def span_readers(self, span, size: int = 50, cursor: str | None = None) -> DataFrame:
        return self._page(self._read("matches").where(F.col("origin") == span), ["at", "match"], size, cursor, {"span": span})

    def span_points(self, ids: DataFrame) -> DataFrame:
        return paging.by_ids(self._read("spans"), ids, "span")

    def evidence(self, transmission) -> DataFrame:
        m = self._read("matches").where(F.col("transmission") == transmission)
        return flow.evidence(m, self._read("spans"), self._read("bodies", "content"))

    # Alerts and operations.

    def alert_rules(self, **where) -> DataFrame:
        return self._read("alert_rules").where(filters.rule_filter(**where)).orderBy(*paging.rules_order())

    def alert_rule(self, rule) -> DataFrame:
        return self._read("alert_rules").where(F.col("rule") == rule)

    def alerts(self, states=(), channels=(), size: int = 50, cursor: str | None = None) -> DataFrame:
        rows = filters.alert_filter(self._read("alerts"), self._read("channel_aliases"), states, channels)
        return self._page(rows, ["opened_at", "alert"], size, cursor, {"states": states, "channels": channels})

    def alert(self, alert) -> DataFrame:
        return self._read("alerts").where(F.col("alert") == alert)

    def audit(self, size: int = 50, cursor: str | None = None, **where) -> DataFrame:
        return self._page(self._read("audit_log", "govern").where(filters.audit_filter(**where)), ["at", "entry"], size, cursor, where)

    def operators(self) -> DataFrame:
        return self._read("operators", "operate").orderBy("operator")

    def me(self) -> dict:
        return {"role": self.role, "permissions": sorted(filters.PERMISSIONS.get(self.role, ()))}

    def sinks(self) -> DataFrame:
        return self._read("sinks", "operate").orderBy("sink")

    def dead_letters(self, size: int = 50, cursor: str | None = None) -> DataFrame:
        return self._page(self._read("dead_letters", "operate"), ["at", "id"], size, cursor, {})

    def live(self, after: int) -> DataFrame:
        return logs.changes(self._read("changes"), after)

    # Graphs and series.

    def _transmissions(self) -> DataFrame:
        rows = topology.resolve(self._read("transmissions"), self._read("agent_aliases"), "from", "to")
        return topology.resolve(rows, self._read("channel_aliases"), "channel")

    def _admitted(self, start, end, where: filters.TopologyFilter) -> DataFrame:
        rows = self._transmissions().where(times.in_window("opened_at", start, end)).where(F.col("from") != F.col("to"))
        rows = rows.join(quality.latest_verdicts(self._read("verdicts")), "transmission", "left")
        return rows.where(where.admits(verdict="verdict"))

    def topology(self, start, end, where: filters.TopologyFilter = filters.TopologyFilter()) -> tuple[DataFrame, DataFrame]:
        """(edges, nodes with ancestors) of a window."""
        keys = ["from", "to", "route"]
        sums = self._admitted(start, end, where).groupBy(*keys).agg(F.count("*").alias("transmissions"), F.sum("bytes").alias("bytes"))
        return topology.edges(sums, keys), topology.with_ancestors(topology.nodes(sums), self._read("agents").select("agent", "parent"))

    def channel_topology(self, start, end, where: filters.TopologyFilter = filters.TopologyFilter()) -> DataFrame:
        """Access edges of agents to channels, those whose channel carried an asked topic."""
        carried = topology.channel_topics(self._transmissions().where(times.in_window("opened_at", start, end)))
        rows = topology.resolve(self._read("accesses"), self._read("agent_aliases"), "agent").where(times.in_window("at", start, end))
        kept = rows.join(carried, "channel", "left").where(where.admits_access()).withColumn("accesses", F.lit(1))
        return topology.access_edges(kept)

    def overview(self, start, end) -> DataFrame:
        rows = self._admitted(start, end, filters.TopologyFilter()).withColumn("transmissions", F.lit(1))
        return topology.overview(rows).crossJoin(topology.queue(self._read("alerts"), self._channels()))

    def queue_channels(self) -> DataFrame:
        return topology.queue_channels(self._channels())

    def series(self, start: int, end: int, step: int, width: int, group: list[str], where: filters.TopologyFilter = filters.TopologyFilter()) -> DataFrame:
        times.check_grid(start, end, step, width)
        rows = self._admitted(start, end, where).withColumn("ts", F.timestamp_micros("opened_at").cast("timestamp_ntz"))
        return topology.series(rows, "ts", start, end, step, group, {"transmissions": F.count("*"), "bytes": F.sum("bytes")})

    def edge_transmissions(self, sender, reader, start, end, where: filters.TopologyFilter = filters.TopologyFilter(), size: int = 50, cursor: str | None = None) -> DataFrame:
        rows = self._admitted(start, end, where).where((F.col("from") == sender) & (F.col("to") == reader))
        return self._page(rows, ["opened_at", "transmission"], size, cursor, {"from": sender, "to": reader, "start": start, "end": end})

    def transmissions_by_id(self, ids: DataFrame) -> DataFrame:
        return paging.by_ids(self._transmissions(), ids, "transmission").join(quality.latest_verdicts(self._read("verdicts")), "transmission", "left")

    def transmission(self, transmission) -> DataFrame:
        return self._transmissions().where(F.col("transmission") == transmission)

    def verdicts(self, transmission) -> DataFrame:
        return self._read("verdicts").where(F.col("transmission") == transmission).orderBy("revision")

    def detection_quality(self, start, end) -> DataFrame:
        rows = self._admitted(start, end, filters.TopologyFilter()).join(quality.strongest_match(self._read("matches")), "transmission", "left")
        call = F.when(F.col("state") == "confirmed", F.concat_ws("/", F.lit("content"), F.col("class_rank").cast("string"), "carrier")).otherwise(F.col("state"))
        return quality.detection_quality(rows.withColumn("call", call), "route", "call")

    def present(self) -> DataFrame:
        """The clock and how long a window takes to settle."""
        clock = F.unix_micros(F.current_timestamp())
        return self._read("watermarks").limit(1).select(clock.alias("now"), F.lit(flow.Timing().settle_after).alias("settle_after"))

    def watermark(self) -> DataFrame:
        return self._read("watermarks").agg(F.max("through").alias("through"))

    # Topics and search.

    def topic_versions(self) -> DataFrame:
        return self._read("topic_versions").orderBy(F.desc("version"))

    def topics(self, version: int, size: int = 50, cursor: str | None = None) -> DataFrame:
        return self._page(self._read("topics").where(F.col("version") == version), ["topic"], size, cursor, {"version": version})

    def topic_sizes(self, pinned: int | None = None, window: Column | None = None) -> DataFrame:
        version = filters.resolve_version(self._read("topic_versions"), pinned)
        known = self._read("topics").where(F.col("version") == version)
        given = self._read("assignments").where(F.col("version") == version).select("transmission", "topic")
        rows = self._transmissions().where(F.col("from") != F.col("to")).drop("topic").join(given, "transmission")
        rows = rows if window is None else rows.where(window)
        return topics.sizes(known, rows, {"transmissions": F.count("*"), "bytes": F.sum("bytes")})

    def topic_lineage(self, version: int) -> DataFrame:
        return self._read("topic_lineage").where(F.col("version") == version)

    def search(self, mode: str, words: str = "", vector: list[float] | None = None, size: int = 50, after: tuple | None = None, where: Column | None = None) -> DataFrame:
        """Documents (id, body, vector) by text, vector or both; filters go before the ranking."""
        docs = self._read("search_docs", "content")
        docs = docs if where is None else docs.where(where)
        if mode == "text":
            return search.by_text(docs, words, size, after)
        if mode == "semantic":
            return search.by_vector(docs.where("vector IS NOT NULL"), vector, size, after)
        return search.by_both(docs, words, vector, size, after)

    def projections(self, size: int = 50, cursor: str | None = None) -> DataFrame:
        return self._page(self._read("projections"), ["requested_at", "projection"], size, cursor, {})

    def projection_status(self, projection) -> DataFrame:
        return self._read("projections").where(F.col("projection") == projection)

    def projection(self, projection) -> DataFrame:
        """Points of one stored frame."""
        return self._read("projection_points", "content").where(F.col("projection") == projection)

    def fit_projection(self, seed: str, most: int) -> DataFrame:
        """Layout of a seeded sample of embedded documents."""
        rows = self._read("search_docs", "content").where("vector IS NOT NULL").select("id", "vector")
        return topics.layout(paging.seeded_sample(rows, "id", seed, most))

    def export(self, data_set: str, path: str) -> dict:
        """Export of settled rows: those that the watermark has passed."""
        rows = self._read(data_set, "content")
        through = self.watermark().first()["through"]
        at = logs.EXPORT_ORDER[data_set][0]
        settled = rows if through is None or dict(rows.dtypes).get(at) not in ("bigint",) else rows.where(F.col(at) < through)
        return logs.export(settled, data_set, path)
