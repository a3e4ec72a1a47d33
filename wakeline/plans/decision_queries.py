"""Filters, alert rules, operators' decisions, match precision and small functions on the supplied tables.

Parts stand for channels, order lines for transmissions, suppliers for agents and
conversation turns for exchanges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import jsons, text, times, urls
from wakeline.operators import alerts, filters, flow, governance, identity, paging, provenance, quality, topics, topology
from wakeline.sources import exchanges, logs
from wakeline.sources.storage import table

from .standins import ACCESSES, ALIASES, CONTRIBUTIONS, accesses, aliases, contributions


def _case(column: str, *values: str | None) -> str:
    """SQL that both engines read: one of the values by remainder."""
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)) + " END"


CHANNEL = f"""p_partkey AS channel, {_case('p_size', 'discovered', 'declared', 'superseded')} AS origin,
  {_case('p_size', 'unreviewed', 'sanctioned', 'unsanctioned', None)} AS policy, {_case('p_size', 'confirmed', 'unconfirmed')} AS listing,
  {_case('p_size', 'active', 'unused', 'dormant', 'active', 'active')} AS detection,
  concat('https://h', p_partkey % 7, '/docs/', p_size, '/', p_partkey) AS url, p_partkey * 1000 AS at"""
STATE = _case("transmission", "suspected", "confirmed", "retracted", "confirmed", "suspected")
# Lines of one order repeat their number; a revision is one line's.
REVISION = "(l_linenumber + 8 * (l_suppkey + 10000000 * l_partkey))"
CHANNELS = f"channels AS (SELECT {CHANNEL} FROM part)"
TRANSMISSIONS = f"{CONTRIBUTIONS}, transmissions AS (SELECT *, {STATE} AS state FROM contributions)"
ALERT = f"""transmission AS alert, transmission, channel, {_case('bytes', 'open', 'acknowledged', 'resolved', 'suppressed')} AS state"""


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_parts(CHANNEL))


def _parts(listed: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth = [""], 0
    for c in listed:
        depth += (c == "(") - (c == ")")
        out = [*out, ""] if c == "," and not depth else [*out[:-1], out[-1] + c]
    return out


def _transmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributions(spark, sf_dir).withColumn("state", F.expr(STATE))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributions(spark, sf_dir).selectExpr(*_parts(ALERT))


def filtered_transmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transmissions admitted by agents, channels, routes and topics, in a window, by state."""
    graph = filters.TopologyFilter(agents=(3, 7, 11), channels=tuple(range(0, 50, 2)), route_kinds=("direct",), topics=("1-URGENT", "2-HIGH"))
    start, end = F.to_timestamp(F.lit("1995-01-01")), F.to_timestamp(F.lit("1997-01-01"))
    rows = _transmissions(spark, sf_dir).where(graph.admits()).where(times.in_window("at", start, end))
    return rows.where(filters.transmission_filter(states=("suspected", "confirmed"), confirmed=False)).select("transmission", "from", "to", "state")


FILTERED_TRANSMISSIONS = f"""
WITH {TRANSMISSIONS} SELECT transmission, "from", "to", state FROM transmissions
WHERE ("from" IN (3, 7, 11) OR "to" IN (3, 7, 11)) AND channel % 2 = 0 AND route = 'direct' AND topic IN ('1-URGENT', '2-HIGH')
AND "at" >= TIMESTAMP '1995-01-01' AND "at" < TIMESTAMP '1997-01-01' AND state = 'suspected'"""


def filtered_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses of channels that carried a topic, by agent and operation."""
    carried = topology.channel_topics(contributions(spark, sf_dir).where("bytes > 45 AND topic IN ('1-URGENT', '5-LOW')"))
    rows = accesses(spark, sf_dir).withColumn("channel", F.col("resource") % 50).join(carried, "channel", "left")
    graph = filters.TopologyFilter(agents=tuple(range(40)), topics=("1-URGENT",))
    return rows.where(graph.admits_access()).groupBy("agent", "channel", "op").agg(F.count("*").alias("accesses"))


FILTERED_ACCESSES = f"""
WITH {CONTRIBUTIONS}, {ACCESSES}, carried AS (SELECT DISTINCT channel FROM contributions WHERE bytes > 45 AND topic = '1-URGENT' AND route = 'channel')
SELECT agent, resource % 50 AS channel, op, count(*) AS accesses FROM accesses
WHERE agent < 40 AND resource % 50 IN (SELECT channel FROM carried) GROUP BY ALL"""


def filtered_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = filters.channel_filter(origins=("discovered", "declared"), listings=("confirmed",), detections=("active", "dormant"), policies=("unreviewed", "unsanctioned"))
    return _channels(spark, sf_dir).where(where).select("channel", "origin", "policy", "detection")


FILTERED_CHANNELS = f"""
WITH {CHANNELS} SELECT channel, origin, policy, detection FROM channels WHERE origin IN ('discovered', 'declared') AND listing = 'confirmed'
AND detection IN ('active', 'dormant') AND policy IN ('unreviewed', 'unsanctioned')"""


def filtered_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents by state, family and label, with traffic, zero where there is none."""
    agents = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS agent_no", "concat('agent-', s_suppkey) AS agent", "s_name AS label", f"{_case('s_suppkey', 'active', 'idle', 'retired')} AS state",
        "array(concat('fam', s_nationkey % 4), concat('fam', s_nationkey % 3)) AS claims", "s_nationkey AS parent",
    )
    kept = agents.where(filters.agent_filter(states=("active", "idle"), families=("fam1", "fam3"), parents=tuple(range(20)), text="7"))
    sums = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_suppkey").alias("agent")).agg(F.count("*").alias("received"))
    listed = kept.select(F.col("agent_no").alias("agent"), "label", "state")
    by_id = agents.where(filters.agent_filter(text="AGENT-1")).select(F.col("agent_no").alias("agent"), "label", F.lit("by id").alias("state"))
    return topology.agent_traffic(listed.unionByName(by_id), sums)


FILTERED_AGENTS = f"""
WITH a AS (SELECT s_suppkey AS agent, s_name AS label, {_case('s_suppkey', 'active', 'idle', 'retired')} AS state, s_nationkey AS n FROM supplier),
kept AS (
  SELECT agent, label, state FROM a WHERE state IN ('active', 'idle') AND (n % 4 IN (1, 3) OR n % 3 = 1) AND n < 20 AND contains(label, '7')
  UNION ALL SELECT agent, label, 'by id' FROM a WHERE 'agent-' || agent LIKE 'agent-1%'),
t AS (SELECT l_suppkey AS agent, count(*) AS received FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT agent, label, state, coalesce(received, 0) AS received FROM kept LEFT JOIN t USING (agent)"""


def filtered_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts by state and channel of record, whose subject still shows."""
    named = filters.alert_filter(_alerts(spark, sf_dir), aliases(spark), states=("open", "acknowledged"), channels=(10, 12, 30, 31, 32))
    hidden = spark.createDataFrame([(31,)], "channel int")
    return filters.shown(named, hidden, _transmissions(spark, sf_dir).where("state = 'retracted'").select("transmission")).select("alert", "channel", "state")


FILTERED_ALERTS = f"""
WITH {TRANSMISSIONS}, {ALIASES}, alerts AS (SELECT {ALERT} FROM transmissions)
SELECT alert, channel, state FROM alerts LEFT JOIN aliases ON channel = id
WHERE state IN ('open', 'acknowledged') AND coalesce(canonical, channel) IN (10, 12, 30, 31, 32) AND channel <> 31
AND alert NOT IN (SELECT transmission FROM transmissions WHERE state = 'retracted')"""


def crossing_transmissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels by transmissions of which some writer is not the reader, after aliases."""
    rows = topology.resolve(contributions(spark, sf_dir), aliases(spark), "from", "to")
    crossed = rows.withColumn("writers", F.array(F.col("from"), F.col("channel") % 25)).where(filters.crossing())
    return crossed.groupBy("channel").agg(F.count("*").alias("crossings"))


CROSSING_TRANSMISSIONS = f"""
WITH {CONTRIBUTIONS}, {ALIASES}, r AS (
  SELECT channel, coalesce(a.canonical, c."from") AS f, coalesce(b.canonical, c."to") AS t
  FROM contributions c LEFT JOIN aliases a ON c."from" = a.id LEFT JOIN aliases b ON c."to" = b.id)
SELECT channel, count(*) AS crossings FROM r WHERE f <> t OR channel % 25 <> t GROUP BY channel"""


def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators' actions with their outcome by permission, in a window and on a subject."""
    action = _case("o_orderkey", "set_verdict", "set_policy", "merge_agents", "create_rule")
    intents = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS intent", "o_custkey % 9 AS author", f"{action} AS action", "o_orderkey * 60 AS at", "array(concat('s', o_custkey % 3), concat('c', o_custkey % 5)) AS subjects"
    )
    roles = table(spark, sf_dir, "nation").where("n_nationkey < 8").selectExpr("n_nationkey AS author", f"{_case('n_nationkey', 'viewer', 'analyst', 'operator', 'governor')} AS role")
    log = governance.audited(intents, roles).where(filters.audit_filter(start=6_000, end=600_000, authors=(1, 2, 3, 8), subject="s1"))
    left = governance.interrupted(log.where("outcome = 'allowed'"), table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").selectExpr("o_orderkey AS intent"))
    return log.join(left.select("intent", F.lit(True).alias("interrupted")), "intent", "left").select("intent", "author", "action", "outcome", F.coalesce("interrupted", F.lit(False)).alias("interrupted"))


AUDIT_TRAIL = f"""
WITH i AS (
  SELECT o_orderkey AS intent, o_custkey % 9 AS author, {_case('o_orderkey', 'set_verdict', 'set_policy', 'merge_agents', 'create_rule')} AS action,
    CASE WHEN o_custkey % 9 < 8 THEN o_custkey % 9 % 4 END AS role
  FROM orders WHERE o_orderkey * 60 >= 6000 AND o_orderkey * 60 < 600000 AND o_custkey % 3 = 1 AND o_custkey % 9 IN (1, 2, 3, 8)),
o AS (
  SELECT intent, author, action, CASE WHEN role = 3 OR (role = 2 AND action IN ('set_verdict', 'merge_agents')) THEN 'allowed' ELSE 'forbidden' END AS outcome FROM i)
SELECT *, outcome = 'allowed' AND intent % 7 = 0 AS interrupted FROM o"""


def filtered_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", f"{_case('conv_id', 'root', 'continued', 'forked')} AS origin", "turn > 1 AS replayed")
    kept = rows.where(filters.conversation_filter(origins=("continued", "forked"), replayed=True))
    rules = kept.selectExpr("conv_id", "turn", f"{_case('turn', 'evaluating', 'paused')} AS status", "conv_id % 4 = 1 AS stale")
    return rules.where(filters.rule_filter(statuses=("paused",), stale=False)).select("conv_id", "turn")


FILTERED_CONVERSATIONS = """
SELECT conv_id, turn FROM conversations WHERE conv_id % 3 IN (1, 2) AND turn > 1 AND turn % 2 = 1 AND conv_id % 4 <> 1"""


def alert_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the seven rules raise, together."""
    c, t = _channels(spark, sf_dir), _transmissions(spark, sf_dir).withColumn("at", F.unix_micros(F.col("at").cast("timestamp")))
    watched = spark.createDataFrame([("3-MEDIUM",)], "topic string")
    docs = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS transmission", "embedding AS vector", "vec_id AS at")
    query = [1.0 / 8] * 64
    found = alerts.evaluated(
        alerts.new_channel(c), alerts.policy_traffic(c), alerts.sanctioned_unused(c), alerts.suspected(t),
        alerts.watched_topic(t, watched), alerts.semantic_query(docs, query, 0.1),
    )
    return found.groupBy("rule", "subject").agg(F.count("*").alias("findings"), F.max("at").alias("last_at"))


ALERT_FINDINGS = f"""
WITH {CHANNELS}, {TRANSMISSIONS}, t AS (SELECT *, epoch_us("at"::TIMESTAMP) AS us FROM transmissions),
f AS (
  SELECT 'new_channel' AS rule, channel AS s, "at" AS us FROM channels WHERE origin = 'discovered'
  UNION ALL SELECT 'unreviewed_traffic', channel, "at" FROM channels WHERE policy = 'unreviewed'
  UNION ALL SELECT 'unsanctioned_traffic', channel, "at" FROM channels WHERE policy = 'unsanctioned'
  UNION ALL SELECT 'sanctioned_unused', channel, "at" FROM channels WHERE policy = 'sanctioned' AND detection IN ('unused', 'dormant')
  UNION ALL SELECT 'suspected_transmission', transmission, us FROM t WHERE state = 'suspected'
  UNION ALL SELECT 'watched_topic', transmission, us FROM t WHERE topic = '3-MEDIUM'
  UNION ALL SELECT 'semantic_query', vec_id, vec_id FROM embeddings WHERE list_sum(embedding::DOUBLE[]) / 8 >= 0.1)
SELECT rule, s::VARCHAR AS subject, count(*) AS findings, max(us) AS last_at FROM f GROUP BY ALL"""


def alert_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts after channels were sanctioned, a rule disabled and subjects judged false."""
    raised = _alerts(spark, sf_dir).selectExpr("alert", "cast(channel AS string) AS subject", f"{_case('alert', 'new_channel', 'watched_topic', 'semantic_query')} AS rule", "state")
    sanctioned = _channels(spark, sf_dir).where("policy = 'sanctioned' AND channel < 50").select("channel")
    off = spark.createDataFrame([("semantic_query",)], "rule string")
    rejected = spark.createDataFrame([("7",), ("8",), ("7",)], "subject string")
    return alerts.suppressed(raised, sanctioned, off, rejected).select("alert", "state", alerts.may_resolve(F.col("state")).alias("may_resolve"))


ALERT_SUPPRESSION = f"""
WITH {TRANSMISSIONS}, {CHANNELS}, a AS (SELECT {ALERT} FROM transmissions),
s AS (
  SELECT alert, CASE WHEN state IN ('open', 'acknowledged') AND (alert % 3 = 2 OR channel IN (7, 8) OR channel IN
    (SELECT channel FROM channels WHERE policy = 'sanctioned')) THEN 'suppressed' ELSE state END AS state FROM a)
SELECT *, state = 'acknowledged' AS may_resolve FROM s"""


def verdict_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts to append: those that differ from the latest, with their next revision."""
    log = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS transmission", f"{REVISION} AS revision", f"{_case('cast(l_quantity AS bigint)', 'genuine', 'false', None)} AS verdict")
    wanted = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS transmission", f"{_case('o_custkey', 'genuine', 'false')} AS verdict")
    return governance.verdicts_to_append(log, wanted)


VERDICT_APPENDS = f"""
WITH log AS (SELECT l_orderkey AS transmission, {REVISION} AS revision, {_case('l_quantity::BIGINT', 'genuine', 'false', None)} AS verdict FROM lineitem),
newest AS (SELECT transmission, revision, verdict FROM log QUALIFY row_number() OVER (PARTITION BY transmission ORDER BY revision DESC) = 1),
wanted AS (SELECT o_orderkey AS transmission, {_case('o_custkey', 'genuine', 'false')} AS verdict FROM orders)
SELECT transmission, w.verdict, coalesce(revision, 0) + 1 AS revision FROM wanted w LEFT JOIN newest n USING (transmission) WHERE w.verdict IS DISTINCT FROM n.verdict"""


def channel_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effect on discovered channels of promoting one to a pattern."""
    rows = _channels(spark, sf_dir).withColumn("channel", F.col("channel").cast("string"))
    return flow.promotion(rows, "0", "path_prefix", "/docs/12").select("channel", "new_origin", "superseded_by")


CHANNEL_PROMOTION = f"""
WITH {CHANNELS}, h AS (SELECT channel::VARCHAR AS channel, origin, url LIKE 'https://h_/docs/12/%' AND origin = 'discovered' AND channel <> 0 AS goes FROM channels)
SELECT channel, CASE WHEN channel = '0' THEN 'declared' WHEN goes THEN 'superseded' ELSE origin END AS new_origin, CASE WHEN goes THEN '0' END AS superseded_by FROM h"""


def pattern_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources that each of several patterns covers and leaves out, and whether it overlaps the first."""
    urls_ = _channels(spark, sf_dir).select("url")
    patterns = [("host", "h3"), ("url_prefix", "https://h1/docs/1"), ("path_prefix", "/docs/12"), ("exact", "https://h0/docs/11/0")]
    out = None
    for kind, pattern in patterns:
        meets = urls.overlap(F.lit(kind), F.lit(pattern), F.lit("path_prefix"), F.lit("/docs"))
        rows = flow.coverage(urls_, kind, pattern).select(F.lit(kind).alias("kind"), "covered", "resources", meets.alias("overlaps"))
        out = rows if out is None else out.unionByName(rows)
    return out


PATTERN_COVERAGE = f"""
WITH {CHANNELS}, u AS (SELECT DISTINCT url FROM channels), k AS (
  SELECT 'host' AS kind, url LIKE 'https://h3/%' AS covered FROM u UNION ALL SELECT 'url_prefix', url LIKE 'https://h1/docs/1/%' FROM u
  UNION ALL SELECT 'path_prefix', url LIKE 'https://h_/docs/12/%' FROM u UNION ALL SELECT 'exact', url = 'https://h0/docs/11/0' FROM u)
SELECT kind, covered, count(*) AS resources, kind = 'path_prefix' AS overlaps FROM k GROUP BY ALL"""


PATTERNS = (("a", "host", "h3"), ("b", "url_prefix", "https://h1/docs/1"), ("c", "path_prefix", "/docs/12"), ("d", "exact", "https://h0/docs/11/0"), ("e", "path_prefix", "/docs/13/"), ("f", "host", "h5"))


def channel_of_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses of URLs with their channel: a declared pattern first, then a discovery."""
    rows = _channels(spark, sf_dir).select("url", F.col("channel").alias("resource"))
    found = _channels(spark, sf_dir).where("origin = 'discovered'").selectExpr("channel AS resource", "concat('found-', channel) AS channel")
    patterns = spark.createDataFrame(PATTERNS, "channel string, kind string, pattern string")
    return flow.channel_of(rows, patterns, found).select("resource", "channel")


CHANNEL_OF_RECORD = f"""
WITH {CHANNELS} SELECT channel AS resource, CASE WHEN url LIKE 'https://h3/%' THEN 'a' WHEN url LIKE 'https://h1/docs/1/%' THEN 'b' WHEN url LIKE 'https://h_/docs/12/%' THEN 'c'
  WHEN url = 'https://h0/docs/11/0' THEN 'd' WHEN url LIKE 'https://h_/docs/13/%' THEN 'e' WHEN url LIKE 'https://h5/%' THEN 'f'
  WHEN origin = 'discovered' THEN 'found-' || channel END AS channel FROM channels"""


def turn_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn numbers of conversations whose turns arrive in any order."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id AS conversation", "turn AS exchange", "(turn * 7) % 5 * 1000 + turn AS ended_at")
    return identity.turns(rows).select("conversation", "exchange", F.col("turn").cast("long").alias("turn"))


TURN_ORDER = """
SELECT conv_id AS conversation, turn AS exchange, row_number() OVER (PARTITION BY conv_id ORDER BY (turn * 7) % 5 * 1000 + turn, turn) - 1 AS turn FROM conversations"""


def json_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by pointer, the first present key, string pairs, and the canonical form."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"b": [1.50, {"x/y": "'), "event_type", F.lit('"}], "a": '), F.get_json_object("props", "$.k"), F.lit("}")).alias("args"))
    return e.where("args IS NOT NULL").select(
        "event_id", jsons.pointer("args", "/b/1/x~1y").alias("kind"), jsons.first_of("args", ["z", "a"]).alias("first"),
        F.size(jsons.string_values("args")).alias("pairs"), jsons.canonical_json("args").alias("canonical"),
    )


JSON_ARGUMENTS = """
SELECT event_id, event_type AS kind, props->>'$.k' AS first, 2 AS pairs, '{"a":' || (props->>'$.k') || ',"b":[1.5,{"x/y":"' || event_type || '"}]}' AS canonical
FROM events WHERE props->>'$.k' IS NOT NULL"""


VERSION_ACTIONS = {"1-URGENT": "begin", "2-HIGH": "complete", "3-MEDIUM": "fail", "4-NOT SPECIFIED": "activate", "5-LOW": "drop"}


def version_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of topic versions from a log of what was done to them."""
    action = F.element_at(F.create_map(*[F.lit(x) for pair in VERSION_ACTIONS.items() for x in pair]), F.col("o_orderpriority"))
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin(*VERSION_ACTIONS))
    log = o.select((F.col("o_orderkey") % 101).alias("version"), action.alias("action"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    return topics.version_states(log)


VERSION_CATALOGUE = """
WITH o AS (SELECT o_orderkey % 101 AS version, o_orderdate AS since, o_orderkey AS id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'fitting' WHEN '2-HIGH' THEN 'ready' WHEN '3-MEDIUM' THEN 'failed' WHEN '5-LOW' THEN 'dropped' ELSE 'active' END AS state FROM orders),
l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY version ORDER BY since DESC, id DESC) = 1)
SELECT version, since, CASE WHEN state = 'active' AND (since, id) < (SELECT max((since, id)) FROM l WHERE state = 'active') THEN 'superseded' ELSE state END AS state FROM l"""


def late_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of customers' orders, every seventh of which arrives late, some twice."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("conversation"), F.col("o_orderkey").alias("exchange"), F.col("o_orderdate").alias("ended_at"))
    on_time, late = o.where("exchange % 7 <> 0"), o.where("exchange % 7 = 0 OR exchange % 11 = 0")
    return identity.rethreaded(identity.turns(on_time), late)


LATE_TURNS = """
SELECT o_custkey AS conversation, o_orderkey AS exchange, o_orderdate AS ended_at,
       (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS turn FROM orders"""


def canonical_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a provider's content, one kind of block for each seventh turn, and their canonical parts."""
    k = (F.col("conv_id") + F.col("turn")) % 7
    mark = F.struct(F.lit("ephemeral").alias("type")).alias("cache_control")
    block = lambda kind, *cs: F.to_json(F.struct(F.lit(kind).alias("type"), *cs))
    ident = F.col("conv_id").cast("string")
    body = (
        F.when(k == 0, block("text", F.col("text"), mark))
        .when(k == 1, block("thinking", F.col("text").alias("thinking"), F.lit("s").alias("signature")))
        .when(k == 2, block("tool_use", ident.alias("id"), F.lit("Read").alias("name"), F.struct(F.col("turn").alias("a")).alias("input")))
        .when(k == 3, block("tool_result", ident.alias("tool_use_id"), F.col("role").alias("content"), (F.col("turn") % 2 == 1).alias("is_error"), mark))
        .when(k == 4, block("server_tool_use", ident.alias("id"), F.lit("search").alias("name"), F.struct(F.col("role").alias("q")).alias("input")))
        .when(k == 5, block("text", F.col("turn"), mark))
        .otherwise(block("search_tool_result", ident.alias("tool_use_id"), F.col("role").alias("content")))
    )
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND role IS NOT NULL")
    parts = exchanges.canonical_parts(F.concat(F.lit("["), body, F.lit("]")))
    found = turns.select("conv_id", "turn", F.explode(parts).alias("p")).select("conv_id", "turn", F.col("p.type").alias("kind"), "p.call_id", "p.name", "p.arguments", "p.outcome", F.md5("p.text").alias("text_md5"))
    return found.fillna("-")


CANONICAL_BLOCKS = """
WITH t AS (SELECT *, (conv_id + turn) % 7 AS k FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)
SELECT conv_id, turn, ['text', 'reasoning', 'tool_call', 'tool_result', 'server_call', 'unknown', 'server_result'][k + 1] AS kind,
  CASE WHEN k IN (2, 3, 4, 6) THEN conv_id::VARCHAR ELSE '-' END AS call_id, CASE k WHEN 2 THEN 'Read' WHEN 4 THEN 'search' ELSE '-' END AS name,
  CASE k WHEN 2 THEN '{"a":' || turn || '}' WHEN 4 THEN '{"q":"' || role || '"}' ELSE '-' END AS arguments,
  CASE WHEN k = 6 OR (k = 3 AND turn % 2 = 0) THEN 'success' WHEN k = 3 THEN 'error' ELSE '-' END AS outcome,
  coalesce(md5(CASE WHEN k < 2 THEN text WHEN k IN (3, 6) THEN role WHEN k = 5 THEN '{"type":"text","turn":' || turn || '}' END), '-') AS text_md5
FROM t"""


def argument_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of the strings in a call's arguments, with the key each is under."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND role IS NOT NULL")
    first = F.regexp_replace(F.col("text"), r'[\x00-\x1F"\\]', " ")
    args = F.concat(F.lit('{"é": "'), first, F.lit('", "n": 1, "list": ["'), F.col("role"), F.lit('", "\\"x", ""], "o": {"in" : "y"}}'))
    return c.select("conv_id", "turn", F.explode(jsons.string_ranges(args)).alias("r")).select("conv_id", "turn", "r.key", F.col("r.start").alias("first"), F.col("r.end").alias("last"))


ARGUMENT_RANGES = """
WITH t AS (SELECT conv_id, turn, strlen(regexp_replace(text, '[\\x00-\\x1F"\\\\]', ' ', 'g')) AS n, strlen(role) AS r FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL)
SELECT conv_id, turn, key, (a)::INT AS first, (a + w)::INT AS last FROM (
  SELECT conv_id, turn, unnest(['é', 'list', 'list', 'in']) AS key, unnest([8, 29 + n, 33 + n + r, 58 + n + r]) AS a, unnest([n, r, 3, 1]) AS w FROM t) WHERE w > 0"""


def match_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest class, carrier and bytes of each transmission's matches."""
    found = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS transmission", "l_partkey % 4 AS class_rank", "l_returnflag AS carrier", f"{REVISION} AS ordinal", "cast(l_quantity AS bigint) AS matched_bytes")
    return quality.strongest_match(found)


MATCH_PRECISION = f"""
WITH m AS (SELECT l_orderkey AS transmission, l_partkey % 4 AS class_rank, l_returnflag AS carrier, {REVISION} AS ordinal, l_quantity::BIGINT AS b FROM lineitem)
SELECT transmission, min(class_rank) AS class_rank, arg_min(carrier, (class_rank, ordinal)) AS carrier, sum(b)::BIGINT AS matched_bytes FROM m GROUP BY 1"""


def shadowed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short matches within the extent of an agent that is present in the layer."""
    found = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS layer", "l_suppkey % 5 AS agent", "l_partkey % 100 AS start", "l_partkey % 100 + cast(l_quantity AS bigint) * 2 AS end", "l_linenumber = 7 AS rare"
    )
    return provenance.shadowed(found)


SHADOWED_MATCHES = """
WITH f AS (SELECT l_orderkey AS layer, l_suppkey % 5 AS agent, l_partkey % 100 AS s, l_partkey % 100 + l_quantity::BIGINT * 2 AS e, l_linenumber = 7 AS rare FROM lineitem),
p AS (SELECT layer, agent, min(s) AS low, max(e) AS high, sum(e - s) AS covered, max(e - s) AS longest, bool_or(rare) AS rare FROM f GROUP BY ALL)
SELECT DISTINCT a.layer, a.agent FROM p a JOIN p b ON a.layer = b.layer AND a.agent <> b.agent
WHERE a.longest < 64 AND NOT a.rare AND b.longest >= 64 AND a.low >= b.low AND a.high <= b.high AND a.covered < b.covered"""


def skeleton_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short matches on widely held grams without a token rare enough."""
    line = table(spark, sf_dir, "lineitem")
    hits = line.selectExpr("l_orderkey AS match", "l_partkey % 40 AS fp", "l_suppkey % 30 AS token", "cast(l_quantity AS bigint) * 2 AS longest")
    holders = provenance.spread(line.selectExpr("l_partkey % 40 AS fp", "l_suppkey % (l_partkey % 12 + 1) AS agent"))
    seen = line.selectExpr("l_suppkey % 30 AS token", "l_partkey % (l_suppkey % 30 + 2) AS text").distinct().groupBy("token").agg(F.count("*").alias("texts"))
    return provenance.skeleton(hits, holders, seen)


SKELETON_MATCHES = """
WITH h AS (SELECT l_partkey % 40 AS fp, count(DISTINCT l_suppkey % (l_partkey % 12 + 1)) AS holders FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % (l_partkey % 12 + 1)) >= 4),
t AS (SELECT l_suppkey % 30 AS token, count(DISTINCT l_partkey % (l_suppkey % 30 + 2)) AS texts FROM lineitem GROUP BY 1)
SELECT l_orderkey AS match FROM lineitem JOIN h ON l_partkey % 40 = fp JOIN t ON l_suppkey % 30 = token
GROUP BY 1 HAVING max(l_quantity::BIGINT * 2) < 64 AND NOT bool_or(texts <= 2 * holders + 1)"""


def match_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best layer of each match, and the kind of match that it makes."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS match", "l_linenumber AS layer", "l_linenumber % 2 = 0 AS complete", "cast(l_quantity AS bigint) AS covered", "l_linenumber % 3 AS chain_length"
    )
    chain = F.when(F.col("chain_length") == 0, F.array().cast("array<string>")).otherwise(F.slice(F.array(F.lit("hex"), F.lit("url")), 1, F.col("chain_length").cast("int")))
    kind = provenance.match_kind(F.col("chain"), F.col("read_text"), F.col("origin_text"))
    best = provenance.best_layer(rows, ["match"]).withColumns({"chain": chain, "origin_text": F.lit("1 23"), "read_text": F.col("covered").cast("string")})
    return best.select("match", "layer", "covered", kind.alias("kind"))


MATCH_LAYERS = """
WITH m AS (SELECT l_orderkey AS match, l_linenumber AS layer, l_quantity::BIGINT AS covered FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, l_quantity::BIGINT DESC, l_linenumber % 3, l_linenumber) = 1)
SELECT match, layer, covered, CASE layer % 3 WHEN 0 THEN CASE WHEN contains('1 23', covered::VARCHAR) THEN 'exact' ELSE 'normalized' END WHEN 1 THEN 'decoded:hex' ELSE 'decoded:hex>url' END AS kind FROM m"""


def span_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by state with hits and first hit."""
    spans = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS span", "o_custkey * 10 AS originated_at", "CASE WHEN o_custkey % 3 > 0 THEN o_custkey * 10 + 1 END AS indexed_at")
    hits = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS span", "l_partkey AS at")
    return provenance.span_states(spans, hits, F.lit(1000), 600).select("span", "hits", "first_hit", "state")


SPAN_LIFECYCLE = """
WITH h AS (SELECT l_orderkey AS span, count(*) AS hits, min(l_partkey) AS first_hit FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS span, coalesce(hits, 0) AS hits, first_hit, CASE WHEN o_custkey * 10 < 400 THEN 'expired' WHEN hits > 0 THEN 'propagated'
  WHEN o_custkey % 3 > 0 THEN 'indexed' ELSE 'originated' END AS state FROM orders LEFT JOIN h ON o_orderkey = span"""


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches asked for by id, not already explained, with origin and reader bodies: every turn reads the one before it."""
    turns = table(spark, sf_dir, "conversations").withColumn("message", F.expr("conv_id * 1000 + turn"))
    bodies = turns.where("conv_id % 4 > 0").selectExpr("message", "text AS body")
    found = turns.where("turn > 0").selectExpr("message AS match", "message - 1 AS origin", "message AS reader_message")
    asked = paging.by_ids(found, turns.where("message % 3 = 0").selectExpr("message AS match"), "match")
    left = provenance.unmatched(asked, found.where("match % 5 = 0"), ["match"])
    spans = turns.selectExpr("message AS span", "message")
    return flow.evidence(left, spans, bodies).select("match", F.md5("origin_body").alias("origin_md5"), F.md5("reader_body").alias("reader_md5"), "origin_dropped", "reader_dropped")


EVIDENCE_ROWS = """
WITH t AS (SELECT *, conv_id * 1000 + turn AS m FROM conversations),
b AS (SELECT m, text FROM t WHERE conv_id % 4 > 0), q AS (SELECT m AS match FROM t WHERE turn > 0 AND m % 3 = 0 AND m % 5 <> 0)
SELECT match, md5(x.text) AS origin_md5, md5(y.text) AS reader_md5, x.text IS NULL AS origin_dropped, y.text IS NULL AS reader_dropped
FROM q LEFT JOIN t o ON o.m = match - 1 LEFT JOIN b x ON x.m = o.m LEFT JOIN b y ON y.m = match"""


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the review queue, and how many channels are in it once each."""
    c = _channels(spark, sf_dir)
    listed = topology.queue_channels(c).agg(F.count("*").alias("channels"))
    return topology.queue(_alerts(spark, sf_dir), c).crossJoin(listed)


REVIEW_QUEUE = f"""
WITH {TRANSMISSIONS}, {CHANNELS}, a AS (SELECT {ALERT} FROM transmissions)
SELECT (SELECT count(*) FROM a WHERE state = 'open') AS open_alerts, count(*) FILTER (policy = 'unreviewed') AS unreviewed,
  count(*) FILTER (listing = 'unconfirmed') AS unconfirmed, count(*) FILTER (policy = 'unreviewed' OR listing = 'unconfirmed') AS channels FROM channels"""


def kept_topic_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions retained and the one in force, rules in their order, heaviest edges."""
    v = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS version", "n_nationkey % 3 = 0 AND n_nationkey < 20 AS activated", "n_nationkey % 8 = 1 AS pinned")
    kept = topology.kept_versions(v, 3)
    now = filters.resolve_version(v.selectExpr("version", "CASE WHEN activated THEN 'active' ELSE 'ready' END AS state"))
    return kept.select("version", (F.col("version") == now).alias("in_force"))


KEPT_TOPIC_VERSIONS = """
WITH v AS (SELECT n_nationkey AS version, n_nationkey % 3 = 0 AND n_nationkey < 20 AS activated, n_nationkey % 8 = 1 AS pinned FROM nation),
a AS (SELECT version FROM v WHERE activated ORDER BY version DESC LIMIT 3)
SELECT version, version = (SELECT max(version) FROM a) AS in_force FROM v WHERE version IN (FROM a) OR pinned OR version > (SELECT max(version) FROM a)"""


def heaviest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = contributions(spark, sf_dir).groupBy("from", "to").agg(F.sum("bytes").alias("bytes"))
    return topology.top_edges(edges, "bytes", 25)


HEAVIEST_EDGES = f"""
WITH {CONTRIBUTIONS} SELECT "from", "to", sum(bytes)::BIGINT AS bytes FROM contributions GROUP BY ALL ORDER BY bytes DESC, "from", "to" LIMIT 25"""


def delivery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes once each on some subjects, their bodies by content, failures, retries and dead letters."""
    e = table(spark, sf_dir, "events").selectExpr("event_id DIV 2 AS id", "event_type AS subject", "unix_micros(cast(ts AS timestamp)) AS at", "user_id % 5 AS group", "props AS body")
    once = logs.deduplicated(logs.subscribed(e, ["error", "click"]).select("id", "subject").distinct(), "id")
    retry, dead = logs.attempts(e.where("subject = 'error'").selectExpr("concat('g', group) AS group", "id % 400 AS id", "at", "concat('r', at % 7) AS reason"), 3)
    again = logs.replay(e.selectExpr("id % 400 AS id", "body"), dead)
    blobs = logs.put_blobs(again)
    held = logs.get_blobs(again.select(F.sha2("body", 256).alias("hash")).distinct(), blobs.where("body NOT LIKE '%9%'"))
    count = lambda df, what, value=F.count("*"): df.agg(F.lit(what).alias("what"), value.alias("n"))
    return (
        count(once.select("id").distinct(), "once").unionByName(count(retry, "retry", F.count("*") + F.sum(F.pmod("retry_at", F.lit(1000003)))))
        .unionByName(count(dead, "dead", F.sum("attempts"))).unionByName(count(again, "again")).unionByName(count(held, "held", F.count("body")))
        .unionByName(count(held, "dropped", F.count_if(F.col("body").isNull())))
    )


DELIVERY_LOG = """
WITH e AS (SELECT event_id // 2 AS id, event_type AS subject, epoch_us(ts) AS seen, user_id % 5 AS g, props AS body FROM events),
n AS (SELECT g, id % 400 AS id, count(*) AS attempts, max(seen) AS last_at FROM e WHERE subject = 'error' GROUP BY ALL),
again AS (SELECT body FROM e WHERE id % 400 IN (SELECT id FROM n WHERE attempts >= 3)), b AS (SELECT DISTINCT body FROM again)
SELECT 'once' AS what, count(DISTINCT id) AS n FROM e WHERE subject IN ('error', 'click')
UNION ALL SELECT 'retry', (count(*) + sum((last_at + (1 << (attempts - 1)) * 1000000) % 1000003))::BIGINT FROM n WHERE attempts < 3
UNION ALL SELECT 'dead', sum(attempts)::BIGINT FROM n WHERE attempts >= 3 UNION ALL SELECT 'again', count(*) FROM again
UNION ALL SELECT 'held', count(*) FROM b WHERE body NOT LIKE '%9%' UNION ALL SELECT 'dropped', count(*) FROM b WHERE body LIKE '%9%'"""


def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts around the middle third, titles, folded keys, id prefixes, times and deadlines."""
    d = table(spark, sf_dir, "documents")
    title = F.concat(F.lit("  "), F.lower(F.substring("text", 1, 12)), F.lit("_x  "))
    cut = text.excerpt("text", F.expr("octet_length(text) DIV 3").cast("int"), F.expr("octet_length(text) * 2 DIV 3").cast("int"), 8)
    at = F.timestamp_micros(F.col("doc_id") * 1_000_001)
    return d.select(
        "doc_id", F.md5(cut["text"]).alias("excerpt"), cut["elided_before"].cast("long").alias("before"), cut["elided_after"].cast("long").alias("after"),
        text.wiki_title(title).alias("title"), text.folded_key(title).alias("key"), text.id_prefix(F.concat(F.lit("Doc-"), "doc_id"), "doc-1").alias("prefixed"),
        times.rfc3339(at).alias("at"), times.deadline("doc_id", 10, 5).alias("deadline"), urls.host(F.concat(F.lit("HTTPS://H"), "doc_id", F.lit("/a"))).alias("host"),
    )


# Bytes of a text are pairs of hex digits; those from 80 to BF go on with a character.
TEXT_PARTS = r"""
WITH d AS (
  SELECT doc_id, text, hex(encode(text)) AS h, strlen(text) AS n, greatest(0, strlen(text) // 3 - 8) AS lo, least(strlen(text), strlen(text) * 2 // 3 + 8) AS hi,
    '  ' || lower(substr(text, 1, 12)) || '_x  ' AS raw FROM documents),
c AS (
  SELECT *, list_filter(range(0, 4), lambda k: lo - k <= 0 OR substr(h, 2 * (lo - k) + 1, 1) NOT IN ('8', '9', 'A', 'B'))[1] AS back,
    list_filter(range(0, 4), lambda k: hi + k >= n OR substr(h, 2 * (hi + k) + 1, 1) NOT IN ('8', '9', 'A', 'B'))[1] AS more,
    trim(regexp_replace(raw, '[\s\x0B_]+', ' ', 'g')) AS t FROM d)
SELECT doc_id, md5(decode(unhex(substr(h, 2 * (lo - back) + 1, 2 * (hi + more - lo + back))))) AS excerpt, lo - back AS before, n - hi - more AS after,
  replace(upper(substr(t, 1, 1)), 'ẞ', 'SS') || substr(t, 2) AS title, lower(trim(raw)) AS key, doc_id::VARCHAR LIKE '1%' AS prefixed,
  strftime(make_timestamp(doc_id * 1000001), '%Y-%m-%dT%H:%M:%S.%fZ') AS at, doc_id + 15 AS deadline, 'h' || doc_id AS host
FROM c"""


NAMES = (
    "filtered_transmissions", "filtered_accesses", "filtered_channels", "filtered_agents", "filtered_alerts", "crossing_transmissions",
    "audit_trail", "filtered_conversations", "alert_findings", "alert_suppression", "verdict_appends", "channel_promotion",
    "pattern_coverage", "channel_of_record", "turn_order", "version_catalogue", "late_turns", "json_arguments", "canonical_blocks", "argument_ranges", "match_precision", "shadowed_matches", "skeleton_matches", "match_layers", "span_lifecycle",
    "evidence_rows", "review_queue", "kept_topic_versions", "heaviest_edges", "delivery_log", "text_parts",
)
QUERIES = {n: globals()[n] for n in NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in NAMES}
