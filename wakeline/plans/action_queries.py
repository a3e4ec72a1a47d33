"""Operators' actions on the supplied events: an event is an action of its user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import actions
from wakeline.sources.storage import table

#: Actions but those of agents, in the order that an event's number picks from.
OTHERS = [a for a, (kind, _) in actions.ACTIONS.items() if kind != "agent"]
SUBJECTS, CLUSTER = 40, 4


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    picked = F.element_at(F.array(*map(F.lit, OTHERS)), (F.col("event_id") % len(OTHERS) + 1).cast("int"))
    role = F.when(F.col("user_id") % 9 == 0, "viewer").when(F.col("user_id") % 9 < 3, "operator").otherwise("governor")
    value = F.when(picked == "set_rule_enabled", F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")).otherwise((F.col("event_id") % 3).cast("string"))
    return e.select(F.col("event_id").alias("seq"), role.alias("role"), picked.alias("action"), (F.col("event_id") % 997 + F.col("user_id") * SUBJECTS).alias("subject"), value.alias("value"))


def _states(log: DataFrame) -> DataFrame:
    """What the subjects were before: some do not exist, the others in one of a few states."""
    first = {
        "channel": "discovered: declared:1 superseded:", "alert": "open acknowledged suppressed", "rule": "builtin:0 stale:1 disabled:2",
        "transmission": "confirmed: detected: confirmed:1", "dead_letter": "dead dead dead", "version": "ready fitting dropped",
    }
    s = F.col("subject")
    at = F.when(s % 5 < 3, 0).when(s % 5 == 3, 1).otherwise(2)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.array(*map(F.lit, x.split()))[at].alias("state")) for k, x in first.items()])
    return log.select("subject").distinct().where("subject % 7 <> 0").select("subject", F.explode(kinds).alias("k")).select("k.kind", "subject", "k.state")


def action_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every action but those on agents, and the state after it."""
    log = _log(spark, sf_dir)
    return actions.effects(log, _states(log)).withColumn("subject", F.col("subject").cast("long"))


ACTION_EFFECTS = f"""
WITH RECURSIVE log AS (
  SELECT event_id AS seq, list_extract({OTHERS}, (event_id % {len(OTHERS)} + 1)::INT) AS action, event_id % 997 + user_id * {SUBJECTS} AS subject,
    CASE WHEN user_id % 9 = 0 THEN 0 WHEN user_id % 9 < 3 THEN 1 ELSE 2 END AS rank, (event_id % 3)::VARCHAR AS v, event_id % 2 = 0 AS yes
  FROM events),
kinds AS (
  SELECT *, CASE WHEN action IN ('set_policy', 'promote_channel') THEN 'channel' WHEN action IN ('acknowledge', 'resolve') THEN 'alert'
      WHEN action LIKE '%rule%' THEN 'rule' WHEN action = 'set_verdict' THEN 'transmission' WHEN action LIKE '%version' THEN 'version' ELSE 'dead_letter' END AS kind
  FROM log),
e AS (
  SELECT *, row_number() OVER (PARTITION BY kind, subject ORDER BY seq) AS n,
    rank >= CASE WHEN kind IN ('alert', 'transmission', 'dead_letter') THEN 1 ELSE 2 END AS may,
    CASE WHEN subject % 7 = 0 THEN NULL ELSE list_extract(CASE kind WHEN 'channel' THEN ['discovered:', 'declared:1', 'superseded:'] WHEN 'alert' THEN ['open', 'acknowledged', 'suppressed']
      WHEN 'rule' THEN ['builtin:0', 'stale:1', 'disabled:2'] WHEN 'transmission' THEN ['confirmed:', 'detected:', 'confirmed:1']
      WHEN 'dead_letter' THEN ['dead', 'dead', 'dead'] ELSE ['ready', 'fitting', 'dropped'] END, greatest(1, (subject % 5)::INT - 1)) END AS first
  FROM kinds),
judged AS (
  SELECT kind, subject, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS action, NULL::VARCHAR AS outcome, any_value(first) AS after FROM e GROUP BY ALL
  UNION ALL
  SELECT kind, subject, n, seq, action, outcome,
    CASE WHEN outcome <> 'applied' THEN s ELSE CASE action
      WHEN 'set_policy' THEN w || ':' || v WHEN 'promote_channel' THEN 'declared:' || v WHEN 'acknowledge' THEN 'acknowledged' WHEN 'resolve' THEN 'resolved'
      WHEN 'set_verdict' THEN 'confirmed:' || v WHEN 'create_rule' THEN 'enabled:' || v WHEN 'update_rule' THEN CASE w WHEN 'disabled' THEN 'disabled:' ELSE 'enabled:' END || v
      WHEN 'set_rule_enabled' THEN CASE WHEN yes THEN 'enabled:' ELSE 'disabled:' END || split_part(s, ':', 2)
      WHEN 'pin_topic_version' THEN 'pinned' WHEN 'unpin_topic_version' THEN 'ready' END END AS after
  FROM (
    SELECT *, CASE WHEN NOT may THEN 'forbidden'
      WHEN action = 'create_rule' THEN CASE WHEN s IS NULL THEN 'applied' ELSE 'rule_exists' END
      WHEN s IS NULL THEN 'not_found'
      WHEN kind = 'channel' AND w = 'superseded' THEN 'channel_superseded'
      WHEN action = 'promote_channel' THEN CASE w WHEN 'discovered' THEN 'applied' ELSE 'channel_not_discovered' END
      WHEN action = 'set_policy' THEN CASE WHEN s = w || ':' || v THEN 'unchanged' ELSE 'applied' END
      WHEN kind = 'alert' AND s NOT IN ('open', 'acknowledged') THEN 'alert_not_active'
      WHEN action = 'acknowledge' THEN CASE s WHEN 'open' THEN 'applied' ELSE 'unchanged' END
      WHEN action = 'resolve' THEN CASE s WHEN 'open' THEN 'alert_not_acknowledged' ELSE 'applied' END
      WHEN action = 'set_verdict' THEN CASE WHEN w <> 'confirmed' THEN 'transmission_not_judgeable' WHEN s = 'confirmed:' || v THEN 'unchanged' ELSE 'applied' END
      WHEN action = 'set_rule_enabled' AND w = 'stale' AND yes THEN 'rule_stale'
      WHEN kind = 'rule' AND w = 'builtin' THEN 'rule_not_editable'
      WHEN action = 'update_rule' THEN CASE WHEN s = CASE w WHEN 'disabled' THEN 'disabled:' ELSE 'enabled:' END || v THEN 'unchanged' ELSE 'applied' END
      WHEN action = 'set_rule_enabled' THEN CASE WHEN w = CASE WHEN yes THEN 'enabled' ELSE 'disabled' END THEN 'unchanged' ELSE 'applied' END
      WHEN action = 'pin_topic_version' THEN CASE s WHEN 'ready' THEN 'applied' WHEN 'pinned' THEN 'unchanged' ELSE 'topic_version_' || s END
      WHEN action = 'unpin_topic_version' THEN CASE s WHEN 'pinned' THEN 'applied' ELSE 'unchanged' END
      ELSE 'applied' END AS outcome
    FROM (SELECT e.*, judged.after AS s, split_part(judged.after, ':', 1) AS w FROM judged JOIN e ON e.kind = judged.kind AND e.subject = judged.subject AND e.n = judged.n + 1)))
SELECT seq, action, subject, outcome, after FROM judged WHERE n > 0"""


def agent_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges, unmerges and renames among clusters of four agents; the canonical agent and label after each."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    agent = F.col("user_id") * CLUSTER + F.col("event_id") % CLUSTER
    action = F.when(F.col("event_id") % 5 < 2, "merge_agents").when(F.col("event_id") % 5 == 2, "rename_agent").otherwise("unmerge")
    back = F.lag("event_id", 1).over(_by_user()).cast("string")
    value = F.when(action == "merge_agents", F.col("user_id") * CLUSTER + F.col("event_id") % 7 % CLUSTER).when(action == "rename_agent", F.col("event_id") % 2).otherwise(back)
    log = e.select(F.col("event_id").alias("seq"), F.lit("governor").alias("role"), action.alias("action"), agent.alias("subject"), value.cast("string").alias("value"))
    users = e.select("user_id").distinct()
    states = users.select(F.lit("agent").alias("kind"), F.explode(F.expr(f"sequence(user_id * {CLUSTER}, user_id * {CLUSTER} + {CLUSTER - 1})")).alias("subject"), F.lit("").alias("state"))
    return actions.effects(log, states).withColumn("subject", F.col("subject").cast("long"))


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("event_id")


# A cluster's state is the canonical agent and label of each of its four, by place, and for every merge its seq, source, moved places and whether it was reverted.
AGENT_ACTIONS = f"""
WITH RECURSIVE e AS (
  SELECT event_id AS seq, user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % {CLUSTER} AS i, event_id % 7 % {CLUSTER} AS j, event_id % 2 AS l,
    CASE WHEN event_id % 5 < 2 THEN 'merge_agents' WHEN event_id % 5 = 2 THEN 'rename_agent' ELSE 'unmerge' END AS action, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS back
  FROM events),
s AS (
  SELECT u, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS action, NULL::BIGINT AS i, NULL::VARCHAR AS outcome, [0, 1, 2, 3]::BIGINT[] AS c, ['', '', '', '']::VARCHAR[] AS labels,
    []::STRUCT(seq BIGINT, src BIGINT, moved BIGINT[], reverted BOOLEAN)[] AS merges FROM e GROUP BY u
  UNION ALL
  SELECT u, n, seq, action, i, outcome,
    CASE WHEN outcome <> 'applied' THEN c WHEN action = 'merge_agents' THEN list_transform(c, lambda x: CASE WHEN x = i THEN j ELSE x END)
      WHEN action = 'unmerge' THEN list_transform(c, lambda x, p: CASE WHEN list_contains(m.moved, p - 1) THEN m.src ELSE x END) ELSE c END,
    CASE WHEN outcome = 'applied' AND action = 'rename_agent' THEN list_transform(labels, lambda x, p: CASE WHEN p - 1 = i THEN l::VARCHAR ELSE x END) ELSE labels END,
    CASE WHEN outcome <> 'applied' THEN merges
      WHEN action = 'merge_agents' THEN list_append(merges, {{'seq': seq, 'src': i, 'moved': list_filter(range(0, {CLUSTER}), lambda p: c[p + 1] = i), 'reverted': false}})
      WHEN action = 'unmerge' THEN list_transform(merges, lambda x: CASE WHEN x.seq = back THEN {{'seq': x.seq, 'src': x.src, 'moved': x.moved, 'reverted': true}} ELSE x END) ELSE merges END
  FROM (
    SELECT *, CASE action
      WHEN 'merge_agents' THEN CASE WHEN i = j THEN 'self_merge' WHEN c[i + 1] = c[j + 1] THEN 'merge_into_self' WHEN c[i + 1] <> i OR c[j + 1] <> j THEN 'agent_merged' ELSE 'applied' END
      WHEN 'unmerge' THEN CASE WHEN m IS NULL THEN 'not_found' WHEN m.reverted THEN 'merge_already_reverted' ELSE 'applied' END
      ELSE CASE WHEN c[i + 1] <> i THEN 'agent_merged' WHEN labels[i + 1] = l::VARCHAR THEN 'unchanged' ELSE 'applied' END END AS outcome
    FROM (SELECT e.*, s.c, s.labels, s.merges, list_filter(s.merges, lambda x: x.seq = e.back)[1] AS m FROM s JOIN e ON e.u = s.u AND e.n = s.n + 1)))
SELECT seq, action, u * {CLUSTER} + i AS subject, outcome, (u * {CLUSTER} + c[i + 1])::VARCHAR || ':' || labels[i + 1] AS after FROM s WHERE n > 0"""

NAMES = ["action_effects", "agent_actions"]
QUERIES = {n: globals()[n] for n in NAMES}
ORACLE_SQL = {n: globals()[n.upper()] for n in NAMES}
