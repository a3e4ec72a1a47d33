"""Predicates shared by the read models. Empty lists admit everything; parts are ANDed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.text import id_prefix
from wakeline.functions.times import in_window
from wakeline.sources.storage import small


def any_of(column, values) -> Column:
    """IN list where the empty list admits all."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isin(list(values)) if values else F.lit(True)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass(frozen=True)
class TopologyFilter:
    """Admits a transmission by sender or reader, channel, route kind, topic and verdict."""

    agents: tuple = ()
    channels: tuple = ()
    route_kinds: tuple = ()
    topics: tuple = ()
    hide_false: bool = False

    def admits(self, sender="from", reader="to", channel="channel", route="route", topic="topic", verdict=None) -> Column:
        seen = [
            any_of(sender, self.agents) | any_of(reader, self.agents) if self.agents else F.lit(True),
            any_of(channel, self.channels),
            any_of(route, self.route_kinds),
            any_of(topic, self.topics),
        ]
        if self.hide_false and verdict is not None:
            seen.append(~F.coalesce(F.col(verdict) == "false", F.lit(False)))
        return all_of(*seen)

    def admits_access(self, agent="agent", channel="channel", channel_topics="topics") -> Column:
        """Accesses count under a topic if their channel carried it."""
        topics = F.arrays_overlap(channel_topics, F.array(*map(F.lit, self.topics))) if self.topics else F.lit(True)
        return all_of(any_of(agent, self.agents), any_of(channel, self.channels), topics)


def topics_outside(topics: DataFrame, known: DataFrame) -> DataFrame:
    """Topics asked for that the version does not have."""
    return topics.join(known, "topic", "left_anti")


class VersionError(ValueError):
    """A topic version cannot be read; `reason` says why."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


def resolve_version(versions: DataFrame, pinned: int | None = None) -> int:
    """The current or a pinned topic version. versions: (version, state), one row each."""
    if pinned is None:
        row = versions.where("state = 'active'").agg(F.max("version")).first()[0]
        if row is None:
            raise VersionError("unknown")
        return row
    row = versions.where(F.col("version") == pinned).first()
    if row is None:
        raise VersionError("unknown")
    reasons = {"fitting": "fitting", "failed": "unknown", "ready": "not activated", "dropped": "not retained"}
    if row["state"] in reasons:
        raise VersionError(reasons[row["state"]])
    return pinned


def channel_filter(origins=(), listings=(), detections=(), policies=()) -> Column:
    return all_of(any_of("origin", origins), any_of("listing", listings), any_of("detection", detections), any_of("policy", policies))


def agent_filter(states=(), families=(), parents=(), text: str | None = None) -> Column:
    """Agents by state, any claimed family, any parent, and label part or id prefix."""
    parts = [any_of("state", states), any_of("parent", parents)]
    if families:
        parts.append(F.arrays_overlap("claims", F.array(*map(F.lit, families))))
    if text:
        parts.append(F.contains(F.lower("label"), F.lit(text.lower())) | id_prefix("agent", text))
    return all_of(*parts)


def alert_filter(alerts: DataFrame, aliases: DataFrame, states=(), channels=()) -> DataFrame:
    """Alerts by state and by channel, superseded channels standing for their successor."""
    named = alerts.join(small(aliases.select(F.col("id").alias("channel"), "canonical")), "channel", "left")
    where = all_of(any_of("state", states), any_of(F.coalesce("canonical", "channel"), channels))
    return named.where(where).drop("canonical")


def rule_filter(statuses=(), stale: bool | None = None) -> Column:
    return all_of(any_of("status", statuses), F.lit(True) if stale is None else F.col("stale") == stale)


def audit_filter(start=None, end=None, authors=(), subject: str | None = None) -> Column:
    window = in_window("at", F.lit(start), F.lit(end)) if start is not None else F.lit(True)
    holds = F.array_contains("subjects", subject) if subject else F.lit(True)
    return all_of(window, any_of("author", authors), holds)


def conversation_filter(origins=(), replayed: bool | None = None) -> Column:
    return all_of(any_of("origin", origins), F.lit(True) if replayed is None else F.col("replayed") == replayed)


def transmission_filter(start=None, end=None, states=(), channels=(), confirmed: bool | None = None) -> Column:
    window = in_window("opened_at", F.lit(start), F.lit(end)) if start is not None else F.lit(True)
    settled = F.lit(True) if confirmed is None else (F.col("state") == "confirmed") == confirmed
    return all_of(window, any_of("state", states), any_of("channel", channels), settled)


def crossing(senders="writers", reader="to") -> Column:
    """Some sender is another agent than the reader, after aliases."""
    return F.exists(senders, lambda w: w != F.col(reader))


def shown(alerts: DataFrame, hidden_channels: DataFrame, merged: DataFrame) -> DataFrame:
    """Alerts whose subject still shows: not on a hidden channel nor a merged transmission."""
    return alerts.join(hidden_channels, "channel", "left_anti").join(merged, "transmission", "left_anti")


# What each role may do.
PERMISSIONS = {
    "viewer": {"view"},
    "analyst": {"view", "content"},
    "operator": {"view", "content", "operate"},
    "governor": {"view", "content", "operate", "govern"},
}


def require(role: str, permission: str) -> None:
    """Guard before any read or action."""
    if permission not in PERMISSIONS.get(role, ()):
        raise PermissionError(f"{role} may not {permission}")
