"""Effects of operators' actions: an ordered fold of an action log over states.

Every action is judged by the state that the actions before it left: it is applied, changes
nothing, names what does not exist, or conflicts; without permission it has no effect. The
order matters only among actions on one subject, so the log is dealt by subject, sorted, and
folded row by row with one subject's state at a time. Agents that any merge connects are one
subject: their components are found first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components

# The actions, what they act on, and the permission each needs.
ACTIONS = {
    "set_policy": ("channel", "govern"), "promote_channel": ("channel", "govern"), "merge_agents": ("agent", "govern"),
    "unmerge": ("agent", "govern"), "rename_agent": ("agent", "govern"), "acknowledge": ("alert", "triage"), "resolve": ("alert", "triage"),
    "create_rule": ("rule", "govern"), "update_rule": ("rule", "govern"), "set_rule_enabled": ("rule", "govern"),
    "set_verdict": ("transmission", "triage"), "replay_dead_letter": ("dead_letter", "operate"),
    "pin_topic_version": ("version", "govern"), "unpin_topic_version": ("version", "govern"),
}
HELD = {"viewer": (), "operator": ("triage", "operate"), "governor": ("triage", "operate", "govern")}

#: What an action makes of a state: the outcome and the state after it. A state is a word, or
#: a word and a value parted by a colon; none is a subject that does not exist.
Step = Callable[[str, str | None], tuple[str, str]]


def _parted(state: str) -> tuple[str, str]:
    word, _, value = state.partition(":")
    return word, value


def _set(state: str, after: str) -> tuple[str, str]:
    return ("unchanged" if state == after else "applied", after)


def _set_policy(state: str, value: str | None) -> tuple[str, str]:
    word, _ = _parted(state)
    return ("channel_superseded", state) if word == "superseded" else _set(state, f"{word}:{value or ''}")


def _promote(state: str, value: str | None) -> tuple[str, str]:
    word, _ = _parted(state)
    if word == "discovered":
        return "applied", f"declared:{value or ''}"
    return "channel_superseded" if word == "superseded" else "channel_not_discovered", state


def _acknowledge(state: str, _: str | None) -> tuple[str, str]:
    return _set(state, "acknowledged") if state in ("open", "acknowledged") else ("alert_not_active", state)


def _resolve(state: str, _: str | None) -> tuple[str, str]:
    if state == "acknowledged":
        return "applied", "resolved"
    return "alert_not_acknowledged" if state == "open" else "alert_not_active", state


def _set_verdict(state: str, value: str | None) -> tuple[str, str]:
    word, _ = _parted(state)
    return _set(state, f"{word}:{value or ''}") if word == "confirmed" else ("transmission_not_judgeable", state)


def _update_rule(state: str, value: str | None) -> tuple[str, str]:
    word, _ = _parted(state)
    # A stale rule is aimed anew and goes on; a disabled one stays so.
    return ("rule_not_editable", state) if word == "builtin" else _set(state, f"{'disabled' if word == 'disabled' else 'enabled'}:{value or ''}")


def _set_rule_enabled(state: str, value: str | None) -> tuple[str, str]:
    word, rule = _parted(state)
    if word == "stale" and value == "true":
        return "rule_stale", state
    if word == "builtin":
        return "rule_not_editable", state
    return _set(state, f"{'enabled' if value == 'true' else 'disabled'}:{rule}")


def _pin(state: str, _: str | None) -> tuple[str, str]:
    return _set(state, "pinned") if state in ("ready", "pinned") else (f"topic_version_{state}", state)


def _unpin(state: str, _: str | None) -> tuple[str, str]:
    return _set(state, "ready") if state in ("ready", "pinned") else ("unchanged", state)


STEPS: dict[str, Step] = {
    "set_policy": _set_policy, "promote_channel": _promote, "acknowledge": _acknowledge, "resolve": _resolve, "set_verdict": _set_verdict,
    "update_rule": _update_rule, "set_rule_enabled": _set_rule_enabled, "pin_topic_version": _pin, "unpin_topic_version": _unpin,
}


class Agents:
    """Canonical agents, labels and merges of the agents that merges connect."""

    def __init__(self):
        self.of: dict[str, str] = {}
        self.label: dict[str, str] = {}
        self.merges: dict[str, tuple[str, list[str], bool]] = {}

    def know(self, agent: str, label: str | None) -> None:
        self.of.setdefault(agent, agent)
        self.label.setdefault(agent, label or "")

    def act(self, seq: str, action: str, agent: str, value: str | None) -> tuple[str, str | None]:
        """The outcome, and the agent's canonical one and label after it."""
        outcome = {"merge_agents": self._merge, "unmerge": self._unmerge, "rename_agent": self._rename}[action](seq, agent, value)
        return outcome, f"{self.of[agent]}:{self.label[agent]}" if agent in self.of else None

    def _merge(self, seq: str, agent: str, into: str | None) -> str:
        if agent == into:
            return "self_merge"
        if agent not in self.of or into not in self.of:
            return "not_found"
        if self.of[agent] == self.of[into]:
            return "merge_into_self"
        if self.of[agent] != agent or self.of[into] != into:
            return "agent_merged"
        moved = [a for a, c in self.of.items() if c == agent]
        self.of |= dict.fromkeys(moved, into)
        self.merges[seq] = (agent, moved, False)
        return "applied"

    def _unmerge(self, seq: str, agent: str, merge: str | None) -> str:
        if merge not in self.merges:
            return "not_found"
        source, moved, reverted = self.merges[merge]
        if reverted:
            return "merge_already_reverted"
        # Just those that the merge moved are put back.
        self.of |= dict.fromkeys(moved, source)
        self.merges[merge] = (source, moved, True)
        return "applied"

    def _rename(self, seq: str, agent: str, label: str | None) -> str:
        if agent not in self.of:
            return "not_found"
        if self.of[agent] != agent:
            return "agent_merged"
        same, self.label[agent] = self.label[agent] == (label or ""), label or ""
        return "unchanged" if same else "applied"


def stepped(action: str, state: str | None, value: str | None) -> tuple[str, str | None]:
    if action == "create_rule":
        return ("applied", f"enabled:{value or ''}") if state is None else ("rule_exists", state)
    if state is None:
        return "not_found", None
    if action == "replay_dead_letter":
        return "applied", None
    return STEPS[action](state, value)


def _connected(log: DataFrame) -> DataFrame:
    """(agent, root) of agents that merges connect; a lone agent is its own root.

    An unmerge may name any agent, so its own is connected to those of the merge that it reverts.
    """
    merges = log.where("action = 'merge_agents' AND subject IS NOT NULL AND value IS NOT NULL")
    reverts = log.where("action = 'unmerge' AND subject IS NOT NULL").select("subject", F.col("value").alias("_merge"))
    of_merge = merges.select(F.col("seq").cast("string").alias("_merge"), F.col("subject").alias("value"))
    pairs = merges.select("subject", "value").unionByName(reverts.join(of_merge, "_merge").select("subject", "value"))
    names = pairs.select(F.explode(F.array("subject", "value")).alias("agent")).distinct()
    # Components need numbers: an agent's is a digest, whose 60 bits only decide who is folded together.
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")
    roots = components(pairs.select(number(F.col("subject")).alias("u"), number(F.col("value")).alias("v")))
    return names.select("agent", number(F.col("agent")).alias("node")).join(roots, "node", "left").select("agent", F.coalesce("root", "node").cast("string").alias("root"))


RESULT = "seq long, action string, subject string, outcome string, after string"


def effects(log: DataFrame, states: DataFrame) -> DataFrame:
    """Every action with its outcome and the state after it.

    log: (seq, role, action, subject, value), in order of seq, which is unique; for a merge
    the value is the agent merged into, for an unmerge the subject is the agent and the value
    the merge's seq. states: (kind, subject, state) before the log; an agent's is its label.
    """
    table = [(role, action, kind, need in held) for role, held in HELD.items() for action, (kind, need) in ACTIONS.items()]
    known = log.sparkSession.createDataFrame(table, "role string, action string, kind string, allowed boolean")
    kinds = known.select("action", "kind").distinct()
    told = (
        log.select("seq", "role", "action", F.col("subject").cast("string").alias("subject"), F.col("value").cast("string").alias("value"))
        .join(F.broadcast(kinds), "action")
        .join(F.broadcast(known.drop("kind")), ["role", "action"], "left")
    )
    before = states.select(F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("action"), F.col("subject").cast("string").alias("subject"),
                           F.col("state").alias("value"), "kind", F.lit(True).alias("allowed"))
    rows = told.drop("role").unionByName(before).withColumn("allowed", F.coalesce("allowed", F.lit(False)))
    grouped = rows.join(_connected(told), (F.col("kind") == "agent") & (F.col("subject") == F.col("agent")), "left")
    grouped = grouped.withColumn("group", F.coalesce("root", "subject")).drop("agent", "root")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, agents = None, None, Agents()
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if (r.kind, r.group) != at:
                    at, state, agents = (r.kind, r.group), None, Agents()
                if r.action is None:
                    if r.kind == "agent":
                        agents.know(r.subject, r.value)
                    else:
                        state = r.value
                    continue
                if not r.allowed:
                    outcome, after = "forbidden", f"{agents.of[r.subject]}:{agents.label[r.subject]}" if r.subject in agents.of else state
                elif r.kind == "agent":
                    outcome, after = agents.act(r.seq, r.action, r.subject, r.value)
                else:
                    outcome, state = stepped(r.action, state, r.value)
                    after = state
                out.append((r.seq, r.action, r.subject, outcome, after))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    in_order = grouped.where("subject IS NOT NULL").repartition("kind", "group").sortWithinPartitions("kind", "group", F.col("seq").asc_nulls_first())
    found = in_order.withColumn("seq", F.col("seq").cast("string")).mapInPandas(run, RESULT.replace("seq long", "seq string"))
    return found.withColumn("seq", F.col("seq").cast("long"))


def final_states(told: DataFrame) -> DataFrame:
    """(kind, subject, state) after the log, of the subjects that it names."""
    kinds = told.sparkSession.createDataFrame([(a, k) for a, (k, _) in ACTIONS.items()], "action string, kind string")
    return told.join(F.broadcast(kinds), "action").groupBy("kind", "subject").agg(F.max_by("after", "seq").alias("state"))
