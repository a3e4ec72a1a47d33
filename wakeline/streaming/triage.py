"""Triage of findings on a stream, with a state for each (rule, subject).

A finding opens an alert, or counts for the one that is open; an alert is forgotten once its
last finding is older than `ttl`, and a later finding opens the next. Findings wait in state until the
watermark has passed them and are taken in order of time, so the result does not depend on
how the stream is cut into batches. Rules and judged subjects are tables, joined on the way in.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wakeline.sources.storage import small

COLUMNS = "alert int, outcome string, occurrences long, first_at long, last_at long, at long"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


class Triage(StatefulProcessor):
    """Input rows: rule, subject, verdict (of the rule and the subject) and at in microseconds.

    Each time that findings were taken gives a row for every alert they belong to, with its totals so far.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "alert int, outcome string, occurrences long, first_at long, last_at long")
        self.waiting = handle.getListState("waiting", "at long, verdict string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["at"], r["verdict"]) for r in rows]
        if new:
            self.waiting.appendList(new)
            self._wake(min(at for at, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get())
        due, later = [tuple(r) for r in rows if r[0] < until], [tuple(r) for r in rows if r[0] >= until]
        known = self.known.get()
        now = tuple(known) if known else None
        out: list[tuple] = []
        for (at, verdict), n in sorted(Counter(due).items()):
            if now and at <= now[4] + self.ttl:
                now = (*now[:2], now[2] + n, now[3], at)
            else:
                if now:
                    out.append((*now, now[4]))
                now = ((now[0] if now else 0) + 1, verdict or "opened", n, at, at)
        if due:
            out.append((*now, now[4]))
        self.waiting.put(later) if later else self.waiting.clear()
        if later:
            self._wake(min(later)[0])
        if now and now[4] + self.ttl < until and not later:
            # Nothing that may still come can belong to it; only its number is kept for as long again.
            if now[4] + 2 * self.ttl < until:
                self.known.clear()
            else:
                self.known.update(now)
                self._wake(now[4] + 2 * self.ttl)
        elif now:
            self.known.update(now)
            self._wake(now[4] + self.ttl)
        # Rows, not frames: most keys have few findings, and a frame for each costs more than they do.
        for alert in out:
            yield Row(rule=key[0], subject=key[1], **dict(zip(NAMES, alert, strict=True)))

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def close(self) -> None:
        pass


def judged(findings: DataFrame, rules: DataFrame, rejected: DataFrame) -> DataFrame:
    """Findings with what their rule or subject makes of them: rule_inactive, operator_rejected, or null.

    rules: (rule, evaluating); rejected: (subject); both are tables, findings may be a stream.
    """
    known = rules.groupBy("rule").agg(F.max("evaluating").alias("_on"))
    out = rejected.select("subject", F.lit(True).alias("_false")).distinct()
    joined = findings.join(small(known), "rule", "left").join(small(out), "subject", "left")
    verdict = F.when(~F.coalesce("_on", F.lit(False)), "rule_inactive").when(F.col("_false"), "operator_rejected")
    return joined.withColumn("verdict", verdict).drop("_on", "_false")


def triaged(findings: DataFrame, rules: DataFrame, rejected: DataFrame, ttl: int, delay: str = "1 minute") -> DataFrame:
    """Alerts (rule, subject, alert, outcome, occurrences, first_at, last_at, at) of a stream of
    findings (rule, subject, at, ts), ts being `at` as a timestamp; of the rows of one alert the
    one with most occurrences is its last."""
    rows = judged(findings.select("rule", "subject", "at", "ts"), rules, rejected).withWatermark("ts", delay)
    types = dict(findings.dtypes)
    return rows.groupBy("rule", "subject").transformWithState(
        Triage(ttl), outputStructType=f"rule {types['rule']}, subject {types['subject']}, {COLUMNS}", outputMode="Append", timeMode="EventTime"
    )


def latest(updates: DataFrame) -> DataFrame:
    """The last row of each alert."""
    keys = ["rule", "subject", "first_at"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct("outcome", "occurrences", "last_at"), "occurrences").alias("u")).select(*keys, "u.*")


def sessions(findings: DataFrame, rules: DataFrame, rejected: DataFrame, ttl: int) -> DataFrame:
    """The same alerts from a table."""
    line = Window.partitionBy("rule", "subject").orderBy("at")
    new = F.when(F.col("at") - F.lag("at").over(line) <= ttl, 0).otherwise(1)
    rows = judged(findings.select("rule", "subject", "at"), rules, rejected).withColumn("_new", new).withColumn("_s", F.sum("_new").over(line))
    found = rows.groupBy("rule", "subject", "_s").agg(F.coalesce(F.min("verdict"), F.lit("opened")).alias("outcome"), F.count("*").alias("occurrences"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return found.drop("_s")
