"""Transmissions opened, suspected, confirmed, discarded, extended and reopened on a stream.

State is kept per block of identities (a reading exchange, a writer, a resource), so a resource
that everyone uses is spread over its readers. Writes reach it as co-accesses: `held` keeps them
until their result is known, `paired` joins them to later reads. All rows wait in state until
the watermark has passed them and are then taken in order of time, so the updates are those
of `operators.flow.correlations` whatever the order of arrival. What retention has passed
is dropped from state.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wakeline.operators.flow import UPDATES, Timing

UPDATE_TYPES = "generation int, update string, at long, matches long"


class Identity:
    """What is known of one identity; `deadline` is when it next changes by itself."""

    def __init__(self, timing: Timing, opened: int, generation: int = 0, phase: str = "awaiting", held: int = 0):
        self.timing, self.opened, self.generation, self.phase, self.held = timing, opened, generation, phase, held

    @property
    def stored(self) -> tuple:
        return (self.opened, self.generation, self.phase, self.held)

    @property
    def deadline(self) -> int:
        t = self.timing
        return self.opened + {"awaiting": t.evidence, "suspected": t.settle_after}.get(self.phase, t.retention)

    def expire(self) -> Iterator[tuple]:
        """The change at the deadline; after retention the phase is `past`."""
        at = self.deadline
        if self.phase == "awaiting" and self.held:
            self.phase = "confirmed"
            yield self.generation, "confirmed", at, self.held
        elif self.phase in ("awaiting", "suspected"):
            self.phase = "suspected" if self.phase == "awaiting" else "discarded"
            yield self.generation, self.phase, at, 0
        else:
            self.phase = "past"

    def match(self, at: int, n: int) -> Iterator[tuple]:
        if self.phase == "awaiting":
            self.held += n
        elif self.phase == "confirmed":
            yield self.generation, "extended", at, n
        else:
            if self.phase == "discarded":
                self.generation += 1
                yield self.generation, "opened", at, 0
            self.phase = "confirmed"
            yield self.generation, "confirmed", at, n


class Correlator(StatefulProcessor):
    """Input rows: keys, kind `read` or `evidence`, at in microseconds; the identities of a block share its state.

    A state call costs as much as deciding many identities, so what is known of a block is one
    row of lists, and so are the rows that a batch leaves waiting.
    """

    def __init__(self, timing: Timing, types: dict[str, str]):
        self.timing, self.keys = timing, list(types)
        self.listed = "".join(f"`{k}` array<{t}>, " for k, t in types.items())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", self.listed + "opened array<long>, generation array<int>, phase array<string>, held array<long>")
        self.waiting = handle.getListState("waiting", self.listed + "at array<long>, matched array<boolean>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(*(r[k] for k in self.keys), r["at"], r["kind"] == "evidence") for r in rows]
        if new:
            self.waiting.appendValue(self._lists(new))
            self._wake(min(r[-2] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # All that the watermark has passed is decided at the first timer of a batch.
        until, n = timerValues.getCurrentWatermarkInMs() * 1000, len(self.keys)
        rows = [r for part in self.waiting.get() for r in zip(*part, strict=True)]
        due, later = defaultdict(list), [r for r in rows if r[n] >= until]
        for r in rows:
            if r[n] < until:
                due[r[:n]].append(r[n:])
        known = {r[:n]: Identity(self.timing, *r[n:]) for r in zip(*(self.known.get() or ()), strict=True)}
        met = set(due) | {k for k, one in known.items() if one.deadline < until}
        if not met:
            return
        for k in met:
            one, out = self._decided(known.get(k), due.get(k, ()), until)
            if one is None or one.phase == "past":
                known.pop(k, None)
            else:
                known[k] = one
            # Rows, not frames: an identity has few updates, and a frame for each costs more than they do.
            for update in out:
                yield Row(**dict(zip(self.keys, k, strict=True)), **dict(zip(UPDATES, update, strict=True)))
        if len(later) < len(rows):
            self.waiting.put([self._lists(later)]) if later else self.waiting.clear()
        if known:
            self.known.update(self._lists([(*k, *one.stored) for k, one in known.items()]))
        else:
            self.known.clear()
        # One timer, for the next row or change, so that a batch reads what waits once.
        if later or known:
            self._wake(min([r[n] for r in later] + [one.deadline for one in known.values()]))

    def _decided(self, one: Identity | None, rows: Iterable[tuple], until: int) -> tuple[Identity | None, list[tuple]]:
        """An identity and its updates after its rows (at, matched), up to a time."""
        out: list[tuple] = []
        # Reads before evidence of the same time; matches of one time are one update.
        for (at, is_match), n in sorted(Counter(rows).items()):
            while one and one.phase != "past" and one.deadline < at:
                out += one.expire()
            if one is None and not is_match:
                one = Identity(self.timing, at)
                out.append((0, "opened", at, 0))
            elif one and is_match and one.phase != "past":
                out += one.match(at, n)
        while one and one.phase != "past" and one.deadline < until:
            out += one.expire()
        return one, out

    @staticmethod
    def _lists(rows: list[tuple]) -> tuple:
        return tuple(map(list, zip(*rows, strict=True)))

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def close(self) -> None:
        pass


def correlated(events: DataFrame, keys: list[str], timing: Timing, delay: str = "1 minute", block: Column | None = None) -> DataFrame:
    """Updates (keys, generation, update, at, matches) of events (keys, kind, at, ts), ts being `at` as a timestamp.

    block: a function of the keys; identities of one block share a state, which is read and written
    whole whenever one of them changes, so a block should hold some hundreds that are open at the
    same time. Without it an identity has a state of its own, whose calls cost most of the time.
    """
    types = {k: dict(events.dtypes)[k] for k in keys}
    blocked = events.select(*keys, "kind", "at", "ts", (F.xxhash64(*keys) if block is None else block).alias("_block"))
    return (
        blocked.withWatermark("ts", delay)
        .groupBy("_block")
        .transformWithState(
            Correlator(timing, types), outputStructType=", ".join(f"`{k}` {t}" for k, t in types.items()) + ", " + UPDATE_TYPES, outputMode="Append", timeMode="EventTime"
        )
    )


def held(writes: DataFrame, results: DataFrame, timing: Timing, delay: str = "1 minute") -> DataFrame:
    """`flow.settled_writes` on two streams: a write waits in state for its result, and comes
    out as unknown once the watermark shows that it has settled.

    writes: (call, write_ts, ...); results: (call, outcome, result_ts), one a call.
    """
    w = writes.withWatermark("write_ts", delay)
    r = results.withColumnRenamed("call", "_call").withWatermark("result_ts", delay)
    seconds = timing.settle_after // 1_000_000
    settles = F.col("write_ts") + F.expr(f"INTERVAL {seconds} SECONDS")
    found = w.join(r, F.expr("call = _call AND result_ts >= write_ts") & (F.col("result_ts") <= settles), "leftOuter")
    released = found.withColumns({"outcome": F.coalesce("outcome", F.lit("unknown")), "released_ts": F.coalesce("result_ts", settles)})
    return released.where("outcome <> 'rejected'").drop("_call", "result_ts")


def paired(writes: DataFrame, reads: DataFrame, timing: Timing, delay: str = "1 minute") -> DataFrame:
    """Co-access on two streams: an interval join with watermarks on both sides.

    writes: (resource, writer, write_ts); reads: (resource, reader, read_ts).
    """
    w = writes.withWatermark("write_ts", delay).withColumnRenamed("resource", "_resource")
    r = reads.withWatermark("read_ts", delay)
    seconds = timing.co_access // 1_000_000
    near = F.expr(f"_resource = resource AND writer <> reader AND read_ts > write_ts AND read_ts <= write_ts + INTERVAL {seconds} SECONDS")
    return r.join(w, near).drop("_resource")
