"""Stateful lifecycle pattern: added, then fetched, then enriched, within a time limit.

Events are handled in (time, position) order, whatever order they arrive in: an event waits in
state until the watermark has passed it. Per key and limit the state is what arrived within the
watermark delay, plus the open links of the last `within_seconds`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.processors import use_rocksdb

OUTPUT = "run_key string, added_us long, fetched_us long, enriched_us long"
KINDS = {"link.added": 0, "content.fetched": 1, "enrichment.completed": 2}


def advance(waiting: list[tuple[int, int, int]], held: list[tuple[int, int]], until_us: int, limit_us: int) -> tuple[list, list, list]:
    """(still waiting, open links, matches) after all events up to `until_us`, in order."""
    done = []
    waiting.sort()
    at = 0
    for us, _, kind in waiting:
        if us > until_us:
            break
        at += 1
        held = [(a, f) for a, f in held if us - a < limit_us]
        if kind == 0:
            held.append((us, -1))
        elif kind == 1:
            held = [(a, us if f < 0 else f) for a, f in held]
        else:
            done += [(a, f, us) for a, f in held if f >= 0]
            held = [(a, f) for a, f in held if f < 0]
    return waiting[at:], held, done


class Lifecycle(StatefulProcessor):
    """List state: events the watermark has not passed, and links added but not yet enriched.
    Value state: the one timer of a key, due when the first of them is."""

    def __init__(self, limit_us: int) -> None:
        self.limit = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, ord long, kind int")
        self.open = handle.getListState("open", "added long, fetched long")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [(r[0], r[1], r[2]) for r in rows]
        if fresh:
            self.waiting.appendList(fresh)
            self._set(min(fresh)[0] // 1000, self.due.get())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        before, opened = [tuple(r) for r in self.waiting.get()], [tuple(r) for r in self.open.get()]
        waiting, held, done = advance(list(before), opened, mark, self.limit)
        held = [(a, f) for a, f in held if mark - a < self.limit]
        # Every call goes to the state's process: only what changed is written.
        for state, old, new in ((self.waiting, before, waiting), (self.open, opened, held)):
            if new and new != old:
                state.put(new)
            elif old and not new:
                state.clear()
        if waiting or held:
            due = waiting[0][0] if waiting else max(a for a, _ in held) + self.limit
            self._set(max(due // 1000, mark // 1000 + 1), None)
        else:
            self.due.clear()
        return iter([Row(run_key=key[0], added_us=a, fetched_us=f, enriched_us=us) for a, f, us in done])

    def _set(self, ms: int, old: tuple | None) -> None:
        if old is None or ms < old[0]:
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, within_seconds: int = 300, delay: str = "5 minutes") -> DataFrame:
    """Matches of the pattern as the watermark passes their last event.

    Events later than the watermark are dropped, as everywhere in Structured Streaming.
    """
    use_rocksdb(events.sparkSession)
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return (
        events.filter(F.col("event_type").isin(*KINDS))
        .withWatermark("occurred_at", delay)
        .select(
            F.unix_micros("occurred_at").alias("us"), F.col("ord").cast("long").alias("ord"), kind[F.col("event_type")].alias("kind"),
            F.coalesce("correlation_id", "id").alias("run_key"), "occurred_at",
        )
        .groupBy("run_key")
        .transformWithState(statefulProcessor=Lifecycle(within_seconds * 1_000_000), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime")
    )
