"""Streams with timers: writes gathered for a moment, memories of a bounded number of things, and daily runs.

State is kept by key in the session's state store (which has to be RocksDB for these operators), so it
survives a restart with the query's checkpoint; time is that of the events, by their watermark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import Any
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Milliseconds for which writes are gathered, and rows of one chunk.
GATHER_MS, CHUNK_ROWS = 100, 250
MILLIS = timedelta(milliseconds=1)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _millis(at: pd.Series) -> list[int]:
    return [(t.to_pydatetime().replace(tzinfo=UTC) - datetime.fromtimestamp(0, UTC)) // MILLIS for t in at]


class Gatherer(StatefulProcessor):
    """Holds a key's rows from the first one on for GATHER_MS, then gives them out in chunks, in order of time and id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, id string")
        self.due = handle.getValueState("due", "at long")

    def _flushed(self, key: tuple, until: int) -> pd.DataFrame:
        rows = sorted((r[0], r[1]) for r in self.held.get())
        self.held.clear()
        self.due.clear()
        return pd.DataFrame({"key": [key[0]] * len(rows), "flushed_at": [until] * len(rows), "chunk": [i // CHUNK_ROWS for i in range(len(rows))], "id": [r[1] for r in rows]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            new = sorted(zip(_millis(batch["ts"]), batch["id"], strict=True))
            for at, name in new:
                due = self.due.get()
                if due is not None and at >= due[0]:  # a row of a later moment, in the same batch
                    self.handle.deleteTimer(due[0])
                    yield self._flushed(key, due[0])
                    due = None
                if due is None:
                    self.due.update((at + GATHER_MS,))
                    self.handle.registerTimer(at + GATHER_MS)
                self.held.appendValue((at, name))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._flushed(key, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def gathered(writes: DataFrame, late: str = "1 second") -> DataFrame:
    """key, flushed_at (ms), chunk, id of a stream of writes(key, id, ts): each moment's writes together."""
    marked = writes.withWatermark("ts", late).select("key", "id", "ts")
    return marked.groupBy("key").transformWithStateInPandas(Gatherer(), "key string, flushed_at long, chunk int, id string", "Append", "EventTime")


class Retained(StatefulProcessor):
    """Remembers the newest ``most`` names of a key for ``ttl_ms`` after they were last seen, and tells which are new."""

    def __init__(self, most: int, ttl_ms: int) -> None:
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "name string", "first long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            out = []
            for at, name in sorted(zip(_millis(batch["ts"]), batch["id"], strict=True)):
                known = {k[0]: (v[0], v[1]) for k, v in self.seen.iterator()}
                for old in [n for n, (_, last) in known.items() if last + self.ttl_ms <= at]:
                    self.seen.removeKey((old,))
                    out.append((key[0], old, "expired"))
                    del known[old]
                if name not in known:
                    out.append((key[0], name, "new"))
                self.seen.updateValue((name,), (known.get(name, (at,))[0], at))
                known[name] = (known.get(name, (at,))[0], at)
                for _, old in sorted((first, n) for n, (first, _) in known.items())[: max(0, len(known) - self.most)]:
                    self.seen.removeKey((old,))
                    out.append((key[0], old, "evicted"))
            yield pd.DataFrame(out, columns=["key", "id", "event"])

    def close(self) -> None:
        pass


def retained(events: DataFrame, most: int, ttl_ms: int, late: str = "1 second") -> DataFrame:
    """key, id, event (new, evicted, expired) of a stream of events(key, id, ts); those first met go first."""
    marked = events.withWatermark("ts", late).select("key", "id", "ts")
    return marked.groupBy("key").transformWithStateInPandas(Retained(most, ttl_ms), "key string, id string, event string", "Append", "EventTime")


def next_run(now_ms: int, hour: int, minute: int, zone: str) -> int:
    """The next time, in UTC milliseconds, at which it is this hour and minute in the zone; within half a second counts as gone."""
    tz = ZoneInfo(zone)
    day = datetime.fromtimestamp(now_ms / 1000, tz).date()
    at = lambda d: (datetime(d.year, d.month, d.day, hour, minute, tzinfo=tz).astimezone(UTC) - datetime.fromtimestamp(0, UTC)) // MILLIS
    return at(day) if at(day) > now_ms + 500 else at(day + timedelta(days=1))


class Daily(StatefulProcessor):
    """A run of each agent every day at its hour in its zone, from the agent's first event on; each run tells how many events came before it.

    The hour of the agent's first event stays; an event counts for the run that follows its own time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plan = handle.getValueState("plan", "hour int, minute int, zone string")
        self.counts = handle.getMapState("counts", "run_at long", "events long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            times = sorted(_millis(batch["ts"]))
            if not self.plan.exists():
                self.plan.update((int(batch["hour"].iloc[0]), int(batch["minute"].iloc[0]), str(batch["zone"].iloc[0])))
                self.handle.registerTimer(next_run(times[0], *self.plan.get()))
            plan = self.plan.get()
            for due, n in Counter(next_run(at, *plan) for at in times).items():
                held = self.counts.getValue((due,)) if self.counts.containsKey((due,)) else (0,)
                self.counts.updateValue((due,), (held[0] + n,))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.handle.registerTimer(next_run(due, *self.plan.get()))
        events = self.counts.getValue((due,))[0] if self.counts.containsKey((due,)) else 0
        if events:
            self.counts.removeKey((due,))
        yield pd.DataFrame({"agent": [key[0]], "run_at": [due], "events": [events]})

    def close(self) -> None:
        pass


def daily_runs(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """agent, run_at (ms), events since the run before of a stream of events(agent, hour, minute, zone, ts)."""
    marked = events.withWatermark("ts", late).select("agent", "hour", "minute", "zone", "ts")
    return marked.groupBy("agent").transformWithStateInPandas(Daily(), "agent string, run_at long, events long", "Append", "EventTime")
