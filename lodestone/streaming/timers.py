"""When to replicate: a start delay, a period, an edge from offline to online, and one run at a time, as a stream with timers in its state."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.inverted import InvertedIndex
from lodestone.operators.store import TableStore
from lodestone.streaming import sync

#: Seconds from the first poll to the first run, and between runs.
DELAY, PERIOD = 30, 20 * 60
COMMAND = "key string, time timestamp, reason string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Schedule:
    """The state of one key, in milliseconds; ``steps`` are told in time order and answer with commands."""

    def __init__(self, online: bool = False, running: bool = False, due: int = -1, last: int = -1, first: bool = True, delay: int = DELAY, period: int = PERIOD):
        self.online, self.running, self.due, self.last, self.first = online, running, due, last, first
        self.delay, self.period = 1000 * delay, 1000 * period

    def until(self, now: int) -> Iterator[tuple[int, str]]:
        """Timers that go off up to ``now``. A run that would start offline, or beside another one, is left out."""
        while 0 <= self.due <= now:
            if self.online and not self.running:
                self.running = True
                yield self.due, "start" if self.first else "period"
            self.first, self.due = False, self.due + self.period

    def told(self, now: int, online: bool | None) -> Iterator[tuple[int, str]]:
        """A poll (``online``), or the end of a run (None). What is older than what was told before is left out."""
        if now < self.last:
            return
        if self.due < 0:
            self.due = now + self.delay
        yield from self.until(now)
        before, self.last = self.online if self.last >= 0 else None, now
        if online is None:
            self.running = False
            return
        self.online = online
        if online and before is False and not self.running:
            self.running = True
            yield now, "edge"


class _Timed(StatefulProcessor):
    def __init__(self, delay: int, period: int):
        self.delay, self.period = delay, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("schedule", "online boolean, running boolean, due bigint, last bigint, first boolean")

    def _load(self) -> Schedule:
        return Schedule(*(self.kept.get() or ()), delay=self.delay, period=self.period) if self.kept.exists() else Schedule(delay=self.delay, period=self.period)

    def _keep(self, s: Schedule, timer: int) -> None:
        self.kept.update((s.online, s.running, s.due, s.last, s.first))
        if s.due != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(s.due)

    @staticmethod
    def _rows(key, found: list[tuple[int, str]]) -> Iterator[Row]:
        for at, reason in found:
            yield Row(key=key[0], time=datetime.fromtimestamp(at / 1000), reason=reason)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = self._load()
        timer = s.due
        told = sorted((round(r["time"].timestamp() * 1000), r["online"] is None, r["online"]) for r in rows)
        yield from self._rows(key, [c for at, _, online in told for c in s.told(at, online)])
        self._keep(s, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s, at = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if s.due <= at:
            yield from self._rows(key, list(s.until(at)))
            self._keep(s, at)

    def close(self) -> None:
        pass


def commands(events: DataFrame, key: str, time: str, online: str, delay: int = DELAY, period: int = PERIOD, late: str = "1 minute") -> DataFrame:
    """``key, time, reason`` (``start``, ``period`` or ``edge``) of each run that is due, from a stream of polls (``online`` true or false)
    and ends of runs (``online`` null).

    Timers go by the polls' own time, so that a stream that is read late, in other batches, or again from its checkpoint gives the same commands, as
    long as a key's polls come in order; one that is older than what an earlier batch told is left out. It needs the RocksDB provider of
    state stores (``PROVIDER``).
    """
    slim = events.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("time"), F.col(online).cast("boolean").alias("online"))
    return slim.withWatermark("time", late).groupBy("key").transformWithState(_Timed(delay, period), COMMAND, "Append", "EventTime")


def replicate_when_due(found: DataFrame, cloud: TableStore, local: TableStore, checkpoint: str, version: str | None = None, index: InvertedIndex | None = None, once: bool = False) -> StreamingQuery:
    """Replicates when a batch has commands, once whatever their number; the index follows, and is swapped when it is whole."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            sync.replicate_once(cloud, local, version, index)

    out = found.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(run)
    return (out.trigger(availableNow=True) if once else out).start()
