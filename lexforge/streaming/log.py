"""The call log as a stream: starts and ends paired by event time, budgets and policies metered in order.

State lies in RocksDB, so the number of open calls isn't bound by memory, and a query that is started again
from its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lexforge.shipping import ship
from lexforge.sources.logs import EVENTS

PAIRED = "session string, sequence long, tool string, started_ms long, ended_ms long, latency_ms double, results long, error string, starts long, ends long, warning string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_log(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A growing folder of JSON-lines logs."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def _prepare(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class _Pairing(StatefulProcessor):
    """What is known of one call, until its time is over."""

    _STATE = "tool string, started_ms long, ended_ms long, latency_ms double, results long, error string, starts long, ends long, due long"

    def __init__(self, timeout_ms: int, settle_ms: int):
        self.timeout_ms, self.settle_ms = timeout_ms, settle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", self._STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        tool, started, ended, latency, results, error, starts, ends, due = self.call.get() if self.call.exists() else (None, None, None, None, None, None, 0, 0, None)
        for e in rows:
            if e.event == "tool_start":
                starts += 1
                if started is None or e.timestamp_ms < started:  # the first counts
                    started, tool = e.timestamp_ms, e.tool
            elif e.event == "tool_end":
                ends += 1
                if ended is None or e.timestamp_ms < ended:
                    ended, latency, results, error = e.timestamp_ms, e.latency_ms, e.result_count, e.error
        if starts or ends:
            both = started is not None and ended is not None
            now = max(started, ended) + self.settle_ms if both else (ended if started is None else started) + self.timeout_ms
            now = max(now, timerValues.getCurrentWatermarkInMs() + 1)
            if now != due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(now)
            self.call.update((tool, started, ended, latency, results, error, starts, ends, now))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.call.exists():
            tool, started, ended, latency, results, error, starts, ends, due = self.call.get()
            if due == expiredTimerInfo.getExpiryTimeInMs():
                self.call.clear()
                warning = "duplicate start" if starts > 1 else "duplicate end" if ends > 1 else "end without start" if not starts else "unfinished" if not ends else None
                yield Row(
                    session=key[0], sequence=key[1], tool=tool, started_ms=started, ended_ms=ended, latency_ms=latency, results=results, error=error, starts=starts, ends=ends, warning=warning
                )


def pair_stream(events: DataFrame, timeout_ms: int = 10 * 60 * 1000, settle_ms: int = 60 * 1000, late_ms: int = 60 * 1000) -> DataFrame:
    """One row per call of a log stream, as the batch operator ``sessions.pair_events`` gives it.

    All by event time: the watermark stays ``late_ms`` behind the latest event.  A call is told once the watermark has passed
    its end by ``settle_ms`` (so that doubled ends are seen), or its start by ``timeout_ms`` without an end: the handler never
    finished, or was dropped.  Events that come later than that make a call of their own: an end that is too late is an end
    without a start.  Events behind the watermark are dropped, as are those without a time.
    """
    _prepare(events.sparkSession)
    some = events.select(F.col("session_id").alias("session"), "sequence", "event", "tool", "timestamp_ms", "latency_ms", "result_count", "error")
    timed = some.where("timestamp_ms IS NOT NULL").withColumn("at", F.timestamp_millis("timestamp_ms")).withWatermark("at", f"{late_ms} milliseconds")
    return timed.groupBy("session", "sequence").transformWithState(_Pairing(timeout_ms, settle_ms), PAIRED, "Append", "EventTime")


class _Ordered(StatefulProcessor):
    """Rows of a session in the order of their sequence, whatever order they come in.

    A row that is ahead of its turn is held until its predecessors are in.  With event times, a gap ends when the watermark has
    passed the row behind it: nothing older can follow.
    """

    def __init__(self, first: int, timed: bool):
        self.first, self.timed = first, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "next long")
        self.held = handle.getMapState("held", "sequence long", "bytes long, tool string, at long")
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        turn = self.turn.get()[0] if self.turn.exists() else self.first
        for row in rows:
            if row.sequence is not None and row.sequence >= turn and not self.held.containsKey((row.sequence,)):
                at = getattr(row, "timestamp_ms", None)
                self.held.updateValue((row.sequence,), (row.bytes, row.tool, at))
                if self.timed and at is not None:
                    self.handle.registerTimer(max(at, timerValues.getCurrentWatermarkInMs() + 1))
        yield from self._release(key, turn)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        over = timerValues.getCurrentWatermarkInMs()
        ripe = [s for (s,), (_, _, at) in self.held.iterator() if at is not None and at <= over]
        turn = self.turn.get()[0] if self.turn.exists() else self.first
        for sequence in sorted(ripe):
            if self.held.containsKey((sequence,)):  # not released behind an earlier one
                yield from self._release(key, max(turn, sequence))

    def _release(self, key, turn: int) -> Iterator[Row]:
        while self.held.containsKey((turn,)):
            size, tool, _ = self.held.getValue((turn,))
            self.held.removeKey((turn,))
            yield from self.take(key[0], turn, size, tool)
            turn += 1
        self.turn.update((turn,))

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Declare further state."""

    def take(self, session, sequence: int, size: int | None, tool: str | None) -> Iterator[Row]:
        raise NotImplementedError


def _in_turn(calls: DataFrame, processor: type[_Ordered], schema: str, first: int, late_ms: int, **options: object) -> DataFrame:
    _prepare(calls.sparkSession)
    timed = "timestamp_ms" in calls.columns
    some = calls.select("session", "sequence", *[F.col(c) if c in calls.columns else F.lit(None).cast(t).alias(c) for c, t in (("bytes", "long"), ("tool", "string"))], *(["timestamp_ms"] if timed else []))
    if timed:
        some = some.withColumn("at", F.timestamp_millis("timestamp_ms")).withWatermark("at", f"{late_ms} milliseconds")
    return some.groupBy("session").transformWithState(processor(first, timed, **options), schema, "Append", "EventTime" if timed else "None")


METERED = "session string, sequence long, attempt long, forwarded boolean, delivered long, exhausted boolean"


class _Meter(_Ordered):
    def __init__(self, first: int, timed: bool, most_calls: int, most_bytes: int, failure_bytes: int):
        super().__init__(first, timed)
        self.most_calls, self.most_bytes, self.failure_bytes = most_calls, most_bytes, failure_bytes

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "attempts long, bytes long, shut boolean")

    def take(self, session, sequence, size, tool) -> Iterator[Row]:
        attempts, used, shut = self.used.get() if self.used.exists() else (0, 0, False)
        attempts, size = attempts + 1, size or 0
        shut = bool(shut or attempts > self.most_calls or used + size > self.most_bytes)
        delivered = self.failure_bytes if shut else size
        self.used.update((attempts, used + delivered, shut))
        yield Row(session=session, sequence=sequence, attempt=attempts, forwarded=not shut, delivered=delivered, exhausted=shut)


def meter_stream(calls: DataFrame, most_calls: int, most_bytes: int, failure_bytes: int = 0, first: int = 1, late_ms: int = 60 * 1000) -> DataFrame:
    """A budget of calls and bytes per session over a stream (session, sequence, bytes; timestamp_ms where known).

    Attempts count first; a response over the bytes is replaced by a failure, whose bytes are charged, and latches the
    session shut.  Calls are metered in the order of their sequence, which counts from ``first``: however the log is split into
    batches, the result is that of ``sessions.budget_meter``.  Without times a call waits for its predecessors for good; with
    them, until the watermark has passed it.  A sequence that comes again is dropped.
    """
    return _in_turn(calls, _Meter, METERED, first, late_ms, most_calls=most_calls, most_bytes=most_bytes, failure_bytes=failure_bytes)


class _Policy(_Ordered):
    def __init__(self, first: int, timed: bool, allowed: list[str]):
        super().__init__(first, timed)
        self.allowed = allowed

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.opened = handle.getValueState("opened", "opened boolean")

    def take(self, session, sequence, size, tool) -> Iterator[Row]:
        if not self.opened.exists():
            if tool in self.allowed:
                self.opened.update((True,))
            else:
                yield Row(session=session, sequence=sequence, tool=tool)


def policy_stream(calls: DataFrame, allowed: list[str], first: int = 1, late_ms: int = 60 * 1000) -> DataFrame:
    """Violations of a first-tool policy over a stream (session, sequence, tool): calls before an allowed one, by their sequence."""
    return _in_turn(calls, _Policy, "session string, sequence long, tool string", first, late_ms, allowed=allowed)
