"""Reply streams with state: each stream's events in order until its result, its error, or too long a silence.

The state of a stream is its last place, the time of its first event, and whether it has ended; Spark
keeps it by stream in its state store, and a run that restarts goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from sceneloom.sources.artifacts import event_of

_STATE = "last long, began long, ended boolean"
_OUT = "stream string, nth long, at timestamp, type string, content string, name string, arguments string, component_ids array<int>, reason string, elapsed_ms long"
#: The event with which a silent stream ends.
TIMED_OUT = "timed out"


class _Replies(StatefulProcessor):
    def __init__(self, silence_ms: int, keep_ms: int) -> None:
        self.silence_ms, self.keep_ms = silence_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stream", _STATE)

    def _only_timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802  the interface's name
        last, began, ended = self.state.get() if self.state.exists() else (-1, None, False)
        latest = None
        for row in sorted(rows, key=lambda r: (r["nth"], r["ms"])):
            if ended or row["nth"] <= last:
                continue
            began, last, latest = row["ms"] if began is None else began, row["nth"], max(latest or 0, row["ms"])
            ended = row["type"] in ("result", "error")
            yield Row(stream=key[0], nth=last, at=row["at"], **{c: row[c] for c in ("type", "content", "name", "arguments", "component_ids", "reason")}, elapsed_ms=row["ms"] - began)
        if latest is not None:
            self.state.update((last, began, ended))
            self._only_timer(latest + (self.keep_ms if ended else self.silence_ms))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        last, began, ended = self.state.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if ended:
            self.state.clear()
            return
        self.state.update((last + 1, began, True))
        self.handle.registerTimer(due + self.keep_ms)
        yield Row(stream=key[0], nth=last + 1, at=None, type="error", content=TIMED_OUT, name=None, arguments=None, component_ids=None, reason=None, elapsed_ms=due - began)

    def close(self) -> None:
        pass


def with_state_store(spark: SparkSession) -> None:
    """State of this kind needs the store that keeps several values by key; queries take the setting when they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def event_rows(lines: DataFrame) -> DataFrame:
    """stream, nth, at, event of ``lines`` (stream, nth, at, value): those whose value is an event."""
    return lines.select("stream", F.col("nth").cast("long").alias("nth"), F.col("at").cast("timestamp").alias("at"), event_of(F.col("value")).alias("event")).where("event.type IS NOT NULL")


def replies(events: DataFrame, late: str = "10 seconds", silence: timedelta = timedelta(seconds=60), keep: timedelta = timedelta(days=1)) -> DataFrame:
    """stream, nth, at, type, content, name, arguments, component_ids, reason, elapsed_ms of a stream ``events`` (stream, nth, at, event).

    The events of a stream come out once each, in the order of nth within what arrives together, up to its first result or
    error; what comes after, comes twice, or is behind an event that is out already drops, as does what is later than the watermark
    (``late``) allows.  A stream that is silent for ``silence`` of event time ends with an error event (no time of its own).  elapsed_ms counts from
    its first event.  That it has ended is remembered for ``keep`` of event time.  Rows without stream, nth or time drop out.
    Call ``with_state_store`` before the query is started.
    """
    flat = events.where("stream IS NOT NULL AND nth IS NOT NULL AND at IS NOT NULL").withWatermark("at", late).select("stream", "nth", "at", F.unix_millis("at").alias("ms"), "event.*")
    processor = _Replies(int(silence.total_seconds() * 1000), int(keep.total_seconds() * 1000))
    return flat.groupBy("stream").transformWithState(processor, _OUT, "Append", "EventTime")
