"""Task and progress streams: throttling, task state, transitions, counters, debouncing, countdowns.

What windows can say is a window, for tables and streams alike. What depends on the events before keeps one small state
for each task. It goes when the watermark is ``keep`` past the task's last event, or, of a task that is done, ``linger``
past it; so the state follows the tasks at work, not all there ever were. Events behind the watermark are late: they
are left out before they reach a state. A task whose state has gone begins anew with its next event.
These streams need the state store that ``with_state_store`` sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from examweft.functions.text import word_count

THROTTLE_MS, DEBOUNCE = 80, "350 milliseconds"
WATERMARK = "10 minutes"


#: How long after its last event a task's state is kept, and after the end of one that is done, in milliseconds.
KEEP_MS, LINGER_MS = 86_400_000, 600_000
DONE = ("completed", "failed")
#: Where a status may go from (fixed values); the same one may come again.
STAGES = {"pending": (None,), "processing": (None, "pending"), "completed": (None, "pending", "processing"), "failed": (None, "pending", "processing")}

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def with_state_store(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries started in here get the state store that keyed states with timers need, over so many partitions."""
    settings = {_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Kept(StatefulProcessor):
    """A state value for each task, which a timer of event time takes away. ``schema`` ends with the time of its newest event."""

    schema = ""

    def __init__(self, keep: int = KEEP_MS):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.schema)

    def put(self, value: tuple, keep: int | None = None) -> None:
        """Keeps ``value`` until ``keep`` past its last field."""
        self.state.update(value)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(value[-1] + (self.keep if keep is None else keep))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


EVENT = "task_id string, ms long, streamed_tokens int, estimated_tokens int"


def throttle(events: DataFrame) -> DataFrame:
    """Events (task_id, ms, streamed_tokens, estimated_tokens) 80 ms after the last that was let through, or
    at the estimate and beyond (F2). For a table: tasks are dealt over partitions and pass through in order, a batch
    at a time, whatever the number of events of a task."""
    order = ["task_id", "ms", "streamed_tokens", "estimated_tokens"]
    rows = events.select(*EVENT_COLUMNS).repartition("task_id").sortWithinPartitions(*(F.asc_nulls_last(c) for c in order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, task, last = False, None, None
        for batch in batches:
            keep = []
            names, times, done, due = (batch.column(c).to_pylist() for c in order)
            for name, ms, streamed, estimated in zip(names, times, done, due, strict=True):
                first = not begun or name != task
                keep.append(first or _passes(last, ms, streamed, estimated))
                if keep[-1]:
                    begun, task, last = True, name, (ms if first or ms is not None else last)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, EVENT)


def _passes(last: int | None, ms: int | None, streamed: int | None, estimated: int | None) -> bool:
    """Whether an event after a task's first goes through; a time or a number that isn't known says nothing for it."""
    return (None not in (last, ms) and ms - last >= THROTTLE_MS) or (None not in (streamed, estimated) and streamed >= estimated)


EVENT_COLUMNS = [c.split()[0] for c in EVENT.split(", ")]


class _Throttle(_Kept):
    schema = "last long, at long"

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        state = self.state.get()
        begun, (last, at) = state is not None, state or (None, 0)
        nulls_last = lambda x: (x is None, x or 0)
        for row in sorted(rows, key=lambda r: (nulls_last(r.ms), nulls_last(r.streamed_tokens))):
            if not begun or _passes(last, row.ms, row.streamed_tokens, row.estimated_tokens):
                begun, last = True, (last if row.ms is None else row.ms)
                yield Row(task_id=row.task_id, ms=row.ms, streamed_tokens=row.streamed_tokens, estimated_tokens=row.estimated_tokens)
            at = max(at, row.ms or 0)
        self.put((last, at))


def throttle_stream(events: DataFrame, watermark: str = WATERMARK, keep: int = KEEP_MS) -> DataFrame:
    """The same for a stream; the state is when the last event went through. Events come in order of batches: one that
    is older than those of a batch before, but not late, is taken after them. The first watermark is 1970: what is older
    counts as of then, so that it isn't late."""
    timed = events.select(*EVENT_COLUMNS, F.greatest(F.timestamp_millis("ms"), F.timestamp_millis(F.lit(1))).alias("ts")).withWatermark("ts", watermark)
    return timed.groupBy("task_id").transformWithState(_Throttle(max(keep, THROTTLE_MS)), EVENT, "append", "eventTime")


STATE = "status string, progress int, message string, error string, seq int"
_FIELDS = ("status", "progress", "message", "error")


class _Tasks(_Kept):
    schema = f"{STATE}, refused int, at long"

    def __init__(self, keep: int, linger: int):
        super().__init__(keep)
        self.linger = linger

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        now = dict(zip((*_FIELDS, "seq", "refused", "at"), self.state.get() or (None, 0, None, None, -1, 0, 0), strict=True))
        for row in sorted(rows, key=lambda r: r.seq):
            if row.status is not None and row.status != now["status"] and now["status"] not in STAGES.get(row.status, (now["status"],)):
                now["refused"] += 1
            now |= {c: row[c] for c in _FIELDS if row[c] is not None} | {"seq": row.seq, "at": max(now["at"], int(row.ts.timestamp() * 1000))}
        self.put(tuple(now.values()), self.linger if now["status"] in DONE else None)
        yield Row(task_id=key[0], **{c: now[c] for c in (*_FIELDS, "seq", "refused")})


def task_states(updates: DataFrame, watermark: str = WATERMARK, keep: int = KEEP_MS, linger: int = LINGER_MS) -> DataFrame:
    """The running state of each task in a stream of partial updates (task_id, seq, ts, status, progress, message, error).

    Null keeps what was; progress may fall. ``refused`` counts changes of status against the order of stages (F1): to a
    former stage, or out of a task that is done. They are taken over all the same, as the last word of whoever sends them.
    """
    rows = updates.select("task_id", "seq", *_FIELDS, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return rows.groupBy("task_id").transformWithState(_Tasks(keep, linger), f"task_id string, {STATE}, refused int", "update", "eventTime")


class _Transitions(_Kept):
    schema = "status string, at long"

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        previous, at = self.state.get() or (None, 0)
        for row in sorted(rows, key=lambda r: r.seq):
            if previous is not None and row.status is not None and row.status != previous:
                yield Row(task_id=key[0], seq=row.seq, previous=previous, status=row.status)
            previous, at = row.status, max(at, int(row.ts.timestamp() * 1000))
        self.put((previous, at))


def transitions(snapshots: DataFrame, watermark: str = WATERMARK, keep: int = KEEP_MS) -> DataFrame:
    """Status changes between polled snapshots (task_id, seq, ts, status) of a stream: task_id, seq, previous, status."""
    rows = snapshots.select("task_id", "seq", "status", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return rows.groupBy("task_id").transformWithState(_Transitions(keep), "task_id string, seq long, previous string, status string", "append", "eventTime")


def streamed_tokens(chunks: DataFrame) -> DataFrame:
    """A running count of words over a task's chunks, one at least for each; every attempt counts from zero."""
    w = Window.partitionBy("task_id", "attempt").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("streamed", F.sum(F.greatest(F.lit(1), word_count(F.col("chunk")))).over(w))


def last_attempt(chunks: DataFrame) -> DataFrame:
    """Only the last attempt's chunks."""
    return chunks.withColumn("_last", F.max("attempt").over(Window.partitionBy("task_id"))).where("attempt = _last").drop("_last")


def debounce(edits: DataFrame, key: str, ts: str, value: str, gap: str = DEBOUNCE) -> DataFrame:
    """The last value of each burst of edits: a session that a gap ends (F9). For tables and, behind a watermark, streams."""
    return edits.groupBy(key, F.session_window(ts, gap)).agg(F.max_by(value, ts).alias(value), F.max(ts).alias("last_edit")).select(key, "last_edit", value)


def debounce_stream(edits: DataFrame, key: str, ts: str, value: str, gap: str = DEBOUNCE, watermark: str = WATERMARK) -> DataFrame:
    """The same for a stream: a burst is known to be over, and is given out, when the watermark is past its gap."""
    return debounce(edits.withWatermark(ts, watermark), key, ts, value, gap)


def submission_time(starts: DataFrame, submits: DataFrame) -> DataFrame:
    """When each exam attempt ends: at its submission or, if sooner, when its time is up (F8)."""
    deadline = F.col("started") + F.make_dt_interval(mins=F.col("duration_minutes"))
    both = starts.join(submits.select("attempt_id", "submitted"), "attempt_id", "left")
    return both.select("attempt_id", F.least(F.coalesce("submitted", deadline), deadline).alias("ended"), (F.col("submitted").isNull() | (F.col("submitted") > deadline)).alias("automatic"))


def countdown_stream(events: DataFrame, watermark: str = "1 second") -> DataFrame:
    """The same for a stream of (attempt_id, kind "start" or "submit", ts, duration_minutes): an event-time timer submits (F8)."""
    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            deadline = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], pd.Timestamp(deadline, unit="ms"), True)], columns=["attempt_id", "ended", "automatic"])
            return
        deadline = state.get[0] if state.exists else None
        for row in pd.concat(list(batches)).sort_values(["ts", "kind"]).itertuples(index=False):
            if row.kind == "start":
                deadline = int(row.ts.timestamp() * 1000) + int(row.duration_minutes) * 60_000
            elif deadline is not None and row.ts.timestamp() * 1000 <= deadline:
                if state.exists:
                    state.remove()
                yield pd.DataFrame([(key[0], row.ts, False)], columns=["attempt_id", "ended", "automatic"])
                return
        if deadline is not None:
            state.update((deadline,))
            state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))

    rows = events.select("attempt_id", "kind", "ts", "duration_minutes").withWatermark("ts", watermark)
    return rows.groupBy("attempt_id").applyInPandasWithState(one, "attempt_id string, ended timestamp, automatic boolean", "deadline long", "append", GroupStateTimeout.EventTimeTimeout)


def save_drafts(drafts: DataFrame, folder: str, checkpoint: str):
    """Drafts of a stream, each batch put into a table of versions; ``latest_drafts`` reads the ones in force."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(folder)

    return drafts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
