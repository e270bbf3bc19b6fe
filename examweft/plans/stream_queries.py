"""Streams over the driver's tables: each runs to the end of what there is, stops, and goes on from its checkpoint with the
rest, all in the shared folder. What comes out equals the answer over the whole table."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examweft.plans.queries import SQL, query, streamed_events, table
from examweft.sources import readers, sinks
from examweft.streaming import progress

#: Partitions of the streams' states; a stream keeps those that it was first started with.
PARTITIONS = 4
#: Longer than the tables last: no state goes, so that the whole table's answer comes out.
ALWAYS = 100 * 366 * 86_400_000


def in_two_runs(spark: SparkSession, rows: DataFrame, ts: str, plan: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What ``plan`` makes of a stream of ``rows``, in two runs with one checkpoint: up to the middle of the times, and the rest.

    The result has a column ``batch``. Each batch is a folder of its own, which a batch that is run again replaces.
    """
    root = f"{sinks.shared_folder(spark)}/examweft/stream-{uuid4().hex}"
    middle = rows.agg(F.percentile_approx(F.col(ts).cast("timestamp"), 0.5).alias("middle"))
    first = F.col(ts).cast("timestamp") <= middle.scalar()

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    for part in (first, ~first):
        rows.where(part | (F.col(ts).isNull() if part is first else F.lit(False))).write.mode("append").parquet(f"{root}/in")
        made = plan(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
        with progress.with_state_store(spark, PARTITIONS):
            running = made.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        running.awaitTermination()
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    return spark.read.schema(f"{kept}, batch int").option("basePath", f"{root}/out").parquet(f"{root}/out")


@query(SQL["throttled"])
def streamed_throttle(spark, d):
    """F2 as a stream."""
    rows = streamed_events(spark, d).withColumn("at", F.timestamp_millis("ms"))
    return in_two_runs(spark, rows, "at", lambda s: progress.throttle_stream(s, "1 day", ALWAYS)).drop("batch")


def _task_events(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") != "view", F.col("event_type"))
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"), F.col("value").cast("int").alias("progress"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("error"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts <= (SELECT quantile_disc(ts, 0.5) FROM events) DESC, event_id) AS n FROM events)
SELECT CAST(user_id AS VARCHAR) AS task_id, arg_max(event_type, n) FILTER (event_type <> 'view') AS status, CAST(trunc(arg_max(value, n)) AS INTEGER) AS progress FROM e GROUP BY user_id""")
def streamed_states(spark, d):
    """F3 as a stream: each task's last state."""
    states = in_two_runs(spark, _task_events(spark, d), "ts", lambda s: progress.task_states(s, "1 day", ALWAYS, ALWAYS), "update")
    last = states.groupBy("task_id").agg(F.max_by(F.struct("status", "progress"), "batch").alias("s"))
    return last.select("task_id", "s.status", "s.progress")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts <= (SELECT quantile_disc(ts, 0.5) FROM events) DESC, event_id) AS n FROM events WHERE event_type <> 'view'),
l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY n) AS previous FROM e)
SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS seq, previous, event_type AS status FROM l WHERE previous <> event_type""")
def streamed_transitions(spark, d):
    """F4 as a stream."""
    rows = _task_events(spark, d).where("status is not null").select("task_id", "seq", "ts", "status")
    return in_two_runs(spark, rows, "ts", lambda s: progress.transitions(s, "1 day", ALWAYS)).drop("batch")


#: An event after all others, by which the watermark passes the last burst and the last deadline.
_AFTER = "timestamp '2100-01-01'"


@query(SQL["debounced"])
def streamed_bursts(spark, d):
    """F9 as a stream: a burst is given out once it is over."""
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    after = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.expr(_AFTER).alias("ts"), F.lit(0.0).alias("value"))
    bursts = in_two_runs(spark, rows.unionByName(after), "ts", lambda s: progress.debounce_stream(s, "user_id", "ts", "value", "6 hours", "1 second"))
    return bursts.where("user_id >= 0").select("user_id", F.col("last_edit").cast("timestamp_ntz").alias("last_edit"), "value")


@query("""WITH s AS (SELECT user_id, min(ts) AS began, date_trunc('milliseconds', min(ts)) + INTERVAL 3 DAY AS deadline FROM events GROUP BY user_id),
b AS (SELECT s.user_id, deadline, min(ts) AS bought FROM s LEFT JOIN events e ON e.user_id = s.user_id AND event_type = 'purchase' AND ts BETWEEN began AND deadline GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS attempt_id, coalesce(bought, deadline) AS ended, bought IS NULL AS automatic FROM b""")
def streamed_endings(spark, d):
    """F8 as a stream: a user's first event is the start, a purchase submits, three days are the time; then a timer ends it."""
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("attempt_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    starts = events.groupBy("attempt_id").agg(F.min("ts").alias("ts")).select("attempt_id", F.lit("start").alias("kind"), "ts", F.lit(3 * 24 * 60).alias("duration_minutes"))
    submits = events.where("event_type = 'purchase'").select("attempt_id", F.lit("submit").alias("kind"), "ts", F.lit(None).cast("int").alias("duration_minutes"))
    after = spark.range(1).select(F.lit("after").alias("attempt_id"), F.lit("start").alias("kind"), F.expr(_AFTER).alias("ts"), F.lit(45).alias("duration_minutes"))
    ended = in_two_runs(spark, starts.unionByName(submits).unionByName(after), "ts", lambda s: progress.countdown_stream(s, "1 second"))
    return ended.where("attempt_id <> 'after'").select("attempt_id", F.col("ended").cast("timestamp_ntz").alias("ended"), "automatic")


@query(SQL["drafts"])
def streamed_drafts(spark, d):
    """S15, F7 as a stream: drafts are put into a table of versions as they come."""
    changes = table(spark, d, "events").select(F.col("user_id").alias("exam_id"), F.col("event_type").alias("student"), F.col("event_id").alias("version"), (F.col("value") > 50).alias("submitted"), "ts")
    kept = in_two_runs(spark, changes, "ts", lambda s: s.select("exam_id", "student", "version", "submitted"))
    return readers.latest_drafts(kept).select("exam_id", "student", "version")
