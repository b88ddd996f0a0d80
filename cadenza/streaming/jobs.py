"""Structured Streaming jobs."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.session import durable_dir


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_batch: int = 8) -> DataFrame:
    """File stream of event tables with a UTC timestamp column ``ts``."""
    static = spark.read.parquet(f"{folder}/{glob}")
    s = spark.readStream.schema(static.schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def _rocksdb(spark: SparkSession):
    """The state store that map state and timers need, for queries started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def run_to_table(df: DataFrame, mode: str = "append", rocksdb: bool = False) -> DataFrame:
    """Run a stream over all available input into a table in the shared folder and read it back."""
    spark = df.sparkSession
    base = os.path.join(durable_dir(spark), f"stream-{uuid.uuid4().hex}")
    w = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    with _rocksdb(spark) if rocksdb else nullcontext():
        q = w.start(f"{base}/out")
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def run_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "update", state: str | None = None) -> None:
    """``handle`` for every batch of all available input. With a ``state`` folder the stream goes on where it stopped."""
    state = state or os.path.join(durable_dir(df.sparkSession), f"stream-{uuid.uuid4().hex}", "state")
    df.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(handle).trigger(availableNow=True).start().awaitTermination()


def stage_durations_stream(events: DataFrame, *, key: str = "user_id", stage: str = "event_type", terminal: str = "purchase", timeout: str = "2 days", late: str = "1 hour") -> DataFrame:
    """Seconds per stage of a job, summed over re-entries; rows appear at the terminal status or when a job goes quiet.

    The state per job is a handful of numbers, whatever its number of events.
    """
    from pyspark.sql import types as T

    key_t = events.schema[key].dataType
    out = T.StructType([T.StructField("job", key_t), T.StructField("run", T.LongType()), T.StructField("stage", T.StringType()), T.StructField("seconds", T.DoubleType())])
    state_t = "run long, stage string, since double, names array<string>, secs array<double>"
    hold = pd.Timedelta(timeout)

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, cur, since, acc = 0, None, 0.0, {}
        if state.exists:
            run, cur, since, names, secs = state.get
            acc = dict(zip(names, secs))
        rows = []

        def emit():
            rows.extend((k[0], run, s, v) for s, v in sorted(acc.items()))

        if state.hasTimedOut:
            emit()
            state.remove()
        else:
            pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
            last = None
            for ts, st in zip(pdf["ts"], pdf[stage]):
                t = ts.value / 1e9
                last = ts
                if cur is not None:
                    acc[cur] = acc.get(cur, 0.0) + (t - since)
                cur, since = st, t
                if st == terminal:
                    acc.setdefault(st, 0.0)
                    emit()
                    run, cur, acc = run + 1, None, {}
            state.update((run, cur, since, list(acc), [float(x) for x in acc.values()]))
            if last is not None:
                due = int((last + hold).value // 1_000_000)
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["job", "run", "stage", "seconds"])

    e = events.withWatermark("ts", late).select(key, "event_id", "ts", stage)
    return e.groupBy(key).applyInPandasWithState(step, out, state_t, "append", GroupStateTimeout.EventTimeTimeout)


class _StageClock(StatefulProcessor):
    """Seconds per stage of one job. Rows wait until the watermark has passed them, so they are counted in order whatever batch brought them."""

    def __init__(self, terminal: str, hold_us: int):
        self.terminal, self.hold = terminal, hold_us

    def init(self, handle) -> None:
        self.handle = handle
        self.wait = handle.getListState("wait", "t long, event_id long, stage string")
        self.secs = handle.getMapState("secs", "stage string", "seconds double")
        self.open = handle.getValueState("open", "run long, stage string, since long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            held = list(zip(frame["t"].tolist(), frame["event_id"].tolist(), frame["stage"].tolist()))
            self.wait.appendList(held)
            first = min(t for t, _, _ in held) if first is None else min(first, min(t for t, _, _ in held))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        # what waits came within the permitted lateness
        ready, later = [], []
        for row in self.wait.get():
            (ready if row[0] <= now else later).append(tuple(row))
        if ready:
            self.wait.clear()
            if later:
                self.wait.put(later)
        run, cur, since, last = self.open.get() if self.open.exists() else (0, None, 0, None)
        acc = {k[0]: v[0] for k, v in self.secs.iterator()}
        done: list[tuple] = []

        def end() -> None:
            nonlocal run, cur, acc
            done.extend((key[0], run, s, v) for s, v in sorted(acc.items()))
            run, cur, acc = run + 1, None, {}

        for t, _, stage in sorted(ready):
            if cur is not None and t - last > self.hold:
                end()
            if cur is not None:
                acc[cur] = acc.get(cur, 0.0) + (t - since) / 1e6
            cur, since, last = stage, t, t
            if stage == self.terminal:
                acc.setdefault(stage, 0.0)
                end()
        if cur is not None and last + self.hold < now:
            end()
        self.secs.clear()
        for s, v in acc.items():
            self.secs.updateValue((s,), (v,))
        self.open.update((run, cur, since, last))
        # the next row that waits, else the moment at which the job counts as quiet
        due = min((r[0] for r in later), default=last + self.hold if cur is not None else None)
        if due is not None:
            self.handle.registerTimer(due // 1000 + 1)
        if done:
            yield pd.DataFrame(done, columns=["job", "run", "stage", "seconds"])

    def close(self) -> None:
        pass


def stage_durations_settled(events: DataFrame, *, key: str = "user_id", stage: str = "event_type", terminal: str = "purchase", timeout: str = "2 days", late: str = "1 hour") -> DataFrame:
    """:func:`stage_durations_stream` in event time: a run ends with the terminal status or before a pause above ``timeout``.

    Rows are emitted once the watermark has passed the end of their run. Batch borders do not matter; rows behind the watermark are dropped.
    Needs the RocksDB state store (see :func:`run_to_table`).
    """
    job = events.schema[key].dataType.simpleString()
    hold = int(pd.Timedelta(timeout).value // 1000)
    e = events.withWatermark("ts", late).select(F.col(key).alias("job"), "event_id", "ts", F.unix_micros("ts").alias("t"), F.col(stage).alias("stage"))
    return e.groupBy("job").transformWithStateInPandas(_StageClock(terminal, hold), f"job {job}, run long, stage string, seconds double", "append", "EventTime")


class _Pauses(StatefulProcessor):
    """The time since the row before, for every row of a key that comes in order."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mine = sorted(t for frame in rows for t in frame["t"].tolist())
        before = self.last.get()[0] if self.last.exists() else None
        out = []
        for t in mine:
            if before is None or t >= before:
                if before is not None:
                    out.append((pd.Timestamp(t, unit="us"), (t - before) / 1e6))
                before = t
        self.last.update((before,))
        if out:
            yield pd.DataFrame(out, columns=["ts", "pause"])

    def close(self) -> None:
        pass


def rolling_pauses(events: DataFrame, *, key: str = "user_id", size: str = "6 hours", slide: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """Sliding windows over the pauses of all keys: count, mean and longest. A pause lies where it ends.

    The last row of a key is state, so pauses go on over batch borders; rows of a key that come after later ones have no pause.
    Two stateful operators in one stream; needs the RocksDB state store.
    """
    e = events.withWatermark("ts", late).select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("t"))
    p = e.groupBy("key").transformWithStateInPandas(_Pauses(), "ts timestamp, pause double", "append", "EventTime", eventTimeColumnName="ts")
    a = p.groupBy(F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("pause").alias("mean"), F.max("pause").alias("longest"))
    return a.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "longest")


def latest_progress(events: DataFrame, *, key: str = "user_id", late: str = "1 hour") -> DataFrame:
    """Newest state per key in update mode."""
    newest = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id"))
    g = events.withWatermark("ts", late).groupBy(key).agg(newest.alias("_n"), F.max("ts").alias("ts"))
    return g.select(key, "ts", F.col("_n.event_type").alias("state"), F.col("_n.value").alias("value"))


def speech_sessions(events: DataFrame, *, key: str = "user_id", gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Session windows by key; closed sessions only. There is no span limit here."""
    s = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return s.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def rolling_levels(events: DataFrame, *, size: str = "6 hours", slide: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """Sliding windows: count, mean and maximum level by kind."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type")
    a = g.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("level"), F.max("value").alias("peak"))
    return a.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "level", "peak")


def dedup_stream(events: DataFrame, *, keys=("user_id", "event_type"), late: str = "12 hours") -> DataFrame:
    """First row per key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def rate_per_minute(events: DataFrame, *, key: str = "user_id", limit: int = 1, size: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Windows in which a key had more than ``limit`` events."""
    g = events.withWatermark("ts", late).groupBy(key, F.window("ts", size).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") > limit).select(key, F.col("w.start").alias("start"), "n")


STEPS_A_BATCH = 1_000_000  # triggers between two stream batches at most


def deliver(queue: DataFrame, send: Callable[[DataFrame], DataFrame], sink: str, *, limit: int | None = None, drain: bool = True) -> None:
    """Deliver queued rows until each is scheduled or has failed; ``sink`` gets one final row per assignment.

    ``send`` adds the boolean ``ok`` to a batch. Rows that failed before their last attempt, and rows beyond
    ``limit`` (deliveries per trigger, earliest first), stay in a queue table that the next trigger reads; with ``drain``, triggers go
    on until the queue is empty when the stream has ended.

    The stream's state and all tables lie beside ``sink``; nothing is kept in the driver, so a job that was stopped goes on by the same
    call. A trigger's folders carry its number (stream batch, then the triggers after it), and a row in the table of finished triggers is
    written last: it names the queue to go on from. A trigger that runs again overwrites its folders, and does not send again
    what it has sent: attempts are marked as soon as they are written.
    """
    from cadenza.operators.publish import delivery_attempt

    spark = queue.sparkSession

    def marks(name: str) -> DataFrame:
        spark.range(0).select(F.col("id").alias("step"), F.col("id").alias("waiting")).write.mode("append").parquet(f"{sink}-{name}")
        return spark.read.parquet(f"{sink}-{name}")

    def mark(name: str, step: int, waiting: int = 0) -> None:
        spark.range(1).select(F.lit(step).cast("long").alias("step"), F.lit(waiting).cast("long").alias("waiting")).write.mode("append").parquet(f"{sink}-{name}")

    def before(step: int | None):
        """The last finished trigger, or the last one before ``step``."""
        m = marks("steps")
        return (m if step is None else m.filter(F.col("step") < step)).orderBy(F.desc("step")).first()

    def trigger(new: DataFrame | None, step: int) -> None:
        due = new.filter("status = 'queued'") if new is not None else None
        last = before(step)
        if last is not None:
            old = spark.read.parquet(f"{sink}-queue/batch={last['step']}")
            due = old if due is None else old.unionByName(due)
        pool, tried = f"{sink}-pool/batch={step}", f"{sink}-tried/batch={step}"
        if marks("sent").filter(F.col("step") == step).isEmpty():
            due.write.mode("overwrite").parquet(pool)
            due = spark.read.parquet(pool)
            now = due.orderBy("scheduled_at", "assignment_id").limit(limit) if limit else due
            delivery_attempt(send(now)).write.mode("overwrite").parquet(tried)
            mark("sent", step)
        due, now = spark.read.parquet(pool), spark.read.parquet(tried)
        now.filter("status <> 'queued'").write.mode("overwrite").parquet(f"{sink}/batch={step}")
        rest = due.join(now.select("assignment_id"), "assignment_id", "left_anti").select(*now.columns)
        now.filter("status = 'queued'").unionByName(rest).write.mode("overwrite").parquet(f"{sink}-queue/batch={step}")
        mark("steps", step, spark.read.parquet(f"{sink}-queue/batch={step}").count())

    run_batches(queue, lambda batch, epoch: trigger(batch, epoch * STEPS_A_BATCH), "append", state=f"{sink}-state")
    while drain and (last := before(None)) is not None and last["waiting"]:
        trigger(None, last["step"] + 1)
