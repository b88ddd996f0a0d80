"""Delivery keeps what a trigger does not take and tries failures three times."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from cadenza.session import durable_dir
from cadenza.streaming import jobs


def test_nothing_is_lost_and_failures_get_three_attempts(spark):
    base = os.path.join(durable_dir(spark), f"t-{uuid.uuid4().hex}")
    rows = spark.range(10).select(F.col("id").alias("assignment_id"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("media_id"), F.col("id").alias("scheduled_at"))
    rows.repartition(3).write.parquet(f"{base}/in")
    q = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    jobs.deliver(q, lambda b: b.withColumn("ok", F.col("assignment_id") % 3 != 0), f"{base}/out", limit=2)
    got = {r.assignment_id: (r.status, r.attempts) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {i: ("failed", 3) if i % 3 == 0 else ("scheduled", 1) for i in range(10)}
    assert spark.read.parquet(f"{base}/out").count() == 10


def _queue(spark, base, n=9):
    rows = spark.range(n).select(F.col("id").alias("assignment_id"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("media_id"), F.col("id").alias("scheduled_at"))
    return rows, lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def _sent(spark, base):
    """How often each assignment was sent, by all triggers that wrote attempts."""
    return {r.assignment_id: r["n"] for r in spark.read.parquet(f"{base}/out-tried").groupBy("assignment_id").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_a_job_that_stops_between_batches_goes_on(spark):
    """Stopped in its second batch, then with new rows after it had ended: nothing is lost, nothing is sent twice."""
    base = os.path.join(durable_dir(spark), f"t-{uuid.uuid4().hex}")
    rows, stream = _queue(spark, base)
    for i in range(3):
        rows.filter(F.col("assignment_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{base}/in")
    calls = []

    def breaks(b):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return b.withColumn("ok", F.lit(True))

    with pytest.raises(Exception, match="stopped"):
        jobs.deliver(stream(), breaks, f"{base}/out")
    assert len(_sent(spark, base)) == 3
    good = lambda b: b.withColumn("ok", F.lit(True))
    jobs.deliver(stream(), good, f"{base}/out")
    assert _sent(spark, base) == {i: 1 for i in range(9)}
    rows.withColumn("assignment_id", F.col("assignment_id") + 100).coalesce(1).write.mode("append").parquet(f"{base}/in")
    jobs.deliver(stream(), good, f"{base}/out")
    assert _sent(spark, base) == {i: 1 for i in [*range(9), *range(100, 109)]}
    got = {r.assignment_id: r.status for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {i: "scheduled" for i in _sent(spark, base)}


def test_a_trigger_that_runs_again_does_not_send_again(spark, monkeypatch):
    """Stopped after sending, before the trigger was finished."""
    base = os.path.join(durable_dir(spark), f"t-{uuid.uuid4().hex}")
    rows, stream = _queue(spark, base)
    rows.coalesce(1).write.parquet(f"{base}/in")
    sends = []

    def send(b):
        sends.append(b.count())
        return b.withColumn("ok", F.col("assignment_id") > 3)

    real = type(rows).unionByName

    def breaks(self, other, *a, **k):
        if len(sends) == 1 and not hasattr(breaks, "done"):
            breaks.done = True
            raise RuntimeError("lost")
        return real(self, other, *a, **k)

    monkeypatch.setattr(type(rows), "unionByName", breaks)
    with pytest.raises(Exception, match="lost"):
        jobs.deliver(stream(), send, f"{base}/out", limit=4)
    jobs.deliver(stream(), send, f"{base}/out", limit=4)
    assert {i: n for i, n in _sent(spark, base).items()} == {i: 3 if i <= 3 else 1 for i in range(9)}
    assert sum(sends) == 4 * 3 + 5
