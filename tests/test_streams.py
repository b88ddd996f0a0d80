"""Streams over several ordered files: batch borders do not matter, late rows are treated as said."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from cadenza.session import durable_dir
from cadenza.streaming import jobs

SCHEMA = "event_id long, user_id long, event_type string, ts timestamp"


def at(hours):
    return f"2024-01-{1 + int(hours) // 24:02d} {int(hours) % 24:02d}:{round(hours * 60) % 60:02d}:00"


def stream(spark, files):
    """A file stream that reads one of the given lists of (event_id, user_id, event_type, hours) at a time."""
    base = os.path.join(durable_dir(spark), f"t-{uuid.uuid4().hex}")
    for f in files:
        rows = spark.createDataFrame([(i, u, k, at(h)) for i, u, k, h in f], "event_id long, user_id long, event_type string, ts string")
        rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(base)
        time.sleep(0.05)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(base)


EVENTS = [
    (1, 1, "view", 0), (2, 1, "click", 1), (3, 1, "view", 3), (4, 1, "purchase", 4), (5, 1, "view", 5), (6, 1, "click", 80), (7, 1, "purchase", 81), (8, 2, "view", 2), (9, 2, "click", 6.5), (10, 3, "view", 70), (11, 9, "end", 200),
]
RUNS = {(1, 0, "view"): 7200, (1, 0, "click"): 7200, (1, 0, "purchase"): 0, (1, 2, "click"): 3600, (1, 2, "purchase"): 0, (2, 0, "view"): 16200}


@pytest.mark.parametrize("cuts", [[], [3], [2, 5, 6, 9]])
def test_stage_durations_do_not_hang_on_batches(spark, cuts):
    """A run ends with its terminal status, before a pause above two days, or when its job goes quiet."""
    rows = sorted(EVENTS, key=lambda e: e[3])
    files = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    # within a batch rows come in any order
    got = jobs.run_to_table(jobs.stage_durations_settled(stream(spark, [f[::-1] for f in files])), rocksdb=True)
    assert {(r.job, r.run, r.stage): r.seconds for r in got.collect()} == RUNS


def test_rows_behind_the_watermark_are_dropped_and_late_ones_within_it_counted(spark):
    files = [[(1, 1, "view", 10)], [(2, 1, "purchase", 11.5)], [(3, 1, "click", 11), (4, 1, "click", 3)], [(5, 9, "end", 200)]]
    got = jobs.run_to_table(jobs.stage_durations_settled(stream(spark, files)), rocksdb=True)
    assert {(r.stage): r.seconds for r in got.collect() if r.job == 1} == {"view": 3600, "click": 1800, "purchase": 0}


@pytest.mark.parametrize("cuts", [[], [2, 4, 7]])
def test_pauses_go_on_over_batch_borders(spark, cuts):
    rows = [(i, i % 2, "x", h) for i, h in enumerate([0, 0.5, 1, 2, 4, 4.5, 7, 11, 12, 40])]
    files = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    got = jobs.run_to_table(jobs.rolling_pauses(stream(spark, files), size="6 hours", slide="6 hours"), rocksdb=True)
    want = {}
    for u in (0, 1):
        mine = [h for _, k, _, h in rows if k == u]
        for a, b in zip(mine, mine[1:]):
            want.setdefault(int(b // 6) * 6, []).append((b - a) * 3600)
    want = {w: (len(v), round(sum(v) / len(v), 3), max(v)) for w, v in want.items() if w + 6 <= 39}
    assert {r.start.hour + 24 * (r.start.day - 1): (r.n, round(r["mean"], 3), r.longest) for r in got.collect()} == want


def test_repetitions_pass_only_when_their_key_is_forgotten(spark):
    """Twelve hours of lateness: a key is forgotten once the watermark has passed its first row by that much."""
    files = [[(1, 1, "a", 0)], [(2, 1, "a", 5)], [(3, 1, "b", 40)], [(4, 1, "b", 60)], [(5, 1, "a", 61)], [(6, 1, "c", 20), (7, 1, "c", 62)]]
    held = []
    jobs.run_batches(jobs.dedup_stream(stream(spark, files)), lambda b, e: held.extend(r.event_id for r in b.collect()), "append")
    # 2 is within twelve hours of 1; 5 comes long after; 6 lies behind the watermark
    assert 2 not in held and 6 not in held
    assert {1, 3, 5, 7} <= set(held)
