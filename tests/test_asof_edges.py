"""As-of joins on keys that one row bounds: one shuffle, no window."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cadenza.operators import edit as E
from cadenza.operators import greedy
from cadenza.operators import intervals as I
from cadenza.operators.ordered import BOUNDED


def _bounded(df):
    return df.withColumn("source_id", F.col("source_id").alias("source_id", metadata=BOUNDED))


def test_asof_on_bounded_keys_equals_brute_force(spark):
    rnd = random.Random(7)
    anchors = [(rnd.choice([-3, 1, 2, 5, None]), rnd.choice([None, *range(12)]), rnd.choice(["a", "b", "", None])) for _ in range(150)]
    points = [(i, rnd.choice([-3, 1, 2, 4, None]), rnd.randrange(-1, 13) + rnd.choice([0.0, 0.5])) for i in range(120)]
    a = _bounded(spark.createDataFrame([(k, None if t is None else float(t), w) for k, t, w in anchors], "source_id long, t double, w string"))
    p = _bounded(spark.createDataFrame(points, "id long, source_id long, at double")).repartition(3)
    j = I.asof(p, a, ["source_id"], "at", "t", id="id", carry={"w": "w"})
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan

    def least(t, k):
        ws = [w for q, u, w in anchors if q == k and u == t]
        return None if None in ws else min(ws)

    want = []
    for i, k, at in points:
        ts = [t for q, t, _ in anchors if q == k and t is not None]
        prev, after = max([t for t in ts if t <= at], default=None), min([t for t in ts if t >= at], default=None)
        want.append((i, k, at, prev, None if prev is None else least(prev, k), after, None if after is None else least(after, k)))
    got = j.select("id", "source_id", "at", "prev_at", "prev_w", "next_at", "next_w").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_both_edges_of_cuts_snap_in_one_pass(spark):
    words = _bounded(spark.createDataFrame([(1, 0.0, 0.3), (1, 1.0, 1.3), (2, 0.0, 0.3)], "source_id long, start double, end double"))
    cuts = _bounded(spark.createDataFrame([(1, 0, 0.02, 1.28), (1, 1, 0.5, 1.31), (3, 2, 0.0, 1.0), (2, 3, 0.01, 0.09)], "source_id long, cut_id long, c_start double, c_end double"))
    s = E.snap_cuts(cuts, words, ["source_id", "cut_id"], tol=0.030000001)
    assert s._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r["cut_id"], r["new_start"], r["new_end"]) for r in s.collect()) == [(0, 0.0, 1.3), (1, 0.5, 1.3), (2, 0.0, 1.0), (3, 0.01, 0.09)]


def test_segments_of_grown_plans_are_folded(spark, monkeypatch):
    def never(*_):
        raise AssertionError("conflict rounds over plans")

    monkeypatch.setattr(greedy, "materialize", never)
    words = _bounded(spark.createDataFrame([(1, 0, "a", 500.0, 500.3)], "source_id long, pos long, word string, start double, end double"))
    span = lambda *x: [{"s": float(a), "e": float(b)} for a, b in x]
    # the third is covered by the second, which the first covers and so drops: it stays
    plans = [(1, 0, span((0, 30), (10, 38), (31, 35)), 900.0), (1, 1, span((0, 20)), 900.0)]
    p = spark.createDataFrame(plans, "source_id long, plan_no long, segs array<struct<s:double,e:double>>, duration_total double")
    out = E.extend_and_finish(_bounded(p), words, target=62.0, low=25.0, high=80.0)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 0, 0.0, 30.0), (1, 0, 2, 31.0, 35.0)]
