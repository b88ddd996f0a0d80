"""Schedules and captions: what depends on the campaign or account only is worked out once for it."""

import pytest

from cadenza.operators import publish as B
from cadenza.operators import rank as K


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_schedule_reads_local_times_once_per_campaign(spark):
    c = spark.createDataFrame([(1, "per_date", "UTC", "10:30", ["2025-03-01", "2025-03-05"], None, None, None), (2, "single_day", "Asia/Ho_Chi_Minh", "07:00", None, "2025-04-02", 45, None), (3, "serial", "UTC", "00:00", [], "2025-04-02", None, 2)],
        "campaign_id long, mode string, zone string, time_of_day string, dates array<string>, day string, interval_min int, step_days int")
    items = spark.createDataFrame([(k, i) for k in (1, 2, 3) for i in (10, 20)], "campaign_id long, item_id long")
    acc = spark.createDataFrame([(k, a, a != 6) for k in (1, 2, 3) for a in (5, 6, 7)], "campaign_id long, account_id long, has_profile boolean")
    got = B.plan_schedule(c, items, acc)
    assert "to_utc_timestamp" not in plan_of(got) and "gettimestamp" not in plan_of(got)
    at = {(r[0], r[1], r[2]): str(r[3]) for r in got.collect()}
    assert at[1, 10, 5] == "2025-03-01 10:30:00" and at[1, 10, 7] == "2025-03-05 10:30:00" and at[1, 20, 5] == "2025-03-05 10:30:00"
    assert at[2, 10, 5] == "2025-04-02 00:00:00" and at[2, 20, 7] == "2025-04-02 03:00:00"
    assert at[3, 20, 7] == "2025-04-04 00:02:00" and len(at) == 12


@pytest.mark.parametrize("globals_", [True, False])
def test_presets_are_joined_once_per_account(spark, globals_):
    rows = [(1, 5, "append", " own tail ", True), (2, 5, "prepend", "own head", True), (3, None, "append", "all tail", globals_), (4, None, "prepend", "all head", globals_), (6, 5, "prepend", "  ", True), (7, 5, "prepend", "off", False), (8, 5, "append", None, True)]
    p = spark.createDataFrame(rows, "preset_id long, account_id long, position string, content string, active boolean")
    c = spark.createDataFrame([(1, 5, " text "), (2, 9, "text"), (3, None, None), (4, 5, "")], "caption_id long, account_id long, text string")
    got = B.apply_presets(c, p)
    assert "sort_array" not in plan_of(got)
    g, t = (["all head"], ["all tail"]) if globals_ else ([], [])
    ids = lambda *x: ",".join(str(i) for i in x if globals_ or i not in (3, 4))
    want = {
        1: ("\n\n".join([*g, "own head", "text", "own tail", *t]), ids(4, 2, 6, 1, 8, 3)), 2: ("\n\n".join([*g, "text", *t]), ids(4, 3)),
        3: ("\n\n".join([*g, *t]), ids(4, 3)), 4: ("\n\n".join([*g, "own head", "own tail", *t]), ids(4, 2, 6, 1, 8, 3)),
    }
    assert {r["caption_id"]: (r["caption"], r["applied"]) for r in got.collect()} == want


def test_items_that_say_the_same_by_one_vector_meet_queries_once(spark):
    items = spark.createDataFrame([(i, [1.0, float(i % 2)], " Same " if i % 3 else "other") for i in range(600)] + [(900, [1.0, 0.0], " "), (901, [1.0, 0.0], None)], "item_id long, v array<double>, said string")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, qv array<double>")
    got = K.vector_topk(items, q, 10, text="said")
    assert "lower(" not in plan_of(got)
    assert sorted((r["query_id"], r["rank"], r["item_id"]) for r in got.collect()) == [(1, 1, 0), (1, 2, 2), (2, 1, 1), (2, 2, 3)]
