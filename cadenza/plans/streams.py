"""Streaming queries: each runs a job over the event table as a stream and reads its result."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from cadenza.plans.registry import query
from cadenza.session import durable_dir
from cadenza.sources import tables as T
from cadenza.streaming import jobs as J

US = "epoch_us(ts)"


def micros(c):
    return F.unix_micros(F.col(c)).alias(c)


@query(
    "st1_stage_durations_stream",
    """WITH o AS (SELECT user_id, event_id, event_type AS stage, epoch_us(ts) AS t,
        coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run FROM events),
      l AS (SELECT *, lead(t) OVER (PARTITION BY user_id, run ORDER BY t, event_id) AS nt FROM o),
      r AS (SELECT user_id, run, bool_or(stage = 'purchase') AS closed FROM o GROUP BY 1, 2),
      q AS (SELECT user_id, max(t) + 2 * 86400000000 AS due FROM o GROUP BY 1), m AS (SELECT max(t) - 3600000000 AS wm FROM o)
    SELECT user_id AS job, run, stage, round(sum(CASE WHEN stage = 'purchase' THEN 0 ELSE (nt - t) / 1e6 END), 3) AS seconds
    FROM l JOIN r USING (user_id, run) JOIN q USING (user_id), m WHERE (nt IS NOT NULL OR stage = 'purchase') AND (closed OR due < wm) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return J.run_to_table(J.stage_durations_stream(J.event_stream(spark, sf))).select("job", "run", "stage", F.round("seconds", 3).alias("seconds"))


@query(
    "st1_stage_durations_settled",
    """WITH m AS (SELECT (max(epoch_us(ts)) - 3600000000) // 1000 * 1000 AS wm FROM events),
      e AS (SELECT user_id, event_id, event_type AS stage, epoch_us(ts) AS t, lag(event_type) OVER w AS ps, lag(epoch_us(ts)) OVER w AS pt FROM events, m WHERE epoch_us(ts) <= wm WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      o AS (SELECT *, sum(coalesce(ps = 'purchase' OR t - pt > 2 * 86400000000, false)::INT) OVER (PARTITION BY user_id ORDER BY t, event_id)::BIGINT AS run FROM e),
      l AS (SELECT *, lead(t) OVER (PARTITION BY user_id, run ORDER BY t, event_id) AS nt, max(run) OVER (PARTITION BY user_id) AS newest, max(t) OVER (PARTITION BY user_id, run) AS quiet FROM o),
      r AS (SELECT user_id, run, bool_or(stage = 'purchase') AS closed FROM o GROUP BY 1, 2)
    SELECT user_id AS job, run, stage, round(sum(CASE WHEN nt IS NULL THEN 0 ELSE (nt - t) / 1e6 END), 3) AS seconds
    FROM l JOIN r USING (user_id, run), m WHERE (nt IS NOT NULL OR stage = 'purchase') AND (closed OR run < newest OR quiet + 2 * 86400000000 < wm) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    s = J.stage_durations_settled(J.event_stream(spark, sf))
    return J.run_to_table(s, rocksdb=True).select("job", "run", "stage", F.round("seconds", 3).alias("seconds"))


@query("st2_latest_progress", f"""SELECT user_id, max({US}) AS ts, max_by(event_type, (ts, event_id)) AS state, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1""")
def _(spark, sf):
    base = os.path.join(durable_dir(spark), f"progress-{uuid.uuid4().hex}")
    J.run_batches(J.latest_progress(J.event_stream(spark, sf)), lambda b, e: b.write.mode("overwrite").parquet(f"{base}/batch={e}"))
    newest = spark.read.parquet(base)
    return newest.groupBy("user_id").agg(F.max_by(F.struct("ts", "state", "value"), "ts").alias("_n")).select("user_id", F.unix_micros("_n.ts").alias("ts"), F.col("_n.state").alias("state"), F.col("_n.value").alias("value"))


@query(
    "st3_speech_sessions",
    f"""WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events), l AS (SELECT *, lag(ts) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l),
      g AS (SELECT user_id, k, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS b, count(*) AS n, sum(value) AS total FROM s GROUP BY 1, 2)
    SELECT user_id, epoch_us(a) AS start, epoch_us(b) AS "end", n, round(total, 6) AS total FROM g, m WHERE b <= wm""",
)
def _(spark, sf):
    s = J.run_to_table(J.speech_sessions(J.event_stream(spark, sf)))
    return s.select("user_id", micros("start"), micros("end"), "n", F.round("total", 6).alias("total"))


@query(
    "st4_rolling_levels",
    """WITH m AS (SELECT max(epoch_us(ts)) - 3600000000 AS wm FROM events), x AS (SELECT event_type, value, unnest([epoch_us(ts) // 10800000000 * 10800000000, epoch_us(ts) // 10800000000 * 10800000000 - 10800000000]) AS start FROM events)
    SELECT start, start + 21600000000 AS "end", event_type, count(*) AS n, round(avg(value), 6) AS level, max(value) AS peak FROM x, m WHERE start + 21600000000 <= wm GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    s = J.run_to_table(J.rolling_levels(J.event_stream(spark, sf)))
    return s.select(micros("start"), micros("end"), "event_type", "n", F.round("level", 6).alias("level"), "peak")


@query(
    "st4_rolling_pauses",
    """WITH m AS (SELECT max(epoch_us(ts)) - 3600000000 AS wm FROM events), g AS (SELECT epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
      x AS (SELECT gap / 1e6 AS pause, unnest([t // 10800000000 * 10800000000, t // 10800000000 * 10800000000 - 10800000000]) AS start FROM g WHERE gap IS NOT NULL)
    SELECT start, start + 21600000000 AS "end", count(*) AS n, round(avg(pause), 3) AS mean, round(max(pause), 3) AS longest FROM x, m WHERE start + 21600000000 <= wm GROUP BY 1, 2""",
)
def _(spark, sf):
    s = J.run_to_table(J.rolling_pauses(J.event_stream(spark, sf)), rocksdb=True)
    return s.select(micros("start"), micros("end"), "n", *[F.round(c, 3).alias(c) for c in ("mean", "longest")])


@query("st5_deliver", """SELECT o_orderkey AS assignment_id, CASE WHEN o_totalprice > 100000 THEN 'scheduled' ELSE 'failed' END AS status, CASE WHEN o_totalprice > 100000 THEN o_orderkey % 4 + 1 ELSE greatest(3, o_orderkey % 4 + 1) END AS attempts FROM orders WHERE o_orderstatus = 'P'""")
def _(spark, sf):
    sink = os.path.join(durable_dir(spark), f"deliver-{uuid.uuid4().hex}")
    o = spark.readStream.schema(T.table(spark, sf, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    k = F.col("o_orderkey")
    q = o.select(k.alias("assignment_id"), F.when(F.col("o_orderstatus") == "P", "queued").otherwise("done").alias("status"), (k % 4).alias("attempts"), F.lit(None).cast("string").alias("media_id"), F.col("o_orderdate").alias("scheduled_at"), "o_totalprice")
    J.deliver(q, lambda b: b.withColumn("ok", F.col("o_totalprice") > 100000), sink)
    return spark.read.parquet(sink).select("assignment_id", "status", "attempts")


@query("st6_dedup_stream", """SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1""")
def _(spark, sf):
    d = J.run_to_table(J.dedup_stream(J.event_stream(spark, sf)).select("user_id", "event_type", "event_id"))
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "st7_rate_per_hour",
    """WITH m AS (SELECT max(epoch_us(ts)) - 600000000 AS wm FROM events) SELECT user_id, epoch_us(ts) // 3600000000 * 3600000000 AS start, count(*) AS n FROM events, m GROUP BY 1, 2 HAVING count(*) > 1 AND epoch_us(any_value(ts)) // 3600000000 * 3600000000 + 3600000000 <= any_value(wm)""",
)
def _(spark, sf):
    r = J.run_to_table(J.rate_per_minute(J.event_stream(spark, sf), size="1 hour"))
    return r.select("user_id", micros("start"), "n")
