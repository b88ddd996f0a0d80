"""Limits, top-k and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.vector import cosine
from cadenza.session import materialize


def rank_cap(duration: Column, per_minute: float = 2.0, low: int = 60, high: int = 300) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.bround(F.greatest(F.lit(0.0), duration / 60.0) * per_minute).cast("int")))


def dynamic_caps(ev: DataFrame, duration: DataFrame, *, per_minute=2.5, low=80, high=400) -> DataFrame:
    """Strongest rows per source up to a limit that grows with its duration.

    The static upper bound lets Spark trim each task's rows before the shuffle.
    """
    w = Window.partitionBy("source_id").orderBy(F.desc("strength"), "id")
    top = ev.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= high)
    cap = duration.select("source_id", rank_cap(F.col("duration"), per_minute, low, high).alias("_cap"))
    return top.join(cap, "source_id").filter(F.col("rank") <= F.col("_cap")).drop("_cap")


def topk_then_topk(clips: DataFrame, inner: Sequence[str], outer: Sequence[str], order: Sequence[Column], k: int, total: int) -> DataFrame:
    """Best ``k`` per inner group, then best ``total`` per outer group."""
    w1 = Window.partitionBy(*inner).orderBy(*order)
    w2 = Window.partitionBy(*outer).orderBy(*order)
    t = clips.withColumn("_a", F.row_number().over(w1)).filter(F.col("_a") <= k).drop("_a")
    return t.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= total)


def rank_diverse_by_topic(clips: DataFrame, target: int, key=("source_id",), score="score", topic="topic", id="clip_id") -> DataFrame:
    """Score order with topic limits, as two window passes.

    First at most two per topic from score 7 up; if the target is not reached, further rows from
    score 6 up while a topic has fewer than three.
    """
    key = list(key)
    t = F.substring(F.trim(F.lower(F.col(topic))), 1, 50)
    best = [F.desc(score), F.col(id)]
    c = clips.filter(F.col(score) >= 6).withColumn("_t", t)
    # within a topic, rows of score >= 7 come before the rest in score order
    w_topic = Window.partitionBy(*key, "_t").orderBy(*best)
    c = c.withColumn("_k", F.row_number().over(w_topic)).filter("_k <= 3")
    c = c.withColumn("_pass", F.when((F.col("_k") <= 2) & (F.col(score) >= 7), 1).otherwise(2))
    w_all = Window.partitionBy(*key).orderBy("_pass", *best)
    return c.withColumn("rank", F.row_number().over(w_all)).filter(F.col("rank") <= target).drop("_t", "_k").withColumnRenamed("_pass", "pass_no")


def top1_per_group(df: DataFrame, key, score: str, tie: str, cols: Sequence[str]) -> DataFrame:
    """Best row per group: partial aggregation instead of a sort."""
    best = F.max_by(F.struct(*cols), F.struct(F.col(score), (-F.col(tie)).alias("_t")))
    return df.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")


def target_counts(duration: Column) -> dict[str, Column]:
    """12 per 20 minutes, +-3 per block, at least 3; maximum capped at 225."""
    blocks = F.greatest(F.lit(0.0), duration) / 1200.0
    target = F.greatest(F.lit(3), F.bround(12 * blocks).cast("int"))
    tol = F.greatest(F.lit(3), F.bround(3 * blocks).cast("int"))
    return {"target": target, "min_count": F.greatest(F.lit(1), target - tol), "max_count": F.least(F.lit(225), target + tol)}


def user_target_counts(n: Column) -> dict[str, Column]:
    tol = F.greatest(F.lit(3), F.bround(n * 0.10).cast("int"))
    return {"target": n, "min_count": F.greatest(F.lit(1), n - tol), "max_count": F.least(F.lit(225), n + tol)}


def due_queue(assignments: DataFrame, now, limit: int = 50) -> DataFrame:
    """Queued rows whose time has come, earliest first: one top-n without a full sort."""
    d = assignments.filter((F.col("status") == "queued") & (F.col("scheduled_at") <= F.lit(now)))
    return d.orderBy("scheduled_at", "assignment_id").limit(limit)


def distinct_text_keep_best(df: DataFrame, key, text: str, score: str, id: str, cols: Sequence[str]) -> DataFrame:
    """One row per trimmed, case-folded text: the best score, then the smallest id."""
    d = df.withColumn("_x", F.lower(F.trim(F.col(text)))).filter("_x <> ''")
    best = F.max_by(F.struct(*cols), F.struct(F.col(score), (-F.col(id)).alias("_t")))
    return d.groupBy(*key, "_x").agg(best.alias("_b")).select(*key, "_b.*")


QUERY_BLOCK = 1024


def vector_topk(items: DataFrame, queries: DataFrame, k: int, min_cos: float | None = None, text: str | None = None) -> DataFrame:
    """Cosine top-k of ``items`` (item_id, v) for every row of ``queries`` (query_id, qv).

    With ``text``, items that say the same (trimmed, case-folded) count once, by their best cosine; items without text are left out.
    Those of one vector are one item, by the smallest id, before they meet the queries: their cosines are equal.

    Queries are counted and reach the tasks in blocks of at most ``QUERY_BLOCK`` as one scalar subquery each; items are
    scanned once per block and never shuffled, and only the best ``k`` per task and query leave a task.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    if text:
        items = items.withColumn("_said", F.lower(F.trim(F.col(text)))).filter("_said <> ''").groupBy("_said", "v").agg(F.min("item_id").alias("item_id"))
        items = materialize(items)
    queries = queries.withColumn("_blk", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    parts = []
    for i in range(blocks):
        packed = queries.filter(F.col("_blk") == i).agg(F.sort_array(F.collect_list(F.struct("query_id", "qv"))).alias("_q"))
        j = items.withColumn("_q", F.explode(packed.scalar()))
        said = ["_said"] if text else []
        parts.append(j.select(F.col("_q.query_id").alias("query_id"), "item_id", cosine(F.col("v"), F.col("_q.qv")).alias("cos"), *said))
    j = parts[0]
    for p in parts[1:]:
        j = j.unionByName(p)
    if min_cos is not None:
        j = j.filter(F.col("cos") >= min_cos)
    if text:
        best = F.max(F.struct("cos", (-F.col("item_id")).alias("_t")))
        j = j.groupBy("query_id", "_said").agg(best.alias("_b")).select("query_id", (-F.col("_b._t")).alias("item_id"), F.col("_b.cos").alias("cos"))
    w = Window.partitionBy("query_id").orderBy(F.desc("cos"), "item_id")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
