"""Timed tables derived from the driver tables. All but ``evidence`` and ``segments`` are narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.ordered import BOUNDED, run_sum, running

WS = "[ \n\t\r]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def thousandths(x: Column) -> Column:
    """``x`` rounded to three digits as the SQL counterparts round doubles: scaled, then rounded.

    ``F.round`` goes by the decimal text of ``x``, which decides one tie in ninety the other way (10.01 / 20).
    """
    return F.round(x * 1000, 0) / 1000


def words(spark: SparkSession, sf: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(source_id, pos, word, start, end, sent), one source per document; built inside the row, no shuffle.

    Texts are cut behind sentence ends first, so the number of sentence ends before a word is its
    sentence's index; flattening keeps the word's own position.
    """
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id", metadata=BOUNDED), "text", *extra)
    sents = F.split("text", "(?<=[.!?…])" + WS)
    flat = F.flatten(
        F.transform(sents, lambda s, n: F.transform(F.split(s, WS), lambda w: F.struct(n.alias("n"), w.alias("word"))))
    )
    d = d.select("source_id", *extra, F.posexplode(flat).alias("_i", "_w")).filter("_w.word <> ''")
    pos = F.col("_i").cast("long")
    # multiples of a tenth: no ties, and much cheaper than decimal rounding
    start = F.rint((pos * F.lit(0.4) + F.lit(0.9) * F.col("_w.n")) * 1000) / 1000
    return d.select(
        "source_id", pos.alias("pos"), F.col("_w.word").alias("word"), start.alias("start"), (F.rint((start + 0.3) * 1000) / 1000).alias("end"), F.col("_w.n").cast("long").alias("sent"), *extra
    )


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """(source_id, sent, start, end, n_words, chars, sim): sentences as short utterances.

    A document's words lie in one task, so the partial aggregation does the work. ``sim`` stands for
    the similarity with the next sentence.
    """
    w = words(spark, sf)
    s = w.groupBy("source_id", "sent").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_words"), (F.sum(F.length("word") + 1) - 1).alias("chars")
    )
    return s.withColumn("sim", ((F.col("sent") * 37 + F.col("source_id")) % 100) / F.lit(100.0))


def arc_segments(spark: SparkSession, sf: str, size: int = 12) -> DataFrame:
    """(source_id, arc_no, seg_no, id, role, start, end, dur, score, closing): story arcs of ``size`` clips in time order."""
    from cadenza.operators.ordered import row_index

    c = running(clips(spark, sf), ["source_id"], ["start", "clip_id"], {"_i": row_index()})
    i = F.col("_i") - 1
    role = (
        F.when(F.col("topic") == "click", "hook").when(F.col("topic") == "view", "setup").when(F.col("topic") == "error", "development")
        .when(F.col("topic") == "purchase", "peak").otherwise("payoff")
    )
    dur = (28 + F.col("clip_id") % 48) / F.lit(4.0)
    return c.select(
        "source_id", F.floor(i / size).alias("arc_no"), (i % size).alias("seg_no"), F.col("clip_id").alias("id"), role.alias("role"),
        "start", F.round(F.col("start") + dur, 3).alias("end"), dur.alias("dur"), "score", (F.col("clip_id") % 2 == 0).alias("closing"),
    )


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """(source_id, seg_idx, start, end, text, speaker): conversation turns laid on a time axis."""
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("source_id"),
        F.col("turn").alias("seg_idx"),
        "text",
        F.col("role").alias("speaker"),
        (F.length("text") * F.lit(0.06)).alias("dur"),
    )
    r = running(c, ["source_id"], ["seg_idx"], {"_before": run_sum("dur", inclusive=False)})
    start = F.round(F.col("_before") + 0.5 * F.col("seg_idx"), 3)
    r = r.withColumn("start", start)
    return r.select("source_id", "seg_idx", "start", F.round(F.col("start") + F.col("dur"), 3).alias("end"), "text", "speaker")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """(source_id, event_id, t, value, kind): event series in epoch seconds."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("source_id"),
        "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"),
        "value",
        F.col("event_type").alias("kind"),
    )


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """(source_id, id, agent, chunk, start, end, text, strength) on a per-source time axis."""
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("source_id"),
        F.col("event_id").alias("id"),
        F.col("event_type").alias("agent"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("_t"),
        "value",
        F.concat_ws(" ", "event_type", "props").alias("text"),
    )
    first = e.groupBy("source_id").agg(F.min("_t").alias("_t0"))
    e = e.join(first, "source_id").withColumn("start", F.round(F.col("_t") - F.col("_t0"), 3))
    return e.select(
        "source_id",
        "id",
        "agent",
        F.floor(F.col("start") / 86400).alias("chunk"),
        "start",
        F.round(F.col("start") + 5 + F.col("value"), 3).alias("end"),
        "text",
        F.least(F.lit(1.0), F.col("value") / 500).alias("strength"),
    )


def clips(spark: SparkSession, sf: str) -> DataFrame:
    """(source_id, clip_id, chunk, start, end, topic, score): scored spans of 28 to 75 seconds."""
    e = evidence(spark, sf)
    return e.select(
        "source_id",
        F.col("id").alias("clip_id"),
        "chunk",
        "start",
        F.round(F.col("start") + 28 + F.col("id") % 48, 3).alias("end"),
        F.col("agent").alias("topic"),
        (5 + F.col("id") % 6).cast("double").alias("score"),
    )


def dense_clips(spark: SparkSession, sf: str, squeeze: int = 400) -> DataFrame:
    """Clips with the time axis squeezed, so that spans really collide."""
    c = clips(spark, sf)
    s = thousandths(F.col("start") / squeeze)
    return c.withColumn("end", F.round(s + F.col("end") - F.col("start"), 3)).withColumn("start", s)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(source_id, item_id, v): embeddings grouped by label."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("label").alias("source_id"),
        F.col("vec_id").alias("item_id"),
        F.col("embedding").cast("array<double>").alias("v"),
    )
