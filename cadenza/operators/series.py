"""Operators on ordered words, points and spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import strip_edges
from cadenza.functions.vector import cosine_continuity
from cadenza.operators.ordered import carried, lag, lead, ordered_blocks, row_index, run_max, run_sum, running


def silence_ranges(words: DataFrame, duration: DataFrame, min_silence: float = 0.6, pad: float = 0.08) -> DataFrame:
    """Pauses to remove: head and tail strictly longer than ``min_silence``, inner ones from it on."""
    key = ["source_id"]
    r = running(words.select("source_id", "pos", "start", "end"), key, ["start", "pos"], {"_n": lead("start"), "_i": row_index()})
    inner = r.filter(F.round(F.col("_n") - F.col("end"), 9) >= min_silence).select(
        "source_id", (F.col("end") + pad).alias("start"), (F.col("_n") - pad).alias("end")
    ).filter("end > start")
    head = r.filter((F.col("_i") == 1) & (F.col("start") > min_silence)).select(
        "source_id", F.lit(0.0).alias("start"), F.greatest(F.lit(0.0), F.col("start") - pad).alias("end")
    )
    tail = r.filter(F.col("_n").isNull()).join(duration, key).filter(F.round(F.col("duration") - F.col("end"), 9) > min_silence).select(
        "source_id", F.least("duration", F.col("end") + pad).alias("start"), F.col("duration").alias("end")
    )
    return inner.unionByName(head).unionByName(tail).withColumn("reason", F.lit("silence"))


def adjacent_similarity(df: DataFrame, key, order, vec: str) -> DataFrame:
    """Cosine of every row with the next one of its key; null on the last."""
    r = running(df, key, order, {"_nv": lead(vec), "_has": lead(F.lit(1))})
    sim = F.when(F.col("_has") == 1, cosine_continuity(F.col(vec), F.col("_nv")))
    return r.withColumn("sim", sim).drop("_nv", "_has")


def boundary_candidates(sims: DataFrame, key, order, *, end: str, threshold=0.35, edge=15.0, keep=30, alone=0.7) -> DataFrame:
    """Local similarity minima below ``threshold`` away from both ends, the ``keep`` lowest per key.

    ``confident`` marks those low enough to need no further verdict.
    """
    total = sims.groupBy(*key).agg(F.max(end).alias("_total"), F.count(F.lit(1)).alias("_rows"))
    s = sims.filter(F.col("sim").isNotNull())
    r = running(s, key, order, {"_p": lag("sim"), "_n": lead("sim")}).join(total, list(key))
    c = r.filter(
        (F.col("_rows") >= 3)
        & (F.col("sim") < threshold)
        & (F.col("sim") <= F.coalesce("_p", F.lit(1.0)))
        & (F.col("sim") <= F.coalesce("_n", F.lit(1.0)))
        & (F.col(end) >= edge)
        & (F.col(end) <= F.col("_total") - edge)
    )
    w = Window.partitionBy(*key).orderBy("sim", *order)
    c = c.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= keep)
    return c.withColumn("confident", F.col("sim") < threshold * alone).drop("_p", "_n", "_k", "_total", "_rows")


def remap_to_plan_time(words: DataFrame, segs: DataFrame, plan_key: Sequence[str], width: float = 60.0) -> DataFrame:
    """Words on the plan's own clock: segments laid end to end, words clipped, the last word of a segment flagged.

    ``segs``: plan_key, source_id, seg_no, seg_start, seg_end. A word belongs to a segment when it starts inside.
    """
    from cadenza.operators.intervals import point_join

    plan_key = list(plan_key)
    length = F.greatest(F.lit(0.0), F.col("seg_end") - F.col("seg_start"))
    s = running(segs.withColumn("_len", length), plan_key, ["seg_no"], {"offset": run_sum("_len", inclusive=False)})
    j = point_join(words, s, ["source_id"], "start", ("seg_start", "seg_end"), width=width).filter("start < seg_end and end > seg_start")
    j = j.withColumns(
        {
            "local_start": F.greatest(F.lit(0.0), F.col("start") - F.col("seg_start")) + F.col("offset"),
            "local_end": F.least(F.col("seg_end"), F.col("end")) - F.col("seg_start") + F.col("offset"),
        }
    )
    # a segment's words are bounded by its length
    w = Window.partitionBy(*plan_key, "seg_no").orderBy("start", "pos")
    j = j.withColumn("is_last", F.lead(F.lit(1)).over(w).isNull())
    return j.filter("local_end > local_start")


def window_gains(points: DataFrame, key, t: str, level: str, *, size=3.0, target=-16.0, limit=6.0, floor=-70.0, digits=2) -> DataFrame:
    """Tumbling windows: clipped gain towards ``target``; windows quieter than ``floor`` are skipped."""
    g = points.groupBy(*key, F.floor(F.col(t) / size).alias("win")).agg(F.avg(level).alias("_l"), F.count(F.lit(1)).alias("n"))
    g = g.filter(F.col("_l") >= floor)
    return g.select(
        *key, "win", "n", F.round(F.greatest(F.lit(-limit), F.least(F.lit(limit), target - F.col("_l"))), digits).alias("gain")
    )


def truncate_running(cuts: DataFrame, key, order, start: str, end: str, *, limit: float, min_piece=0.25, stop=0.1) -> DataFrame:
    """Cut lists whose durations add up to at most ``limit``; rows after the budget are dropped."""
    c = cuts.withColumn("_d", F.col(end) - F.col(start)).filter(F.round("_d", 9) >= min_piece)
    c = c.withColumn("_d", F.least(F.col("_d"), F.lit(float(limit))))
    r = running(c, key, order, {"_used": run_sum("_d", inclusive=False)})
    left = F.lit(float(limit)) - F.col("_used")
    r = r.filter(F.round(left, 9) > stop)
    return r.withColumn(end, F.col(start) + F.least(F.col("_d"), left)).drop("_d", "_used")


def spread_words(segs: DataFrame, text: str, start: str, end: str, digits: int | None = 3) -> DataFrame:
    """Every word of ``text`` with an even share of [start, end]."""
    words = F.filter(F.split(F.trim(F.col(text)), "[ \n\t\r]+"), lambda w: w != "")
    s = segs.withColumn("_w", words).filter(F.size("_w") > 0)
    per = F.greatest(F.lit(0.001), F.col(end) - F.col(start)) / F.size("_w")
    s = s.withColumn("_per", per).select("*", F.posexplode("_w").alias("word_no", "word"))
    at = {"word_start": F.col(start) + F.col("word_no") * F.col("_per"), "word_end": F.col(start) + (F.col("word_no") + 1) * F.col("_per")}
    return s.withColumns({n: c if digits is None else F.round(c, digits) for n, c in at.items()}).drop("_w", "_per")


def evict_lru(entries: DataFrame, key, age: str, size: str, id: str, limit) -> DataFrame:
    """Entries to delete, oldest first, until the rest fits ``limit`` (a column or number)."""
    r = running(entries, key, [age, id], {"_before": run_sum(size, inclusive=False)})
    total = entries.groupBy(*key).agg(F.sum(size).alias("_total"))
    return r.join(total, list(key)).filter(F.col("_total") - F.col("_before") > limit).drop("_before", "_total")


def position_penalty(hooks: DataFrame, start: str, score: str, p_start: str, p_end: str, *, strict=0.4, soft=0.6, late=0.1, least=0.5) -> DataFrame:
    """Late starts inside the parent lose score or the row."""
    dur = F.col(p_end) - F.col(p_start)
    adj = F.when(F.col(start) > F.col(p_start) + dur * strict, F.greatest(F.lit(0.0), F.col(score) - late)).otherwise(F.col(score))
    h = hooks.filter(F.col(start) <= F.col(p_start) + dur * soft).withColumn("adjusted", F.round(adj, 9))
    return h.filter(F.col("adjusted") >= least)


# Words that point at something visible.
DEICTIC = ("вот", "здесь", "смотри", "тут", "сюда", "этот", "эта", "это", "here", "this", "look", "see", "watch")


def trigger_points(words: DataFrame, series: DataFrame, lexicon: Sequence[str] = DEICTIC, factor: float = 1.25) -> DataFrame:
    """Lexicon hits become markers that join an existing marker series (source_id, t, factor)."""
    hits = words.filter(strip_edges(F.col("word")).isin(*lexicon)).select("source_id", F.col("start").alias("t"), F.lit(factor).alias("factor"))
    return series.select("source_id", "t", "factor").unionByName(hits)


def text_sections(df: DataFrame, text: str, *, whole: int = 12000, head: int = 6000, tail: int = 4000) -> DataFrame:
    """Short texts stay whole; long ones give a head and a tail section and a flag."""
    t = F.col(text)
    long = F.length(t) > whole
    return df.withColumns(
        {
            "first_section": F.when(long, F.substring(t, 1, head)).otherwise(t),
            "last_section": F.when(long, F.expr(f"right({text}, {tail})")).otherwise(F.lit("")),
            "omitted": long,
        }
    )
