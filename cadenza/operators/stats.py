"""Aggregates over timed tables. Everything is partial + final aggregation; ordered inputs go through blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.vector import cosine
from cadenza.operators.ordered import carried, exact_percentile, lag, lead, ordered_blocks, row_index, run_sum, running


def transcript_stats(words: DataFrame, key: Sequence[str] = ("source_id",)) -> DataFrame:
    """Word count, words per minute, speech seconds and silence share per source."""
    agg = words.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_words"), F.max("end").alias("duration"), F.sum(F.col("end") - F.col("start")).alias("speech_sec")
    )
    return agg.withColumns(
        {
            "wpm": F.when(F.col("duration") > 0, F.col("n_words") / (F.col("duration") / 60)).otherwise(F.lit(0.0)),
            "silence_ratio": F.when(
                F.col("duration") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("speech_sec") / F.col("duration")))
            ).otherwise(F.lit(0.0)),
        }
    )


def speech_rate(stats: DataFrame, n: str, speech: str, words_sec: str, duration: str, logprob: str) -> DataFrame:
    """Words per second with fallbacks and confidence from the mean log probability."""
    c = F.col
    wps = (
        F.when((c(n) > 0) & (c(speech) > 0), c(n) / c(speech))
        .when((c(n) > 0) & (c(words_sec) > 0), c(n) / c(words_sec))
        .when((c(n) > 0) & (c(duration) > 0), c(n) / c(duration))
        .otherwise(F.lit(0.0))
    )
    conf = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(c(logprob)))), F.lit(0.0))
    return stats.withColumns({"words_per_sec": wps, "confidence": conf})


def gap_distribution(spans: DataFrame, key, start: str, end: str, id: str) -> DataFrame:
    """Mean, population deviation, maximum and bias-corrected excess kurtosis of the positive gaps."""
    r = running(spans, key, [start, id], {"_pe": lag(end)})
    g = r.withColumn("_g", F.col(start) - F.col("_pe")).withColumn("_g", F.when(F.col("_g") > 0, F.col("_g")))
    s = g.groupBy(*key).agg(
        F.count("_g").alias("n_gaps"),
        F.avg("_g").alias("mean_gap"),
        F.stddev_pop("_g").alias("gap_std"),
        F.max("_g").alias("max_gap"),
        F.kurtosis("_g").alias("_k"),
        F.sum(F.col(end) - F.col(start)).alias("speech_sec"),
    )
    n = F.col("n_gaps").cast("double")
    corrected = F.try_divide((n - 1) * ((n + 1) * F.col("_k") + 6), (n - 2) * (n - 3))
    kurt = F.when((n >= 4) & (F.col("gap_std") > 0), corrected).otherwise(F.lit(0.0))
    return s.withColumn("gap_kurtosis", kurt).drop("_k")


def interval_cv(points: DataFrame, key, t: str, id: str) -> DataFrame:
    """Deviation over mean of the intervals between points; needs three points and a positive mean."""
    r = running(points, key, [t, id], {"_p": lag(t)}).withColumn("_d", F.col(t) - F.col("_p"))
    s = r.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_points"), F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_s")
    )
    return s.filter((F.col("n_points") >= 3) & (F.col("_m") > 0)).select(*key, "n_points", (F.col("_s") / F.col("_m")).alias("cv"))


def coverage_summary(ev: DataFrame, agents: Sequence[str], strong: float = 0.6, themes_min: int = 3, theme: str = "text") -> DataFrame:
    """Per chunk: counts by agent, the first two strong fragments, frequent themes; empty chunks are rows too."""
    key = ["source_id", "chunk"]
    counts = ev.groupBy(*key).agg(*[F.count(F.when(F.col("agent") == a, 1)).alias(f"n_{a}") for a in agents])
    w = Window.partitionBy(*key).orderBy("start", "id")
    first = (
        ev.filter(F.col("strength") >= strong)
        .select(*key, "start", "id")
        .withColumn("_k", F.row_number().over(w))
        .filter("_k <= 2")
        .groupBy(*key)
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "id"))), lambda s: s["id"].cast("string")), ",").alias("strong_ids"))
    )
    dominant = (
        ev.groupBy(*key, F.col(theme).alias("_th")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= themes_min)
        .groupBy(*key).agg(F.count(F.lit(1)).alias("n_themes"), F.min("_th").alias("first_theme"))
    )
    grid = ev.groupBy("source_id").agg(F.max("chunk").alias("_m")).select(
        "source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m"))).alias("chunk")
    )
    out = grid.join(counts, key, "left").join(first, key, "left").join(dominant, key, "left")
    zero = {f"n_{a}": 0 for a in agents} | {"n_themes": 0, "strong_ids": "", "first_theme": ""}
    out = out.fillna(zero)
    return out.withColumn("is_gap", sum((F.col(f"n_{a}") for a in agents), F.lit(0)) == 0)


def vote_aggregate(votes: DataFrame, *, veto: int, cap: int) -> DataFrame:
    """Ensemble votes (source_id, judge, id, start, end, text, score) -> median score per agreed item."""
    keyed = votes.withColumns(
        {
            "_s": F.bround("start", 1),
            "_e": F.bround("end", 1),
            "_x": F.substring(F.lower(F.trim("text")), 1, 50),
        }
    )
    key = ["source_id", "_s", "_e", "_x"]
    med = exact_percentile(keyed, key, "score", {"median_score": 0.5})
    info = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("votes"), F.min(F.struct("judge", "id", "start", "end")).alias("_first"))
    out = info.filter(F.col("votes") >= veto).join(med, key)
    out = out.select("source_id", F.col("_first.id").alias("id"), "votes", "median_score", F.col("_first.start").alias("start"))
    w = Window.partitionBy("source_id").orderBy(F.desc("median_score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)


def selection_stats(clips: DataFrame, duration: DataFrame) -> DataFrame:
    """Density per minute, duration spread and a topic histogram per source."""
    c = clips.withColumn("_d", F.round(F.col("end") - F.col("start"), 6))
    med = exact_percentile(c, ["source_id"], "_d", {"median_duration": 0.5})
    agg = c.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("_d").alias("min_duration"), F.max("_d").alias("max_duration")
    )
    hist = c.groupBy("source_id", "topic").agg(F.count(F.lit(1)).alias("_n"))
    entry = F.concat_ws(":", "topic", F.col("_n").cast("string"))
    hist = hist.groupBy("source_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("a"), "topic", entry.alias("e")))), lambda s: s["e"]), ","
        ).alias("topics")
    )
    out = agg.join(med, "source_id").join(hist, "source_id").join(duration, "source_id")
    dens = F.when(F.col("duration") > 0, F.col("n") / (F.col("duration") / 60)).otherwise(F.lit(0.0))
    return out.withColumn("per_minute", dens)


def context_risk(segs: DataFrame, key, order: Sequence[str], start: str, end: str, vec: str | None, sentiment: str) -> DataFrame:
    """Largest of three ramps over adjacent plan segments: far vectors, long jumps, sentiment shifts."""
    runs = {"_pe": lag(end), "_ps": lag(sentiment)}
    if vec:
        runs["_pv"] = lag(vec)
    r = running(segs, key, order, runs)
    sim = cosine(F.col("_pv"), F.col(vec)) if vec else F.lit(None).cast("double")
    both = F.col("_pv").isNotNull() & F.col(vec).isNotNull() if vec else F.lit(False)
    a = r.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.min(F.when(both, sim)).alias("_sim"),
        F.max(F.abs(F.col(start) - F.col("_pe"))).alias("_gap"),
        F.max(F.abs(F.col(sentiment) - F.col("_ps"))).alias("_shift"),
    )
    def ramp(x):
        return F.when(x.isNull(), F.lit(0.0)).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 3))

    r1, r2, r3 = ramp((0.4 - F.col("_sim")) / 0.4), ramp((F.col("_gap") - 300) / 600.0), ramp((F.col("_shift") - 0.5) / 0.8)
    reasons = F.array_compact(
        F.array(F.when(r1 > 0.3, F.lit("semantic")), F.when(r2 > 0.3, F.lit("gap")), F.when(r3 > 0.3, F.lit("sentiment")))
    )
    many = F.col("n_segments") >= 2
    return a.select(
        *key,
        "n_segments",
        F.when(many, F.greatest(r1, r2, r3)).otherwise(F.lit(0.0)).alias("risk"),
        F.when(many, F.array_join(reasons, ",")).otherwise(F.lit("")).alias("reasons"),
    )


# Duration steps (upper bound in seconds, fit) and grade thresholds.
DURATION_STEPS = ((10, 55.0), (20, 78.0), (30, 92.0), (60, 100.0), (90, 92.0), (120, 80.0), (180, 68.0))
GRADES = ((85, "A"), (70, "B"), (55, "C"))


def duration_fit_steps(sec: Column) -> Column:
    """Step table; bounds up to 30 s are exclusive, later ones inclusive."""
    out = None
    for bound, fit in DURATION_STEPS:
        cond = sec < bound if bound <= 30 else sec <= bound
        out = F.when(cond, fit) if out is None else out.when(cond, fit)
    return out.otherwise(F.lit(55.0))


def duration_fit_tent(sec: Column, low: float = 28.0, best: float = 42.0, high: float = 75.0) -> Column:
    """1 at ``best``, 0.5 at both edges, linear between, 0 outside."""
    up = 0.5 + 0.5 * (sec - low) / (best - low)
    down = 1.0 - 0.5 * (sec - best) / (high - best)
    return F.when((sec < low) | (sec > high), F.lit(0.0)).when(sec <= best, up).otherwise(down)


def composite_score(duration: Column, rhythm: Column, visual: Column, bookend: Column, trend: Column, digits: int = 1) -> Column:
    narrative = F.least(
        F.lit(1.0), F.lit(0.7) + F.when(bookend, 0.2).otherwise(0.0) + F.when((duration >= 25) & (duration <= 75), 0.1).otherwise(0.0)
    )
    raw = (
        0.35 * duration_fit_steps(duration)
        + 0.25 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), rhythm)) * 100
        + 0.20 * F.coalesce(visual, F.lit(0.7)) * 100
        + 0.15 * narrative * 100
        + 0.05 * trend * 100
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), digits)


def grade(score: Column) -> Column:
    out = None
    for bound, letter in GRADES:
        out = F.when(score >= bound, letter) if out is None else out.when(score >= bound, letter)
    return out.otherwise("D")


def monotone_runs(segs: DataFrame, key=("source_id",), order=("seg_idx",), long_sec: float = 30.0, need: int = 3) -> DataFrame:
    """Runs of one speaker with long continuations, and the rhythm score per source.

    A row continues a run when its speaker equals the previous row's and it is longer than
    ``long_sec``; ``need`` continuations make an issue. Lengths are rounded to 9 digits, as a difference of times is not exact.
    """
    key, order = list(key), list(order)
    r = running(segs, key, order, {"_p": lag("speaker")})
    cont = F.coalesce((F.col("speaker") == F.col("_p")) & (F.round(F.col("end") - F.col("start"), 9) > long_sec), F.lit(False))
    r = r.withColumn("_new", F.when(cont, 0).otherwise(1))
    r = running(r, key, order, {"_run": run_sum("_new")})
    runs = r.groupBy(*key, "_run").agg((F.count(F.lit(1)) - 1).alias("_c"))
    return runs.groupBy(*key).agg(
        F.count(F.when(F.col("_c") >= need, 1)).alias("issues"), F.max("_c").alias("longest")
    ).withColumn("rhythm_score", F.greatest(F.lit(0.0), 1 - F.col("issues") * 0.15))


def episodes(moments: DataFrame, duration: DataFrame, target: float = 600.0, min_source: float = 1200.0) -> DataFrame:
    """Time buckets of equal length (at most ``target`` seconds) with counts, top themes and a summary.

    ``moments``: source_id, id, start, strength, theme, line. Sources below ``min_source`` give no rows.
    """
    d = duration.filter(F.col("duration") >= min_source).withColumn("_n", (F.floor(F.col("duration") / target) + 1))
    m = moments.join(d, "source_id").withColumn("_len", F.col("duration") / F.col("_n"))
    m = m.withColumn("episode", F.least(F.col("_n") - 1, F.floor(F.col("start") / F.col("_len"))))
    key = ["source_id", "episode"]
    base = m.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_moments"),
        F.round(F.min(F.col("episode") * F.col("_len")), 1).alias("ep_start"),
        F.round(F.min(F.least("duration", (F.col("episode") + 1) * F.col("_len"))), 1).alias("ep_end"),
    )
    w = Window.partitionBy(*key).orderBy(F.desc("strength"), "id")
    top = m.select(*key, "strength", "id", "line").withColumn("_k", F.row_number().over(w)).filter("_k <= 3")
    top = top.groupBy(*key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "line"))), lambda s: s["line"]), " | ").alias("summary")
    )
    th = m.groupBy(*key, "theme").agg(F.max("strength").alias("_s"))
    w2 = Window.partitionBy(*key).orderBy(F.desc("_s"), "theme")
    th = th.withColumn("_k", F.row_number().over(w2)).filter("_k <= 5").groupBy(*key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "theme"))), lambda s: s["theme"]), ",").alias("themes")
    )
    return base.join(top, key).join(th, key)


# Question weights of the segment check and of the cover choice.
SEGMENT_QUESTIONS = {"face_visible": (0.4, "face_off_screen"), "well_framed": (0.3, "poor_framing"), "energetic": (0.3, "low_energy")}
COVER_QUESTIONS = {"face_visible": 0.5, "well_framed": 0.3, "engaging": 0.2}


def answer_value(answer: Column) -> Column:
    return F.when(answer == "yes", 1.0).when(answer == "no", 0.0).otherwise(F.lit(0.5))


def question_score(answers: DataFrame, key) -> DataFrame:
    """Weighted answers (``question``, ``answer``) per segment with flags."""
    q = F.col("question")
    weight = F.lit(0.0)
    flag = F.lit(None).cast("string")
    for name, (wt, fl) in SEGMENT_QUESTIONS.items():
        weight = F.when(q == name, wt).otherwise(weight)
        flag = F.when((q == name) & (F.col("answer") == "no"), fl).otherwise(flag)
    s = answers.groupBy(*key).agg(
        F.sum(weight * answer_value(F.col("answer"))).alias("_s"),
        F.array_sort(F.collect_set(flag)).alias("_f"),
        F.max(F.when(~F.col("answer").isin("yes", "no"), 1).otherwise(0)).alias("_u"),
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s")))
    flags = (
        F.when(F.size("_f") > 0, F.array_join("_f", ","))
        .when(F.col("_u") == 1, F.lit("occluded"))
        .when(F.round(score, 9) >= 0.8, F.lit("visual_ok"))
        .otherwise(F.lit(""))
    )
    return s.select(*key, score.alias("score"), flags.alias("flags"))


def best_frame(answers: DataFrame, key, frame: str) -> DataFrame:
    """Frame with the best cover score per plan; the earliest on a tie."""
    q = F.col("question")
    weight = F.lit(0.0)
    for name, wt in COVER_QUESTIONS.items():
        weight = F.when(q == name, wt).otherwise(weight)
    s = answers.groupBy(*key, frame).agg(F.round(F.sum(weight * answer_value(F.col("answer"))), 9).alias("score"))
    best = F.max_by(F.struct(frame, "score"), F.struct("score", (-F.col(frame)).alias("f")))
    return s.groupBy(*key).agg(best.alias("_b")).select(*key, F.col(f"_b.{frame}").alias(frame), F.col("_b.score").alias("score"))


def stage_durations(events: DataFrame, key, stage: str, t: str, id: str) -> DataFrame:
    """Seconds spent per stage, summed over re-entries, up to the job's last event."""
    r = running(events, key, [t, id], {"_n": lead(t)})
    return r.groupBy(*key, stage).agg(F.sum(F.coalesce(F.col("_n") - F.col(t), F.lit(0.0))).alias("seconds"))


def edit_stats(removed: DataFrame, key=("source_id",)) -> DataFrame:
    """Counts and seconds removed, by reason kind."""
    kind = F.split("reason", ":")[0]
    return removed.groupBy(*key, kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("seconds"), F.max(F.col("end") - F.col("start")).alias("longest")
    )


def snap_stats(cuts: DataFrame, key=("source_id",), old=("c_start", "c_end"), new=("new_start", "new_end"), least: float = 1e-4) -> DataFrame:
    """Of moved cuts: all boundaries, those that moved by more than ``least``, the largest move."""
    a, b = F.abs(F.col(new[0]) - F.col(old[0])), F.abs(F.col(new[1]) - F.col(old[1]))
    far = F.greatest(F.when(a > least, a).otherwise(F.lit(0.0)), F.when(b > least, b).otherwise(F.lit(0.0)))
    return cuts.groupBy(*key).agg(
        (2 * F.count(F.lit(1))).alias("total_boundaries"), F.count(F.when(a > least, 1)).alias("snapped_starts"), F.count(F.when(b > least, 1)).alias("snapped_ends"), F.round(F.max(far), 3).alias("max_shift")
    )


def gate_stats(items: DataFrame, key, outcome: str, score: str) -> DataFrame:
    kinds = ("accepted", "swapped", "rejected", "kept_low")
    return items.groupBy(*key).agg(
        *[F.count(F.when(F.col(outcome) == k, 1)).alias(k) for k in kinds],
        F.avg(score).alias("mean_score"),
        F.min(score).alias("min_score"),
    )
