"""Assembly of plans from ranked rows and arcs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import safe_id, tokens, trim_text
from cadenza.functions.vector import norm
from cadenza.operators.intervals import exclude_overlapping, overlap_join
from cadenza.operators.rank import vector_topk
from cadenza.operators.segment import CLOSING_ROLES, PLAN_MAX, PLAN_MIN
from cadenza.session import materialize


def jitter(*parts: Column, top: float = 10.0) -> Column:
    """Repeatable 0..``top`` seconds from a hash of the given columns."""
    return F.pmod(F.xxhash64(*parts), F.lit(256)) / F.lit(255.0) * top


def normalize_bounds(
    df: DataFrame, start: str, end: str, duration: str, *, low: float = PLAN_MIN, high: float = PLAN_MAX, pad: Column | None = None
) -> DataFrame:
    """Add ``n_start, n_end``: too long spans keep their middle, short ones grow to ``low`` + jitter; null when impossible.

    ``pad`` overrides the jitter.
    """
    d = F.col(duration)
    s = F.greatest(F.lit(0.0), F.least(F.col(start), d))
    e = F.greatest(F.lit(0.0), F.least(F.col(end), d))
    ok = (F.col(end) > F.col(start)) & (d > 0) & (e > s)
    length = e - s
    # too long
    ls = F.greatest(F.lit(0.0), (s + e) / 2 - high / 2)
    le = F.least(d, ls + high)
    ls = F.greatest(F.lit(0.0), le - high)
    # too short
    goal = F.lit(low) + (pad if pad is not None else jitter(F.round(s, 3), F.round(e, 3)))
    half = (goal - length) / 2
    ps, pe = F.greatest(F.lit(0.0), s - half), F.least(d, e + half)
    miss = F.greatest(F.lit(0.0), goal - (pe - ps))
    qe = F.when(ps <= 0, F.least(d, pe + miss)).otherwise(pe)
    qs = F.when((ps > 0) & (pe >= d), F.greatest(F.lit(0.0), ps - miss)).otherwise(ps)
    enough = F.round(qe - qs, 9) >= low
    ns = F.when(~ok, None).when(length > high, ls).when(length >= low, s).when(enough, qs)
    ne = F.when(~ok, None).when(length > high, le).when(length >= low, e).when(enough, qe)
    return df.withColumns({"n_start": ns, "n_end": ne})


def single_plans(ranked: DataFrame, duration: DataFrame, *, pad: Column | None = None) -> DataFrame:
    """Every ranked row as a one-segment plan of allowed length."""
    r = normalize_bounds(ranked.join(duration.select("source_id", "duration"), "source_id"), "start", "end", "duration", pad=pad)
    return r.filter("n_start is not null").select(
        "source_id", F.col("id").alias("plan_id"), "score", F.array(F.struct(F.col("n_start").alias("s"), F.col("n_end").alias("e"))).alias("segs"),
        (F.col("n_end") - F.col("n_start")).alias("duration"), F.lit("single").alias("origin"),
    )


def thematic_plans(
    items: DataFrame, duration: DataFrame, *, largest: int = 20, min_size: int = 3, seg_low: float = PLAN_MIN, seg_high: float = PLAN_MAX, pad: Column | None = None
) -> DataFrame:
    """One plan per theme cluster: best hook, up to two body rows, best payoff; 45 to 80 seconds in all.

    With the default segment bounds two segments already exceed 80 s, so no plan can arise; narrower bounds
    make the rule useful.

    ``items``: source_id, cluster, id, start, end, category, score.
    """
    key = ["source_id", "cluster"]
    size = items.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_f")).filter(F.col("_n") >= min_size)
    w = Window.partitionBy("source_id").orderBy(F.desc("_n"), "_f")
    size = size.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= largest).select(*key)
    part = F.when(F.col("category") == "hook_candidate", 0).when(F.col("category") == "payoff_candidate", 2).when(
        F.col("category").isin("peak_candidate", "development_material"), 1
    )
    i = items.join(size, key).withColumn("_part", part).filter("_part is not null")
    wc = Window.partitionBy(*key, "_part").orderBy(F.desc("score"), "id")
    i = i.withColumn("_k", F.row_number().over(wc)).filter("_k <= 2 and (_part = 1 or _k = 1)")
    i = normalize_bounds(i.join(duration.select("source_id", "duration"), "source_id"), "start", "end", "duration", low=seg_low, high=seg_high, pad=pad)
    seg = F.struct("_part", "_k", F.col("n_start").alias("s"), F.col("n_end").alias("e"))
    g = i.groupBy(*key).agg(
        F.max(F.col("_part") == 0).alias("_h"), F.max(F.col("_part") == 2).alias("_p"), F.avg("score").alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("n_start").isNotNull(), seg))).alias("_s"),
    ).filter("_h and _p and size(_s) >= 2")
    g = g.withColumn("segs", F.transform("_s", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    total = F.aggregate("segs", F.lit(0.0), lambda a, x: a + x["e"] - x["s"])
    g = g.withColumn("duration", F.round(total, 6)).filter((F.col("duration") >= PLAN_MIN) & (F.col("duration") <= PLAN_MAX))
    return g.select(*key, "score", "segs", "duration")


def pull_closure(groups: DataFrame, segs: DataFrame, key=("source_id", "arc_no")) -> DataFrame:
    """(key, grp, id) pulled into groups without a closing role: first payoff with a conclusion, else payoff, else peak.

    ``groups``: key, grp, dur, has_closing; ``segs``: key, grp, seg_no, id, role, dur, closing. Only the first candidate of
    each kind per arc matters; it must fit into 80 s.
    """
    key = list(key)
    kind = F.when((F.col("role") == "payoff") & F.col("closing"), 0).when(F.col("role") == "payoff", 1).when(F.col("role") == "peak", 2)
    c = segs.withColumn("_kind", kind).filter("_kind is not null")
    best = c.groupBy(*key).agg(F.min(F.struct("_kind", "seg_no", "id", F.col("dur").alias("cdur"))).alias("_b"))
    j = groups.filter(~F.col("has_closing")).join(best, key)
    return j.filter(F.round(F.col("dur") + F.col("_b.cdur"), 9) <= PLAN_MAX).select(*key, "grp", F.col("_b.id").alias("id"))


def pad_short_group(plans: DataFrame, *, low: float = PLAN_MIN, pad: Column | None = None) -> DataFrame:
    """Lengthen plans below ``low`` at their outer ends, half on each side, what does not fit on the other; drop the rest.

    ``plans``: plan_id, segs, duration_total (length of the source).
    """
    total = F.aggregate("segs", F.lit(0.0), lambda a, x: a + x["e"] - x["s"])
    p = plans.withColumn("_raw", total)
    need = F.greatest(F.lit(0.0), F.lit(low) + (pad if pad is not None else jitter(F.col("plan_id"))) - F.col("_raw"))
    p = p.withColumn("_need", F.when(F.round("_raw", 9) < low, need).otherwise(F.lit(0.0)))
    lroom = F.greatest(F.lit(0.0), F.get("segs", F.lit(0))["s"])
    rroom = F.greatest(F.lit(0.0), F.col("duration_total") - F.try_element_at("segs", F.lit(-1))["e"])
    p = p.withColumns({"_l0": F.least(lroom, F.col("_need") / 2), "_r0": F.least(rroom, F.col("_need") / 2), "_lr": lroom, "_rr": rroom})
    p = p.withColumn("_r", F.col("_r0") + F.least(F.col("_rr") - F.col("_r0"), F.greatest(F.lit(0.0), F.col("_need") - F.col("_l0") - F.col("_r0"))))
    p = p.withColumn("_l", F.col("_l0") + F.least(F.col("_lr") - F.col("_l0"), F.greatest(F.lit(0.0), F.col("_need") - F.col("_l0") - F.col("_r"))))
    p = p.filter(F.round(F.col("_raw") + F.col("_l") + F.col("_r"), 6) >= low)
    n = F.size("segs")
    segs = F.transform(
        "segs",
        lambda x, i: F.struct(
            F.when(i == 0, x["s"] - F.col("_l")).otherwise(x["s"]).alias("s"), F.when(i == n - 1, x["e"] + F.col("_r")).otherwise(x["e"]).alias("e")
        ),
    )
    return p.withColumn("segs", segs).drop("_raw", "_need", "_l0", "_r0", "_lr", "_rr", "_l", "_r")


def extend_to_target(plans: DataFrame, *, target: float, low: float = PLAN_MIN, most: float = 15.0) -> DataFrame:
    """Grow every segment of plans in [low, target) evenly on both sides, at most ``most`` seconds each."""
    total = F.aggregate("segs", F.lit(0.0), lambda a, x: a + x["e"] - x["s"])
    per = F.least(F.lit(most), (F.lit(target) - total) / F.greatest(F.lit(1), F.size("segs")))
    grow = F.when((F.round(total, 9) >= low) & (F.round(total, 9) < target), per).otherwise(F.lit(0.0))
    segs = F.transform(
        "segs",
        lambda x: F.struct(
            F.greatest(F.lit(0.0), x["s"] - grow / 2).alias("s"), F.when(grow > 0, F.least(F.col("duration_total"), x["e"] + grow / 2)).otherwise(x["e"]).alias("e")
        ),
    )
    return plans.withColumn("segs", segs)


def to_plan(clips: DataFrame, *, prefix: str = "r", hook: str = "hook", limit: int = 140) -> DataFrame:
    """Ranked clips -> plan rows: rounded single segment, running id, limited text."""
    return clips.select(
        "source_id", F.concat(F.lit(prefix), F.col("rank").cast("string")).alias("plan_id"), trim_text(F.col(hook), limit).alias("hook"),
        F.round("start", 3).alias("seg_start"), F.round("end", 3).alias("seg_end"), F.round(F.col("end") - F.col("start"), 3).alias("duration"), "score",
    )


def union_candidates(**sources: DataFrame) -> DataFrame:
    """Candidates of several origins in one table with an ``origin`` column."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("origin", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# Mean shot length per pacing profile.
SHOT_MODES = {"dynamic": 2.5, "balanced": 4.0, "documentary": 6.0, "mkbhd_clean": 3.5}
BOOSTED = ("base_arc", "package_of_shorts", "thematic_cluster", "per_moment_arc")


def score_adjust(plans: DataFrame) -> DataFrame:
    """Boost for multi-segment arcs, cut for context risk, mild preference for the expected length.

    ``plans``: score, origin, n_segments, risk, duration, pacing.
    """
    boost = F.when(F.col("origin").isin(*BOOSTED) & (F.col("n_segments") >= 2), 1.25).otherwise(F.lit(1.0))
    risk = F.when(F.col("n_segments") >= 2, 1 - 0.3 * F.col("risk")).otherwise(F.lit(1.0))
    mode = F.lit(4.0)
    for name, m in SHOT_MODES.items():
        mode = F.when(F.col("pacing") == name, m).otherwise(mode)
    expected = F.greatest(F.lit(20.0), F.least(F.lit(60.0), mode * 10 * 0.2))
    pace = F.when(F.col("duration") > 0, 1 - F.least(F.lit(0.15), F.abs(F.col("duration") - expected) / expected * 0.1)).otherwise(F.lit(1.0))
    return plans.withColumn("score", F.col("score") * boost * risk * pace)


def recent_liked(artifacts: DataFrame, jobs: DataFrame, *, exclude_job, newest: int = 500, keep: int = 50) -> DataFrame:
    """Newest liked rows of other jobs: filters come before the limits."""
    a = artifacts.filter(F.col("liked") & (F.col("job_id") != F.lit(exclude_job))).join(jobs.select("job_id"), "job_id", "left_semi")
    return a.orderBy(F.desc("created"), "artifact_id").limit(min(newest, keep))


# Anchors by date and by vector, and characters of one.
ANCHORS_BY_DATE, ANCHORS_BY_VECTOR, ANCHOR_CHARS = 8, 5, 180


def liked_anchors(liked: DataFrame, like: DataFrame | None = None, *, most: int = ANCHORS_BY_DATE, most_near: int = ANCHORS_BY_VECTOR) -> DataFrame:
    """(rank, artifact_id, anchor, mode): phrases of liked rows (artifact_id, created, hook, v) that steer new selections, each said once.

    With ``like`` (one row: qv) the nearest by cosine; rows without a usable vector do not take part. Without it, or when no row can be
    compared, the newest. Phrases are compared trimmed and case-folded, and cut to ``ANCHOR_CHARS`` characters for output.
    """
    rows = liked.select("artifact_id", "created", F.substring(F.trim("hook"), 1, ANCHOR_CHARS).alias("anchor"), "v").filter("anchor <> ''")
    said = F.lower(F.trim(F.col("anchor")))
    if like is not None:
        q = like.filter(norm(F.col("qv")) > 1e-9).select("qv").limit(1).withColumn("query_id", F.lit(0))
        size = q.select(F.size("qv").alias("n")).first()
        usable = F.coalesce((norm(F.col("v")) > 1e-9) & (F.size("v") == F.lit(size["n"] if size else -1)), F.lit(False))
        near = vector_topk(rows.filter(usable).withColumnRenamed("artifact_id", "item_id"), q, min(most, most_near), text="anchor")
        near = materialize(near.select(F.col("item_id").alias("artifact_id"), "rank").join(rows.select("artifact_id", "anchor"), "artifact_id"))
        if not near.isEmpty():
            return near.select(F.col("rank").cast("int").alias("rank"), "artifact_id", "anchor", F.lit("cosine").alias("mode"))
    newest = F.max(F.struct("created", (-F.col("artifact_id")).alias("_t"), "anchor"))
    n = rows.groupBy(said.alias("_said")).agg(newest.alias("_b")).select("_b.created", (-F.col("_b._t")).alias("artifact_id"), "_b.anchor")
    n = n.orderBy(F.desc("created"), "artifact_id").limit(most)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("created"), "artifact_id")  # of the few rows that are left
    return n.select(F.row_number().over(w).alias("rank"), "artifact_id", "anchor", F.lit("top_by_date").alias("mode"))


def _first_free(hits: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """(keys, k): the smallest rank from 1 that is not among a plan's hits."""
    w = Window.partitionBy(*keys).orderBy(rank)
    h = hits.select(*keys, rank).distinct().withColumn("_next", F.lead(rank).over(w))
    gap = F.min(F.when(F.col("_next").isNull() | (F.col("_next") > F.col(rank) + 1), F.col(rank) + 1))
    return h.groupBy(*keys).agg(F.when(F.min(rank) > 1, F.lit(1).cast("long")).otherwise(gap).alias("k"))


def alternate_payoff(
    plans: DataFrame, ranked: DataFrame, duration: DataFrame | None = None, *, shortest: float = 6.0, longest: float = 22.0, gap: float = 1.0, width: float = 64.0
) -> DataFrame:
    """Best payoff row per plan that keeps ``gap`` seconds from its segments; the hook's motif first, then the score.

    ``plans``: source_id, plan_id, seg_no, s, e; ``ranked``: source_id, id, start, end, category, score, motif. With
    ``duration`` (source_id, duration) candidates end half a second after their source at most. Candidates are numbered
    in the order of the source, and of the source and motif; those that touch a plan come from a range join, and
    the first number they leave free is looked up, so no plan meets all candidates.
    """
    from cadenza.operators.intervals import best_overlap
    from cadenza.operators.ordered import row_index, running

    d = F.col("end") - F.col("start")
    cand = ranked.filter((F.col("category") == "payoff_candidate") & (d >= shortest) & (d <= longest))
    if duration is not None:
        cand = cand.join(duration.select("source_id", "duration"), "source_id").filter(F.col("end") <= F.col("duration") + 0.5).drop("duration")
    cand = cand.select("source_id", "id", "motif", "start", "end", (-F.col("score")).alias("_neg"))
    numbered = running(cand, ["source_id"], ["_neg", "id"], {"_any": row_index()})
    same = running(numbered.filter(F.col("motif").isNotNull()), ["source_id", "motif"], ["_neg", "id"], {"_same": row_index()})

    hook = plans.filter("seg_no = 0").select("source_id", "plan_id", F.col("s").alias("hs"), F.col("e").alias("he"))
    hook = best_overlap(hook, ranked, ["source_id", "plan_id"], ("hs", "he"), ("start", "end"), take={"hook_motif": "motif"}, rid="id", width=width)
    hook = hook.select("source_id", "plan_id", "hook_motif")
    occ = plans.select("source_id", "plan_id", (F.col("s") - gap).alias("_os"), (F.col("e") + gap).alias("_oe"))
    keys = ["source_id", "plan_id"]

    def hits(c: DataFrame, *cols: str) -> DataFrame:
        return overlap_join(c.select("source_id", "id", "start", "end", *cols), occ, ["source_id"], ("start", "end"), ("_os", "_oe"), width=width)

    of_motif = hits(same, "motif", "_same").join(hook, keys).filter(F.col("motif") == F.col("hook_motif"))
    free_any = _first_free(hits(numbered, "_any"), keys, "_any").withColumnRenamed("k", "_any")
    free_same = _first_free(of_motif, keys, "_same").withColumnRenamed("k", "_same")
    one = F.lit(1).cast("long")
    p = hook.join(free_any, keys, "left").join(free_same, keys, "left").withColumns({"_any": F.coalesce("_any", one), "_same": F.coalesce("_same", one)})
    best = F.struct("id", "start", "end")
    p = p.join(same.select("source_id", F.col("motif").alias("hook_motif"), "_same", best.alias("_b1")), ["source_id", "hook_motif", "_same"], "left")
    p = p.join(numbered.select("source_id", "_any", best.alias("_b2")), ["source_id", "_any"], "left")
    p = p.withColumn("_b", F.coalesce("_b1", "_b2")).filter(F.col("_b").isNotNull())
    return p.select("source_id", "plan_id", F.col("_b.id").alias("alt_id"), F.col("_b.start").alias("alt_start"), F.col("_b.end").alias("alt_end"))


def swap_payoff(plans: DataFrame, alternates: DataFrame) -> DataFrame:
    """Segments of the plans with the last one of every plan that has an alternate replaced by it."""
    last = plans.groupBy("source_id", "plan_id").agg(F.max("seg_no").alias("_last"))
    j = plans.join(last, ["source_id", "plan_id"]).join(alternates.select("source_id", "plan_id", "alt_start", "alt_end"), ["source_id", "plan_id"], "left")
    out = (F.col("seg_no") == F.col("_last")) & F.col("alt_start").isNotNull()
    j = j.withColumns({"s": F.when(out, F.col("alt_start")).otherwise(F.col("s")), "e": F.when(out, F.col("alt_end")).otherwise(F.col("e"))})
    return j.drop("_last", "alt_start", "alt_end")


def gate_by_score(plans: DataFrame, *, threshold: float, mode: str, retry: DataFrame | None = None) -> DataFrame:
    """Outcome per plan: accepted, rejected, swapped or kept_low; a missing score (failed check) passes.

    ``mode``: ``keep``, ``reject`` or ``resort``; for the last one ``retry`` (plan_id, new_score) holds the score with another
    payoff; the swap is kept only when it passes.
    """
    ok = F.col("score").isNull() | (F.col("score") >= threshold)
    if mode == "reject":
        return plans.withColumn("outcome", F.when(ok, "accepted").otherwise("rejected"))
    if mode == "keep" or retry is None:
        return plans.withColumn("outcome", F.when(ok, "accepted").otherwise("kept_low"))
    p = plans.join(retry, "plan_id", "left")
    out = F.when(ok, "accepted").when(F.col("new_score") >= threshold, "swapped").otherwise("kept_low")
    return p.withColumn("outcome", out).withColumn("final_score", F.when(F.col("outcome") == "swapped", F.col("new_score")).otherwise(F.col("score"))).drop("new_score")


def fill_limits(duration: Column) -> dict[str, Column]:
    """Minimum themes and moments, maximum themes and moments, by minutes of source."""
    m = duration / 60

    def tier(a, b, c, d):
        return F.when(m <= 15, a).when(m <= 40, b).when(m <= 80, c).otherwise(d)

    return {"min_themes": tier(2, 3, 4, 5), "min_moments": tier(5, 8, 30, 50), "max_themes": tier(5, 7, 10, 12), "max_moments": tier(12, 20, 45, 70)}


def fill_sparse(moments: DataFrame, quotes: DataFrame, peaks: DataFrame, duration: DataFrame) -> DataFrame:
    """Moments of every source, topped up from quotes (-2/+8 s) and peaks (-3/+10 s) when there are too few.

    ``moments``: source_id, id, start, end; ``quotes``/``peaks``: source_id, chunk, id, sec. Quotes of a chunk come before its peaks.
    """
    d = duration.select("source_id", "duration", *[c.alias(n) for n, c in fill_limits(F.col("duration")).items()])
    n = d.join(moments.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n")), "source_id", "left").fillna({"_n": 0})
    sparse = n.filter(F.col("_n") < F.col("min_moments"))
    q = quotes.select("source_id", "chunk", F.lit(0).alias("_k"), "id", F.greatest(F.lit(0.0), F.col("sec") - 2).alias("start"), (F.col("sec") + 8).alias("end"), F.lit(0.6).alias("strength"))
    p = peaks.select("source_id", "chunk", F.lit(1).alias("_k"), "id", F.greatest(F.lit(0.0), F.col("sec") - 3).alias("start"), (F.col("sec") + 10).alias("end"), F.lit(0.65).alias("strength"))
    g = q.unionByName(p).join(sparse, "source_id").withColumn("end", F.least("end", "duration")).filter("end > start")
    w = Window.partitionBy("source_id").orderBy("chunk", "_k", "id")
    g = g.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 70).filter(F.col("_r") <= F.col("max_moments") - F.col("_n"))
    extra = g.select("source_id", "id", "start", "end", F.when(F.col("_k") == 0, "quote").otherwise("peak").alias("origin"))
    return moments.select("source_id", "id", "start", "end", F.lit("model").alias("origin")).unionByName(extra)


def decorate_plan(segs: DataFrame) -> DataFrame:
    """Plan rows from segments (source_id, arc_no, seg_no, role, text, score, visual): hook text, tokens, mean score, running id."""
    key = ["source_id", "arc_no"]
    g = segs.groupBy(*key).agg(
        F.min_by("text", F.struct(F.when(F.col("role") == "hook", 0).otherwise(1).alias("h"), "seg_no")).alias("_hook"),
        F.avg(F.col("score") * (0.6 + 0.4 * F.col("visual"))).alias("score"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(tokens(F.col("text")))))).alias("tokens"),
    )
    w = Window.partitionBy("source_id").orderBy(F.desc("score"), "arc_no")
    from cadenza.operators.ordered import row_index, running

    g = running(g.withColumn("_neg", -F.round("score", 9)), ["source_id"], ["_neg", "arc_no"], {"_r": row_index()})
    return g.select(*key, F.concat(F.lit("r"), F.col("_r").cast("string")).alias("plan_id"), trim_text(F.col("_hook"), 140).alias("hook"), "score", "tokens")
