"""Window, aggregate and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import rank as K
from cadenza.operators import series as S
from cadenza.operators import stats as A
from cadenza.operators.ordered import exact_percentile, lag, row_index, run_sum, running
from cadenza.plans.registry import CLIPS, DENSE, EVIDENCE, POINTS, SEGMENTS, VECTORS, WORDS, query
from cadenza.sources import tables as T

AGENTS = ("click", "error", "purchase", "signup", "view")


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def word_duration(w):
    return w.groupBy("source_id").agg(F.max("end").alias("duration"))


def clip_duration(c):
    return c.groupBy("source_id").agg(F.max("end").alias("duration"))


@query(
    "a1_transcript_stats",
    """SELECT source_id, count(*) AS n_words, max("end") AS duration, round(sum("end"-start), 6) AS speech_sec,
    round(count(*) / (max("end") / 60), 6) AS wpm,
    round(greatest(0, least(1, 1 - sum("end"-start) / max("end"))), 6) AS silence_ratio FROM words GROUP BY 1""",
    (WORDS,),
)
def _(spark, sf):
    return A.transcript_stats(T.words(spark, sf)).select("source_id", "n_words", "duration", *r6("speech_sec", "wpm", "silence_ratio"))


@query(
    "a2_speech_rate",
    """SELECT source_id, round(CASE WHEN speech > 0 THEN n / speech WHEN wsec > 0 THEN n / wsec WHEN dur > 0 THEN n / dur ELSE 0 END, 6) AS words_per_sec,
    round(greatest(0, least(1, exp(lp))), 6) AS confidence FROM (
      SELECT source_id, count(*) AS n, sum(CASE WHEN length(word) > 3 THEN "end" - start ELSE 0 END) AS speech,
        sum("end" - start) AS wsec, max("end") AS dur, avg(-0.01::DOUBLE * length(word)) AS lp FROM words GROUP BY 1)""",
    (WORDS,),
)
def _(spark, sf):
    w = T.words(spark, sf)
    d = F.col("end") - F.col("start")
    s = w.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.length("word") > 3, d).otherwise(0.0)).alias("speech"),
        F.sum(d).alias("wsec"),
        F.max("end").alias("dur"),
        F.avg(F.length("word") * F.lit(-0.01)).alias("lp"),
    )
    return A.speech_rate(s, "n", "speech", "wsec", "dur", "lp").select("source_id", *r6("words_per_sec", "confidence"))


@query(
    "a3_gap_distribution",
    """, g AS (SELECT source_id, start, "end", CASE WHEN d > 0 THEN d END AS g FROM (
        SELECT *, start - lag("end") OVER (PARTITION BY source_id ORDER BY start, id) AS d FROM evidence)),
      s AS (SELECT source_id, count(g) AS n, avg(g) AS m, stddev_pop(g) AS sd, max(g) AS mx, sum("end"-start) AS sp FROM g GROUP BY 1),
      k AS (SELECT g.source_id, avg(power(g.g - s.m, 4)) / power(any_value(s.sd), 4) - 3 AS k FROM g JOIN s USING (source_id) WHERE s.sd > 0 GROUP BY 1)
    SELECT source_id, n AS n_gaps, round(m, 3) AS mean_gap, round(sd, 3) AS gap_std, round(mx, 3) AS max_gap, round(sp, 3) AS speech_sec,
      round(CASE WHEN n >= 4 AND sd > 0 THEN (n-1)::DOUBLE / ((n-2)*(n-3)) * ((n+1) * k.k + 6) ELSE 0 END, 4) AS gap_kurtosis
    FROM s LEFT JOIN k USING (source_id)""",
    (EVIDENCE,),
)
def _(spark, sf):
    g = A.gap_distribution(T.evidence(spark, sf), ["source_id"], "start", "end", "id")
    return g.select(
        "source_id", "n_gaps", *[F.round(c, 3).alias(c) for c in ("mean_gap", "gap_std", "max_gap", "speech_sec")],
        F.round("gap_kurtosis", 4).alias("gap_kurtosis"),
    )


@query(
    "a4_interval_cv",
    """SELECT source_id, n AS n_points, round(s / m, 6) AS cv FROM (
      SELECT source_id, count(*) AS n, avg(d) AS m, stddev_pop(d) AS s FROM (
        SELECT source_id, t - lag(t) OVER (PARTITION BY source_id ORDER BY t, event_id) AS d FROM points) GROUP BY 1)
    WHERE n >= 3 AND m > 0""",
    (POINTS,),
)
def _(spark, sf):
    return A.interval_cv(T.points(spark, sf), ["source_id"], "t", "event_id").select("source_id", "n_points", *r6("cv"))


@query(
    "a5_coverage_summary",
    """, grid AS (SELECT source_id, unnest(range(max(chunk) + 1)) AS chunk FROM evidence GROUP BY 1),
      c AS (SELECT source_id, chunk, """
    + ", ".join(f"count(*) FILTER (agent = '{a}') AS n_{a}" for a in AGENTS)
    + """ FROM evidence GROUP BY 1, 2),
      st AS (SELECT source_id, chunk, string_agg(id::VARCHAR, ',' ORDER BY start, id) AS strong_ids FROM (
         SELECT *, row_number() OVER (PARTITION BY source_id, chunk ORDER BY start, id) AS k FROM evidence WHERE strength >= 0.1) WHERE k <= 2 GROUP BY 1, 2),
      th AS (SELECT source_id, chunk, count(*) AS n_themes, min(agent) AS first_theme FROM (
         SELECT source_id, chunk, agent FROM evidence GROUP BY 1, 2, 3 HAVING count(*) >= 3) GROUP BY 1, 2)
    SELECT source_id, chunk, """
    + ", ".join(f"coalesce(n_{a}, 0) AS n_{a}" for a in AGENTS)
    + """, coalesce(strong_ids, '') AS strong_ids, coalesce(n_themes, 0) AS n_themes, coalesce(first_theme, '') AS first_theme,
      c.chunk IS NULL AS is_gap
    FROM grid LEFT JOIN c USING (source_id, chunk) LEFT JOIN st USING (source_id, chunk) LEFT JOIN th USING (source_id, chunk)""",
    (EVIDENCE,),
)
def _(spark, sf):
    return A.coverage_summary(T.evidence(spark, sf), AGENTS, strong=0.1, themes_min=3, theme="agent")


@query(
    "a6_vote_aggregate",
    """, votes AS (SELECT source_id, j AS judge, id, start, "end", text, least(1, strength * (1 + j / 10.0::DOUBLE)) AS score
        FROM evidence, (SELECT unnest([1, 2, 3]) AS j) WHERE (id + j) % 4 <> 0),
      g AS (SELECT source_id, min(id) AS id, count(*) AS votes, median(score) AS median_score, min(start) AS start
        FROM votes GROUP BY source_id, round_even(start, 1), round_even("end", 1), left(lower(trim(text)), 50) HAVING count(*) >= 2)
    SELECT source_id, id, votes, round(median_score, 6) AS median_score, start, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY median_score DESC, id) AS rank FROM g) WHERE rank <= 60""",
    (EVIDENCE,),
)
def _(spark, sf):
    ev = T.evidence(spark, sf).withColumn("judge", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    votes = ev.filter((F.col("id") + F.col("judge")) % 4 != 0).withColumn(
        "score", F.least(F.lit(1.0), F.col("strength") * (1 + F.col("judge") / F.lit(10.0)))
    )
    out = A.vote_aggregate(votes, veto=2, cap=60)
    return out.select("source_id", "id", "votes", *r6("median_score"), "start", "rank")


@query(
    "a7_centroid",
    """SELECT source_id, i - 1 AS dim, round(avg(x), 6) AS mean FROM (
      SELECT source_id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM vectors) GROUP BY 1, 2""",
    (VECTORS,),
)
def _(spark, sf):
    from cadenza.functions.vector import centroid

    c = centroid(T.vectors(spark, sf), ["source_id"], "v", dim=64)
    return c.select("source_id", F.posexplode("centroid").alias("dim", "mean")).select(
        "source_id", F.col("dim").cast("long").alias("dim"), *r6("mean")
    )


@query(
    "a8_selection_stats",
    """SELECT s.source_id, n, min_duration, median_duration, max_duration, topics, round(n / (duration / 60), 6) AS per_minute FROM (
      SELECT source_id, count(*) AS n, min(d) AS min_duration, median(d) AS median_duration, max(d) AS max_duration, max("end") AS duration
      FROM (SELECT *, round("end" - start, 6) AS d FROM clips) GROUP BY 1) s
    JOIN (SELECT source_id, string_agg(topic || ':' || c, ',' ORDER BY c DESC, topic) AS topics FROM (
      SELECT source_id, topic, count(*) AS c FROM clips GROUP BY 1, 2) GROUP BY 1) USING (source_id)""",
    (CLIPS,),
)
def _(spark, sf):
    c = T.clips(spark, sf)
    o = A.selection_stats(c, clip_duration(c))
    return o.select("source_id", "n", "min_duration", "median_duration", "max_duration", "topics", *r6("per_minute"))


@query(
    "a9_run_rollups",
    """SELECT (event_id // 1000) AS run_id, round(avg(value), 6) AS mean_score, count(*) AS calls,
      count(*) FILTER (event_type = 'error') AS failed, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS tokens,
      count(DISTINCT event_type) AS agents FROM events GROUP BY 1""",
)
def _(spark, sf):
    e = T.table(spark, sf, "events")
    return e.groupBy(F.floor(F.col("event_id") / 1000).alias("run_id")).agg(
        F.round(F.avg("value"), 6).alias("mean_score"),
        F.count(F.lit(1)).alias("calls"),
        F.count(F.when(F.col("event_type") == "error", 1)).alias("failed"),
        F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"),
        F.countDistinct("event_type").alias("agents"),
    )


@query(
    "a10_context_risk",
    """, p AS (SELECT source_id, clip_id, clip_id // 400 AS plan_no, start, "end", (clip_id % 21 - 10) / 10.0::DOUBLE AS mood FROM dense),
      g AS (SELECT source_id, plan_no, abs(start - lag("end") OVER w) AS gap, abs(mood - lag(mood) OVER w) AS shift FROM p
            WINDOW w AS (PARTITION BY source_id, plan_no ORDER BY clip_id)),
      s AS (SELECT source_id, plan_no, count(*) AS n,
        coalesce(round_even(greatest(0, least(1, (max(gap) - 300) / 600)), 3), 0) AS r2,
        coalesce(round_even(greatest(0, least(1, (max(shift) - 0.5) / 0.8)), 3), 0) AS r3 FROM g GROUP BY 1, 2)
    SELECT source_id, plan_no, n AS n_segments, CASE WHEN n >= 2 THEN greatest(r2, r3) ELSE 0 END AS risk,
      CASE WHEN n >= 2 THEN concat_ws(',', CASE WHEN r2 > 0.3 THEN 'gap' END, CASE WHEN r3 > 0.3 THEN 'sentiment' END) ELSE '' END AS reasons FROM s""",
    (DENSE,),
)
def _(spark, sf):
    p = T.dense_clips(spark, sf).select(
        "source_id", "clip_id", F.floor(F.col("clip_id") / 400).alias("plan_no"), "start", "end",
        ((F.col("clip_id") % 21 - 10) / F.lit(10.0)).alias("mood"),
    )
    return A.context_risk(p, ["source_id", "plan_no"], ["clip_id"], "start", "end", None, "mood")


@query(
    "a10_context_risk_vectors",
    """, n AS (SELECT source_id, item_id, list_cosine_similarity(v, lag(v) OVER (PARTITION BY source_id ORDER BY item_id)) AS sim FROM vectors)
    SELECT source_id, n_segments, r AS risk, CASE WHEN r > 0.3 THEN 'semantic' ELSE '' END AS reasons FROM (
      SELECT source_id, count(*) AS n_segments, coalesce(round_even(greatest(0, least(1, (0.4 - min(sim)) / 0.4)), 3), 0) AS r FROM n GROUP BY 1)""",
    (VECTORS,),
)
def _(spark, sf):
    v = T.vectors(spark, sf).withColumns({"start": F.lit(0.0), "end": F.lit(0.0), "mood": F.lit(0.0)})
    return A.context_risk(v, ["source_id"], ["item_id"], "start", "end", "v", "mood")


@query(
    "a11_composite_score",
    """, x AS (SELECT clip_id, "end" - start AS d, (clip_id % 10) / 10.0::DOUBLE AS rh, CASE WHEN clip_id % 3 = 0 THEN NULL ELSE score / 10 END AS vis,
        clip_id % 2 = 0 AS book, (clip_id % 5) / 4.0::DOUBLE AS tr FROM clips),
      y AS (SELECT clip_id, d, 0.35::DOUBLE * (CASE WHEN d < 10 THEN 55 WHEN d < 20 THEN 78 WHEN d < 30 THEN 92 WHEN d <= 60 THEN 100 WHEN d <= 90 THEN 92 WHEN d <= 120 THEN 80 WHEN d <= 180 THEN 68 ELSE 55 END)
        + 0.25::DOUBLE * rh * 100 + 0.20::DOUBLE * coalesce(vis, 0.7::DOUBLE) * 100
        + 0.15::DOUBLE * least(1, 0.7::DOUBLE + CASE WHEN book THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN d BETWEEN 25 AND 75 THEN 0.1::DOUBLE ELSE 0 END) * 100
        + 0.05::DOUBLE * tr * 100 AS raw FROM x)
    SELECT clip_id, raw AS composite, CASE WHEN raw >= 85 THEN 'A' WHEN raw >= 70 THEN 'B' WHEN raw >= 55 THEN 'C' ELSE 'D' END AS grade
    FROM (SELECT clip_id, round(greatest(0, least(100, raw)), 4) AS raw FROM y)""",
    (CLIPS,),
)
def _(spark, sf):
    c = T.clips(spark, sf)
    i = F.col("clip_id")
    score = A.composite_score(
        F.col("end") - F.col("start"), (i % 10) / F.lit(10.0), F.when(i % 3 != 0, F.col("score") / 10), i % 2 == 0, (i % 5) / F.lit(4.0), digits=4,
    )
    return c.select("clip_id", score.alias("composite")).withColumn("grade", A.grade(F.col("composite")))


@query(
    "a12_monotone_runs",
    """, c AS (SELECT source_id, seg_idx, coalesce(speaker = lag(speaker) OVER w AND round("end" - start, 9) > 30, false) AS cont FROM seg2
        WINDOW w AS (PARTITION BY source_id ORDER BY seg_idx)),
      r AS (SELECT source_id, sum(CASE WHEN cont THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY seg_idx) AS run FROM c),
      n AS (SELECT source_id, run, count(*) - 1 AS k FROM r GROUP BY 1, 2)
    SELECT source_id, count(*) FILTER (k >= 1) AS issues, max(k) AS longest, round(greatest(0, 1 - count(*) FILTER (k >= 1) * 0.15::DOUBLE), 6) AS rhythm_score FROM n GROUP BY 1""",
    (SEGMENTS, """ seg2 AS (SELECT source_id, seg_idx, start, "end", CASE WHEN seg_idx % 4 = 3 THEN 'user' ELSE 'assistant' END AS speaker FROM segments)"""),
)
def _(spark, sf):
    s = T.segments(spark, sf).withColumn("speaker", F.when(F.col("seg_idx") % 4 == 3, "user").otherwise("assistant"))
    s = s.withColumn("end", F.col("start") + F.round(F.col("end") - F.col("start"), 9))
    return A.monotone_runs(s, need=1).select("source_id", "issues", "longest", *r6("rhythm_score"))


@query(
    "a13_episodes",
    """, d AS (SELECT source_id, max("end") AS duration, floor(max("end") / 600) + 1 AS n FROM dense GROUP BY 1 HAVING max("end") >= 1200),
      m AS (SELECT source_id, clip_id, start, score, topic, duration, duration / n AS len, least(n - 1, floor(start / (duration / n)))::BIGINT AS episode FROM dense JOIN d USING (source_id)),
      t AS (SELECT source_id, episode, string_agg(line, ' | ' ORDER BY k) AS summary FROM (
        SELECT source_id, episode, topic || ' ' || clip_id AS line, row_number() OVER (PARTITION BY source_id, episode ORDER BY score DESC, clip_id) AS k FROM m) WHERE k <= 3 GROUP BY 1, 2),
      h AS (SELECT source_id, episode, string_agg(topic, ',' ORDER BY s DESC, topic) AS themes FROM (
        SELECT source_id, episode, topic, max(score) AS s FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT source_id, episode, n_moments, ep_start, ep_end, summary, themes FROM (
      SELECT source_id, episode, count(*) AS n_moments, round(min(episode * len), 1) AS ep_start, round(min(least(duration, (episode + 1) * len)), 1) AS ep_end
      FROM m GROUP BY 1, 2) JOIN t USING (source_id, episode) JOIN h USING (source_id, episode)""",
    (DENSE,),
)
def _(spark, sf):
    c = T.dense_clips(spark, sf)
    m = c.select("source_id", F.col("clip_id").alias("id"), "start", F.col("score").alias("strength"), F.col("topic").alias("theme"),
                 F.concat_ws(" ", "topic", F.col("clip_id").cast("string")).alias("line"))
    return A.episodes(m, clip_duration(c))


@query(
    "a14_detection_ratio",
    """SELECT source, lang, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS yes_ratio,
      round(count(quality) / count(*)::DOUBLE, 6) AS presence FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""",
)
def _(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "source", "lang")
    j = d.join(T.table(spark, sf, "labels"), "doc_id", "left")
    return j.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)), 6).alias("yes_ratio"),
        F.round(F.count("quality") / F.count(F.lit(1)), 6).alias("presence"),
    )


ANSWERS_SQL = """ ans AS (SELECT user_id AS source_id, event_id // 3 AS frame, ['face_visible','well_framed','energetic'][1 + event_id % 3] AS question,
  CASE WHEN event_type IN ('click','purchase') THEN 'yes' WHEN event_type = 'error' THEN 'no' WHEN event_type = 'view' THEN 'yes' ELSE 'unknown' END AS answer FROM events)"""


def _answers(spark, sf, names=("face_visible", "well_framed", "energetic")):
    e = T.table(spark, sf, "events")
    k = F.col("event_id") % 3
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("source_id"),
        F.floor(F.col("event_id") / 3).alias("frame"),
        F.when(k == 0, names[0]).when(k == 1, names[1]).otherwise(names[2]).alias("question"),
        F.when(kind.isin("click", "purchase", "view"), "yes").when(kind == "error", "no").otherwise("unknown").alias("answer"),
    )


@query(
    "a15_question_score",
    """, s AS (SELECT frame, greatest(0, least(1, sum((CASE question WHEN 'face_visible' THEN 0.4 ELSE 0.3 END)::DOUBLE * (CASE answer WHEN 'yes' THEN 1 WHEN 'no' THEN 0 ELSE 0.5 END)))) AS score,
      string_agg(DISTINCT CASE WHEN answer = 'no' THEN CASE question WHEN 'face_visible' THEN 'face_off_screen' WHEN 'well_framed' THEN 'poor_framing' ELSE 'low_energy' END END, ',' ORDER BY CASE WHEN answer = 'no' THEN CASE question WHEN 'face_visible' THEN 'face_off_screen' WHEN 'well_framed' THEN 'poor_framing' ELSE 'low_energy' END END) AS fl,
      bool_or(answer = 'unknown') AS u FROM ans GROUP BY 1)
    SELECT frame, round(score, 6) AS score, coalesce(fl, CASE WHEN u THEN 'occluded' WHEN round(score, 9) >= 0.8 THEN 'visual_ok' ELSE '' END) AS flags FROM s""",
    (ANSWERS_SQL,),
)
def _(spark, sf):
    return A.question_score(_answers(spark, sf), ["frame"]).select("frame", *r6("score"), "flags")


@query(
    "a15_best_frame",
    """, s AS (SELECT source_id, frame, round(sum((CASE question WHEN 'face_visible' THEN 0.5 WHEN 'well_framed' THEN 0.3 ELSE 0.2 END)::DOUBLE * (CASE answer WHEN 'yes' THEN 1 WHEN 'no' THEN 0 ELSE 0.5 END)), 9) AS score FROM ans GROUP BY 1, 2)
    SELECT source_id, frame, score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, frame) AS k FROM s) WHERE k = 1""",
    (ANSWERS_SQL,),
)
def _(spark, sf):
    return A.best_frame(_answers(spark, sf, ("face_visible", "well_framed", "engaging")), ["source_id"], "frame")


@query(
    "a16_stage_durations",
    """SELECT source_id, kind AS stage, round(sum(coalesce(n - t, 0)), 4) AS seconds FROM (
      SELECT *, lead(t) OVER (PARTITION BY source_id ORDER BY t, event_id) AS n FROM points) GROUP BY 1, 2""",
    (POINTS,),
)
def _(spark, sf):
    p = T.points(spark, sf)
    return A.stage_durations(p, ["source_id"], "kind", "t", "event_id").select("source_id", F.col("kind").alias("stage"), F.round("seconds", 4).alias("seconds"))


SILENCE_SQL = """, sw AS (SELECT source_id, start, "end", lead(start) OVER w AS n, row_number() OVER w AS i, max("end") OVER (PARTITION BY source_id) + 1 AS duration FROM words
      WINDOW w AS (PARTITION BY source_id ORDER BY start, pos)),
   sil AS (SELECT source_id, "end" + 0.08::DOUBLE AS start, n - 0.08::DOUBLE AS "end" FROM sw WHERE round(n - "end", 9) >= 0.6 AND n - 0.08 > "end" + 0.08
     UNION ALL SELECT source_id, 0, greatest(0, start - 0.08::DOUBLE) FROM sw WHERE i = 1 AND start > 0.6
     UNION ALL SELECT source_id, least(duration, "end" + 0.08::DOUBLE), duration FROM sw WHERE n IS NULL AND round(duration - "end", 9) > 0.6)"""


def _silences(spark, sf):
    w = T.words(spark, sf)
    d = w.groupBy("source_id").agg((F.max("end") + 1).alias("duration"))
    return S.silence_ranges(w, d)


@query("w2_silence_ranges", SILENCE_SQL + """ SELECT source_id, round(start, 6) AS start, round("end", 6) AS "end" FROM sil""", (WORDS,))
def _(spark, sf):
    return _silences(spark, sf).select("source_id", *r6("start", "end"))


@query(
    "a17_edit_stats",
    SILENCE_SQL + """ SELECT source_id, 'silence' AS kind, count(*) AS n, round(sum("end" - start), 6) AS seconds, round(max("end" - start), 6) AS longest FROM sil GROUP BY 1""",
    (WORDS,),
)
def _(spark, sf):
    return A.edit_stats(_silences(spark, sf)).select("source_id", "kind", "n", *r6("seconds", "longest"))


@query(
    "a19_gate_stats",
    """SELECT source_id, count(*) FILTER (score >= 9) AS accepted, count(*) FILTER (score = 8) AS swapped, count(*) FILTER (score <= 5) AS rejected,
      count(*) FILTER (score IN (6, 7)) AS kept_low, round(avg(score), 6) AS mean_score, min(score) AS min_score FROM clips GROUP BY 1""",
    (CLIPS,),
)
def _(spark, sf):
    s = F.col("score")
    c = T.clips(spark, sf).withColumn("outcome", F.when(s >= 9, "accepted").when(s == 8, "swapped").when(s <= 5, "rejected").otherwise("kept_low"))
    return A.gate_stats(c, ["source_id"], "outcome", "score").withColumn("mean_score", F.round("mean_score", 6))


@query(
    "w3_invert_spans",
    """, d AS (SELECT source_id, max("end") + 30 AS duration FROM evidence GROUP BY 1),
      s AS (SELECT source_id, start, "end", coalesce(max("end") OVER (PARTITION BY source_id ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM evidence),
      l AS (SELECT source_id, max("end") AS e FROM evidence GROUP BY 1)
    SELECT source_id, round(seen, 6) AS gap_start, round(start, 6) AS gap_end FROM s WHERE start > seen + 0.001::DOUBLE
    UNION ALL SELECT source_id, round(e, 6), round(duration, 6) FROM d JOIN l USING (source_id) WHERE e < duration - 0.001::DOUBLE""",
    (EVIDENCE,),
)
def _(spark, sf):
    from cadenza.operators.intervals import gaps_between

    e = T.evidence(spark, sf)
    d = e.groupBy("source_id").agg((F.max("end") + 30).alias("duration"))
    return gaps_between(e, ["source_id"], "start", "end", id="id", duration=d).select("source_id", *r6("gap_start", "gap_end"))


@query(
    "w7_adjacent_similarity",
    """SELECT source_id, item_id, round(list_cosine_similarity(v, lead(v) OVER (PARTITION BY source_id ORDER BY item_id)), 6) AS sim FROM vectors""",
    (VECTORS,),
)
def _(spark, sf):
    return S.adjacent_similarity(T.vectors(spark, sf), ["source_id"], ["item_id"], "v").select("source_id", "item_id", *r6("sim"))


@query(
    "w9_boundary_candidates",
    """, n AS (SELECT source_id, item_id, row_number() OVER w AS rn, list_cosine_similarity(v, lead(v) OVER w) AS sim FROM vectors WINDOW w AS (PARTITION BY source_id ORDER BY item_id)),
      e AS (SELECT *, rn * 10.0::DOUBLE AS e, max(rn * 10.0::DOUBLE) OVER (PARTITION BY source_id) AS total, count(*) OVER (PARTITION BY source_id) AS c FROM n),
      s AS (SELECT *, coalesce(lag(sim) OVER w, 1) AS p, coalesce(lead(sim) OVER w, 1) AS q FROM e WHERE sim IS NOT NULL WINDOW w AS (PARTITION BY source_id ORDER BY item_id)),
      k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY sim, item_id) AS k FROM s WHERE c >= 3 AND sim < 0.35 AND sim <= p AND sim <= q AND e >= 15 AND e <= total - 15)
    SELECT source_id, item_id, round(sim, 6) AS sim, sim < 0.35 * 0.7 AS confident FROM k WHERE k <= 30""",
    (VECTORS,),
)
def _(spark, sf):
    v = running(T.vectors(spark, sf), ["source_id"], ["item_id"], {"_rn": row_index()}).withColumn("end", F.col("_rn") * F.lit(10.0))
    s = S.adjacent_similarity(v, ["source_id"], ["item_id"], "v").select("source_id", "item_id", "end", "sim")
    return S.boundary_candidates(s, ["source_id"], ["item_id"], end="end").select("source_id", "item_id", *r6("sim"), "confident")


PLAN_SQL = """ seg AS (SELECT source_id, plan_no, row_number() OVER (PARTITION BY source_id, plan_no ORDER BY b) AS seg_no, b AS seg_start, b + 7.5::DOUBLE AS seg_end FROM (
    SELECT source_id, pos // 250 AS plan_no, start AS b FROM words WHERE pos % 50 = 10))"""


def plan_segments(w):
    """Five spans per 250 words: a plan of word-anchored segments; bounded per plan."""
    from pyspark.sql import Window

    s = w.filter(F.col("pos") % 50 == 10).select("source_id", F.floor(F.col("pos") / 250).alias("plan_no"), F.col("start").alias("seg_start"))
    win = Window.partitionBy("source_id", "plan_no").orderBy("seg_start")
    return s.withColumns({"seg_no": F.row_number().over(win), "seg_end": F.col("seg_start") + 7.5})


@query(
    "w19_remap_to_plan_time",
    """, o AS (SELECT *, coalesce(sum(seg_end - seg_start) OVER (PARTITION BY source_id, plan_no ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM seg),
      j AS (SELECT o.source_id, plan_no, seg_no, pos, word, greatest(0, start - seg_start) + off AS local_start, least(seg_end, "end") - seg_start + off AS local_end,
        lead(1) OVER (PARTITION BY o.source_id, plan_no, seg_no ORDER BY start, pos) IS NULL AS is_last
        FROM o JOIN words w ON o.source_id = w.source_id AND w.start >= seg_start AND w.start < seg_end AND w."end" > seg_start)
    SELECT source_id, plan_no, seg_no, pos, word, round(local_start, 6) AS local_start, round(local_end, 6) AS local_end, is_last FROM j WHERE local_end > local_start""",
    (WORDS, PLAN_SQL),
)
def _(spark, sf):
    w = T.words(spark, sf)
    j = S.remap_to_plan_time(w, plan_segments(w), ["source_id", "plan_no"], width=8.0)
    return j.select("source_id", "plan_no", F.col("seg_no").cast("long").alias("seg_no"), "pos", "word", *r6("local_start", "local_end"), "is_last")


@query(
    "w24_window_gains",
    """SELECT source_id, win, n, round(greatest(-6, least(6, -16 - l)), 6) AS gain FROM (
      SELECT source_id, floor(t / 3600)::BIGINT AS win, avg(-value / 4) AS l, count(*) AS n FROM points GROUP BY 1, 2) WHERE l >= -70""",
    (POINTS,),
)
def _(spark, sf):
    p = T.points(spark, sf).withColumn("level", -F.col("value") / 4)
    return S.window_gains(p, ["source_id"], "t", "level", size=3600.0, digits=6)


@query(
    "w27b_truncate_running",
    """, c AS (SELECT source_id, chunk, clip_id, start, least("end" - start, 180) AS d FROM clips WHERE round("end" - start, 9) >= 0.25),
      u AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY source_id, chunk ORDER BY start, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c)
    SELECT source_id, clip_id, round(start, 6) AS start, round(start + least(d, 180 - used), 6) AS "end" FROM u WHERE round(180 - used, 9) > 0.1""",
    (CLIPS,),
)
def _(spark, sf):
    c = S.truncate_running(T.clips(spark, sf), ["source_id", "chunk"], ["start", "clip_id"], "start", "end", limit=180.0)
    return c.select("source_id", "clip_id", *r6("start", "end"))


@query(
    "w28_spread_words",
    r""", p AS (SELECT source_id, seg_idx, start, "end", list_filter(string_split_regex(trim(text, E' \n\t\r'), '[ \n\t\r]+'), lambda w: w <> '') AS w FROM segments),
      x AS (SELECT source_id, seg_idx, start, greatest(0.001::DOUBLE, "end" - start) / len(w) AS per, unnest(range(len(w))) AS word_no, unnest(w) AS word FROM p)
    SELECT source_id, seg_idx, word_no, word, start + word_no * per AS word_start, start + (word_no + 1) * per AS word_end FROM x""",
    (SEGMENTS,),
)
def _(spark, sf):
    s = S.spread_words(T.segments(spark, sf), "text", "start", "end", digits=None)
    return s.select("source_id", "seg_idx", F.col("word_no").cast("long").alias("word_no"), "word", "word_start", "word_end")


@query(
    "w29_evict_lru",
    """SELECT source, doc_id FROM (SELECT source, doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id % 17, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
      sum(n_chars) OVER (PARTITION BY source) AS t FROM documents) WHERE t - b > 20000""",
)
def _(spark, sf):
    d = T.table(spark, sf, "documents").select("source", "doc_id", "n_chars", (F.col("doc_id") % 17).alias("age"))
    return S.evict_lru(d, ["source"], "age", "n_chars", "doc_id", 20000).select("source", "doc_id")


@query(
    "w31_position_penalty",
    """SELECT clip_id, adjusted FROM (SELECT clip_id, start, round(CASE WHEN start - chunk * 86400 > 86400 * 0.4::DOUBLE THEN greatest(0, score / 10 - 0.1::DOUBLE) ELSE score / 10 END, 9) AS adjusted, chunk FROM clips)
    WHERE start <= chunk * 86400 + 86400 * 0.6::DOUBLE AND adjusted >= 0.5""",
    (CLIPS,),
)
def _(spark, sf):
    c = T.clips(spark, sf).withColumns(
        {"p_start": F.col("chunk") * F.lit(86400.0), "p_end": (F.col("chunk") + 1) * F.lit(86400.0), "score": F.col("score") / 10}
    )
    return S.position_penalty(c, "start", "score", "p_start", "p_end").select("clip_id", "adjusted")


@query(
    "w33_trigger_points",
    """SELECT source_id, start AS t, 1.25::DOUBLE AS factor FROM words WHERE lower(trim(trim(word), '.,!?;:…—"''«»()[]-')) IN ('die', 'the', 'this', 'le', 'el')
    UNION ALL SELECT source_id, start, 1.0 FROM words WHERE pos % 100 = 0""",
    (WORDS,),
)
def _(spark, sf):
    w = T.words(spark, sf)
    base = w.filter(F.col("pos") % 100 == 0).select("source_id", F.col("start").alias("t"), F.lit(1.0).alias("factor"))
    return S.trigger_points(w, base, ("die", "the", "this", "le", "el"))


@query(
    "k1_dynamic_caps",
    """, d AS (SELECT source_id, greatest(5, least(60, round_even(max("end") / 60 * 0.001, 0)))::INT AS cap FROM evidence GROUP BY 1)
    SELECT source_id, id, rank FROM (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY strength DESC, id) AS rank FROM evidence) JOIN d USING (source_id) WHERE rank <= cap""",
    (EVIDENCE,),
)
def _(spark, sf):
    e = T.evidence(spark, sf)
    d = e.groupBy("source_id").agg(F.max("end").alias("duration"))
    return K.dynamic_caps(e.select("source_id", "id", "strength"), d, per_minute=0.001, low=5, high=60).select("source_id", "id", "rank")


@query(
    "k1_rank_caps_by_duration",
    """SELECT source_id, greatest(60, least(300, round_even(greatest(0, dur / 60) * 2, 0)))::INT AS ranked_cap, greatest(80, least(400, round_even(greatest(0, dur / 60) * 2.5, 0)))::INT AS input_cap
    FROM (SELECT source_id, max("end") AS dur FROM words GROUP BY 1)""",
    (WORDS,),
)
def _(spark, sf):
    d = word_duration(T.words(spark, sf))
    return d.select("source_id", K.rank_cap(F.col("duration")).alias("ranked_cap"), K.rank_cap(F.col("duration"), 2.5, 80, 400).alias("input_cap"))


@query(
    "k2_topk_per_chunk",
    """SELECT source_id, clip_id, rank FROM (SELECT source_id, clip_id, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, clip_id) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY source_id, chunk ORDER BY score DESC, clip_id) AS a FROM clips) WHERE a <= 3) WHERE rank <= 40""",
    (CLIPS,),
)
def _(spark, sf):
    c = K.topk_then_topk(T.clips(spark, sf), ["source_id", "chunk"], ["source_id"], [F.desc("score"), F.col("clip_id")], 3, 40)
    return c.select("source_id", "clip_id", "rank")


@query(
    "k3_rank_diverse_by_topic",
    """, a AS (SELECT *, row_number() OVER (PARTITION BY source_id, left(trim(lower(topic)), 50) ORDER BY score DESC, clip_id) AS k FROM clips WHERE score >= 6),
      b AS (SELECT *, CASE WHEN k <= 2 AND score >= 7 THEN 1 ELSE 2 END AS pass_no FROM a WHERE k <= 3)
    SELECT source_id, clip_id, pass_no, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pass_no, score DESC, clip_id) AS rank FROM b) WHERE rank <= 12""",
    (CLIPS,),
)
def _(spark, sf):
    return K.rank_diverse_by_topic(T.clips(spark, sf), 12).select("source_id", "clip_id", "pass_no", "rank")


@query(
    "k6_top1_per_group",
    """SELECT source_id, chunk, clip_id, start, score FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chunk ORDER BY score DESC, clip_id) AS k FROM clips) WHERE k = 1""",
    (CLIPS,),
)
def _(spark, sf):
    return K.top1_per_group(T.clips(spark, sf), ["source_id", "chunk"], "score", "clip_id", ["clip_id", "start", "score"])


@query(
    "k11_target_counts",
    """, d AS (SELECT source_id, max("end") AS dur FROM words GROUP BY 1), t AS (SELECT source_id, dur, greatest(3, round_even(12 * dur / 1200, 0))::INT AS target, greatest(3, round_even(3 * dur / 1200, 0))::INT AS tol FROM d)
    SELECT source_id, target, greatest(1, target - tol) AS min_count, least(225, target + tol) AS max_count,
      greatest(3, least(60, round_even(dur / 60 / 2, 0)))::INT AS density_target FROM t""",
    (WORDS,),
)
def _(spark, sf):
    d = word_duration(T.words(spark, sf))
    dens = F.greatest(F.lit(3), F.least(F.lit(60), F.bround(F.col("duration") / 60 / 2).cast("int")))
    return d.withColumns(K.target_counts(F.col("duration"))).withColumn("density_target", dens).drop("duration")


@query(
    "k11_user_targets",
    """, u AS (SELECT c_custkey, 3 + (c_custkey % 223)::INT AS n FROM customer)
    SELECT c_custkey, n AS target, greatest(1, n - greatest(3, round_even(n * 0.10::DOUBLE, 0)::INT)) AS min_count, least(225, n + greatest(3, round_even(n * 0.10::DOUBLE, 0)::INT)) AS max_count FROM u""".replace(", u AS", "WITH u AS", 1),
)
def _(spark, sf):
    c = T.table(spark, sf, "customer").select("c_custkey", (3 + F.col("c_custkey") % 223).cast("int").alias("n"))
    return c.withColumns(K.user_target_counts(F.col("n"))).drop("n")


@query(
    "k15_due_queue",
    """SELECT o_orderkey AS assignment_id, strftime(o_orderdate, '%Y-%m-%d') AS scheduled_on FROM orders WHERE o_orderstatus = 'P' AND o_orderdate <= TIMESTAMP '1996-06-30' ORDER BY o_orderdate, o_orderkey LIMIT 50""",
)
def _(spark, sf):
    o = T.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("assignment_id"), F.col("o_orderdate").alias("scheduled_at"), F.when(F.col("o_orderstatus") == "P", "queued").otherwise("done").alias("status")
    )
    due = K.due_queue(o, F.lit("1996-06-30").cast("timestamp_ntz"))
    return due.select("assignment_id", F.date_format("scheduled_at", "yyyy-MM-dd").alias("scheduled_on"))


@query(
    "d10_distinct_text_keep_best",
    """SELECT source_id, id, strength FROM (SELECT *, row_number() OVER (PARTITION BY source_id, lower(trim(text)) ORDER BY strength DESC, id) AS k FROM evidence WHERE trim(text) <> '') WHERE k = 1""",
    (EVIDENCE,),
)
def _(spark, sf):
    return K.distinct_text_keep_best(T.evidence(spark, sf), ["source_id"], "text", "strength", "id", ["id", "strength"]).select("source_id", "id", "strength")


@query(
    "d11_dedup_by_content_hash",
    """SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id FROM documents""",
)
def _(spark, sf):
    from cadenza.operators.dedup import by_content_hash

    return by_content_hash(T.table(spark, sf, "documents"), "text", "doc_id")


@query(
    "p9_reweight_by_profile",
    """, w AS (SELECT source_id, id, strength, ['talking_head','fashion','travel','screencast','custom'][1 + source_id % 5] AS profile, agent IN ('view', 'click') AS vis FROM evidence)
    SELECT source_id, id, round(greatest(0, least(1, strength * (1 + (CASE profile WHEN 'talking_head' THEN CASE WHEN vis THEN 0.3 ELSE 0.7 END WHEN 'fashion' THEN CASE WHEN vis THEN 0.8 ELSE 0.2 END
      WHEN 'travel' THEN CASE WHEN vis THEN 0.7 ELSE 0.3 END ELSE 0.5 END - 0.5)::DOUBLE))), 6) AS score FROM w""",
    (EVIDENCE,),
)
def _(spark, sf):
    from cadenza.operators.rules import reweight_by_profile

    e = T.evidence(spark, sf).withColumn("profile", F.element_at(F.array(*map(F.lit, ("talking_head", "fashion", "travel", "screencast", "custom"))), (F.col("source_id") % 5 + 1).cast("int")))
    return reweight_by_profile(e, "profile", "strength", F.col("agent").isin("view", "click")).select("source_id", "id", F.round("strength", 6).alias("score"))


@query(
    "p10_enabled_agents",
    """, s AS (SELECT DISTINCT source_id, ['talking_head','fashion','travel','screencast','custom'][1 + source_id % 5] AS profile, source_id % 7 <> 0 AS vision FROM evidence),
      a AS (SELECT unnest(['hook_hunter','theme_finder','humor_specialist','emotion_reader','quote_miner','story_tracker']) AS agent)
    SELECT source_id, agent FROM s, a WHERE NOT vision OR NOT ((profile IN ('fashion', 'travel') AND agent IN ('theme_finder', 'quote_miner', 'story_tracker')) OR (profile = 'screencast' AND agent = 'humor_specialist'))""",
    (EVIDENCE,),
)
def _(spark, sf):
    from cadenza.operators.rules import enabled_agents

    e = T.evidence(spark, sf).select("source_id").distinct()
    e = e.withColumns({"profile": F.element_at(F.array(*map(F.lit, ("talking_head", "fashion", "travel", "screencast", "custom"))), (F.col("source_id") % 5 + 1).cast("int")), "vision": F.col("source_id") % 7 != 0})
    return enabled_agents(e, "profile", "vision").select("source_id", "agent")


@query(
    "p13_filter_hidden",
    """SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k')::INT < 50 ORDER BY ts DESC, event_id LIMIT 200""",
)
def _(spark, sf):
    e = T.table(spark, sf, "events")
    return e.filter(F.get_json_object("props", "$.k").cast("int") < 50).orderBy(F.desc("ts"), "event_id").limit(200).select("event_id", "user_id")


@query(
    "p16_plan_length_gate",
    """, c AS (SELECT source_id, chunk, clip_id, start, least("end" - start, 180) AS d FROM clips WHERE round("end" - start, 9) >= 0.25),
      t AS (SELECT source_id, chunk FROM c GROUP BY 1, 2 HAVING sum(d) >= 60),
      u AS (SELECT c.*, coalesce(sum(d) OVER (PARTITION BY source_id, chunk ORDER BY start, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c JOIN t USING (source_id, chunk))
    SELECT source_id, chunk, clip_id, round(start, 6) AS start, round(start + least(d, 180 - used), 6) AS "end" FROM u WHERE round(180 - used, 9) > 0.1""",
    (CLIPS,),
)
def _(spark, sf):
    from cadenza.operators.plan_ops import plan_length_gate

    g = plan_length_gate(T.clips(spark, sf), ["source_id", "chunk"], ["start", "clip_id"], "start", "end", low=60.0, high=180.0)
    return g.select("source_id", "chunk", "clip_id", *r6("start", "end"))


@query(
    "p17_text_sections",
    """SELECT doc_id, length(text) > 3000 AS omitted, md5(CASE WHEN length(text) > 3000 THEN left(text, 1500) ELSE text END) AS first_md5,
      md5(CASE WHEN length(text) > 3000 THEN right(text, 1000) ELSE '' END) AS last_md5 FROM documents""",
)
def _(spark, sf):
    d = S.text_sections(T.table(spark, sf, "documents").select("doc_id", "text"), "text", whole=3000, head=1500, tail=1000)
    return d.select("doc_id", "omitted", F.md5("first_section").alias("first_md5"), F.md5("last_section").alias("last_md5"))


@query(
    "j12_liked_items",
    """SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'HOUSEHOLD' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""",
)
def _(spark, sf):
    o = T.table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    c = T.table(spark, sf, "customer").filter(F.col("c_mktsegment") == "HOUSEHOLD")
    return o.join(c, o.o_custkey == c.c_custkey).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "c_custkey")


@query(
    "j13_project_detail",
    """SELECT c_custkey, n_name, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0) AS total, coalesce(max(strftime(o_orderdate, '%Y-%m-%d')), '') AS last_order
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def _(spark, sf):
    from cadenza.operators.plan_ops import with_children

    c = T.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = T.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = T.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    d = with_children(
        c, o, "c_custkey",
        {"n_orders": F.count("o_orderkey"), "total": F.round(F.sum("o_totalprice"), 2), "last_order": F.max(F.date_format("o_orderdate", "yyyy-MM-dd"))},
    )
    return d.fillna({"n_orders": 0, "total": 0.0, "last_order": ""}).join(n, "c_nationkey", "left").select("c_custkey", "n_name", "n_orders", "total", "last_order")


@query(
    "j13_three_references",
    """WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS intro, c_custkey % 40 AS outro, c_nationkey + 1 AS companion FROM customer)
    SELECT c_custkey, a.n_name AS intro_name, b.n_name AS outro_name, b.n_regionkey AS outro_region, c.n_name AS companion_name
    FROM p LEFT JOIN nation a ON a.n_nationkey = intro LEFT JOIN nation b ON b.n_nationkey = outro LEFT JOIN nation c ON c.n_nationkey = companion""",
)
def _(spark, sf):
    from cadenza.operators.plan_ops import with_references

    k, n = F.col("c_custkey"), F.col("c_nationkey")
    p = T.table(spark, sf, "customer").select("c_custkey", F.when(k % 4 > 0, n).alias("intro_id"), (k % 40).alias("outro_id"), (n + 1).alias("companion_id"))
    r = with_references(p, T.table(spark, sf, "nation"), "n_nationkey", {"intro": "intro_id", "outro": "outro_id", "companion": "companion_id"}, ["n_name", "n_regionkey"])
    return r.select("c_custkey", F.col("intro.n_name").alias("intro_name"), F.col("outro.n_name").alias("outro_name"), F.col("outro.n_regionkey").alias("outro_region"), F.col("companion.n_name").alias("companion_name"))


@query(
    "j14_task_grid",
    """, c AS (SELECT DISTINCT source_id, chunk FROM evidence), a AS (SELECT unnest(['hook', 'theme', 'humor']) AS agent), s AS (SELECT unnest([0.7, 1.5]::DOUBLE[]) AS scale)
    SELECT source_id, chunk, agent, scale FROM c, a, s""",
    (EVIDENCE,),
)
def _(spark, sf):
    from cadenza.operators.plan_ops import task_grid

    return task_grid(T.evidence(spark, sf).select("source_id", "chunk").distinct(), agent=["hook", "theme", "humor"], scale=[0.7, 1.5])
