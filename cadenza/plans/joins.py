"""Interval, nearest-match and cut-editing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import edit as E
from cadenza.operators import intervals as I
from cadenza.operators import stats as A
from cadenza.operators.ordered import row_index, running
from cadenza.plans.registry import CLIPS, DENSE, EVIDENCE, POINTS, SEGMENTS, WORDS, query
from cadenza.plans.windows import clip_duration, r6, word_duration
from cadenza.sources import tables as T

SPANS = """ spans AS (SELECT source_id, pos AS span_id, round(start - 0.25::DOUBLE, 3) AS b, round(start + 5.9::DOUBLE, 3) AS e FROM words WHERE pos % 40 = 7)"""


def spans(w, every=40, at=7, before=0.25, after=5.9):
    return w.filter(F.col("pos") % every == at).select(
        "source_id", F.col("pos").alias("span_id"), F.round(F.col("start") - before, 3).alias("b"), F.round(F.col("start") + after, 3).alias("e")
    )


@query(
    "j1_words_in_interval",
    """SELECT s.source_id, span_id, coalesce(string_agg(word, ' ' ORDER BY pos), '') AS text FROM spans s LEFT JOIN words w
    ON s.source_id = w.source_id AND w.start >= b AND w.start < e GROUP BY 1, 2""",
    (WORDS, SPANS),
)
def _(spark, sf):
    w = T.words(spark, sf)
    return I.words_text(w, spans(w), ["source_id", "span_id"], ("b", "e"), width=8.0).select("source_id", "span_id", "text")


@query(
    "j1_words_inside_or_label",
    """, j AS (SELECT s.source_id, span_id, string_agg(word, ' ' ORDER BY pos) FILTER (w.start >= b AND w."end" <= e2) AS a, string_agg(word, ' ' ORDER BY pos) FILTER (w.start < e2 AND w."end" > b) AS o
      FROM (SELECT *, CASE WHEN span_id % 3 = 0 THEN b + 0.35::DOUBLE ELSE e END AS e2 FROM spans) s LEFT JOIN words w ON s.source_id = w.source_id AND w.start <= e2 AND w."end" >= b GROUP BY 1, 2)
    SELECT source_id, span_id, coalesce(a, o, 'span ' || span_id) AS text FROM j""",
    (WORDS, SPANS),
)
def _(spark, sf):
    w = T.words(spark, sf)
    s = spans(w).withColumn("e", F.when(F.col("span_id") % 3 == 0, F.col("b") + 0.35).otherwise(F.col("e")))
    s = s.withColumn("label", F.concat(F.lit("span "), F.col("span_id").cast("string")))
    return I.words_text(w, s, ["source_id", "span_id"], ("b", "e"), mode="inside", label="label", width=8.0).select("source_id", "span_id", "text")


MOMENTS = """ moments AS (SELECT source_id, clip_id AS moment_id, start AS m_start, "end" AS m_end FROM dense WHERE score = 10),
 evd AS (SELECT source_id, clip_id AS id, start, "end", strength FROM (SELECT *, score / 10 AS strength FROM dense) WHERE score < 10)"""


def moments(spark, sf):
    d = T.dense_clips(spark, sf)
    m = d.filter("score = 10").select("source_id", F.col("clip_id").alias("moment_id"), F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    e = d.filter("score < 10").select("source_id", F.col("clip_id").alias("id"), "start", "end", (F.col("score") / 10).alias("strength"))
    return m, e


@query(
    "j2_evidence_near",
    """, j AS (SELECT m.source_id, moment_id, id, (e.start < m_end + 30 AND e."end" > greatest(0, m_start - 30)) AS near FROM moments m JOIN evd e ON m.source_id = e.source_id AND e.start < m_end + 120 AND e."end" > greatest(0, m_start - 120)),
      n AS (SELECT source_id, moment_id, count(*) FILTER (near) AS k, count(*) AS n FROM j GROUP BY 1, 2)
    SELECT source_id, moment_id, id, CASE WHEN k < 3 THEN 120.0::DOUBLE ELSE 30 END AS used_window FROM j JOIN n USING (source_id, moment_id) WHERE (near OR k < 3) AND CASE WHEN k < 3 THEN n ELSE k END >= 2""",
    (DENSE, MOMENTS),
)
def _(spark, sf):
    m, e = moments(spark, sf)
    return I.evidence_near(m, e, window=30.0, fallback=120.0, min_n=3, width=300.0).select("source_id", "moment_id", "id", "used_window")


@query(
    "j3_best_overlap",
    """, j AS (SELECT m.source_id, moment_id, id, round((least(m_end, e."end") - greatest(m_start, e.start)) / greatest(0.001, m_end - m_start), 9) AS r FROM moments m JOIN evd e ON m.source_id = e.source_id AND e.start < m_end AND m_start < e."end"),
      k AS (SELECT *, row_number() OVER (PARTITION BY source_id, moment_id ORDER BY r DESC, id) AS k FROM j WHERE r >= 0.5)
    SELECT m.source_id, m.moment_id, round(r, 6) AS overlap, id AS best_id FROM moments m LEFT JOIN (SELECT * FROM k WHERE k = 1) USING (source_id, moment_id)""",
    (DENSE, MOMENTS),
)
def _(spark, sf):
    m, e = moments(spark, sf)
    b = I.best_overlap(m, e, ["source_id", "moment_id"], ("m_start", "m_end"), ("start", "end"), take={"best_id": "id"}, rid="id", width=90.0, min_ratio=0.5)
    return b.select("source_id", "moment_id", *r6("overlap"), "best_id")


@query(
    "j3b_parent_by_midpoint",
    """, j AS (SELECT m.source_id, moment_id, id FROM moments m JOIN evd e ON m.source_id = e.source_id AND (m_start + m_end) / 2 BETWEEN e.start - 0.05::DOUBLE AND e."end" + 0.05::DOUBLE)
    SELECT m.source_id, m.moment_id, coalesce(min(id), -1) AS parent FROM moments m LEFT JOIN j USING (source_id, moment_id) GROUP BY 1, 2""",
    (DENSE, MOMENTS),
)
def _(spark, sf):
    m, e = moments(spark, sf)
    p = e.withColumn("parent", F.col("id"))
    return I.parent_by_midpoint(m, p, ["source_id", "moment_id"], ("m_start", "m_end"), ("start", "end"), idx="id", take="parent", default=-1, width=90.0).select("source_id", "moment_id", "parent")


CUTS = """ cuts AS (SELECT source_id, pos AS cut_id, round(start + 0.021::DOUBLE * (pos % 5 - 2), 3) AS c_start, round(start + 7.3::DOUBLE + 0.017::DOUBLE * (pos % 7 - 3), 3) AS c_end FROM words WHERE pos % 50 = 3)"""
# the same, computed once: read by several branches each
WORDS_ONCE = WORDS.replace("\nwords AS (", "\nwords AS MATERIALIZED (")
CUTS_ONCE = CUTS.replace(" cuts AS (", " cuts AS MATERIALIZED (")


def cuts(w):
    p = F.col("pos")
    return w.filter(p % 50 == 3).select(
        "source_id", p.alias("cut_id"), F.round(F.col("start") + F.lit(0.021) * (p % 5 - 2), 3).alias("c_start"),
        F.round(F.col("start") + F.lit(7.3) + F.lit(0.017) * (p % 7 - 3), 3).alias("c_end"),
    )


SNAPPED = """, ws AS MATERIALIZED (SELECT source_id, start, "end", floor(start)::BIGINT AS sb, floor("end")::BIGINT AS eb FROM words),
      cs AS MATERIALIZED (SELECT *, unnest(list_distinct([floor(c_start - 0.04)::BIGINT, floor(c_start + 0.04)::BIGINT])) AS sb FROM cuts),
      ce AS MATERIALIZED (SELECT *, unnest(list_distinct([floor(c_end - 0.04)::BIGINT, floor(c_end + 0.04)::BIGINT])) AS eb FROM cuts),
      s AS (SELECT c.source_id, cut_id, min_by(w.start, (round(abs(w.start - c_start), 9), w.start)) AS s FROM cs c JOIN ws w ON c.source_id = w.source_id AND c.sb = w.sb WHERE round(abs(w.start - c_start), 9) <= 0.03 GROUP BY 1, 2),
      e AS (SELECT c.source_id, cut_id, min_by(w."end", (round(abs(w."end" - c_end), 9), w."end")) AS e FROM ce c JOIN ws w ON c.source_id = w.source_id AND c.eb = w.eb WHERE round(abs(w."end" - c_end), 9) <= 0.03 GROUP BY 1, 2),
      moved AS (SELECT source_id, cut_id, CASE WHEN ok THEN a ELSE c_start END AS new_start, CASE WHEN ok THEN b ELSE c_end END AS new_end FROM (
      SELECT c.*, coalesce(s, c_start) AS a, coalesce(e, c_end) AS b, round(coalesce(e, c_end) - coalesce(s, c_start), 9) > 0.1 AS ok FROM cuts c LEFT JOIN s USING (source_id, cut_id) LEFT JOIN e USING (source_id, cut_id)))"""


@query(
    "j4_snap_cuts_to_words",
    SNAPPED + " SELECT source_id, cut_id, new_start, new_end FROM moved",
    (WORDS_ONCE, CUTS_ONCE),
)
def _(spark, sf):
    w = T.words(spark, sf)
    return E.snap_cuts(cuts(w), w, ["source_id", "cut_id"], tol=0.030000001).select("source_id", "cut_id", "new_start", "new_end")


# a beat near the start of every third word
BEATS = """ beats AS MATERIALIZED (SELECT source_id, round(start + 0.013::DOUBLE * (pos % 11), 3) AS t FROM words WHERE pos % 3 = 0)"""


def _beat_sql(edge: str) -> str:
    return f""" {edge}p AS (SELECT c.source_id, cut_id, b.t FROM cuts c ASOF JOIN beats b ON c.source_id = b.source_id AND c.c_{edge} >= b.t),
      {edge}n AS (SELECT c.source_id, cut_id, b.t FROM cuts c ASOF JOIN beats b ON c.source_id = b.source_id AND c.c_{edge} <= b.t)"""


def _near(edge: str) -> str:
    p, n, x = f"{edge}p.t", f"{edge}n.t", f"c_{edge}"
    return f"CASE WHEN {x} - {p} <= 0.150000001 AND ({n} IS NULL OR {x} - {p} <= {n} - {x}) THEN {p} WHEN {n} - {x} <= 0.150000001 THEN {n} ELSE {x} END"


BEAT_SNAPS = (
    WORDS_ONCE, CUTS_ONCE, BEATS, _beat_sql("start"), _beat_sql("end"),
    f""" snaps AS (SELECT *, ne - ns < greatest(0.1, (c_end - c_start) * 0.1) - 5e-10 AS back FROM (SELECT c.*, {_near('start')} AS ns, {_near('end')} AS ne FROM cuts c
      LEFT JOIN startp USING (source_id, cut_id) LEFT JOIN startn USING (source_id, cut_id) LEFT JOIN endp USING (source_id, cut_id) LEFT JOIN endn USING (source_id, cut_id)))""",
)


def beat_snaps(spark, sf):
    w = T.words(spark, sf)
    beats = w.filter(F.col("pos") % 3 == 0).select("source_id", F.round(F.col("start") + F.lit(0.013) * (F.col("pos") % 11), 3).alias("t"))
    # every seventh cut is so short that moving its edges apart or together leaves too little
    c = cuts(w).withColumn("c_end", F.when(F.col("cut_id") % 350 == 3, F.round(F.col("c_start") + 0.22, 3)).otherwise(F.col("c_end")))
    return E.snap_to_beats(c, beats, ["source_id", "cut_id"]), beats


_SHORT_CUTS = [x.replace(" cuts AS MATERIALIZED (SELECT", " cuts0 AS (SELECT") + ", cuts AS MATERIALIZED (SELECT source_id, cut_id, c_start, CASE WHEN cut_id % 350 = 3 THEN round(c_start + 0.22::DOUBLE, 3) ELSE c_end END AS c_end FROM cuts0)" if x is CUTS_ONCE else x for x in BEAT_SNAPS]


@query("j4_snap_to_beats", """SELECT source_id, cut_id, CASE WHEN back OR ns = c_start THEN c_start ELSE round(ns, 3) END AS new_start, CASE WHEN back OR ne = c_end THEN c_end ELSE round(ne, 3) END AS new_end, back AS kept_back FROM snaps""", tuple(_SHORT_CUTS))
def _(spark, sf):
    return beat_snaps(spark, sf)[0].select("source_id", "cut_id", "new_start", "new_end", "kept_back")


@query(
    "j4_beat_snap_stats",
    """SELECT source_id, count(*) FILTER (ns <> c_start) AS snapped_starts, count(*) FILTER (ne <> c_end) AS snapped_ends, any_value(n) AS total_beats, round(max(greatest(abs(ns - c_start), abs(ne - c_end))), 3) AS max_shift
    FROM snaps JOIN (SELECT source_id, count(*) AS n FROM beats GROUP BY 1) USING (source_id) GROUP BY 1""",
    tuple(_SHORT_CUTS),
)
def _(spark, sf):
    s, beats = beat_snaps(spark, sf)
    return E.beat_snap_stats(s, beats)


@query(
    "j4_nearest_event",
    """, a AS (SELECT * FROM points WHERE kind = 'purchase'), p AS (SELECT * FROM points WHERE kind = 'signup'),
      j AS (SELECT p.source_id, p.event_id, a.t, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(a.t - p.t), a.t) AS k FROM p JOIN a ON a.source_id = p.source_id AND abs(a.t - p.t) <= 20000)
    SELECT p.source_id, p.event_id, round(j.t, 3) AS nearest FROM p LEFT JOIN (SELECT * FROM j WHERE k = 1) j USING (event_id)""",
    (POINTS,),
)
def _(spark, sf):
    p = T.points(spark, sf)
    n = I.nearest_within(p.filter("kind = 'signup'"), p.filter("kind = 'purchase'"), ["source_id"], "t", "t", 20000.0, id="event_id", out="nearest")
    return n.select("source_id", "event_id", F.round("nearest", 3).alias("nearest"))


FLAGS = r""" flags AS (SELECT source_id, pos, start, "end", coalesce(regexp_matches(trim(lag(word) OVER w), '[.!?…]$'), true) OR coalesce(round(start - lag("end") OVER w, 9) >= 0.8, true) AS opens,
   regexp_matches(trim(word), '[.!?…]$') OR coalesce(round(lead(start) OVER w - "end", 9) >= 0.8, false) AS closes FROM words WINDOW w AS (PARTITION BY source_id ORDER BY start, pos))"""


@query(
    "a17_snap_stats",
    SNAPPED + """ SELECT source_id, 2 * count(*) AS total_boundaries, count(*) FILTER (a > 1e-4) AS snapped_starts, count(*) FILTER (b > 1e-4) AS snapped_ends,
      round(max(greatest(CASE WHEN a > 1e-4 THEN a ELSE 0 END, CASE WHEN b > 1e-4 THEN b ELSE 0 END)), 3)::DOUBLE AS max_shift FROM (SELECT source_id, abs(new_start - c_start) AS a, abs(new_end - c_end) AS b FROM moved JOIN cuts USING (source_id, cut_id)) GROUP BY 1""",
    (WORDS_ONCE, CUTS_ONCE),
)
def _(spark, sf):
    w = T.words(spark, sf)
    return A.snap_stats(E.snap_cuts(cuts(w), w, ["source_id", "cut_id"], tol=0.030000001))


TO_SENTENCE = r""", fs AS MATERIALIZED (SELECT *, floor(start / 2)::BIGINT AS sb, floor("end" / 2)::BIGINT AS eb FROM flags),
      cs AS MATERIALIZED (SELECT *, unnest(range(floor((c_start - 2) / 2)::BIGINT, floor((c_start + 2) / 2)::BIGINT + 1)) AS sb FROM cuts),
      ce AS MATERIALIZED (SELECT *, unnest(range(floor((c_end - 2) / 2)::BIGINT, floor((c_end + 2) / 2)::BIGINT + 1)) AS eb FROM cuts),
      s AS (SELECT c.source_id, cut_id, min_by(f.start, (round(abs(f.start - c_start) - CASE WHEN opens THEN 0.5 ELSE 0 END, 9), pos)) AS s FROM cs c JOIN fs f ON c.source_id = f.source_id AND c.sb = f.sb WHERE f.start BETWEEN c_start - 2.0::DOUBLE AND c_start + 2.0::DOUBLE GROUP BY 1, 2),
      e AS (SELECT c.source_id, cut_id, min_by(f."end", (round(abs(f."end" - c_end) - CASE WHEN closes THEN 0.5 ELSE 0 END, 9), pos)) AS e FROM ce c JOIN fs f ON c.source_id = f.source_id AND c.eb = f.eb WHERE f."end" BETWEEN c_end - 2.0::DOUBLE AND c_end + 2.0::DOUBLE GROUP BY 1, 2),
      snapped AS (SELECT source_id, cut_id, CASE WHEN ok THEN a ELSE c_start END AS snap_start, CASE WHEN ok THEN b ELSE c_end END AS snap_end FROM (
      SELECT c.*, coalesce(s, c_start) AS a, coalesce(e, c_end) AS b, round(coalesce(e, c_end) - coalesce(s, c_start), 9) > 0.5 AS ok FROM cuts c LEFT JOIN s USING (source_id, cut_id) LEFT JOIN e USING (source_id, cut_id)))"""


@query(
    "j5_snap_to_sentence",
    TO_SENTENCE + " SELECT source_id, cut_id, snap_start, snap_end FROM snapped",
    (WORDS_ONCE, CUTS_ONCE, FLAGS.replace(" flags AS (", " flags AS MATERIALIZED (")),
)
def _(spark, sf):
    w = T.words(spark, sf)
    return E.snap_to_sentence(cuts(w), w, ["source_id", "cut_id"], ("c_start", "c_end")).select("source_id", "cut_id", "snap_start", "snap_end")


# plans of three spans each over the words of a document; spans lie close enough to meet when they grow
GROWN = """ segs AS MATERIALIZED (SELECT source_id, pos // 120 AS plan_no, row_number() OVER (PARTITION BY source_id, pos // 120 ORDER BY pos) - 1 AS seg_no, round(start + 0.02::DOUBLE * (pos % 5), 3) AS os, round(start + 9 + pos % 13, 3) AS oe FROM words WHERE pos % 40 = 5),
  dur AS (SELECT source_id, max("end") AS d FROM words GROUP BY 1),
  ext AS MATERIALIZED (SELECT *, CASE WHEN round(tot, 9) >= 25 AND round(tot, 9) < 62 THEN least(15, (62 - tot) / n) ELSE 0 END AS gr FROM (SELECT segs.*, d, sum(oe - os) OVER w AS tot, count(*) OVER w AS n FROM segs JOIN dur USING (source_id) WINDOW w AS (PARTITION BY source_id, plan_no))),
  cuts AS MATERIALIZED (SELECT source_id, plan_no * 10 + seg_no AS cut_id, greatest(0, os - gr / 2) AS c_start, least(d, oe + gr / 2) AS c_end FROM ext WHERE gr > 0)"""


@query(
    "p15_extend_and_finish",
    TO_SENTENCE + """,
      done AS (SELECT ext.source_id, plan_no, seg_no, CASE WHEN gr > 0 AND least(d, snap_end) > greatest(0, snap_start) THEN greatest(0, snap_start) ELSE os END AS s, CASE WHEN gr > 0 AND least(d, snap_end) > greatest(0, snap_start) THEN least(d, snap_end) ELSE oe END AS e
        FROM ext LEFT JOIN snapped ON snapped.source_id = ext.source_id AND cut_id = plan_no * 10 + seg_no),
      walk AS (SELECT source_id, plan_no, seg_no, s, e, true AS keep, [{'s': s, 'e': e}] AS acc FROM done WHERE seg_no = 0
        UNION ALL SELECT source_id, plan_no, seg_no, s, e, ok, CASE WHEN ok THEN list_append(acc, {'s': s, 'e': e}) ELSE acc END FROM (
          SELECT r.*, w.acc, len(list_filter(w.acc, lambda a: round(greatest(0, least(a.e, r.e) - greatest(a.s, r.s)) / greatest(0.000001, r.e - r.s) - 0.6, 9) >= 0)) = 0 AS ok
          FROM walk w JOIN done r ON r.source_id = w.source_id AND r.plan_no = w.plan_no AND r.seg_no = w.seg_no + 1))
    SELECT source_id, plan_no, seg_no, round(s, 6) AS s, round(e, 6) AS e FROM walk WHERE keep QUALIFY round(sum(e - s) OVER (PARTITION BY source_id, plan_no), 9) BETWEEN 24.95 AND 80.05""",
    (WORDS_ONCE, GROWN, FLAGS.replace(" flags AS (", " flags AS MATERIALIZED (")),
    recursive=True,
)
def _(spark, sf):
    w = T.words(spark, sf)
    pos = F.col("pos")
    seg = F.struct("pos", F.round(F.col("start") + F.lit(0.02) * (pos % 5), 3).alias("s"), F.round(F.col("start") + 9 + pos % 13, 3).alias("e"))
    p = w.filter(pos % 40 == 5).groupBy("source_id", F.floor(pos / 120).alias("plan_no")).agg(F.sort_array(F.collect_list(seg)).alias("_s"))
    p = p.withColumn("segs", F.transform("_s", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))).drop("_s")
    d = w.groupBy("source_id").agg(F.max("end").alias("duration_total"))
    out = E.extend_and_finish(p.join(d, "source_id"), w, target=62.0, low=25.0, high=80.0)
    return out.select("source_id", "plan_no", F.col("seg_no").cast("long").alias("seg_no"), *r6("s", "e"))


@query(
    "j6_next_prev_sentence_end",
    r""", se AS (SELECT source_id, "end" AS s_end FROM words WHERE regexp_matches(trim(word), '[.!?…]$'))
    SELECT c.source_id, cut_id, min(s_end) FILTER (round(s_end - c_end, 9) > 0 AND round(s_end - c_end, 9) <= 30) AS next_end, max(s_end) FILTER (round(c_end - s_end, 9) >= 0.1 AND round(c_end - s_end, 9) <= 10) AS prev_end
    FROM cuts c LEFT JOIN se ON c.source_id = se.source_id AND s_end BETWEEN c_end - 11 AND c_end + 31 GROUP BY 1, 2""",
    (WORDS, CUTS),
)
def _(spark, sf):
    w = T.words(spark, sf)
    return E.next_prev_sentence_end(cuts(w), w, "c_end", "cut_id", ahead=30.0, back=10.0).select("source_id", "cut_id", "next_end", "prev_end")


@query(
    "j7_interpolate_at",
    """, s0 AS (SELECT source_id, t, CASE WHEN event_id % 5 > 1 THEN value END AS v FROM points WHERE kind <> 'signup'),
      s AS (SELECT *, coalesce(lag(v) OVER w, lead(v) OVER w, lag(v, 2) OVER w, lead(v, 2) OVER w) AS near FROM s0 WINDOW w AS (PARTITION BY source_id ORDER BY t)),
      p AS (SELECT source_id, event_id, t FROM points WHERE kind = 'signup'),
      b AS (SELECT p.*, s.t AS bt, s.v AS bv, s.near AS bn FROM p ASOF LEFT JOIN s ON p.source_id = s.source_id AND p.t >= s.t),
      f AS (SELECT b.*, s.t AS ft, s.v AS fv, s.near AS fn FROM b ASOF LEFT JOIN s ON b.source_id = s.source_id AND b.t < s.t)
    SELECT source_id, event_id, round(CASE WHEN bv IS NOT NULL AND fv IS NOT NULL THEN bv + (fv - bv) * (t - bt) / (ft - bt)
      ELSE coalesce(bv, fv, CASE WHEN bt IS NOT NULL THEN bn ELSE fn END) END, 6) AS value_at FROM f""",
    (POINTS,),
)
def _(spark, sf):
    p = T.points(spark, sf)
    s = p.filter("kind <> 'signup'").withColumn("value", F.when(F.col("event_id") % 5 > 1, F.col("value")))
    q = p.filter("kind = 'signup'").select("source_id", "event_id", "t")
    return I.interpolate_at(q, s, "t", "t", "value", id="event_id").select("source_id", "event_id", *r6("value_at"))


@query(
    "j11_exclude_overlapping",
    """SELECT source_id, id FROM evd e WHERE NOT EXISTS (SELECT 1 FROM moments m WHERE m.source_id = e.source_id AND e.start < m_end + 1 AND e."end" > m_start - 1)""",
    (DENSE, MOMENTS),
)
def _(spark, sf):
    m, e = moments(spark, sf)
    return I.exclude_overlapping(e, m, ["source_id", "id"], ("start", "end"), ("m_start", "m_end"), gap=1.0, width=90.0).select("source_id", "id")


@query(
    "u3_exclude_used",
    """SELECT source_id, id FROM evidence WHERE (source_id, id) NOT IN (SELECT source_id, clip_id FROM clips WHERE score >= 9)""",
    (CLIPS,),
)
def _(spark, sf):
    used = T.clips(spark, sf).filter("score >= 9").select("source_id", F.col("clip_id").alias("id"))
    return T.evidence(spark, sf).join(used, ["source_id", "id"], "left_anti").select("source_id", "id")


@query(
    "u4_subtract_spans",
    """, h AS (SELECT c.source_id, cut_id, c_start, c_end, greatest(c_start, w.start) AS hs, least(c_end, w."end") AS he FROM cuts c JOIN words w ON c.source_id = w.source_id AND w.start < c_end AND w."end" > c_start WHERE w.pos % 4 = 0
        UNION ALL SELECT source_id, cut_id, c_start, c_end, c_end, c_end FROM cuts),
      s AS (SELECT *, coalesce(max(he) OVER (PARTITION BY source_id, cut_id ORDER BY hs, he ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c_start) AS seen FROM h)
    SELECT source_id, cut_id, round(greatest(seen, c_start), 6) AS piece_start, round(hs, 6) AS piece_end FROM s WHERE round(hs - greatest(seen, c_start), 9) > 0.05""",
    (WORDS, CUTS),
)
def _(spark, sf):
    w = T.words(spark, sf)
    holes = w.filter(F.col("pos") % 4 == 0).select("source_id", F.col("start").alias("h_start"), F.col("end").alias("h_end"))
    p = I.subtract_spans(cuts(w), holes, ["source_id"], ["cut_id"], ("c_start", "c_end"), ("h_start", "h_end"), width=8.0)
    return p.select("source_id", "cut_id", *r6("piece_start", "piece_end"))


FILLER_SQL = """'und', 'the', 'de', 'la', 'en', 'of'"""
STRIP = """lower(trim(trim(word), '.,!?;:…—"''«»()[]-'))"""


@query(
    "w14_cut_out_fillers",
    f""", h AS (SELECT c.source_id, cut_id, c_start, c_end, greatest(c_start, w.start - 0.03::DOUBLE) AS hs, least(c_end, w."end" + 0.03::DOUBLE) AS he FROM cuts c JOIN words w ON c.source_id = w.source_id AND w.start >= c_start AND w."end" <= c_end + 0.001::DOUBLE WHERE {STRIP} IN ({FILLER_SQL})
        UNION ALL SELECT source_id, cut_id, c_start, c_end, c_end, c_end FROM cuts),
      s AS (SELECT *, coalesce(max(he) OVER (PARTITION BY source_id, cut_id ORDER BY hs, he ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c_start) AS seen FROM h)
    SELECT source_id, cut_id, round(greatest(seen, c_start), 6) AS piece_start, round(hs, 6) AS piece_end FROM s WHERE round(hs - greatest(seen, c_start), 9) > 0.05""",
    (WORDS, CUTS),
)
def _(spark, sf):
    from cadenza.functions.text import is_filler

    w = T.words(spark, sf)
    p = E.cut_out_words(cuts(w), w, ["source_id", "cut_id"], is_filler(F.col("word"), ("und", "the", "de", "la", "en", "of")), width=8.0)
    return p.select("source_id", "cut_id", *r6("piece_start", "piece_end"))


@query(
    "w15_compress_pauses",
    r""", g AS (SELECT source_id, lag("end") OVER w AS g_start, start AS g_end, trim(lag(word) OVER w) AS pw FROM words WINDOW w AS (PARTITION BY source_id ORDER BY start, pos)),
      k AS (SELECT *, CASE WHEN regexp_matches(pw, '[.!…]$') THEN 0.25 WHEN pw LIKE '%?' THEN 0.35 WHEN pw LIKE '%,' THEN 0.12 ELSE 0.2 END::DOUBLE AS keep FROM g WHERE round(g_end - g_start, 9) >= 0.4),
      h AS (SELECT c.source_id, cut_id, c_start, c_end, g_start + keep / 2 AS hs, g_end - keep / 2 AS he FROM cuts c JOIN k ON c.source_id = k.source_id AND g_start > c_start + 0.001::DOUBLE AND g_end < c_end
        UNION ALL SELECT source_id, cut_id, c_start, c_end, c_end, c_end FROM cuts),
      s AS (SELECT *, coalesce(max(he) OVER (PARTITION BY source_id, cut_id ORDER BY hs, he ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c_start) AS seen FROM h)
    SELECT source_id, cut_id, round(greatest(seen, c_start), 6) AS piece_start, round(hs, 6) AS piece_end FROM s WHERE round(hs - greatest(seen, c_start), 9) > 0.01""",
    (WORDS, CUTS),
)
def _(spark, sf):
    w = T.words(spark, sf)
    sp = w.select("source_id", F.col("pos").alias("sp_id"), F.col("start").alias("sp_start"), F.col("end").alias("sp_end"))
    p = E.compress_pauses(cuts(w), sp, ["source_id", "cut_id"], words=w, width=8.0)
    return p.select("source_id", "cut_id", *r6("piece_start", "piece_end"))


MARK = r"die|que|the\s+\S{2}\s+of|of\s+the\s+\S+\s+the|en\s+la\s"
ARCS = """ arcs AS (SELECT source_id, pos AS arc_id, start AS a_start, round(start + 18 + ((pos // 60) % 9) * 7, 3) AS a_end FROM words WHERE pos % 60 = 10),
  dur AS (SELECT source_id, max("end") AS duration FROM words GROUP BY 1)"""


def arcs(w):
    p = F.col("pos")
    return w.filter(p % 60 == 10).select("source_id", p.alias("arc_id"), F.col("start").alias("a_start"), F.round(F.col("start") + 18 + (F.floor(p / 60) % 9) * 7, 3).alias("a_end"))


@query(
    "w16_extend_boundaries",
    rf""", wa AS (SELECT source_id, pos, word, start, "end", regexp_matches(trim(word), '[.!?…]$') AS closes, lead(start) OVER w AS ns,
        regexp_matches(lower(concat_ws(' ', word, lead(word) OVER w, lead(word, 2) OVER w, lead(word, 3) OVER w)), '^(?:{MARK})') AS mk FROM words WINDOW w AS (PARTITION BY source_id ORDER BY start, pos)),
      a1 AS (SELECT a.source_id, arc_id, a_start, a_end, duration,
        max_by(closes, pos) FILTER (w."end" >= round(a_end - 5, 9) AND w.start < a_end) AS closed,
        max(w."end") FILTER (closes AND round(w."end", 9) <= round(a_end - 0.1::DOUBLE, 9) AND w."end" >= greatest(0, round(a_end - 5, 9))) AS bk
        FROM arcs a JOIN dur USING (source_id) LEFT JOIN wa w ON w.source_id = a.source_id AND w."end" >= a_end - 5.5 AND w.start <= a_end GROUP BY ALL),
      a2 AS (SELECT *, NOT coalesce(closed, false) AND bk IS NOT NULL AND bk > a_start + 1 AND round(bk - a_start, 9) >= 75 * 0.25 AS t1 FROM a1),
      a3 AS (SELECT source_id, arc_id, a_start, a_end, duration, coalesce(t1, false) AS t1, CASE WHEN t1 THEN bk ELSE a_end END AS e1 FROM a2),
      a4 AS (SELECT a.*, w."end" AS le, w.ns FROM a3 a ASOF LEFT JOIN wa w ON a.source_id = w.source_id AND round(a.e1 - 0.2::DOUBLE, 9) <= w."end"),
      a5 AS (SELECT *, coalesce(round(ns - le, 9) >= 0.8 AND round(ns - le, 9) <= 5 AND ns > e1 AND round(ns - a_end, 9) <= 35, false) AS t2 FROM a4),
      a6 AS (SELECT source_id, arc_id, a_start, a_end, duration, t1, t2, CASE WHEN t2 THEN ns ELSE e1 END AS e2 FROM a5),
      a7 AS (SELECT *, least(round(e2 + 15, 9), duration) AS h FROM a6),
      m AS (SELECT a.source_id, arc_id, min(pos) FILTER (mk) AS mpos, max_by(w."end", pos) AS lw FROM a7 a JOIN wa w ON w.source_id = a.source_id AND w."end" >= e2 AND w.start < h GROUP BY 1, 2),
      m2 AS (SELECT a.source_id, arc_id, min(w."end") AS se FROM a7 a JOIN m USING (source_id, arc_id) JOIN wa w ON w.source_id = a.source_id AND w.pos >= mpos AND w.start < h AND closes GROUP BY 1, 2),
      a8 AS (SELECT a7.*, CASE WHEN mpos IS NOT NULL THEN coalesce(se, lw) END AS tg FROM a7 LEFT JOIN m USING (source_id, arc_id) LEFT JOIN m2 USING (source_id, arc_id)),
      a9 AS (SELECT *, CASE WHEN tg > e2 AND round(tg - a_end, 9) <= 35 THEN tg WHEN tg > e2 THEN a_end + 35 ELSE e2 END AS e3,
        CASE WHEN tg > e2 AND round(tg - a_end, 9) <= 35 THEN 'extend_closure_marker' WHEN tg > e2 THEN 'extend_capped' END AS t3 FROM a8),
      c AS (SELECT a.source_id, arc_id, max(w."end") AS c FROM a9 a JOIN wa w ON w.source_id = a.source_id AND closes AND round(w."end", 9) <= round(a_start + 75 - 0.1::DOUBLE, 9) AND w."end" >= round(a_start + 75 - 15, 9) GROUP BY 1, 2),
      f AS (SELECT a9.*, round(e3 - a_start, 9) > 75 AS t4, CASE WHEN round(e3 - a_start, 9) > 75 THEN coalesce(c, a_start + 75) ELSE e3 END AS e4 FROM a9 LEFT JOIN c USING (source_id, arc_id))
    SELECT source_id, arc_id, round(least(e4, duration), 6) AS a_end, coalesce(nullif(concat_ws(',', CASE WHEN t1 THEN 'tail_trim' END, CASE WHEN t2 THEN 'bridge_pause' END, t3, CASE WHEN t4 THEN 'length_cap' END), ''), 'no_adjustment') AS adjustments FROM f""",
    (WORDS, ARCS),
)
def _(spark, sf):
    w = T.words(spark, sf)
    x = E.extend_boundaries(arcs(w), w, word_duration(w), marker=MARK)
    return x.select("source_id", "arc_id", *r6("a_end"), "adjustments")


@query(
    "w17_repair_endings",
    r""", p AS (SELECT source_id, arc_id AS plan_id, a_start AS p_start, a_end AS p_end, duration, arc_id % 4 <> 2 AS inc FROM arcs JOIN dur USING (source_id)),
      se AS (SELECT source_id, start AS ss, "end" AS s FROM words WHERE regexp_matches(trim(word), '[.!?…]$')),
      l AS (SELECT p.*, w.word, w.start AS ws FROM p ASOF LEFT JOIN words w ON p.source_id = w.source_id AND p.p_end >= w.start),
      o AS (SELECT *, inc AND NOT coalesce(regexp_matches(trim(word), '[.!?…]$') AND round(p_end - ws, 9) <= 10, false) AS open FROM l),
      f AS (SELECT o.source_id, plan_id, min(s) AS f FROM o JOIN se ON o.source_id = se.source_id AND round(ss - p_end, 9) > 0 AND ss <= least(round(p_end + 30, 9), duration) AND round(s - p_end, 9) <= 30 GROUP BY 1, 2),
      b AS (SELECT o.source_id, plan_id, max(s) AS b FROM o JOIN se ON o.source_id = se.source_id AND s <= round(p_end - 0.1::DOUBLE, 9) AND s >= greatest(0, round(p_end - 10, 9)) GROUP BY 1, 2),
      mo AS (SELECT source_id, start AS ms, start + 4 AS me, (pos % 11) / 10.0::DOUBLE AS cos FROM words WHERE pos % 25 = 0),
      s AS (SELECT o.source_id, plan_id, max_by(me, (cos, me)) AS sm FROM o JOIN mo ON o.source_id = mo.source_id AND cos >= 0.5 AND ms >= p_end AND ms <= least(p_end + 45, duration) AND me <= least(p_end + 45, duration) GROUP BY 1, 2),
      x AS (SELECT o.*, f, CASE WHEN round(b - p_start, 9) >= 5 THEN b END AS b, sm FROM o LEFT JOIN f USING (source_id, plan_id) LEFT JOIN b USING (source_id, plan_id) LEFT JOIN s USING (source_id, plan_id))
    SELECT source_id, plan_id, round(least(CASE WHEN NOT open THEN p_end ELSE coalesce(f, b, sm, p_end) END, duration), 6) AS new_end,
      CASE WHEN NOT open THEN 'complete' WHEN f IS NOT NULL THEN 'extended' WHEN b IS NOT NULL THEN 'trimmed' WHEN sm IS NOT NULL THEN 'semantic' ELSE 'failed' END AS outcome FROM x""",
    (WORDS, ARCS),
)
def _(spark, sf):
    w = T.words(spark, sf)
    p = arcs(w).select("source_id", F.col("arc_id").alias("plan_id"), F.col("a_start").alias("p_start"), F.col("a_end").alias("p_end"), (F.col("arc_id") % 4 != 2).alias("incomplete"))
    m = w.filter(F.col("pos") % 25 == 0).select("source_id", F.col("start").alias("m_start"), (F.col("start") + 4).alias("m_end"), ((F.col("pos") % 11) / F.lit(10.0)).alias("cos"))
    r = E.repair_endings(p, w, word_duration(w), m)
    return r.select("source_id", "plan_id", *r6("new_end"), "outcome")


@query(
    "w23_threshold_islands",
    """, q AS (SELECT source_id, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.5) AS hi FROM points GROUP BY 1),
      p AS (SELECT points.source_id, event_id, t, value > lo AND value < hi AND kind <> 'error' AS inn FROM points JOIN q USING (source_id)),
      l AS (SELECT *, lag(inn) OVER w AS pi, lead(t) OVER w AS nt FROM p WINDOW w AS (PARTITION BY source_id ORDER BY t, event_id)),
      r AS (SELECT *, sum(CASE WHEN inn AND NOT coalesce(pi, false) THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY t, event_id) AS run FROM l)
    SELECT source_id, round(min(t), 3) AS start, round(max_by(nt, t), 3) AS "end" FROM r WHERE inn GROUP BY source_id, run HAVING arg_max_null(nt, t) IS NOT NULL AND round(arg_max_null(nt, t) - min(t), 9) BETWEEN 5000 AND 90000""",
    (POINTS,),
)
def _(spark, sf):
    p = T.points(spark, sf)
    x = p.filter("kind = 'error'").select("source_id", F.col("t").alias("x_start"), F.col("t").alias("x_end"))
    i = E.threshold_islands(p, ["source_id"], "t", "value", "event_id", low=0.1, high=0.5, shortest=5000.0, longest=90000.0, excluded=x, width=3600.0)
    return i.select("source_id", *[F.round(c, 3).alias(c) for c in ("start", "end")])


@query(
    "w23_upper_islands",
    """, q AS (SELECT source_id, quantile_cont(value, 0.9) AS hi FROM points GROUP BY 1),
      p AS (SELECT points.source_id, event_id, t, value > hi AS inn FROM points JOIN q USING (source_id)),
      l AS (SELECT *, lag(inn) OVER w AS pi, lead(t) OVER w AS nt FROM p WINDOW w AS (PARTITION BY source_id ORDER BY t, event_id)),
      r AS (SELECT *, sum(CASE WHEN inn AND NOT coalesce(pi, false) THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY t, event_id) AS run FROM l)
    SELECT source_id, round(min(t), 3) AS start, round(max(nt), 3) AS "end" FROM r WHERE inn GROUP BY source_id, run HAVING arg_max_null(nt, t) IS NOT NULL AND round(max(nt) - min(t), 9) BETWEEN 1000 AND 50000""",
    (POINTS,),
)
def _(spark, sf):
    i = E.upper_islands(T.points(spark, sf), ["source_id"], "t", "value", "event_id", q=0.9, shortest=1000.0, longest=50000.0)
    return i.select("source_id", *[F.round(c, 3).alias(c) for c in ("start", "end")])


@query(
    "w23_upper_islands_confidence",
    """, q AS (SELECT source_id, quantile_cont(value, 0.9) AS hi FROM points GROUP BY 1),
      p AS (SELECT points.source_id, event_id, t, value > hi AS inn, least(1.0::DOUBLE, value / hi) AS cf FROM points JOIN q USING (source_id)),
      l AS (SELECT *, lag(inn) OVER w AS pi, lead(t) OVER w AS nt, lead(cf) OVER w AS ncf FROM p WINDOW w AS (PARTITION BY source_id ORDER BY t, event_id)),
      r AS (SELECT *, sum(CASE WHEN inn AND NOT coalesce(pi, false) THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY t, event_id) AS run FROM l)
    SELECT source_id, round(min(t), 3) AS start, round(arg_max_null(ncf, t), 6) AS confidence FROM r WHERE inn GROUP BY source_id, run HAVING arg_max_null(nt, t) IS NOT NULL AND round(max(nt) - min(t), 9) BETWEEN 1000 AND 50000""",
    (POINTS,),
)
def _(spark, sf):
    i = E.upper_islands(T.points(spark, sf), ["source_id"], "t", "value", "event_id", q=0.9, shortest=1000.0, longest=50000.0)
    return i.select("source_id", F.round("start", 3).alias("start"), F.round("confidence", 6).alias("confidence"))


@query(
    "w25_final_drop",
    """, t AS (SELECT source_id, clip_id, start, "end", unnest([0, 1, 2]) AS k, unnest([greatest(start, "end" - 20), (greatest(start, "end" - 20) + "end") / 2, "end" - 0.02::DOUBLE]) AS x FROM clips WHERE round("end" - start, 9) >= 0.5),
      s AS (SELECT source_id, start AS t, max(strength) * 500 AS value FROM evidence GROUP BY 1, 2),
      b AS (SELECT t.*, s.t AS bt, s.value AS bv FROM t ASOF LEFT JOIN s ON t.source_id = s.source_id AND t.x >= s.t),
      f AS (SELECT b.*, s.t AS ft, s.value AS fv FROM b ASOF LEFT JOIN s ON b.source_id = s.source_id AND b.x <= s.t),
      v AS (SELECT source_id, clip_id, "end", k, CASE WHEN bt IS NULL THEN fv WHEN ft IS NULL OR ft <= bt THEN bv ELSE bv + (fv - bv) * (x - bt) / (ft - bt) END AS y FROM f),
      g AS (SELECT source_id, clip_id, "end", arg_min(y, k) FILTER (y > 0) - arg_max(y, k) FILTER (y > 0) AS d, count(*) FILTER (y > 0) AS n FROM v GROUP BY ALL)
    SELECT source_id, clip_id, round("end", 3) AS time_sec, round(d, 6) AS "drop" FROM g WHERE n >= 2 AND d >= 0.05""",
    (CLIPS,),
)
def _(spark, sf):
    c = T.clips(spark, sf).select("source_id", F.col("clip_id"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    s = T.evidence(spark, sf).groupBy("source_id", F.col("start").alias("t")).agg((F.max("strength") * 500).alias("value"))
    d = E.final_drop(c, s, ["source_id", "clip_id"], window=20.0, drop=0.05, digits=6)
    return d.select("source_id", "clip_id", "time_sec", "drop")


@query(
    "w34_extend_near_markers",
    """, m AS (SELECT source_id, start + 5.85::DOUBLE AS m_t, 0.1::DOUBLE * (pos % 5) AS h FROM words WHERE pos % 8 = 7)
    SELECT s.source_id, span_id, round(e + coalesce(max(h), 0), 6) AS e FROM spans s LEFT JOIN m ON s.source_id = m.source_id AND m_t BETWEEN e - 0.3 AND e + 0.3 AND round(abs(m_t - e), 9) < 0.2 GROUP BY s.source_id, span_id, e""",
    (WORDS, SPANS),
)
def _(spark, sf):
    w = T.words(spark, sf)
    m = w.filter(F.col("pos") % 8 == 7).select("source_id", (F.col("start") + 5.85).alias("m_t"), (F.lit(0.1) * (F.col("pos") % 5)).alias("m_hold"))
    return I.extend_near_markers(spans(w), m, ["source_id", "span_id"], ("b", "e"), width=8.0).select("source_id", "span_id", *r6("e"))
