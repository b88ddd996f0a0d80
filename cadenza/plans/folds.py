"""Sessions, chunks, windows and other sequential rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import dedup as D
from cadenza.operators import segment as G
from cadenza.operators.ordered import row_index, running
from cadenza.plans.registry import ARCSEG, CLIPS, DENSE, EVIDENCE, POINTS, SEGMENTS, SENTENCES, WORDS, query
from cadenza.plans.windows import PLAN_SQL, plan_segments, r6, word_duration
from cadenza.sources import tables as T


def orbit(nxt: str, rows: str, idx: str = "i") -> str:
    """SQL: the opening rows reached from every source's first row through ``nxt`` (source_id, i, nx)."""
    return f""" orbit AS (SELECT source_id, min({idx}) AS i FROM {rows} GROUP BY 1
      UNION ALL SELECT o.source_id, n.nx FROM orbit o JOIN {nxt} n ON o.source_id = n.source_id AND o.i = n.i WHERE n.nx IS NOT NULL)"""


@query(
    "w1_sessionize",
    """SELECT source_id, min(start) AS start, max("end") AS "end", count(*) AS n_words FROM walk GROUP BY source_id, isl, g""",
    (
        WORDS,
        """ fl AS (SELECT source_id, pos, start, "end", coalesce(round(start - lag("end") OVER (PARTITION BY source_id ORDER BY start, pos), 9) >= 0.75, true) AS brk FROM words)""",
        """ il AS (SELECT *, sum(brk::INT) OVER (PARTITION BY source_id ORDER BY start, pos) AS isl FROM fl)""",
        """ ik AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id, isl ORDER BY start, pos) AS k FROM il)""",
        """ walk AS (SELECT source_id, isl, k, start, "end", start AS b, 0 AS g FROM ik WHERE k = 1
          UNION ALL SELECT n.source_id, n.isl, n.k, n.start, n."end", CASE WHEN round(n."end" - 20 - w.b, 9) >= 0 THEN n.start ELSE w.b END, w.g + CASE WHEN round(n."end" - 20 - w.b, 9) >= 0 THEN 1 ELSE 0 END
          FROM walk w JOIN ik n ON n.source_id = w.source_id AND n.isl = w.isl AND n.k = w.k + 1)""",
    ),
    recursive=True,
)
def _(spark, sf):
    t = G.session_table(G.sessionize(T.words(spark, sf).select("source_id", "pos", "start", "end")))
    return t.select("source_id", "start", "end", "n_words")


@query(
    "w1_sessionize_text",
    """SELECT source_id, session, start, "end", n_words, text FROM (
      SELECT source_id, s - 1 AS session, min(start) AS start, max("end") AS "end", count(*) AS n_words, string_agg(word, ' ' ORDER BY pos) AS text FROM (
      SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start, pos) AS s FROM (
        SELECT *, coalesce(round(start - lag("end") OVER (PARTITION BY source_id ORDER BY start, pos), 9) >= 0.75, true) AS b FROM words)) GROUP BY 1, 2)""",
    (WORDS,),
)
def _(spark, sf):
    return G.session_table(G.sessionize(T.words(spark, sf), max_span=None), text=True)


def _steps(cond: str, extra: str = "") -> str:
    """SQL: walk sentences in order; ``cond`` opens a new segment given base columns b, of the open segment."""
    return f""" st AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start, sent) - 1 AS i, lag("end") OVER (PARTITION BY source_id ORDER BY start, sent) AS pe,
        lag(sim) OVER (PARTITION BY source_id ORDER BY start, sent) AS ps FROM sentences),
     walk AS (SELECT source_id, i, sent, start AS b, 0::BIGINT AS g FROM st WHERE i = 0
       UNION ALL SELECT st.source_id, st.i, st.sent, CASE WHEN {cond} THEN st.start ELSE w.b END, w.g + CASE WHEN {cond} THEN 1 ELSE 0 END FROM walk w JOIN st ON st.source_id = w.source_id AND st.i = w.i + 1)"""


@query(
    "w6_time_windows",
    """SELECT source_id, g AS win, min(start) AS start, max("end") AS "end", count(*) AS n FROM walk JOIN sentences USING (source_id, sent) GROUP BY 1, 2""",
    (SENTENCES, _steps("(round(st.start - st.pe, 9) > 2 OR round(st.start - 45 - w.b, 9) >= 0)")),
    recursive=True,
)
def _(spark, sf):
    w = G.time_windows(T.sentences(spark, sf))
    return w.groupBy("source_id", "win").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


@query(
    "w8_semantic_chunks",
    """SELECT source_id, g AS chunk, min(start) AS start, max("end") AS "end", count(*) AS n FROM walk JOIN sentences USING (source_id, sent) GROUP BY 1, 2""",
    (SENTENCES, _steps("((st.ps < 0.35 AND round(st.pe - 20 - w.b, 9) >= 0) OR round(st.pe - 90 - w.b, 9) >= 0)")),
    recursive=True,
)
def _(spark, sf):
    w = G.semantic_chunks(T.sentences(spark, sf), sim="sim", threshold=0.35, min_len=20.0, target=60.0)
    return w.groupBy("source_id", "chunk").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def _budget(size: str, budget: int, overlap: int, at_least_one: bool) -> str:
    tail = f"(SELECT min(t.i) FROM st t WHERE t.source_id = st.source_id AND t.before >= st.before - {overlap} AND t.i <= st.i)"
    keep = f"least({tail}, st.i - 1)" if at_least_one else tail
    return f""" sz AS (SELECT source_id, sent, start, "end", {size} AS size, row_number() OVER (PARTITION BY source_id ORDER BY start, sent) - 1 AS i FROM sentences),
      st AS (SELECT *, sum(size) OVER (PARTITION BY source_id ORDER BY i) - size AS before FROM sz),
      k AS (SELECT st.source_id, st.i, min(t.i) AS tail FROM st JOIN st t ON t.source_id = st.source_id AND t.i <= st.i AND t.before >= st.before - {overlap} GROUP BY 1, 2),
      kb AS (SELECT st.*, CASE WHEN {str(at_least_one).lower()} THEN greatest(0, least(tail, st.i - 1)) ELSE tail END AS kt FROM st JOIN k USING (source_id, i)),
      kc AS (SELECT kb.*, s2.before AS kbase FROM kb JOIN st s2 ON s2.source_id = kb.source_id AND s2.i = kb.kt),
      walk AS (SELECT source_id, i, before AS b, 0::BIGINT AS g, true AS o, kt FROM kc WHERE i = 0
       UNION ALL SELECT s.source_id, s.i, CASE WHEN s.before + s.size - {budget} > w.b THEN s.kbase ELSE w.b END, w.g + CASE WHEN s.before + s.size - {budget} > w.b THEN 1 ELSE 0 END,
         s.before + s.size - {budget} > w.b, s.kt FROM walk w JOIN kc s ON s.source_id = w.source_id AND s.i = w.i + 1),
      open AS (SELECT source_id, g, i AS j, CASE WHEN g = 0 THEN 0 ELSE kt END AS lo FROM walk WHERE o),
      rng AS (SELECT *, coalesce(lead(j) OVER (PARTITION BY source_id ORDER BY g), 1000000000) AS hi FROM open)"""


@query(
    "w4_chunk_by_chars",
    """SELECT r.source_id, g AS chunk, min(start) AS start, max("end") AS "end", count(*) AS n_segments, sum(size)::DOUBLE AS size FROM rng r JOIN st ON st.source_id = r.source_id AND st.i >= lo AND st.i < hi GROUP BY 1, 2""",
    (SENTENCES, _budget("chars + 1", 900, 150, True)),
    recursive=True,
)
def _(spark, sf):
    rows = G.budget_chunks(T.sentences(spark, sf), size=F.col("chars") + 1, budget=900, overlap=150, at_least_one=True)
    return G.chunk_table(rows)


@query(
    "w4_chunk_by_chars_strict_tail",
    """SELECT r.source_id, g AS chunk, min(start) AS start, max("end") AS "end", count(*) AS n_segments, sum(size)::DOUBLE AS size FROM rng r JOIN st ON st.source_id = r.source_id AND st.i >= lo AND st.i < hi GROUP BY 1, 2""",
    (SENTENCES, _budget("chars + 1", 1200, 200, False)),
    recursive=True,
)
def _(spark, sf):
    rows = G.budget_chunks(T.sentences(spark, sf), size=F.col("chars") + 1, budget=1200, overlap=200, at_least_one=False)
    return G.chunk_table(rows)


@query(
    "w5_chunk_by_tokens",
    """, tot AS (SELECT source_id, sum(size) AS t FROM st GROUP BY 1)
    SELECT r.source_id, g AS chunk, min(start) AS start, max("end") AS "end", count(*) AS n_segments, sum(size)::DOUBLE AS size FROM rng r JOIN st ON st.source_id = r.source_id AND st.i >= lo AND st.i < hi JOIN tot ON tot.source_id = r.source_id WHERE t > 400 GROUP BY 1, 2
    UNION ALL SELECT st.source_id, 0, min(start), max("end"), count(*), sum(size)::DOUBLE FROM st JOIN tot USING (source_id) WHERE t <= 400 GROUP BY 1""",
    (SENTENCES, _budget("ceil(chars / 4.0::DOUBLE)::BIGINT", 300, 60, False)),
    recursive=True,
)
def _(spark, sf):
    rows = G.chunk_by_tokens(T.sentences(spark, sf), tokens=F.ceil(F.col("chars") / F.lit(4.0)), threshold=400, window=300, overlap=60)
    return G.chunk_table(rows)


# conversation turns cut into pieces of at most 38 estimated tokens, as rows of "sentences"
PIECES = r""" d AS (SELECT source_id, seg_idx, start, "end", list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda x: x <> '') AS ws FROM segments WHERE text IS NOT NULL),
  w AS MATERIALIZED (SELECT *, sum(t) OVER (PARTITION BY source_id, seg_idx ORDER BY i)::BIGINT AS c FROM (
    SELECT source_id, seg_idx, i, ws[i] AS word, ceil((length(ws[i]) + 1) / 4.0::DOUBLE)::BIGINT AS t FROM (SELECT source_id, seg_idx, ws, unnest(range(1, len(ws) + 1)) AS i FROM d))),
  nx AS MATERIALIZED (SELECT a.source_id, a.seg_idx, a.i, greatest(b.i, a.i + 1) AS nx FROM (SELECT *, c - t + 38 AS most FROM w) a ASOF JOIN w b ON a.source_id = b.source_id AND a.seg_idx = b.seg_idx AND a.most < b.c),
  hop AS (SELECT source_id, seg_idx, 1::BIGINT AS i FROM d UNION ALL SELECT o.source_id, o.seg_idx, n.nx FROM hop o JOIN nx n USING (source_id, seg_idx, i) JOIN w ON w.source_id = o.source_id AND w.seg_idx = o.seg_idx AND w.i = n.nx),
  piece AS (SELECT source_id, seg_idx, i AS lo, lead(i, 1, 1000000000) OVER (PARTITION BY source_id, seg_idx ORDER BY i) AS hi FROM hop),
  sentences AS MATERIALIZED (SELECT p.source_id, p.seg_idx * 1000 + row_number() OVER (PARTITION BY p.source_id, p.seg_idx ORDER BY p.lo) AS sent,
    CASE WHEN any_value(len(ws)) > 0 THEN round(any_value(d.start) + any_value(d."end" - d.start) * (p.lo - 1) / any_value(len(ws)), 6) ELSE any_value(d.start) END AS start,
    CASE WHEN any_value(len(ws)) > 0 THEN round(any_value(d.start) + any_value(d."end" - d.start) * least(p.hi - 1, any_value(len(ws))) / any_value(len(ws)), 6) ELSE any_value(d."end") END AS "end",
    coalesce(length(string_agg(word, ' ' ORDER BY w.i)), 0) AS chars
    FROM piece p JOIN d ON d.source_id = p.source_id AND d.seg_idx = p.seg_idx LEFT JOIN w ON w.source_id = p.source_id AND w.seg_idx = p.seg_idx AND w.i >= p.lo AND w.i < p.hi GROUP BY p.source_id, p.seg_idx, p.lo, p.hi)"""


@query(
    "w5_chunk_by_tokens_split",
    """, tot AS (SELECT source_id, sum(size) AS t FROM st GROUP BY 1)
    SELECT r.source_id, g AS chunk, min(start) AS start, max("end") AS "end", count(*) AS n_segments, sum(size)::DOUBLE AS size FROM rng r JOIN st ON st.source_id = r.source_id AND st.i >= lo AND st.i < hi JOIN tot ON tot.source_id = r.source_id WHERE t > 60 GROUP BY 1, 2
    UNION ALL SELECT st.source_id, 0, min(start), max("end"), count(*), sum(size)::DOUBLE FROM st JOIN tot USING (source_id) WHERE t <= 60 GROUP BY 1""",
    (SEGMENTS, PIECES, _budget("ceil(chars / 4.0::DOUBLE)::BIGINT", 50, 12, False)),
    recursive=True,
)
def _(spark, sf):
    """Segments longer than a window's new part are split by words, then chunked."""
    rows = G.chunk_by_tokens(T.segments(spark, sf).filter("text is not null"), threshold=60, window=50, overlap=12, order=("seg_idx",), text="text")
    return G.chunk_table(rows)


@query(
    "x8_split_long",
    r""" SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY lo) - 1)::INT AS piece_no, length(piece)::INT AS chars, md5(piece) AS digest FROM (
      SELECT p.doc_id, lo, coalesce(string_agg(word, ' ' ORDER BY i), '') AS piece FROM piece p LEFT JOIN w ON w.doc_id = p.doc_id AND w.i >= p.lo AND w.i < p.hi GROUP BY 1, 2)""",
    (
        r""" d AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL)""",
        r""" w AS MATERIALIZED (SELECT *, sum(t) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS c FROM (
             SELECT doc_id, i, ws[i] AS word, ceil(length(ws[i]) / 4.0::DOUBLE)::BIGINT AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)))""",
        # a piece ends before the first word that exceeds the limit, but has one word at least
        r""" nx AS MATERIALIZED (SELECT a.doc_id, a.i, greatest(b.i, a.i + 1) AS nx FROM (SELECT *, c - t + 300 AS most FROM w) a ASOF JOIN w b ON a.doc_id = b.doc_id AND a.most < b.c)""",
        r""" orbit AS (SELECT doc_id, 1::BIGINT AS i FROM d UNION ALL SELECT o.doc_id, n.nx FROM orbit o JOIN nx n USING (doc_id, i) JOIN w ON w.doc_id = o.doc_id AND w.i = n.nx)""",
        r""" piece AS (SELECT doc_id, i AS lo, lead(i, 1, 1000000000) OVER (PARTITION BY doc_id ORDER BY i) AS hi FROM orbit)""",
    ),
    recursive=True,
)
def _(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "text")
    return G.split_long(d, "text", 300).select("doc_id", "piece_no", F.length("piece").alias("chars"), F.md5("piece").alias("digest"))


@query(
    "d1_dedup_close_starts",
    """SELECT source_id, i AS id FROM orbit""",
    (
        DENSE,
        """ rn AS (SELECT source_id, clip_id, start, row_number() OVER (PARTITION BY source_id ORDER BY start, clip_id) AS k FROM dense)""",
        """ nk AS (SELECT a.source_id, a.clip_id AS i, min(b.k) AS k FROM rn a JOIN rn b ON a.source_id = b.source_id AND b.k > a.k AND round(b.start - 60 - a.start, 9) >= 0 GROUP BY 1, 2)""",
        """ nxt AS (SELECT nk.source_id, i, rn.clip_id AS nx FROM nk JOIN rn USING (source_id, k))""",
        """ orbit AS (SELECT source_id, clip_id AS i FROM rn WHERE k = 1 UNION ALL SELECT o.source_id, n.nx FROM orbit o JOIN nxt n ON o.source_id = n.source_id AND o.i = n.i)""",
    ),
    recursive=True,
)
def _(spark, sf):
    return G.dedup_close_starts(T.dense_clips(spark, sf), 60.0, id="clip_id").select("source_id", F.col("clip_id").alias("id"))


@query(
    "w22b_non_overlapping",
    """SELECT source_id, i AS clip_id FROM orbit""",
    (
        DENSE,
        """ rn AS (SELECT source_id, clip_id, start, "end", row_number() OVER (PARTITION BY source_id ORDER BY start, clip_id) AS k FROM dense)""",
        """ nk AS (SELECT a.source_id, a.clip_id AS i, min(b.k) AS k FROM rn a JOIN rn b ON a.source_id = b.source_id AND b.k > a.k AND b.start >= a."end" GROUP BY 1, 2)""",
        """ nxt AS (SELECT nk.source_id, i, rn.clip_id AS nx FROM nk JOIN rn USING (source_id, k))""",
        """ orbit AS (SELECT source_id, clip_id AS i FROM rn WHERE k = 1 UNION ALL SELECT o.source_id, n.nx FROM orbit o JOIN nxt n ON o.source_id = n.source_id AND o.i = n.i)""",
    ),
    recursive=True,
)
def _(spark, sf):
    return G.non_overlapping(T.dense_clips(spark, sf), ["source_id"], "start", "end", "clip_id").select("source_id", "clip_id")


@query(
    "w26_min_interval_pick",
    """SELECT source_id, i AS event_id FROM orbit""",
    (
        POINTS,
        """ rn AS (SELECT source_id, event_id, t, row_number() OVER (PARTITION BY source_id ORDER BY t, event_id) AS k FROM points QUALIFY (k - 1) % 2 = 0)""",
        """ nk AS (SELECT a.source_id, a.event_id AS i, min(b.k) AS k FROM rn a JOIN rn b ON a.source_id = b.source_id AND b.k > a.k AND round(b.t - 90000 - a.t, 9) >= 0 GROUP BY 1, 2)""",
        """ nxt AS (SELECT nk.source_id, i, rn.event_id AS nx FROM nk JOIN rn USING (source_id, k))""",
        """ orbit AS (SELECT source_id, event_id AS i FROM rn WHERE k = 1 UNION ALL SELECT o.source_id, n.nx FROM orbit o JOIN nxt n ON o.source_id = n.source_id AND o.i = n.i)""",
    ),
    recursive=True,
)
def _(spark, sf):
    return G.min_interval_pick(T.points(spark, sf), ["source_id"], "t", "event_id", nth=2, min_sec=90000.0).select("source_id", "event_id")


@query(
    "w22_peaks",
    """SELECT source_id, event_id, round(least(1, (value - thr) / greatest(s, 1)), 6) AS prominence FROM orbit o JOIN c USING (source_id, k)""",
    (
        POINTS,
        """ s AS (SELECT source_id, avg(value) AS m, stddev_pop(value) AS s FROM points GROUP BY 1 HAVING count(*) >= 10)""",
        """ r AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS q, row_number() OVER w AS k FROM points WINDOW w AS (PARTITION BY source_id ORDER BY t, event_id))""",
        """ c AS (SELECT r.*, m + 0.5 * s AS thr, s FROM r JOIN s USING (source_id) WHERE value > m + 0.5 * s AND value > p AND value > q)""",
        """ nk AS (SELECT a.source_id, a.k AS i, min(b.k) AS nx FROM c a JOIN c b ON a.source_id = b.source_id AND b.k >= a.k + 5 GROUP BY 1, 2)""",
        """ orbit AS (SELECT source_id, min(k) AS k FROM c GROUP BY 1 UNION ALL SELECT o.source_id, n.nx FROM orbit o JOIN nk n ON o.source_id = n.source_id AND o.k = n.i)""",
    ),
    recursive=True,
)
def _(spark, sf):
    return G.peaks(T.points(spark, sf), ["source_id"], "t", "value", "event_id", digits=6).select("source_id", "event_id", "prominence")


RULES = (("and_the", r"^(?:und|the|de|la)\s+\S{2}$", 2), ("three", r"^(?:die|of|que)\s+\S+\s+\S{3}$", 3), ("short", r"^(?:in|en|el)[.,]?$", 1))


PHRASES = (
        WORDS,
        r""" g3 AS (SELECT source_id, word, start, "end", row_number() OVER w AS i, lead(word) OVER w AS w2, lead(word, 2) OVER w AS w3, lead("end") OVER w AS e2, lead("end", 2) OVER w AS e3 FROM words WINDOW w AS (PARTITION BY source_id ORDER BY start, pos))""",
        r""" hit AS (SELECT *, CASE WHEN rule = 'and_the' THEN 2 ELSE 3 END AS len FROM (SELECT *, CASE WHEN w2 IS NOT NULL AND regexp_matches(lower(trim(word || ' ' || w2)), '^(?:und|the|de|la)\s+\S{2}$') THEN 'and_the'
            WHEN w3 IS NOT NULL AND regexp_matches(lower(trim(word || ' ' || w2 || ' ' || w3)), '^(?:die|of|que)\s+\S+\s+\S{3}$') THEN 'three' END AS rule FROM g3) WHERE rule IS NOT NULL)""",
        """ nxt AS (SELECT source_id, i, (SELECT min(b.i) FROM hit b WHERE b.source_id = a.source_id AND b.i >= a.i + a.len) AS nx FROM hit a)""",
        orbit("nxt", "hit"),
    r""" used AS (SELECT o.source_id, unnest(range(o.i, o.i + g.len)) AS i FROM orbit o JOIN hit g ON g.source_id = o.source_id AND g.i = o.i)""",
)
PHRASES_SQL = r"""SELECT o.source_id, g.start, CASE WHEN len = 2 THEN e2 ELSE e3 END AS "end", rule FROM orbit o JOIN hit g ON g.source_id = o.source_id AND g.i = o.i
    UNION ALL SELECT source_id, start, "end", 'short' FROM g3 WHERE regexp_matches(lower(trim(word)), '^(?:in|en|el)[.,]?$') AND NOT EXISTS (SELECT 1 FROM used u WHERE u.source_id = g3.source_id AND u.i = g3.i)"""


@query("w11_phrase_match", PHRASES_SQL, PHRASES, recursive=True)
def _(spark, sf):
    return G.phrase_match(T.words(spark, sf), RULES).select("source_id", "start", "end", "rule")


@query(
    "w12_split_arcs",
    """SELECT source_id, arc_no, seg_no, id, grp FROM wk""",
    (
        ARCSEG,
        """ wk AS (SELECT source_id, arc_no, seg_no, id, role, dur, 0::BIGINT AS grp, dur AS cur, role <> 'hook' AS nh FROM arcseg WHERE seg_no = 0
          UNION ALL SELECT a.source_id, a.arc_no, a.seg_no, a.id, a.role, a.dur, w.grp + CASE WHEN br THEN 1 ELSE 0 END, CASE WHEN br THEN a.dur ELSE w.cur + a.dur END, CASE WHEN br THEN a.role <> 'hook' ELSE w.nh OR a.role <> 'hook' END
          FROM (SELECT w.*, a.seg_no AS sn, (a.role = 'hook' AND w.nh) OR (w.cur >= 45 AND w.nh AND a.role IN ('peak', 'payoff', 'hook')) OR w.cur + a.dur > 80 AS br FROM wk w JOIN arcseg a ON a.source_id = w.source_id AND a.arc_no = w.arc_no AND a.seg_no = w.seg_no + 1) w
          JOIN arcseg a ON a.source_id = w.source_id AND a.arc_no = w.arc_no AND a.seg_no = w.sn)""",
    ),
    recursive=True,
)
def _(spark, sf):
    return G.split_arcs(T.arc_segments(spark, sf)).select("source_id", "arc_no", "seg_no", "id", "grp")


def _merge_pass(src: str, name: str, wants: str) -> str:
    return f""" {name}w AS (SELECT source_id, arc_no, i, i0, i1, dur, dev, op, cl, 0::BIGINT AS p FROM {src} WHERE i = 0
      UNION ALL SELECT g.source_id, g.arc_no, g.i, CASE WHEN m THEN w.i0 ELSE g.i0 END, g.i1, CASE WHEN m THEN w.dur + g.dur ELSE g.dur END, CASE WHEN m THEN w.dev + g.dev ELSE g.dev END, CASE WHEN m THEN w.op OR g.op ELSE g.op END, g.cl, w.p + CASE WHEN m THEN 0 ELSE 1 END
      FROM (SELECT w.*, ({wants}) AND w.dur + g.dur <= 80 AS m FROM {name}w w JOIN {src} g ON g.source_id = w.source_id AND g.arc_no = w.arc_no AND g.i = w.i + 1) w JOIN {src} g ON g.source_id = w.source_id AND g.arc_no = w.arc_no AND g.i = w.i + 1),
     {name} AS (SELECT source_id, arc_no, p AS i, i0, i1, dur, dev, op, cl FROM {name}w QUALIFY row_number() OVER (PARTITION BY source_id, arc_no, p ORDER BY {name}w.i DESC) = 1)"""


_MERGE = (
    ARCSEG,
    """ gs AS (SELECT *, seg_no // 2 AS grp FROM arcseg)""",
    """ g0 AS (SELECT source_id, arc_no, grp AS i, min(seg_no) AS i0, max(seg_no) AS i1, sum(dur) AS dur, count(*) FILTER (role = 'development') AS dev, bool_or(role IN ('hook', 'setup')) AS op, max_by(role IN ('peak', 'payoff'), seg_no) AS cl FROM gs GROUP BY 1, 2, 3)""",
    _merge_pass("g0", "g1", "w.dur < 45 AND NOT (w.op AND w.cl AND w.dur >= 27)"),
    _merge_pass("g1", "g2", "NOT w.cl"),
    _merge_pass("g2", "g3", "w.dur < 62 AND w.dev < 2"),
)


@query(
    "w13_merge_groups",
    """, l AS (SELECT *, max(i) OVER (PARTITION BY source_id, arc_no) AS last, lead(dur) OVER (PARTITION BY source_id, arc_no ORDER BY i) AS nd, lead(i1) OVER (PARTITION BY source_id, arc_no ORDER BY i) AS ni, lag(dur) OVER (PARTITION BY source_id, arc_no ORDER BY i) AS pd FROM g3)
    SELECT source_id, arc_no, i AS plan_no, i0 AS first_seg, CASE WHEN i = last - 1 AND nd < 45 AND dur + nd <= 80 THEN ni ELSE i1 END AS last_seg, round(CASE WHEN i = last - 1 AND nd < 45 AND dur + nd <= 80 THEN dur + nd ELSE dur END, 6) AS dur
    FROM l WHERE NOT (i = last AND last > 0 AND dur < 45 AND pd + dur <= 80)""",
    _MERGE,
    recursive=True,
)
def _(spark, sf):
    s = T.arc_segments(spark, sf).withColumn("grp", F.floor(F.col("seg_no") / 2))
    m = G.merge_groups(s)
    return m.select("source_id", "arc_no", F.col("plan_no").cast("long").alias("plan_no"), "first_seg", "last_seg", *r6("dur"))


@query(
    "w18_audio_offsets",
    """SELECT source_id, arc_no, cut_no, round(a_start, 6) AS a_start, round(CASE WHEN nxt_off IS NULL THEN e ELSE e + nxt_off END, 6) AS a_end FROM (
      SELECT *, lead(off) OVER (PARTITION BY source_id, arc_no ORDER BY cut_no) AS nxt_off FROM wk)""",
    (
        ARCSEG,
        """ ct AS (SELECT source_id, arc_no, seg_no AS cut_no, CASE WHEN role = 'setup' THEN 'hook' ELSE role END AS role, seg_no * 0.5::DOUBLE AS s, seg_no * 0.5::DOUBLE + dur / 8 AS e FROM arcseg)""",
        """ wk AS (SELECT source_id, arc_no, cut_no, role, s, e, s AS a_start, 0.0::DOUBLE AS off FROM ct WHERE cut_no = 0
          UNION ALL SELECT source_id, arc_no, cut_no, role, s, e, s + o, o FROM (SELECT source_id, arc_no, cut_no, role, s, e, CASE WHEN role = pr OR round(abs(raw), 9) < 0.08 THEN 0 ELSE raw END AS o FROM (
            SELECT c.*, w.role AS pr, CASE WHEN (w.role || '>' || c.role) IN ('development>peak', 'hook>peak') THEN -least(0.4, (w.e - w.s) * 0.2, (c.e - c.s) * 0.2, greatest(0, c.s), greatest(0, w.e - w.a_start - 0.1))
              ELSE least(0.4, (w.e - w.s) * 0.2, (c.e - c.s) * 0.2, greatest(0, c.e - c.s - 0.1)) END::DOUBLE AS raw
            FROM wk w JOIN ct c ON c.source_id = w.source_id AND c.arc_no = w.arc_no AND c.cut_no = w.cut_no + 1)))""",
    ),
    recursive=True,
)
def _(spark, sf):
    s = T.arc_segments(spark, sf)
    c = s.select("source_id", "arc_no", F.col("seg_no").alias("cut_no"), F.when(F.col("role") == "setup", "hook").otherwise(F.col("role")).alias("role"),
                 (F.col("seg_no") * F.lit(0.5)).alias("c_start"), (F.col("seg_no") * F.lit(0.5) + F.col("dur") / 8).alias("c_end"))
    return G.audio_offsets(c, ["source_id", "arc_no"]).select("source_id", "arc_no", "cut_no", *r6("a_start", "a_end"))


@query(
    "w18_audio_offsets_everywhere",
    """SELECT source_id, arc_no, cut_no, round(a_start, 6) AS a_start, round(CASE WHEN nxt_off IS NULL THEN e ELSE e + nxt_off END, 6) AS a_end FROM (
      SELECT *, lead(off) OVER (PARTITION BY source_id, arc_no ORDER BY cut_no) AS nxt_off FROM wk)""",
    (
        ARCSEG,
        """ ct AS (SELECT source_id, arc_no, seg_no AS cut_no, CASE WHEN role = 'setup' THEN 'hook' ELSE role END AS role, seg_no * 0.5::DOUBLE AS s, seg_no * 0.5::DOUBLE + dur / 8 AS e FROM arcseg)""",
        """ wk AS (SELECT source_id, arc_no, cut_no, role, s, e, s AS a_start, 0.0::DOUBLE AS off FROM ct WHERE cut_no = 0
          UNION ALL SELECT source_id, arc_no, cut_no, role, s, e, s + o, o FROM (SELECT source_id, arc_no, cut_no, role, s, e, CASE WHEN round(abs(raw), 9) < 0.08 THEN 0 ELSE raw END AS o FROM (
            SELECT c.*, w.role AS pr, (least(0.4, (w.e - w.s) * 0.2, (c.e - c.s) * 0.2, greatest(0, c.e - c.s - 0.1)))::DOUBLE AS raw
            FROM wk w JOIN ct c ON c.source_id = w.source_id AND c.arc_no = w.arc_no AND c.cut_no = w.cut_no + 1)))""",
    ),
    recursive=True,
)
def _(spark, sf):
    s = T.arc_segments(spark, sf)
    c = s.select("source_id", "arc_no", F.col("seg_no").alias("cut_no"), F.when(F.col("role") == "setup", "hook").otherwise(F.col("role")).alias("role"),
                 (F.col("seg_no") * F.lit(0.5)).alias("c_start"), (F.col("seg_no") * F.lit(0.5) + F.col("dur") / 8).alias("c_end"))
    return G.audio_offsets(c, ["source_id", "arc_no"], every=True).select("source_id", "arc_no", "cut_no", *r6("a_start", "a_end"))


@query(
    "w18_jl_choice",
    """SELECT source_id, pos, CASE WHEN pos % 9 = 0 THEN 'j_cut' WHEN word LIKE '%?' THEN 'l_cut' WHEN nw IN ('итак', 'теперь') THEN 'j_cut' WHEN pos % 10 >= 7 THEN 'l_cut' ELSE 'hard' END AS kind,
      CASE WHEN pos % 9 = 0 THEN 0.3 WHEN word LIKE '%?' THEN 0.25 WHEN pos % 10 >= 7 THEN 0.3 WHEN word LIKE '%.' THEN 0.08 ELSE 0.05 END::DOUBLE AS off FROM (
        SELECT source_id, pos, word, lead(word) OVER (PARTITION BY source_id ORDER BY start, pos) AS nw FROM words) WHERE nw IS NOT NULL""",
    (WORDS,),
)
def _(spark, sf):
    from cadenza.operators.ordered import lead

    w = running(T.words(spark, sf), ["source_id"], ["start", "pos"], {"nw": lead("word")}).filter("nw is not null")
    kind, off = G.jl_choice(F.col("word"), F.col("nw"), F.col("pos") % 9 == 0, (F.col("pos") % 10) / F.lit(10.0))
    return w.select("source_id", "pos", kind.alias("kind"), off.alias("off"))


FLOW_SQL = """ o AS (SELECT *, coalesce(sum(seg_end - seg_start) OVER (PARTITION BY source_id, plan_no ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM seg),
  flow AS (SELECT *, row_number() OVER (PARTITION BY source_id, plan_no, seg_no ORDER BY pos) - 1 AS i FROM (SELECT o.source_id, plan_no, seg_no, pos, word, greatest(0, start - seg_start) + off AS ls, least(seg_end, "end") - seg_start + off AS le
      FROM o JOIN words w ON o.source_id = w.source_id AND w.start >= seg_start AND w.start < seg_end) WHERE le > ls)"""


def _cue_sql(opens: str) -> str:
    return f""" wk AS (SELECT source_id, plan_no, seg_no, i, 0::BIGINT AS cue, 1 AS n, length(word) AS c, ls AS s, le AS e, ls, word, regexp_matches(word, '[.!?…]$') AS stop FROM flow WHERE i = 0
      UNION ALL SELECT source_id, plan_no, seg_no, i, cue + CASE WHEN op THEN 1 ELSE 0 END, CASE WHEN op THEN 1 ELSE n + 1 END, CASE WHEN op THEN length(word) ELSE c + 1 + length(word) END, CASE WHEN op THEN ls ELSE s END, le, ls, word, regexp_matches(word, '[.!?…]$')
      FROM (SELECT f.*, w.cue, w.n, w.c, w.s, {opens} AS op FROM wk w JOIN flow f ON f.source_id = w.source_id AND f.plan_no = w.plan_no AND f.seg_no = w.seg_no AND f.i = w.i + 1))"""


_CUE_OUT = """SELECT source_id, plan_no, seg_no, cue AS cue_no, round(min(s), 6) AS start, round(max(e), 6) AS "end", string_agg(word, ' ' ORDER BY i) AS text FROM wk GROUP BY 1, 2, 3, 4"""


def _cues(spark, sf, mode):
    from cadenza.operators import series as S

    w = T.words(spark, sf)
    flow = S.remap_to_plan_time(w, plan_segments(w), ["source_id", "plan_no"], width=8.0)
    c = G.build_cues(flow, ["source_id", "plan_no"], ["pos"], mode=mode)
    return c.select("source_id", "plan_no", F.col("seg_no").cast("long").alias("seg_no"), F.col("cue_no").cast("long").alias("cue_no"), *r6("start", "end"), "text")


@query("w20_cues_legacy", _CUE_OUT, (WORDS, PLAN_SQL, FLOW_SQL, _cue_sql("w.stop OR w.n >= 6 OR round(w.e - w.s, 9) >= 3")), recursive=True)
def _(spark, sf):
    return _cues(spark, sf, "legacy")


@query("w20_cues_chars", _CUE_OUT, (WORDS, PLAN_SQL, FLOW_SQL, _cue_sql("w.stop OR w.c + 1 + length(f.word) > 40")), recursive=True)
def _(spark, sf):
    return _cues(spark, sf, "chars")


@query(
    "w20_wrapped_cues",
    f"""SELECT source_id, plan_no, seg_no, cue_no, CASE WHEN len(l) > 2 THEN l[1] || chr(10) || array_to_string(l[2:], ' ') ELSE array_to_string(l, chr(10)) END AS lines FROM (
      SELECT *, string_split(list_reduce([''] || list_filter(string_split(text, ' '), lambda x: x <> ''), lambda a, w: CASE WHEN a = '' THEN w
        WHEN length(w) < 20 AND length(regexp_extract(a, '[^\n]*$')) < 20 AND length(regexp_extract(a, '[^\n]*$')) + 1 + length(w) <= 20 THEN a || ' ' || w ELSE a || chr(10) || w END), chr(10)) AS l FROM ({_CUE_OUT}))""",
    (WORDS, PLAN_SQL, FLOW_SQL, _cue_sql("w.stop")),
    recursive=True,
)
def _(spark, sf):
    c = _cues(spark, sf, "sentence")
    return c.select("source_id", "plan_no", "seg_no", "cue_no", G.wrap_lines(F.col("text"), 2, 20).alias("lines"))


@query("w20_cues_sentence", _CUE_OUT, (WORDS, PLAN_SQL, FLOW_SQL, _cue_sql("w.stop")), recursive=True)
def _(spark, sf):
    return _cues(spark, sf, "sentence")


@query("w20_cues_word", _CUE_OUT, (WORDS, PLAN_SQL, FLOW_SQL, _cue_sql("true")), recursive=True)
def _(spark, sf):
    return _cues(spark, sf, "word")


TRACK = """ tr AS (SELECT source_id, i // 64 AS clip_no, i % 64 AS k, event_id AS t, least(1, value / 100) AS x FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t, event_id) - 1 AS i FROM points))"""


def _track(spark, sf):
    """Tracks of 64 consecutive samples: one clip each."""
    r = running(T.points(spark, sf), ["source_id"], ["t", "event_id"], {"_i": row_index()})
    return r.select("source_id", F.floor((F.col("_i") - 1) / 64).alias("clip_no"), F.col("event_id").cast("double").alias("t"), F.least(F.lit(1.0), F.col("value") / 100).alias("x"))


@query(
    "w21_smooth_track",
    """, n AS (SELECT source_id, clip_no, max(k) AS last FROM wk GROUP BY 1, 2),
      kw AS (SELECT source_id, clip_no, k, t, e, e AS kx, 0::BIGINT AS kn, true AS kept FROM wk WHERE k = 0
        UNION ALL SELECT w.source_id, w.clip_no, w.k, w.t, w.e, CASE WHEN mv THEN w.e ELSE p.kx END, p.kn + CASE WHEN mv THEN 1 ELSE 0 END, mv FROM (SELECT p.*, round(abs(w.e - p.kx), 9) >= 0.03 AS mv FROM kw p JOIN wk w ON w.source_id = p.source_id AND w.clip_no = p.clip_no AND w.k = p.k + 1 JOIN n ON n.source_id = p.source_id AND n.clip_no = p.clip_no AND w.k < n.last) p JOIN wk w ON w.source_id = p.source_id AND w.clip_no = p.clip_no AND w.k = p.k + 1),
      z AS (SELECT kw.source_id, kw.clip_no, max(kn) AS mk, max_by(kx, k) AS lx FROM kw GROUP BY 1, 2),
      f AS (SELECT z.*, wk.t AS lt, wk.e AS le, round(abs(wk.e - lx), 9) < 0.03 AS still, mk > 0 AS many FROM z JOIN n USING (source_id, clip_no) JOIN wk ON wk.source_id = z.source_id AND wk.clip_no = z.clip_no AND wk.k = n.last)
    SELECT kw.source_id, kw.clip_no, kn AS kf_no, CASE WHEN many AND still AND kn = mk THEN lt ELSE t END AS t, round(e, 6) AS x FROM kw JOIN f USING (source_id, clip_no) WHERE kept
    UNION ALL SELECT source_id, clip_no, mk + 1, lt, round(le, 6) FROM f WHERE many AND NOT still""",
    (POINTS, TRACK, """ wk AS (SELECT source_id, clip_no, k, t::DOUBLE AS t, x AS e FROM tr WHERE k = 0 UNION ALL SELECT tr.source_id, tr.clip_no, tr.k, tr.t, 0.2::DOUBLE * tr.x + 0.8::DOUBLE * w.e FROM wk w JOIN tr ON tr.source_id = w.source_id AND tr.clip_no = w.clip_no AND tr.k = w.k + 1)"""),
    recursive=True,
)
def _(spark, sf):
    s = G.smooth_track(_track(spark, sf), ["source_id", "clip_no"], "t", "x", alpha=0.2, dead_zone=0.03)
    return s.select("source_id", "clip_no", F.col("kf_no").cast("long").alias("kf_no"), "t", *r6("x"))


@query(
    "w32_spring_smooth",
    """SELECT source_id, clip_no, t, round(greatest(0, least(1, p)), 6) AS smooth FROM wk""",
    (
        POINTS, TRACK,
        """ tk AS (SELECT source_id, clip_no, k, k * 0.04::DOUBLE AS t, x FROM tr)""",
        """ w0 AS (SELECT source_id, clip_no, k, t, x, 0.001::DOUBLE AS dt FROM tk WHERE k = 0)""",
        """ wk AS (SELECT source_id, clip_no, k, t, (-64 * (0.5 - x)) * dt AS v, 0.5::DOUBLE + (-64 * (0.5 - x)) * dt * dt AS p FROM w0
          UNION ALL SELECT source_id, clip_no, k, t, v2, p + v2 * dt FROM (SELECT tk.source_id, tk.clip_no, tk.k, tk.t, w.p, greatest(0.001, tk.t - w.t) AS dt, w.v + (-64 * (w.p - tk.x) - 16 * w.v) * greatest(0.001, tk.t - w.t) AS v2
            FROM wk w JOIN tk ON tk.source_id = w.source_id AND tk.clip_no = w.clip_no AND tk.k = w.k + 1))""",
    ),
    recursive=True,
)
def _(spark, sf):
    r = running(T.points(spark, sf), ["source_id"], ["t", "event_id"], {"_i": row_index()})
    i = F.col("_i") - 1
    tr = r.select("source_id", F.floor(i / 64).alias("clip_no"), ((i % 64) * F.lit(0.04)).alias("t"), F.least(F.lit(1.0), F.col("value") / 100).alias("x"))
    return G.spring_smooth(tr, ["source_id", "clip_no"], "t", "x").select("source_id", "clip_no", "t", *r6("smooth"))


@query(
    "w27_trim_to_budget",
    """, t AS (SELECT source_id, arc_no, sum(dur) AS total, coalesce(sum(dur) FILTER (role IN ('hook', 'peak', 'payoff')), 0) AS need, min_by(id, seg_no) FILTER (role = 'hook') AS hook, max_by(id, seg_no) FILTER (role IN ('peak', 'payoff')) AS last_id FROM arcseg GROUP BY 1, 2),
      opt AS (SELECT a.*, need, row_number() OVER (PARTITION BY source_id, arc_no ORDER BY score DESC, seg_no) AS k FROM arcseg a JOIN t USING (source_id, arc_no) WHERE round(total, 9) > {L} AND round(need, 9) < {L} AND role NOT IN ('hook', 'peak', 'payoff')),
      walk AS (SELECT source_id, arc_no, k, id, round(dur, 9) <= round({L} - need, 9) AS keep, CASE WHEN round(dur, 9) <= round({L} - need, 9) THEN dur ELSE 0 END AS used FROM opt WHERE k = 1
        UNION ALL SELECT o.source_id, o.arc_no, o.k, o.id, round(w.used + o.dur, 9) <= round({L} - o.need, 9), CASE WHEN round(w.used + o.dur, 9) <= round({L} - o.need, 9) THEN w.used + o.dur ELSE w.used END
        FROM walk w JOIN opt o ON o.source_id = w.source_id AND o.arc_no = w.arc_no AND o.k = w.k + 1)
    SELECT a.source_id, a.arc_no, a.seg_no, a.id, a.role FROM arcseg a JOIN t USING (source_id, arc_no) LEFT JOIN walk w ON w.source_id = a.source_id AND w.arc_no = a.arc_no AND w.id = a.id
    WHERE CASE WHEN round(total, 9) <= {L} THEN true WHEN round(need, 9) < {L} THEN a.role IN ('hook', 'peak', 'payoff') OR coalesce(w.keep, false) ELSE coalesce(a.id = hook, false) OR coalesce(a.id = last_id, false) END""".replace("{L}", str(G.PLAN_MAX)),
    (ARCSEG,),
    recursive=True,
)
def _(spark, sf):
    s = T.arc_segments(spark, sf)
    return G.trim_to_budget(s, ["source_id", "arc_no"]).select("source_id", "arc_no", "seg_no", "id", "role")


@query(
    "d2_dedup_hybrid",
    """SELECT source_id, gone AS id FROM walk WHERE gone IS NOT NULL UNION ALL SELECT source_id, unnest(list_transform(st, lambda x: x.id)) FROM (SELECT source_id, max_by(st, k) AS st FROM walk GROUP BY 1)""",
    (
        DENSE,
        r""" ev AS (SELECT source_id, clip_id AS id, round(start / 20, 3) AS start, score / 10 AS strength, list_distinct(string_split(lower(topic || ' said ' || chunk), ' ')) AS w FROM dense)""",
        r""" rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start, strength DESC, id) AS k, {'id': id, 's': start, 'p': strength, 'w': w} AS me FROM ev)""",
        # st: the last five keepers; gone: the one that leaves them and so stays for good
        r""" walk AS (SELECT source_id, k, [me] AS st, NULL::BIGINT AS gone FROM rk WHERE k = 1
          UNION ALL SELECT source_id, k, CASE WHEN hit IS NULL AND len(st) >= 5 THEN list_append(st[2:], me) WHEN hit IS NULL THEN list_append(st, me)
              WHEN me.p > st[hit].p THEN list_transform(st, lambda x, i: CASE WHEN i = hit THEN me ELSE x END) ELSE st END, CASE WHEN hit IS NULL AND len(st) >= 5 THEN st[1].id END FROM (
            SELECT r.source_id, r.k, r.me, w.st, list_filter(range(1, len(w.st) + 1), lambda i: abs(w.st[i].s - r.me.s) < 3
              AND len(list_intersect(w.st[i].w, r.me.w))::DOUBLE / (len(w.st[i].w) + len(r.me.w) - len(list_intersect(w.st[i].w, r.me.w))) >= 0.5)[1] AS hit
            FROM walk w JOIN rk r ON r.source_id = w.source_id AND r.k = w.k + 1))""",
    ),
    recursive=True,
)
def _(spark, sf):
    d = T.dense_clips(spark, sf).select("source_id", F.col("clip_id").alias("id"), T.thousandths(F.col("start") / 20).alias("start"), (F.col("score") / 10).alias("strength"), F.concat_ws(" ", "topic", F.lit("said"), F.col("chunk").cast("string")).alias("text"))
    return D.dedup_hybrid(d).select("source_id", "id")


_GLUE = "{{'s': {a}.s, 'e': {b}.e, 'c': least({a}.c, {b}.c)}}"


@query(
    "w10_chapters",
    """SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY s) AS ch_no, round(s, 6) AS start, round(e, 6) AS "end", round(c, 6) AS confidence FROM halves WHERE round(e - s, 9) <= 300""",
    (
        SENTENCES,
        """ pts AS (SELECT source_id, "end" AS p, (sent % 5) / 5.0::DOUBLE AS c, false AS is_end FROM sentences WHERE sent % 13 = 5)""",
        """ d AS (SELECT source_id, max("end") AS duration, list(DISTINCT "end" ORDER BY "end") AS ends FROM sentences GROUP BY 1)""",
        """ allp AS (SELECT * FROM pts UNION ALL SELECT source_id, duration, CASE WHEN source_id IN (SELECT source_id FROM pts) THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END, true FROM d)""",
        """ b AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY is_end, p, c) AS i FROM allp)""",
        """ ch AS MATERIALIZED (SELECT source_id, list({'s': s, 'e': p, 'c': c} ORDER BY i) AS l FROM (SELECT *, coalesce(lag(p) OVER (PARTITION BY source_id ORDER BY i), 0.0) AS s FROM b) GROUP BY 1)""",
        f""" mg AS (SELECT source_id, l, 0::BIGINT AS i, 0::BIGINT AS used, list_filter(l, lambda x: false) AS done FROM ch
          UNION ALL SELECT source_id, l, i + 1,
            CASE WHEN used > i THEN used WHEN short AND NOT coalesce(into_left, false) AND rt IS NOT NULL THEN i + 2 ELSE i + 1 END,
            CASE WHEN used > i THEN done WHEN NOT short THEN list_append(done, x) WHEN into_left THEN list_append(done[1:len(done) - 1], {_GLUE.format(a='done[len(done)]', b='x')})
              WHEN rt IS NOT NULL THEN list_append(done, {_GLUE.format(a='x', b='rt')}) ELSE list_append(done, x) END
          FROM (SELECT *, l[i + 1] AS x, l[i + 2] AS rt, round(l[i + 1].e - l[i + 1].s, 9) < 60 AS short, len(done) > 0 AND (l[i + 2] IS NULL OR done[len(done)].c <= l[i + 2].c) AS into_left FROM mg WHERE i < len(l)))""",
        """ merged AS (SELECT source_id, x.s AS s, x.e AS e, x.c AS c FROM (SELECT source_id, unnest(done) AS x FROM mg WHERE i = len(l)))""",
        # the nearest end within 15 s of the middle, the earlier of two, else the middle
        """ halves AS (SELECT source_id, s, e, c FROM merged UNION ALL
          SELECT source_id, unnest([s, p]), unnest([p, e]), c * 0.9::DOUBLE FROM (
            SELECT source_id, s, e, c, CASE WHEN near > s AND near < e THEN near ELSE (s + e) / 2 END AS p FROM (
              SELECT h.*, list_sort(list_transform(list_filter(d.ends, lambda x: abs(x - (s + e) / 2) <= 15), lambda x: {'far': abs(x - (s + e) / 2), 'x': x}))[1].x AS near
              FROM halves h JOIN d ON d.source_id = h.source_id WHERE round(e - s, 9) > 300)))""",
    ),
    recursive=True,
)
def _(spark, sf):
    s = T.sentences(spark, sf)
    b = s.filter(F.col("sent") % 13 == 5).select("source_id", F.col("end").alias("at"), ((F.col("sent") % 5) / F.lit(5.0)).alias("confidence"))
    return G.chapters(b, word_duration(s), s).select("source_id", "ch_no", *r6("start", "end", "confidence"))


@query(
    "w10_fixed_chapters",
    """, d AS (SELECT source_id, max("end") AS duration, greatest(1, round_even(max("end") / 180, 0))::INT AS n FROM words GROUP BY 1), x AS (SELECT *, unnest(range(n)) AS i FROM d)
    SELECT source_id, (i + 1)::INT AS ch_no, round(i * (duration / n), 6) AS start, round(CASE WHEN i = n - 1 THEN duration ELSE (i + 1) * (duration / n) END, 6) AS "end" FROM x""",
    (WORDS,),
)
def _(spark, sf):
    return G.fixed_chapters(word_duration(T.words(spark, sf))).select("source_id", "ch_no", *r6("start", "end"))
