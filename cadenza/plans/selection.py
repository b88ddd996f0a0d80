"""Conflict filters, clusters and diverse ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.text import tokens
from cadenza.operators import rank as K
from cadenza.operators import select as X
from cadenza.operators.ordered import row_index, running
from cadenza.plans.registry import CLIPS, DENSE, VECTORS, query
from cadenza.plans.windows import clip_duration, r6
from cadenza.sources import tables as T


def greedy_sql(src: str, key: str, order: str, payload: str, ok: str) -> tuple[str, str]:
    """SQL: walk rows of ``src`` per key in ``order``; ``ok`` decides over (w.acc, r.*) whether a row is accepted."""
    return (
        f""" rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM {src})""",
        f""" walk AS (SELECT {', '.join('r.' + c.strip() for c in key.split(','))}, r.k, r.rid, true AS keep, [{payload}] AS acc FROM rk r WHERE k = 1
          UNION ALL SELECT {', '.join('r.' + c.strip() for c in key.split(','))}, r.k, r.rid, {ok}, CASE WHEN {ok} THEN list_append(w.acc, {payload}) ELSE w.acc END
          FROM walk w JOIN rk r ON {' AND '.join(f'r.{c.strip()} = w.{c.strip()}' for c in key.split(','))} AND r.k = w.k + 1)""",
    )


_OV = "greatest(0, least(a.e, r.e) - greatest(a.s, r.s))"
_NMS_OK = f"len(list_filter(w.acc, lambda a: round({_OV} - 0.4::DOUBLE * least(a.e - a.s, r.e - r.s), 9) > 0)) = 0"


@query(
    "d3_nms_overlap",
    "SELECT source_id, rid AS clip_id FROM walk WHERE keep",
    (DENSE, ' src AS (SELECT source_id, clip_id AS rid, score, start AS s, "end" AS e FROM dense)', *greedy_sql("src", "source_id", "score DESC, rid", "{'s': r.s, 'e': r.e}", _NMS_OK)),
    recursive=True,
)
def _(spark, sf):
    return X.nms_overlap(T.dense_clips(spark, sf), id="clip_id", score="score").select("source_id", "clip_id")


@query(
    "d9_dedup_hooks",
    "SELECT source_id, chapter, rid AS clip_id FROM walk WHERE keep",
    (DENSE, ' src AS (SELECT source_id, floor(start / 600)::BIGINT AS chapter, clip_id AS rid, score, start AS s, "end" AS e FROM dense)',
     *greedy_sql("src", "source_id, chapter", "score DESC, rid", "{'s': r.s, 'e': r.e}", _NMS_OK.replace("0.4::DOUBLE", "0.5::DOUBLE"))),
    recursive=True,
)
def _(spark, sf):
    h = T.dense_clips(spark, sf).withColumn("chapter", F.floor(F.col("start") / 600))
    h = h.withColumn("_ch", F.concat_ws("|", F.col("source_id").cast("string"), F.col("chapter").cast("string")))
    return X.nms_overlap(h, id="clip_id", score="score", key="_ch", limit=0.5).select("source_id", "chapter", "clip_id")


TOKENS_SQL = r"list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: length(t) >= 3))"
_JAC = "len(list_intersect(a, r.tok))::DOUBLE / (len(a) + len(r.tok) - len(list_intersect(a, r.tok)))"


@query(
    "d4_dedup_jaccard",
    "SELECT source AS source_id, rid AS doc_id FROM walk WHERE keep",
    (f" src AS (SELECT source, doc_id AS rid, n_chars, {TOKENS_SQL} AS tok FROM documents)",
     *greedy_sql("src", "source", "n_chars DESC, rid", "r.tok", f"len(r.tok) = 0 OR len(list_filter(w.acc, lambda a: len(a) > 0 AND round({_JAC} - 0.85, 9) > 0)) = 0")),
    recursive=True,
)
def _(spark, sf):
    d = T.table(spark, sf, "documents").select(F.col("source").alias("source_id"), "doc_id", "n_chars", tokens(F.col("text")).alias("tok"))
    return X.dedup_jaccard(d, id="doc_id", rank=[-F.col("n_chars")], tokens="tok", threshold=0.85).select("source_id", "doc_id")


@query(
    "j15_similar_pairs",
    f""", s AS (SELECT source, doc_id, list_sort({TOKENS_SQL}) AS tok FROM documents),
      rep AS (SELECT source, tok, min(doc_id) AS rid FROM s WHERE len(tok) > 0 GROUP BY 1, 2)
    SELECT a.source AS source_id, a.rid AS id_a, b.rid AS id_b, round(len(list_intersect(a.tok, b.tok))::DOUBLE / (len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok))), 6) AS sim
    FROM rep a JOIN rep b ON a.source = b.source AND a.rid < b.rid AND least(len(a.tok), len(b.tok)) >= 0.5 * greatest(len(a.tok), len(b.tok)) WHERE round(len(list_intersect(a.tok, b.tok))::DOUBLE / (len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok))) - 0.5, 9) >= 0
    UNION ALL SELECT s.source, rid, doc_id, 1.0 FROM s JOIN rep ON s.source = rep.source AND s.tok = rep.tok WHERE doc_id <> rid""".replace(", s AS", "WITH s AS", 1),
)
def _(spark, sf):
    d = T.table(spark, sf, "documents").select(F.col("source").alias("source_id"), "doc_id", tokens(F.col("text")).alias("tok"))
    return X.similar_pairs(d, id="doc_id", tokens="tok", threshold=0.5).withColumn("sim", F.round("sim", 6))


def vector_pairs_sql(key: str, vec: str, threshold: float) -> str:
    """SQL: pairs of different vectors of a key, and copies with the smallest id of their vector."""
    return f"""WITH v AS (SELECT {key} AS k, vec_id, {vec}::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
      s AS MATERIALIZED (SELECT * FROM v WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
      rep AS MATERIALIZED (SELECT k, v, min(vec_id) AS rid FROM s GROUP BY 1, 2)
    SELECT a.k AS source_id, a.rid AS id_a, b.rid AS id_b, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM rep a JOIN rep b ON a.k = b.k AND a.rid < b.rid AND len(a.v) = len(b.v) WHERE round(list_cosine_similarity(a.v, b.v) - {threshold}, 9) >= 0
    UNION ALL SELECT s.k, rid, vec_id, 1.0 FROM s JOIN rep USING (k, v) WHERE vec_id <> rid"""


@query("j15_similar_vectors", vector_pairs_sql("label", "embedding", 0.3))
def _(spark, sf):
    return X.similar_pairs(T.vectors(spark, sf), id="item_id", vec="v", metric="cosine", threshold=0.3).withColumn("sim", F.round("sim", 6))


# the first components only, over all labels: close pairs exist there, and regions separate
@query("j15_similar_short_vectors", vector_pairs_sql("0", "embedding[:6]", 0.95))
def _(spark, sf):
    v = T.vectors(spark, sf).filter("source_id is not null").withColumns({"source_id": F.lit(0), "v": F.slice("v", 1, 6)})
    return X.similar_pairs(v, id="item_id", vec="v", metric="cosine", threshold=0.95).withColumn("sim", F.round("sim", 6))


PLANS = """ pl AS (SELECT source_id, i // 2 AS p, min(clip_id) AS rid, avg(score) AS score, list({'s': round(start / 20, 3), 'e': round(round(start / 20, 3) + "end" - start, 3)} ORDER BY clip_id) AS segs FROM (
   SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start, clip_id) - 1 AS i FROM dense) GROUP BY 1, 2)"""


def plans(spark, sf):
    """Plans of two neighbouring clips on a crowded time axis."""
    d = running(T.dense_clips(spark, sf), ["source_id"], ["start", "clip_id"], {"_i": row_index()})
    s = T.thousandths(F.col("start") / 20)
    seg = F.struct("clip_id", s.alias("s"), F.round(s + F.col("end") - F.col("start"), 3).alias("e"))
    p = d.groupBy("source_id", F.floor((F.col("_i") - 1) / 2).alias("p")).agg(
        F.min("clip_id").alias("plan_id"), F.avg("score").alias("score"), F.sort_array(F.collect_list(seg)).alias("_s")
    )
    return p.withColumn("segs", F.transform("_s", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))).drop("_s", "p")


_INT = "list_sum(list_transform(a, lambda x: list_sum(list_transform(r.segs, lambda y: greatest(0, least(x.e, y.e) - greatest(x.s, y.s))))))"
_LEN = "list_sum(list_transform({}, lambda x: x.e - x.s))"


@query(
    "d5_dedup_iou",
    "SELECT source_id, rid AS plan_id FROM walk WHERE keep",
    (DENSE, PLANS, *greedy_sql("pl", "source_id", "score DESC, rid", "r.segs", f"len(list_filter(w.acc, lambda a: round({_INT} - 0.4 * ({_LEN.format('a')} + {_LEN.format('r.segs')} - {_INT}), 9) >= 0)) = 0")),
    recursive=True,
)
def _(spark, sf):
    return X.dedup_iou(plans(spark, sf), id="plan_id", score="score", threshold=0.4).select("source_id", "plan_id")


RICH = """ rich AS (SELECT pl.source_id, rid, score, segs, e.embedding::DOUBLE[] AS vec, """ + TOKENS_SQL.replace("lower(text)", "lower(d.text)") + """ AS tok FROM pl JOIN embeddings e ON e.vec_id = rid // 20 JOIN documents d ON d.doc_id = rid // 10)"""


def rich_plans(spark, sf):
    p = plans(spark, sf)
    e = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("_vid"), F.col("embedding").cast("array<double>").alias("vec"))
    d = T.table(spark, sf, "documents").select(F.col("doc_id").alias("_did"), tokens(F.col("text")).alias("tokens"))
    p = p.withColumns({"_vid": F.floor(F.col("plan_id") / 20), "_did": F.floor(F.col("plan_id") / 10)})
    return p.join(e, "_vid").join(d, "_did").select("source_id", "plan_id", "score", "segs", "vec", "tokens")


def _plan_ok(jac: float, cos: float, ov: float) -> str:
    seg = f"len(list_filter(r.segs, lambda y: len(list_filter(a.segs, lambda x: round(greatest(0, least(x.e, y.e) - greatest(x.s, y.s)) / greatest(0.000001, y.e - y.s) - {ov}, 9) >= 0)) > 0)) > 0"
    jc = "len(list_intersect(a.tok, r.tok))::DOUBLE / (len(a.tok) + len(r.tok) - len(list_intersect(a.tok, r.tok)))"
    return f"len(list_filter(w.acc, lambda a: ({seg}) OR round(list_cosine_similarity(a.vec, r.vec) - {cos}, 9) >= 0 OR (len(r.tok) >= 8 AND round({jc} - {jac}, 9) >= 0))) = 0"


def _plan_level(jac: float, cos: float, ov: float) -> str:
    """SQL: 1, 2 or 3 for the first level at which an accepted plan rejects ``r``, 0 for none."""
    seg = f"len(list_filter(w.acc, lambda a: len(list_filter(r.segs, lambda y: len(list_filter(a.segs, lambda x: round(greatest(0, least(x.e, y.e) - greatest(x.s, y.s)) / greatest(0.000001, y.e - y.s) - {ov}, 9) >= 0)) > 0)) > 0)) > 0"
    near = f"len(list_filter(w.acc, lambda a: round(list_cosine_similarity(a.vec, r.vec) - {cos}, 9) >= 0)) > 0"
    jc = "len(list_intersect(a.tok, r.tok))::DOUBLE / (len(a.tok) + len(r.tok) - len(list_intersect(a.tok, r.tok)))"
    return f"CASE WHEN {seg} THEN 1 WHEN {near} THEN 2 WHEN len(r.tok) >= 8 AND len(list_filter(w.acc, lambda a: round({jc} - {jac}, 9) >= 0)) > 0 THEN 3 ELSE 0 END"


def _plan_walk(name: str, src: str, jac: float) -> tuple[str, str]:
    lv = _plan_level(jac, 0.88, 0.30)
    return (
        f""" {name}k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, rid) AS k FROM {src})""",
        f""" {name} AS (SELECT source_id, k, rid, 0 AS lv, [{_RICH_PAY.replace('r.', '')}] AS acc FROM {name}k WHERE k = 1
          UNION ALL SELECT source_id, k, rid, lv, CASE WHEN lv = 0 THEN list_append(acc, pay) ELSE acc END FROM (
            SELECT r.source_id, r.k, r.rid, {lv} AS lv, w.acc, {_RICH_PAY} AS pay FROM {name} w JOIN {name}k r ON r.source_id = w.source_id AND r.k = w.k + 1))""",
    )


_RICH_PAY = "{'segs': r.segs, 'vec': r.vec, 'tok': r.tok}"


@query(
    "d6_unique_plans",
    "SELECT source_id, rid AS plan_id, pick FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY k) AS pick FROM walk WHERE keep) WHERE pick <= 12",
    (DENSE, PLANS, RICH, *greedy_sql("rich", "source_id", "score DESC, rid", _RICH_PAY, _plan_ok(0.65, 0.88, 0.30))),
    recursive=True,
)
def _(spark, sf):
    return X.unique_plans(rich_plans(spark, sf), cap=F.lit(12)).select("source_id", "plan_id", "pick")


@query(
    "d6_reject_levels",
    """SELECT source_id, count(*) FILTER (lv = 1) AS reused_span, count(*) FILTER (lv = 2) AS near_vector, count(*) FILTER (lv = 3) AS same_words FROM walk WHERE lv > 0 GROUP BY 1""",
    (DENSE, PLANS, RICH, *_plan_walk("walk", "rich", 0.65)),
    recursive=True,
)
def _(spark, sf):
    p = rich_plans(spark, sf)
    return X.reject_levels(p, X.unique_plans(p))


@query(
    "d6_unique_plans_loose",
    "SELECT source_id, rid AS plan_id FROM walk WHERE keep",
    (DENSE, PLANS, RICH, *greedy_sql("rich", "source_id", "score DESC, rid", _RICH_PAY, _plan_ok(0.88, 0.92, 1.01))),
    recursive=True,
)
def _(spark, sf):
    return X.unique_plans(rich_plans(spark, sf), params=X.LOOSE).select("source_id", "plan_id")


@query(
    "d6b_unique_plans_relaxed",
    """SELECT source_id, plan_id, pick, false AS relaxed FROM one WHERE source_id NOT IN (SELECT source_id FROM few) UNION ALL
    SELECT source_id, rid, row_number() OVER (PARTITION BY source_id ORDER BY k) AS pick, true FROM again WHERE lv = 0 QUALIFY pick <= 12""",
    (
        DENSE, PLANS, RICH, *_plan_walk("walk", "rich", 0.65),
        " one AS MATERIALIZED (SELECT source_id, rid AS plan_id, row_number() OVER (PARTITION BY source_id ORDER BY k) AS pick FROM walk WHERE lv = 0 QUALIFY pick <= 12)",
        " few AS MATERIALIZED (SELECT source_id FROM one GROUP BY 1 HAVING count(*) < 6)",
        " poor AS MATERIALIZED (SELECT * FROM rich WHERE source_id IN (SELECT source_id FROM few))",
        *_plan_walk("again", "poor", 0.8),
    ),
    recursive=True,
)
def _(spark, sf):
    return X.unique_plans_relaxed(rich_plans(spark, sf), low=F.lit(6), cap=F.lit(12)).select("source_id", "plan_id", "pick", "relaxed")


@query(
    "d7_dedup_within_plan",
    "SELECT source_id, chunk, rid AS clip_id FROM walk WHERE keep",
    (DENSE, ' src AS (SELECT source_id, chunk, clip_id AS rid, round(start / 20, 3) AS s, round(start / 20, 3) + "end" - start AS e FROM dense)',
     *greedy_sql("src", "source_id, chunk", "rid", "{'s': r.s, 'e': r.e}", f"len(list_filter(w.acc, lambda a: round({_OV} / greatest(0.000001, r.e - r.s) - 0.6, 9) >= 0)) = 0")),
    recursive=True,
)
def _(spark, sf):
    d = T.dense_clips(spark, sf)
    s = T.thousandths(F.col("start") / 20)
    d = d.withColumns({"s": s, "e": s + F.col("end") - F.col("start")})
    return X.dedup_within_plan(d, plan=["source_id", "chunk"], seg="clip_id", id="clip_id", start="s", end="e").select("source_id", "chunk", "clip_id")


@query(
    "d8_cap_by_duration",
    """SELECT source_id, rid AS plan_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY k) AS pick FROM walk WHERE keep) JOIN (SELECT source_id, max("end") / 60 AS m FROM dense GROUP BY 1) USING (source_id)
    WHERE pick <= CASE WHEN m < 10 THEN 8 WHEN m < 15 THEN 15 WHEN m < 30 THEN 20 WHEN m < 60 THEN 25 ELSE 30 END""",
    (DENSE, PLANS, RICH, *greedy_sql("rich", "source_id", "score DESC, rid", "r.tok", f"len(r.tok) = 0 OR len(list_filter(w.acc, lambda a: len(a) > 0 AND round({_JAC} - 0.7, 9) >= 0)) = 0")),
    recursive=True,
)
def _(spark, sf):
    d = T.dense_clips(spark, sf)
    return X.cap_by_duration(rich_plans(spark, sf), clip_duration(d)).select("source_id", "plan_id")


def ranked_pool(spark, sf):
    """All vectors, numbered per source in the order in which clusters are opened."""
    return running(T.vectors(spark, sf), ["source_id"], ["item_id"], {"_i": row_index()})


_SUM = "{'s': list_transform(range(1, len(r.v) + 1), lambda j: x.s[j] + r.v[j]), 'n': x.n + 1}"


@query(
    "d12_leader_clusters",
    """SELECT source_id, item_id, c::BIGINT AS cluster FROM walk""",
    (
        VECTORS,
        """ rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY item_id) AS k FROM vectors)""",
        f""" walk AS (SELECT source_id, k, item_id, 0::BIGINT AS c, [{{'s': v, 'n': 1}}] AS st FROM rk WHERE k = 1
          UNION ALL SELECT source_id, k, item_id, coalesce(hit, len(st) + 1) - 1, CASE WHEN hit IS NULL THEN list_append(st, {{'s': v, 'n': 1}}) ELSE list_transform(st, lambda x, i: CASE WHEN i = hit THEN {_SUM.replace('r.v', 'v')} ELSE x END) END FROM (
            SELECT r.source_id, r.k, r.item_id, r.v, w.st, list_filter(range(1, len(w.st) + 1), lambda i: round(list_cosine_similarity(r.v, w.st[i].s) - 0.3, 9) >= 0)[1] AS hit
            FROM walk w JOIN rk r ON r.source_id = w.source_id AND r.k = w.k + 1))""",
    ),
    recursive=True,
)
def _(spark, sf):
    return X.leader_clusters(ranked_pool(spark, sf), threshold=0.3)


def novel_arcs(spark, sf):
    v = T.vectors(spark, sf)
    i = F.col("item_id")
    return v.select(
        "source_id", i.alias("arc_id"), F.floor(i / 20).alias("chapter"), (i % 4).cast("string").alias("kind"), ((i * 7 % 10) / F.lit(10.0)).alias("hook_score"),
        ((i * 3 % 10) / F.lit(10.0)).alias("arc_score"), F.lit(0.0).alias("start"), (25 + i % 55).cast("double").alias("end"), "v",
    )


def _novel_walk(name: str, start: str, sim: str, limit: float, ok: str, no: int) -> tuple[str, ...]:
    """SQL: one pass over ``rk``; ``start`` gives (source_id, acc)."""
    entry = f"{{'arc': r.arc_id, 'chapter': r.chapter, 'kind': r.kind, 'w': r.w, 'comp': r.comp, 'nov': nov, 'pass': {no}}}"
    nov = f"greatest(0, least(1, 1 - greatest(0, coalesce(list_max(list_transform(w.acc, lambda a: {sim})), 0))))"
    return (
        f""" {name} AS (SELECT source_id, 0::BIGINT AS k, acc FROM {start}
          UNION ALL SELECT source_id, k, CASE WHEN len(acc) < 10 AND fits AND round(nov - (1 - {limit}), 9) >= 0 THEN list_append(acc, {entry.replace('r.', '')}) ELSE acc END FROM (
            SELECT r.*, w.acc, {nov} AS nov, {ok} AS fits FROM {name} w JOIN rk r ON r.source_id = w.source_id AND r.k = w.k + 1))""",
        f""" {name}e AS MATERIALIZED (SELECT source_id, max_by(acc, k) AS acc FROM {name} GROUP BY 1)""",
    )


def novel_sql(src: str, sim: str, limit: float) -> tuple[str, ...]:
    fit = 'CASE WHEN "end" - start <= 42 THEN 0.5::DOUBLE + 0.5::DOUBLE * ("end" - start - 28) / 14 ELSE 1 - 0.5::DOUBLE * ("end" - start - 42) / 33 END'
    return (
        src,
        f""" rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(comp, 9) DESC, arc_id) AS k FROM (
          SELECT *, 0.4::DOUBLE * hook_score + 0.4::DOUBLE * arc_score + 0.2::DOUBLE * ({fit}) AS comp FROM arcs WHERE "end" - start BETWEEN 28 AND 75))""",
        """ begin AS (SELECT DISTINCT source_id, list_filter([{'arc': arc_id, 'chapter': chapter, 'kind': kind, 'w': w, 'comp': comp, 'nov': comp, 'pass': 1}], lambda x: false) AS acc FROM rk WHERE k = 1)""",
        *_novel_walk("first", "begin", sim, limit, "len(list_filter(w.acc, lambda a: a.kind = r.kind)) < 2", 1),
        *_novel_walk("second", "firste", sim, 0.85, "len(list_filter(w.acc, lambda a: a.chapter = r.chapter)) = 0", 2),
    )


NOVEL = """SELECT source_id, x.arc AS arc_id, i AS rank, round(x.comp * x.nov, 6) AS final_score, round(x.nov, 6) AS novelty, x.pass::BIGINT AS pass_no
    FROM (SELECT source_id, unnest(range(1, len(acc) + 1)) AS i, unnest(acc) AS x FROM seconde)"""
_ARC = """item_id AS arc_id, item_id // 20 AS chapter, (item_id % 4)::VARCHAR AS kind, (item_id * 7 % 10) / 10.0::DOUBLE AS hook_score, (item_id * 3 % 10) / 10.0::DOUBLE AS arc_score, 0.0::DOUBLE AS start, (25 + item_id % 55)::DOUBLE AS "end\""""
_ARC_V = f""" arcs AS (SELECT source_id, {_ARC}, v AS w FROM vectors)"""
_WSIM = "CASE WHEN len(a.w) = 0 OR len(r.w) = 0 THEN 0 ELSE len(list_intersect(a.w, r.w))::DOUBLE / (len(a.w) + len(r.w) - len(list_intersect(a.w, r.w))) END"
_ARC_W = f""" arcs AS (SELECT source_id, {_ARC}, {TOKENS_SQL} AS w FROM (SELECT v.*, substr(d.text, 1, 200) AS text FROM vectors v JOIN documents d ON d.doc_id = v.item_id % 40))"""


@query("k4_rank_novel", NOVEL, (VECTORS, *novel_sql(_ARC_V, "list_cosine_similarity(r.w, a.w)", 0.72)), recursive=True)
def _(spark, sf):
    return X.rank_novel(novel_arcs(spark, sf), target=10).select("source_id", "arc_id", "rank", *r6("final_score", "novelty"), "pass_no")


# five arcs share an opening each, so many are alike by words
@query("k4_rank_novel_by_words", NOVEL, (VECTORS, *novel_sql(_ARC_W, _WSIM, 0.6)), recursive=True)
def _(spark, sf):
    d = T.table(spark, sf, "documents").select(F.col("doc_id").alias("_d"), tokens(F.substring("text", 1, 200)).alias("tokens"))
    a = novel_arcs(spark, sf).withColumn("_d", F.col("arc_id") % 40).join(d, "_d").drop("_d")
    return X.rank_novel(a, target=10, words=True).select("source_id", "arc_id", "rank", *r6("final_score", "novelty"), "pass_no")


ANCHORS = """ q AS (SELECT source_id AS query_id, list(m ORDER BY i) AS qv FROM (SELECT source_id, i, avg(x) AS m FROM (SELECT source_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM vectors) GROUP BY 1, 2) GROUP BY 1),
  j AS (SELECT query_id, item_id, list_cosine_similarity(v, qv) AS cos FROM vectors, q)"""


def anchors(v):
    """One query vector per label: its centroid."""
    from cadenza.functions.vector import centroid

    return centroid(v, ["source_id"], "v", dim=64).select(F.col("source_id").alias("query_id"), F.col("centroid").alias("qv"))


@query(
    "k5_vector_topk",
    """SELECT query_id, item_id, round(cos, 6) AS cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, item_id) AS rank FROM j) WHERE rank <= 10""",
    (VECTORS, ANCHORS),
)
def _(spark, sf):
    v = T.vectors(spark, sf)
    return K.vector_topk(v, anchors(v), 10).select("query_id", "item_id", *r6("cos"), "rank")


@query(
    "k5_vector_topk_min_cosine",
    """SELECT query_id, item_id, round(cos, 6) AS cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, item_id) AS rank FROM j WHERE cos >= 0.2) WHERE rank <= 25""",
    (VECTORS, ANCHORS),
)
def _(spark, sf):
    v = T.vectors(spark, sf)
    return K.vector_topk(v, anchors(v), 25, min_cos=0.2).select("query_id", "item_id", *r6("cos"), "rank")


CATS = """ ranked AS (SELECT source_id, clip_id AS id, start, "end", score, CASE topic WHEN 'click' THEN 'hook_candidate' WHEN 'view' THEN 'development_material' WHEN 'purchase' THEN 'peak_candidate' WHEN 'signup' THEN 'payoff_candidate' ELSE 'cutaway_material' END AS category FROM clips)"""


def ranked(spark, sf):
    t = F.col("topic")
    cat = (
        F.when(t == "click", "hook_candidate").when(t == "view", "development_material").when(t == "purchase", "peak_candidate")
        .when(t == "signup", "payoff_candidate").otherwise("cutaway_material")
    )
    return T.clips(spark, sf).select("source_id", F.col("clip_id").alias("id"), "start", "end", "score", cat.alias("category"))


@query(
    "k7_quota_arc",
    """, a AS (SELECT source_id, id, category, row_number() OVER (PARTITION BY source_id, category ORDER BY score DESC, id) AS k FROM ranked),
      b AS (SELECT *, CASE WHEN category = 'hook_candidate' AND k <= 1 THEN 0 WHEN category = 'development_material' AND k <= 2 THEN 1 WHEN category = 'development_material' AND k = 3 THEN 2
        WHEN category = 'peak_candidate' AND k <= 2 THEN 3 WHEN category = 'payoff_candidate' AND k <= 1 THEN 4 WHEN category = 'cutaway_material' AND k <= 2 THEN 5 END AS p FROM a),
      c AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY p, k) AS position FROM b WHERE p IS NOT NULL)
    SELECT source_id, id, ['hook', 'setup', 'development', 'peak', 'payoff', 'development'][p + 1] AS role, position FROM c WHERE p < 5 OR position <= 5""",
    (CLIPS, CATS),
)
def _(spark, sf):
    return X.quota_arc(ranked(spark, sf))
