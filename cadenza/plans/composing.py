"""Plan assembly and validation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import compose as C
from cadenza.operators import rank as K
from cadenza.operators import validate as V
from cadenza.operators.segment import split_arcs
from cadenza.operators.select import leader_clusters
from cadenza.plans.folds import T
from cadenza.plans.registry import ARCSEG, CLIPS, DENSE, EVIDENCE, ORACLES, WORDS, query
from cadenza.plans.selection import CATS, ranked, ranked_pool
from cadenza.plans.windows import AGENTS, clip_duration, r6

PAD = "(id % 256) / 255.0::DOUBLE * 10"


def pad():
    return (F.col("id") % 256) / F.lit(255.0) * 10


def bounds_sql(src: str) -> str:
    """SQL: span repair over ``src`` (source_id, id, start, end, duration, ...)."""
    return f""" b0 AS (SELECT *, greatest(0, least(start, duration)) AS s, greatest(0, least("end", duration)) AS e FROM {src}),
      b1 AS (SELECT *, e - s AS len, 45 + {PAD} AS goal, greatest(0, (s + e) / 2 - 40) AS ls0 FROM b0 WHERE "end" > start AND duration > 0 AND e > s),
      b2 AS (SELECT *, least(duration, ls0 + 80) AS le, greatest(0, s - (goal - len) / 2) AS ps, least(duration, e + (goal - len) / 2) AS pe FROM b1),
      b3 AS (SELECT *, greatest(0, goal - (pe - ps)) AS miss FROM b2),
      b4 AS (SELECT *, CASE WHEN ps <= 0 THEN least(duration, pe + miss) ELSE pe END AS qe, CASE WHEN ps > 0 AND pe >= duration THEN greatest(0, ps - miss) ELSE ps END AS qs FROM b3),
      nb AS (SELECT *, CASE WHEN len > 80 THEN greatest(0, le - 80) WHEN len >= 45 THEN s WHEN round(qe - qs, 9) >= 45 THEN qs END AS n_start, CASE WHEN len > 80 THEN le WHEN len >= 45 THEN e WHEN round(qe - qs, 9) >= 45 THEN qe END AS n_end FROM b4)"""


def short_bounds_sql(src: str, low: float, high: float) -> str:
    """SQL: span repair without jitter between ``low`` and ``high`` over ``src``."""
    return bounds_sql(src).replace(f"45 + {PAD}", f"{low}").replace("/ 2 - 40", f"/ 2 - {high / 2}").replace("ls0 + 80", f"ls0 + {high}").replace("len > 80", f"len > {high}").replace("le - 80", f"le - {high}").replace("len >= 45", f"len >= {low}").replace(">= 45 THEN", f">= {low} THEN")


def thematic_sql(src: str) -> tuple[str, ...]:
    """SQL: plans of clusters over ``src`` (source_id, cluster, id, start, end, category, score, duration)."""
    return (
        f""" big AS (SELECT source_id, cluster FROM (SELECT source_id, cluster, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, f) AS k FROM (
          SELECT source_id, cluster, count(*) AS n, min(id) AS f FROM {src} GROUP BY 1, 2 HAVING count(*) >= 3)) WHERE k <= 20)""",
        f""" part AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, cluster, part ORDER BY score DESC, id) AS k FROM (
          SELECT *, CASE WHEN category = 'hook_candidate' THEN 0 WHEN category = 'payoff_candidate' THEN 2 WHEN category IN ('peak_candidate', 'development_material') THEN 1 END AS part
          FROM {src} JOIN big USING (source_id, cluster)) WHERE part IS NOT NULL) WHERE k <= 2 AND (part = 1 OR k = 1))""",
        # rows that cannot be repaired count for the parts and the score, but give no segment
        short_bounds_sql("part", 10.0, 20.0),
        """ fixed AS (SELECT p.*, nb.n_start, nb.n_end FROM part p LEFT JOIN nb ON nb.source_id = p.source_id AND nb.cluster = p.cluster AND nb.id = p.id)""",
    )


THEMATIC = """SELECT source_id, cluster, round(avg(score), 6) AS score, round(sum(n_end - n_start), 6) AS duration, count(n_start)::INT AS n_segments FROM fixed GROUP BY 1, 2
    HAVING bool_or(part = 0) AND bool_or(part = 2) AND count(n_start) >= 2 AND round(sum(n_end - n_start), 6) BETWEEN 45 AND 80"""


LONG = """ lng AS (SELECT source_id, id, start, CASE WHEN id % 9 = 0 THEN "end" + 60 ELSE "end" END AS "end", score, category, max("end") OVER (PARTITION BY source_id) + 5 AS duration FROM ranked)"""


def long_rows(spark, sf):
    r = ranked(spark, sf)
    d = r.groupBy("source_id").agg((F.max("end") + 5).alias("duration"))
    return r.withColumn("end", F.when(F.col("id") % 9 == 0, F.col("end") + 60).otherwise(F.col("end"))), d


@query("p11_normalize_bounds", """SELECT source_id, id, round(n_start, 6) AS n_start, round(n_end, 6) AS n_end FROM nb""", (CLIPS, CATS, LONG, bounds_sql("lng")))
def _(spark, sf):
    r, d = long_rows(spark, sf)
    return C.normalize_bounds(r.join(d, "source_id"), "start", "end", "duration", pad=pad()).select("source_id", "id", *r6("n_start", "n_end"))


@query("k9_single_plans", """SELECT source_id, id AS plan_id, score, round(n_end - n_start, 6) AS duration FROM nb WHERE n_start IS NOT NULL""", (CLIPS, CATS, LONG, bounds_sql("lng")))
def _(spark, sf):
    r, d = long_rows(spark, sf)
    return C.single_plans(r, d, pad=pad()).select("source_id", "plan_id", "score", *r6("duration"))


@query(
    "k8_thematic_plans", THEMATIC,
    (CLIPS, CATS, " themed AS (SELECT *, (id // 1000) * 4 + floor(score / 4)::BIGINT AS cluster, max(\"end\") OVER (PARTITION BY source_id) AS duration FROM ranked)", *thematic_sql("themed")),
)
def _(spark, sf):
    r = ranked(spark, sf).withColumn("cluster", F.floor(F.col("id") / 1000) * 4 + F.floor(F.col("score") / 4))
    t = C.thematic_plans(r, clip_duration(T.clips(spark, sf)), seg_low=10.0, seg_high=20.0, pad=F.lit(0.0))
    return t.select("source_id", "cluster", *r6("score", "duration"), F.size("segs").alias("n_segments"))


_LED = ORACLES["d12_leader_clusters"].removeprefix("WITH RECURSIVE ").rsplit("\n", 1)[0]
_VECTOR_ITEMS = """ items AS (SELECT source_id, c::BIGINT AS cluster, item_id AS id, (item_id * 9)::DOUBLE AS start, (item_id * 9 + 8 + item_id % 16)::DOUBLE AS "end", (item_id % 7)::DOUBLE AS score,
  ['hook_candidate', 'development_material', 'peak_candidate', 'payoff_candidate'][item_id % 4 + 1] AS category, 1000000.0::DOUBLE AS duration FROM walk)"""


@query("k8_thematic_plans_on_leader_clusters", THEMATIC, (_LED, _VECTOR_ITEMS, *thematic_sql("items")), recursive=True)
def _(spark, sf):
    """Clusters by running centroids of the vectors, then one plan per cluster."""
    i = F.col("item_id")
    c = leader_clusters(ranked_pool(spark, sf), threshold=0.3)
    category = F.element_at(F.array(*[F.lit(x) for x in ("hook_candidate", "development_material", "peak_candidate", "payoff_candidate")]), (i % 4 + 1).cast("int"))
    items = c.select(
        "source_id", "cluster", i.alias("id"), (i * 9).cast("double").alias("start"), (i * 9 + 8 + i % 16).cast("double").alias("end"), (i % 7).cast("double").alias("score"), category.alias("category")
    )
    t = C.thematic_plans(items, items.select("source_id").distinct().withColumn("duration", F.lit(1e6)), seg_low=10.0, seg_high=20.0, pad=F.lit(0.0))
    return t.select("source_id", "cluster", *r6("score", "duration"), F.size("segs").alias("n_segments"))


@query(
    "w30_pull_closure",
    """, g AS (SELECT source_id, arc_no, seg_no // 2 AS grp, sum(dur) AS dur, bool_or(role IN ('peak', 'payoff')) AS hc FROM arcseg GROUP BY 1, 2, 3),
      c AS (SELECT *, CASE WHEN role = 'payoff' AND closing THEN 0 WHEN role = 'payoff' THEN 1 WHEN role = 'peak' THEN 2 END AS kind FROM arcseg),
      b AS (SELECT * FROM c WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id, arc_no ORDER BY kind, seg_no) = 1)
    SELECT g.source_id, g.arc_no, grp, b.id FROM g JOIN b USING (source_id, arc_no) WHERE NOT hc AND round(g.dur + b.dur, 9) <= 80""",
    (ARCSEG,),
)
def _(spark, sf):
    s = T.arc_segments(spark, sf).withColumn("grp", F.floor(F.col("seg_no") / 2))
    g = s.groupBy("source_id", "arc_no", "grp").agg(F.sum("dur").alias("dur"), F.max(F.col("role").isin("peak", "payoff")).alias("has_closing"))
    return C.pull_closure(g, s)


# whole arcs whose segments are shortened to one, two or three eighths, so that plans of every length come up
SHORT_PLANS = """ shortened AS (SELECT source_id, arc_no, seg_no, id, start, dur * (1 + arc_no % 3) / 8 AS dur, "end" FROM arcseg),
  sp AS (SELECT a.source_id, arc_no, min(id) AS id, list({'s': start, 'e': start + dur} ORDER BY seg_no) AS segs, sum(dur) AS raw, min(start) AS s0, max_by(start + dur, seg_no) AS e1, any_value(tot) AS tot, count(*) AS n
  FROM shortened a JOIN (SELECT source_id, max("end") + 3 AS tot FROM arcseg GROUP BY 1) USING (source_id) GROUP BY 1, 2)"""


def short_plans(spark, sf):
    a = T.arc_segments(spark, sf)
    d = a.groupBy("source_id").agg((F.max("end") + 3).alias("duration_total"))
    a = a.withColumn("dur", F.col("dur") * (1 + F.col("arc_no") % 3) / 8)
    g = a.groupBy("source_id", "arc_no").agg(
        F.min("id").alias("id"),
        F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "start", "dur"))), lambda x: F.struct(x["start"].alias("s"), (x["start"] + x["dur"]).alias("e"))).alias("segs"),
    )
    return g.join(d, "source_id").withColumn("plan_id", F.col("id"))


@query(
    "p14_pad_short_group",
    f""", n AS (SELECT *, CASE WHEN round(raw, 9) < 45 THEN greatest(0, 45 + {PAD} - raw) ELSE 0 END AS need, greatest(0, s0) AS lr, greatest(0, tot - e1) AS rr FROM sp),
      m AS (SELECT *, least(lr, need / 2) AS l0, least(rr, need / 2) AS r0 FROM n), o AS (SELECT *, r0 + least(rr - r0, greatest(0, need - l0 - r0)) AS r FROM m),
      q AS (SELECT *, l0 + least(lr - l0, greatest(0, need - l0 - r)) AS l FROM o)
    SELECT source_id, arc_no, round(s0 - l, 6) AS first_start, round(e1 + r, 6) AS last_end FROM q WHERE round(raw + l + r, 6) >= 45""",
    (ARCSEG, SHORT_PLANS),
)
def _(spark, sf):
    p = C.pad_short_group(short_plans(spark, sf), pad=pad())
    return p.select("source_id", "arc_no", F.round(F.get("segs", F.lit(0))["s"], 6).alias("first_start"), F.round(F.try_element_at("segs", F.lit(-1))["e"], 6).alias("last_end"))


@query(
    "p15_extend_to_target",
    """, g AS (SELECT *, CASE WHEN round(raw, 9) >= 25 AND round(raw, 9) < 62 THEN least(15, (62 - raw) / n) ELSE 0 END AS gr FROM sp)
    SELECT source_id, arc_no, round(list_sum(list_transform(segs, lambda x: CASE WHEN gr > 0 THEN least(tot, x.e + gr / 2) ELSE x.e END - greatest(0, x.s - gr / 2))), 5) AS duration FROM g""",
    (ARCSEG, SHORT_PLANS),
)
def _(spark, sf):
    p = C.extend_to_target(short_plans(spark, sf), target=62.0, low=25.0)
    return p.select("source_id", "arc_no", F.round(F.aggregate("segs", F.lit(0.0), lambda a, x: a + (x["e"] - x["s"])), 5).alias("duration"))


@query(
    "p12_to_plan",
    """, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, clip_id) AS rank FROM clips)
    SELECT source_id, 'r' || rank AS plan_id, topic || ' opens at ' || clip_id AS hook, round(start, 3) AS seg_start, round("end", 3) AS seg_end, round("end" - start, 3) AS duration, score FROM r""",
    (CLIPS,),
)
def _(spark, sf):
    w = Window.partitionBy("source_id").orderBy(F.desc("score"), "clip_id")
    c = T.clips(spark, sf).withColumn("rank", F.row_number().over(w))
    c = c.withColumn("hook", F.concat_ws(" opens at ", "topic", F.col("clip_id").cast("string")))
    return C.to_plan(c)


@query(
    "u1_union_candidates",
    """SELECT 'base' AS origin, count(*) AS n, round(sum(score), 6) AS total FROM clips WHERE score >= 8 UNION ALL SELECT 'single', count(*), round(sum(score), 6) FROM clips WHERE topic = 'view'
    UNION ALL SELECT 'alternate', count(*), round(sum(score), 6) FROM clips WHERE chunk % 2 = 0""",
    (CLIPS,),
)
def _(spark, sf):
    c = T.clips(spark, sf).select("source_id", "clip_id", "score", "topic", "chunk")
    u = C.union_candidates(base=c.filter("score >= 8"), single=c.filter("topic = 'view'"), alternate=c.filter("chunk % 2 = 0"))
    return u.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total"))


@query(
    "k10_score_adjust",
    """, p AS (SELECT clip_id, score, ['base_arc','single','thematic_cluster'][1 + clip_id % 3] AS origin, clip_id % 4 AS n, (clip_id % 7) / 7.0::DOUBLE AS risk, "end" - start AS d FROM clips)
    SELECT clip_id, round(score * CASE WHEN origin <> 'single' AND n >= 2 THEN 1.25::DOUBLE ELSE 1 END * CASE WHEN n >= 2 THEN 1 - 0.3::DOUBLE * risk ELSE 1 END * (1 - least(0.15::DOUBLE, abs(d - 20) / 20 * 0.1::DOUBLE)), 6) AS score FROM p""",
    (CLIPS,),
)
def _(spark, sf):
    i = F.col("clip_id")
    p = T.clips(spark, sf).select(
        "clip_id", "score", F.element_at(F.array(F.lit("base_arc"), F.lit("single"), F.lit("thematic_cluster")), (i % 3 + 1).cast("int")).alias("origin"), (i % 4).alias("n_segments"),
        ((i % 7) / F.lit(7.0)).alias("risk"), (F.col("end") - F.col("start")).alias("duration"), F.lit("balanced").alias("pacing"),
    )
    return C.score_adjust(p).select("clip_id", *r6("score"))


@query(
    "k12_recent_liked",
    """SELECT o_orderkey AS artifact_id, o_custkey AS job_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_custkey <> 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""",
)
def _(spark, sf):
    a = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("artifact_id"), F.col("o_custkey").alias("job_id"), (F.col("o_orderstatus") == "F").alias("liked"), F.col("o_orderdate").alias("created"))
    j = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"))
    return C.recent_liked(a, j, exclude_job=7).select("artifact_id", "job_id")


LIKED = """ liked AS (SELECT o_orderkey AS artifact_id, o_orderdate AS created, substr(trim(d.text), 1, 180) AS anchor, e.embedding::DOUBLE[] AS v
  FROM orders JOIN documents d ON d.doc_id = o_orderkey % 60 JOIN embeddings e ON e.vec_id = o_orderkey % 300 WHERE o_orderstatus = 'F' AND trim(d.text) <> '')"""


def liked(spark, sf, hook=None):
    """Liked orders with a phrase and a vector; many of them say the same."""
    o = T.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("artifact_id"), F.col("o_orderdate").alias("created"))
    d = T.table(spark, sf, "documents").select(F.col("doc_id").alias("_d"), (F.col("text") if hook is None else hook).alias("hook"))
    e = T.table(spark, sf, "embeddings").select(F.col("vec_id").alias("_e"), F.col("embedding").cast("array<double>").alias("v"))
    k = F.col("artifact_id")
    return o.withColumns({"_d": k % 60, "_e": k % 300}).join(d, "_d").join(e, "_e").drop("_d", "_e")


@query(
    "k12_liked_anchors_by_date",
    """SELECT row_number() OVER (ORDER BY created DESC, artifact_id)::INT AS rank, artifact_id, anchor, 'top_by_date' AS mode FROM (
      SELECT * FROM liked QUALIFY row_number() OVER (PARTITION BY lower(trim(anchor)) ORDER BY created DESC, artifact_id) = 1) ORDER BY created DESC, artifact_id LIMIT 8""",
    (LIKED,),
)
def _(spark, sf):
    return C.liked_anchors(liked(spark, sf))


@query(
    "k12_liked_anchors_by_vector",
    """, c AS (SELECT l.*, list_cosine_similarity(v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS cos FROM liked l)
    SELECT row_number() OVER (ORDER BY cos DESC, artifact_id)::INT AS rank, artifact_id, anchor, 'cosine' AS mode FROM (
      SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lower(trim(anchor)) ORDER BY cos DESC, artifact_id) = 1) ORDER BY cos DESC, artifact_id LIMIT 5""",
    (LIKED,),
)
def _(spark, sf):
    q = T.table(spark, sf, "embeddings").filter("vec_id = 7").select(F.col("embedding").cast("array<double>").alias("qv"))
    return C.liked_anchors(liked(spark, sf), q)


@query(
    "k5_vector_topk_distinct_text",
    """, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0),
      c AS (SELECT query_id, artifact_id AS item_id, list_cosine_similarity(v, qv) AS cos, lower(trim(anchor)) AS said FROM liked, q),
      b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, said ORDER BY cos DESC, item_id) = 1)
    SELECT query_id, item_id, round(cos, 6) AS cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, item_id) AS rank FROM b) WHERE rank <= 10""",
    (LIKED,),
)
def _(spark, sf):
    e = T.table(spark, sf, "embeddings").filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("qv"))
    items = liked(spark, sf, F.substring(F.trim("text"), 1, 180)).select(F.col("artifact_id").alias("item_id"), "v", F.col("hook").alias("said"))
    return K.vector_topk(items, e, 10, text="said").select("query_id", "item_id", *r6("cos"), "rank")


MOTIF = """ rk AS (SELECT source_id, clip_id AS id, start, start + 6 + clip_id % 17 AS "end", CASE WHEN topic IN ('signup', 'view') THEN 'payoff_candidate' ELSE 'peak_candidate' END AS category, score, clip_id % 3 AS motif FROM dense),
  ps AS (SELECT source_id, clip_id AS plan_id, 0 AS seg_no, start AS s, "end" AS e FROM dense WHERE score >= 9 UNION ALL SELECT source_id, clip_id, 1, "end" + 300, "end" + 330 FROM dense WHERE score >= 9)"""


@query(
    "k13_alternate_payoff",
    """, h AS (SELECT p.source_id, plan_id, max_by(motif, (round((least(e, r."end") - greatest(s, r.start)) / greatest(0.001, e - s), 9), -id)) AS hm FROM ps p LEFT JOIN rk r ON r.source_id = p.source_id AND r.start < e AND s < r."end" WHERE seg_no = 0 GROUP BY 1, 2),
      c AS (SELECT h.source_id, h.plan_id, id, start, "end", score, CASE WHEN motif = hm THEN 0 ELSE 1 END AS m FROM h JOIN rk r ON r.source_id = h.source_id JOIN (SELECT source_id, max("end") * 0.8::DOUBLE AS d FROM dense GROUP BY 1) l ON l.source_id = h.source_id WHERE category = 'payoff_candidate' AND "end" - start BETWEEN 6 AND 22 AND "end" <= d + 0.5
        AND NOT EXISTS (SELECT 1 FROM ps p WHERE p.source_id = h.source_id AND p.plan_id = h.plan_id AND r.start < p.e + 1 AND r."end" > p.s - 1)),
      alt AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source_id, plan_id ORDER BY m, score DESC, id) = 1)
    SELECT p.source_id, p.plan_id, seg_no, alt.id AS alt_id, round(CASE WHEN seg_no = 1 THEN coalesce(alt.start, s) ELSE s END, 3) AS s, round(CASE WHEN seg_no = 1 THEN coalesce(alt."end", e) ELSE e END, 3) AS e FROM ps p LEFT JOIN alt USING (source_id, plan_id)""",
    (DENSE, MOTIF),
)
def _(spark, sf):
    d = T.dense_clips(spark, sf)
    r = d.select("source_id", F.col("clip_id").alias("id"), "start", (F.col("start") + 6 + F.col("clip_id") % 17).alias("end"), F.when(F.col("topic").isin("signup", "view"), "payoff_candidate").otherwise("peak_candidate").alias("category"), "score", (F.col("clip_id") % 3).alias("motif"))
    top = d.filter("score >= 9")
    p = top.select("source_id", F.col("clip_id").alias("plan_id"), F.lit(0).alias("seg_no"), F.col("start").alias("s"), F.col("end").alias("e")).unionByName(
        top.select("source_id", F.col("clip_id").alias("plan_id"), F.lit(1).alias("seg_no"), (F.col("end") + 300).alias("s"), (F.col("end") + 330).alias("e")))
    length = d.groupBy("source_id").agg((F.max("end") * 0.8).alias("duration"))
    alt = C.alternate_payoff(p, r, length)
    swapped = C.swap_payoff(p, alt).join(alt.select("source_id", "plan_id", "alt_id"), ["source_id", "plan_id"], "left")
    return swapped.select("source_id", "plan_id", "seg_no", "alt_id", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"))


@query(
    "k17_gate_by_score",
    """, p AS (SELECT clip_id AS plan_id, CASE WHEN clip_id % 10 = 0 THEN NULL ELSE score / 10 END AS score, (clip_id * 7 % 11) / 10.0::DOUBLE AS ns FROM clips)
    SELECT plan_id, CASE WHEN score IS NULL OR score >= 0.75 THEN 'accepted' WHEN ns >= 0.75 THEN 'swapped' ELSE 'kept_low' END AS outcome, CASE WHEN NOT (score IS NULL OR score >= 0.75) AND ns >= 0.75 THEN ns ELSE score END AS final_score FROM p""",
    (CLIPS,),
)
def _(spark, sf):
    c = T.clips(spark, sf)
    p = c.select(F.col("clip_id").alias("plan_id"), F.when(F.col("clip_id") % 10 != 0, F.col("score") / 10).alias("score"))
    retry = c.select(F.col("clip_id").alias("plan_id"), ((F.col("clip_id") * 7 % 11) / F.lit(10.0)).alias("new_score"))
    return C.gate_by_score(p, threshold=0.75, mode="resort", retry=retry).select("plan_id", "outcome", "final_score")


@query(
    "k14_fill_sparse",
    """, d AS (SELECT source_id, max("end") AS dur, max("end") / 60 AS m FROM dense GROUP BY 1),
      l AS (SELECT source_id, dur, CASE WHEN m <= 15 THEN 5 WHEN m <= 40 THEN 8 WHEN m <= 80 THEN 30 ELSE 50 END AS mn, CASE WHEN m <= 15 THEN 12 WHEN m <= 40 THEN 20 WHEN m <= 80 THEN 45 ELSE 70 END AS mx FROM d),
      mo AS (SELECT source_id, clip_id AS id, start, "end" FROM dense WHERE score = 10), n AS (SELECT l.*, (SELECT count(*) FROM mo WHERE mo.source_id = l.source_id) AS n FROM l),
      g AS (SELECT source_id, chunk, 0 AS k, clip_id AS id, greatest(0, start - 2) AS start, start + 8 AS e FROM dense WHERE score = 9 UNION ALL SELECT source_id, chunk, 1, clip_id, greatest(0, start - 3), start + 10 FROM dense WHERE score = 8),
      r AS (SELECT g.source_id, id, start, least(e, dur) AS e, k, row_number() OVER (PARTITION BY g.source_id ORDER BY chunk, k, id) AS r, mx - n AS room FROM g JOIN n USING (source_id) WHERE n < mn AND least(e, dur) > start)
    SELECT source_id, id, round(start, 6) AS start, round("end", 6) AS "end", 'model' AS origin FROM mo UNION ALL SELECT source_id, id, round(start, 6), round(e, 6), CASE k WHEN 0 THEN 'quote' ELSE 'peak' END FROM r WHERE r <= room""",
    (DENSE,),
)
def _(spark, sf):
    d = T.dense_clips(spark, sf)
    m = d.filter("score = 10").select("source_id", F.col("clip_id").alias("id"), "start", "end")
    q = d.filter("score = 9").select("source_id", "chunk", F.col("clip_id").alias("id"), F.col("start").alias("sec"))
    p = d.filter("score = 8").select("source_id", "chunk", F.col("clip_id").alias("id"), F.col("start").alias("sec"))
    return C.fill_sparse(m, q, p, clip_duration(d)).select("source_id", "id", *r6("start", "end"), "origin")


@query(
    "k16_decorate_plan",
    """, g AS (SELECT source_id, arc_no, arg_min(role || ' number ' || id, (CASE WHEN role = 'hook' THEN 0 ELSE 1 END, seg_no)) AS hook, avg(score / 10 * (0.6::DOUBLE + 0.4::DOUBLE * (id % 2))) AS score FROM arcseg GROUP BY 1, 2)
    SELECT source_id, arc_no, 'r' || row_number() OVER (PARTITION BY source_id ORDER BY round(score, 9) DESC, arc_no) AS plan_id, hook, round(score, 6) AS score FROM g""",
    (ARCSEG,),
)
def _(spark, sf):
    s = T.arc_segments(spark, sf).withColumns({"text": F.concat_ws(" number ", "role", F.col("id").cast("string")), "score": F.col("score") / 10, "visual": (F.col("id") % 2).cast("double")})
    return C.decorate_plan(s).select("source_id", "arc_no", "plan_id", "hook", *r6("score"))


# --- validation -------------------------------------------------------------------------------


def raw_answers(spark, sf):
    """One model answer per evidence row, some of them broken: fenced, without text, reversed, truncated, numbers as text."""
    e = T.evidence(spark, sf)
    i = F.col("id")
    item = F.struct(
        F.when(i % 7 == 0, F.format_string("%.3f", "start")).otherwise(F.col("start").cast("string")).alias("start"),
        F.when(i % 19 == 0, F.col("start")).otherwise(F.col("end")).cast("string").alias("end"),
        F.when(i % 13 != 0, F.col("text")).alias("text"),
        F.when(F.col("agent") != "error", F.col("strength") * 2).cast("string").alias("strength"),
        F.col("agent").alias("mood"),
        F.when(i % 5 == 0, F.lit("th1")).alias("pairs_with_theme_id"),
    )
    body = F.to_json(F.struct(F.array(item).alias("items")))
    raw = (
        F.when(i % 17 == 0, F.expr("left(body, 30)")).when(i % 11 == 0, F.concat(F.lit("Here it is:\n```json\n"), F.col("body"), F.lit("\n```"))).otherwise(F.col("body"))
    )
    return e.select("source_id", "id", "agent", "chunk", body.alias("body")).withColumn("raw", raw).drop("body")


@query(
    "p1_validate_evidence",
    """SELECT source_id, id, start, "end", text, round(least(1, CASE WHEN agent = 'error' THEN 0.5 ELSE strength * 2 END), 6) AS strength, CASE WHEN id % 5 = 0 THEN 'th1' END AS motif_id, agent AS mood
    FROM evidence WHERE id % 17 <> 0 AND id % 13 <> 0 AND id % 19 <> 0""",
    (EVIDENCE,),
)
def _(spark, sf):
    v = V.validate_evidence(V.parse_items(raw_answers(spark, sf), "raw"))
    return v.select("source_id", "id", "start", "end", "text", *r6("strength"), "motif_id", F.col("extra")["mood"].alias("mood"))


@query("p1_quarantine", """SELECT source_id, id FROM evidence WHERE id % 17 = 0""", (EVIDENCE,))
def _(spark, sf):
    return V.quarantine(raw_answers(spark, sf), "raw").select("source_id", "id")


@query(
    "p2_validate_clips",
    """, c AS (SELECT clip_id, chunk, chunk * 86400.0::DOUBLE AS cs, (chunk + 1) * 86400.0::DOUBLE AS ce, CASE WHEN clip_id % 6 = 0 THEN start - chunk * 86400 ELSE start END AS s0, CASE WHEN clip_id % 6 = 0 THEN "end" - chunk * 86400 ELSE "end" END AS e0, topic, score FROM clips),
      d AS (SELECT *, cs > 1 AND e0 < cs AND e0 <= ce - cs + 5 AS rel FROM c),
      f AS (SELECT clip_id, greatest(greatest(0, cs - 3), CASE WHEN rel THEN s0 + cs ELSE s0 END) AS s, least(ce + 3, CASE WHEN rel THEN e0 + cs ELSE e0 END) AS e, greatest(5, least(10, score * 2 - 6))::INT AS score, topic FROM d)
    SELECT clip_id, round(s, 3) AS start, round(e, 3) AS "end", score, CASE WHEN topic = 'error' THEN 'question' ELSE 'bold_claim' END AS hook_kind, 'conclusion' AS closure FROM f WHERE e - s BETWEEN 28 AND 90""",
    (CLIPS,),
)
def _(spark, sf):
    c = T.clips(spark, sf)
    off = F.when(F.col("clip_id") % 6 == 0, F.col("chunk") * F.lit(86400.0)).otherwise(F.lit(0.0))
    item = F.create_map(
        F.lit("start_sec"), (F.col("start") - off).cast("string"), F.lit("end_sec"), (F.col("end") - off).cast("string"), F.lit("hook"), F.concat(F.lit(" look "), F.col("topic")),
        F.lit("score"), (F.col("score") * 2 - 6).cast("string"), F.lit("hook_kind"), F.when(F.col("topic") == "error", "QUESTION").otherwise("loud"), F.lit("closure_type"), F.lit("none"),
    )
    d = c.select("clip_id", (F.col("chunk") * F.lit(86400.0)).alias("c_start"), ((F.col("chunk") + 1) * F.lit(86400.0)).alias("c_end"), item.alias("item"))
    return V.validate_clips(d).select("clip_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "score", "hook_kind", "closure")


@query(
    "p3_validate_hooks",
    """, h AS (SELECT clip_id, greatest(start, chunk * 86400 + 100) AS s, least(start + 1 + clip_id % 12, (chunk + 1) * 86400) AS e, least(1, score / 9) AS score, topic FROM clips),
      k AS (SELECT clip_id, s, CASE WHEN round(e - s, 9) > 9.6 THEN s + 8 ELSE e END AS e, score, topic FROM h)
    SELECT clip_id, round(s, 3) AS start, round(e, 3) AS "end", round(score, 6) AS score, 'bold_claim' AS kind FROM k WHERE round(e - s, 9) >= 1.6""",
    (CLIPS,),
)
def _(spark, sf):
    c = T.clips(spark, sf).select(
        "clip_id", F.col("start").cast("string").alias("start"), (F.col("start") + 1 + F.col("clip_id") % 12).cast("string").alias("end"), (F.col("score") / 9).cast("string").alias("score"),
        F.col("topic").alias("kind"), (F.col("chunk") * 86400 + 100).cast("double").alias("p_start"), ((F.col("chunk") + 1) * 86400).cast("double").alias("p_end"),
    )
    return V.validate_hooks(c).select("clip_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), *r6("score"), "kind")


@query(
    "p4_validate_arcs",
    """, a AS (SELECT clip_id, greatest(start, chunk * 86400 + 200) AS s, least("end", (chunk + 1) * 86400) AS e, start AS hs, start + 4 AS he, score FROM clips WHERE topic <> 'error')
    SELECT clip_id, round(s, 3) AS start, round(CASE WHEN abs(s - hs) > 0.1 THEN s ELSE hs END, 3) AS hook_start, round(CASE WHEN abs(s - hs) > 0.1 THEN least(s + (he - hs), e) ELSE he END, 3) AS hook_end, 5 AS n_dev FROM a WHERE round(e - s, 9) BETWEEN 28 AND 75 AND score / 10 >= 0.7""",
    (CLIPS,),
)
def _(spark, sf):
    c = T.clips(spark, sf).select(
        "clip_id", "start", "end", F.col("start").alias("hook_start"), (F.col("start") + 4).alias("hook_end"), F.when(F.col("topic") != "error", "Punchline").otherwise("none").alias("closure"),
        F.array_repeat(F.col("topic"), 7).alias("development"), (F.col("score") / 10).alias("coherence"), (F.col("chunk") * 86400 + 200).cast("double").alias("p_start"), ((F.col("chunk") + 1) * 86400).cast("double").alias("p_end"),
    )
    return V.validate_arcs(c, coherence=0.7).select("clip_id", *[F.round(x, 3).alias(x) for x in ("start", "hook_start", "hook_end")], F.size("development").alias("n_dev"))


@query(
    "p5_validate_ranked",
    """SELECT clip_id, CASE WHEN clip_id % 8 = 0 THEN 0.5 ELSE least(1, score / 8) END AS score, CASE WHEN topic = 'view' THEN 'peak_candidate' ELSE 'development_material' END AS category, CASE WHEN topic IN ('click', 'purchase') THEN topic ELSE 'click' END AS agent FROM clips""",
    (CLIPS,),
)
def _(spark, sf):
    c = T.clips(spark, sf).select("clip_id", F.when(F.col("clip_id") % 8 == 0, "n/a").otherwise((F.col("score") / 8).cast("string")).alias("score"), F.when(F.col("topic") == "view", " PEAK_candidate").otherwise(F.col("topic")).alias("category"), F.upper("topic").alias("agent"))
    return V.validate_ranked(c, ("click", "purchase"), "click")


@query(
    "p6_validate_story",
    """, t AS (SELECT a.*, e."end" AS e_end, CASE WHEN a.id % 3 = 0 THEN coalesce(e.start, 0) ELSE a.start END AS s FROM arcseg a LEFT JOIN (SELECT * FROM evidence WHERE id % 7 <> 0) e ON e.id = a.id),
      u AS (SELECT *, CASE WHEN id % 4 = 0 THEN coalesce(e_end, s + 1) ELSE "end" END AS e FROM t)
    SELECT source_id, id, role, s AS start, e AS "end", role = 'payoff' AND closing AS payoff_conclusion FROM u WHERE e > s""",
    (ARCSEG,),
)
def _(spark, sf):
    a = T.arc_segments(spark, sf)
    s = a.select("source_id", "id", F.upper("role").alias("role"), F.when(F.col("id") % 3 != 0, F.col("start").cast("string")).alias("start"), F.when(F.col("id") % 4 != 0, F.col("end").cast("string")).alias("end"), F.col("closing").alias("payoff_conclusion"))
    # some rows cite evidence that does not exist
    return V.validate_story(s, T.evidence(spark, sf).filter("id % 7 <> 0")).select("source_id", "id", "role", "start", "end", "payoff_conclusion")


# variants of known and unknown kinds with every kind of flaw in their segments
VARIANT_ROWS = """ vr AS (SELECT source_id, arc_no AS variant_no, ['long_philosophical', 'variant_deep_dive', 'Punchy_Summary', 'haiku', 'variant_package_of_shorts'][arc_no % 5 + 1] AS kind, id,
  CASE WHEN id % 11 = 0 THEN 'extra' ELSE role END AS role, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 13 = 1 THEN 'soon' ELSE (start - 40)::VARCHAR END AS st, CASE WHEN id % 4 = 0 THEN NULL ELSE "end"::VARCHAR END AS en,
  CASE WHEN arc_no % 2 = 0 THEN 55.0::DOUBLE END AS predicted, seg_no FROM arcseg)"""


@query(
    "p6_validate_variants",
    """, t AS (SELECT v.*, e.start AS es, e."end" AS ee, regexp_replace(lower(kind), '^variant_', '') AS k FROM vr v LEFT JOIN (SELECT * FROM evidence WHERE id % 7 <> 0) e ON e.id = v.id AND e.source_id = v.source_id
        WHERE role <> 'extra' AND (st IS NULL OR st <> 'soon')),
      u AS (SELECT *, coalesce(st::DOUBLE, es, 0) AS a, coalesce(en::DOUBLE, ee, coalesce(st::DOUBLE, es, 0) + 1) AS b FROM t WHERE k IN ('long_philosophical', 'package_of_shorts', 'punchy_summary', 'deep_dive')),
      w AS (SELECT *, greatest(0, a) AS s2, sum(b - greatest(0, a)) OVER (PARTITION BY source_id, variant_no) AS len FROM u WHERE b > a)
    SELECT source_id, variant_no, 'variant_' || k AS variant_id, replace(k, '_', ' ') AS label, id, round(s2, 6) AS start, round(b, 6) AS "end", ['strain', 'neutral', 'reveal'][seg_no % 3 + 1] AS beat, round(coalesce(predicted, len), 6) AS predicted, 0.0::DOUBLE AS target FROM w""",
    (ARCSEG, VARIANT_ROWS),
)
def _(spark, sf):
    a, i, v = T.arc_segments(spark, sf), F.col("id"), F.col("arc_no")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    rows = a.select(
        "source_id", v.alias("variant_no"), pick(("long_philosophical", "variant_deep_dive", "Punchy_Summary", "haiku", "variant_package_of_shorts"), v % 5).alias("kind"), "id",
        F.when(i % 11 == 0, "extra").otherwise(F.initcap("role")).alias("role"),
        F.when(i % 3 == 0, None).when(i % 13 == 1, "soon").otherwise((F.col("start") - 40).cast("string")).alias("start"), F.when(i % 4 != 0, F.col("end").cast("string")).alias("end"),
        pick(("Strain", "joy", "REVEAL"), F.col("seg_no") % 3).alias("beat"), F.when(v % 2 == 0, "55").alias("predicted"), F.lit(None).cast("string").alias("label"), F.lit("-3").alias("target"),
    )
    out = V.validate_variants(rows, T.evidence(spark, sf).filter("id % 7 <> 0"))
    return out.select("source_id", "variant_no", "variant_id", "label", "id", *r6("start", "end"), "beat", *r6("predicted"), "target")


@query(
    "p7_validate_compressed",
    """SELECT conv_id, turn, (turn % 2 = 0)::INT AS n_quotes, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS n_peaks, (turn * 10)::DOUBLE AS r_start FROM conversations WHERE length(trim(text)) > 0 AND turn % 5 <> 4""",
)
def _(spark, sf):
    c = T.table(spark, sf, "conversations")
    x = c.select(
        "conv_id", "turn", F.when(F.col("turn") % 5 != 4, F.col("text")).otherwise("  ").alias("summary"),
        F.array(F.struct(F.lit(1.0).alias("sec"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("").alias("text"))).alias("quotes"),
        F.array(F.struct(F.lit(1.0).alias("sec"), F.when(F.col("role") == "user", "humor").otherwise("shrug").alias("kind"))).alias("peaks"),
        F.lit(None).cast("double").alias("r_start"), F.lit(None).cast("double").alias("r_end"), (F.col("turn") * 10).cast("double").alias("c_start"), (F.col("turn") * 10 + 10).cast("double").alias("c_end"),
    )
    return V.validate_compressed(x).select("conv_id", "turn", F.size("quotes").alias("n_quotes"), F.size("peaks").alias("n_peaks"), "r_start")


@query(
    "p8_sanitize_segments",
    r"""SELECT doc_id, md5(t) AS digest FROM (SELECT doc_id, array_to_string(list_filter(string_split_regex(trim(text, E' \n\t\r'), '[ \n\t\r]+'), lambda w: w <> '' AND length(w) <= 12), ' ') AS t FROM documents WHERE length(text) <= 1000) WHERE t <> ''""",
)
def _(spark, sf):
    d = V.sanitize_segments(T.table(spark, sf, "documents").select("doc_id", "text"), "text", word=12)
    return d.select("doc_id", F.md5("text").alias("digest"))


@query(
    "j8_lookup_by_key",
    """, r AS (SELECT source_id, round_even(start, 1) AS s, left(text, 80) AS x, max_by(strength, id) AS st FROM evidence WHERE id % 3 = 0 GROUP BY 1, 2, 3)
    SELECT e.source_id, e.id, round(st, 6) AS strength FROM evidence e LEFT JOIN r ON r.source_id = e.source_id AND r.s = round_even(e.start, 1) AND r.x = left(e.text, 80)""",
    (EVIDENCE,),
)
def _(spark, sf):
    e = T.evidence(spark, sf)
    r = e.filter(F.col("id") % 3 == 0).select("source_id", "id", "start", "text", "strength")
    return V.lookup_by_key(e.select("source_id", "id", "start", "text"), r, ["strength"]).select("source_id", "id", *r6("strength"))


@query(
    "j9_backfill",
    """, rk AS (SELECT * FROM evidence WHERE agent = 'purchase'), n AS (SELECT s.source_id, count(rk.id) AS n FROM (SELECT DISTINCT source_id FROM evidence) s LEFT JOIN rk USING (source_id) GROUP BY 1 HAVING count(rk.id) < 20),
      p AS (SELECT *, round_even(start, 1) AS s FROM evidence), q AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM rk WHERE rk.source_id = p.source_id AND round_even(rk.start, 1) = p.s) QUALIFY row_number() OVER (PARTITION BY source_id, s ORDER BY strength DESC, id) = 1),
      k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY strength DESC, id) AS k FROM q)
    SELECT source_id, id, start, false AS backfilled FROM rk UNION ALL SELECT k.source_id, id, start, true FROM k JOIN n USING (source_id) WHERE k.k <= 25 - n""",
    (EVIDENCE,),
)
def _(spark, sf):
    e = T.evidence(spark, sf)
    return V.backfill(e.filter("agent = 'purchase'"), e, need=20, cap=25)


@query(
    "j10_drop_flagged",
    """SELECT source_id, id FROM evidence WHERE NOT (agent = 'error' AND (id % 10) / 10.0 >= 0.75)""",
    (EVIDENCE,),
)
def _(spark, sf):
    e = T.evidence(spark, sf)
    f = e.filter("agent = 'error'").select("source_id", "id", ((F.col("id") % 10) / F.lit(10.0)).alias("confidence"))
    return V.drop_flagged(e, f).select("source_id", "id")


@query(
    "a18_chunk_diagnostics",
    """, r AS (SELECT source_id, chunk, count(*) AS n FROM clips GROUP BY 1, 2), v AS (SELECT source_id, chunk, sum(c)::BIGINT AS n, string_agg(score::INT || ':' || c, ',' ORDER BY score) AS s FROM (SELECT source_id, chunk, score, count(*) AS c FROM clips WHERE score >= 7 GROUP BY 1, 2, 3) GROUP BY 1, 2),
      g AS (SELECT source_id, unnest(range(max(chunk) + 1)) AS chunk FROM clips GROUP BY 1)
    SELECT source_id, chunk, chunk * 10 AS chars, CASE WHEN chunk % 7 = 3 THEN 'timeout' ELSE '' END AS error, coalesce(r.n, 0) AS raw_items, coalesce(v.n, 0) AS valid_items, coalesce(v.s, '') AS scores FROM g LEFT JOIN r USING (source_id, chunk) LEFT JOIN v USING (source_id, chunk)""",
    (CLIPS,),
)
def _(spark, sf):
    c = T.clips(spark, sf)
    g = c.groupBy("source_id").agg(F.max("chunk").alias("_m")).select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m"))).alias("chunk"))
    g = g.withColumns({"chars": F.col("chunk") * 10, "error": F.when(F.col("chunk") % 7 == 3, "timeout")})
    return V.chunk_diagnostics(g, c, c.filter("score >= 7"))
