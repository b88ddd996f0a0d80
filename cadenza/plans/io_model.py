"""Source, sink, column-function and model-surface queries, and the flagship."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from cadenza.functions import scoring as Z
from cadenza.functions import text as X
from cadenza.functions.vector import cosine, cosine_continuity
from cadenza.operators import model as M
from cadenza.operators import rank as K
from cadenza.operators import segment as G
from cadenza.operators import stats as A
from cadenza.operators.greedy import jaccard
from cadenza.operators.select import dedup_jaccard
from cadenza.operators.validate import extract_json
from cadenza.plans.folds import PHRASES, PHRASES_SQL, RULES
from cadenza.plans.registry import CLIPS, EVIDENCE, POINTS, SEGMENTS, SENTENCES, VECTORS, WORDS, query
from cadenza.plans.selection import _JAC, TOKENS_SQL, greedy_sql
from cadenza.plans.windows import r6
from cadenza.session import durable_dir
from cadenza.sources import readers as R
from cadenza.sources import sinks as S
from cadenza.sources import tables as T


def _tmp(spark, name):
    return os.path.join(durable_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _doc_words(sentence: bool = False):
    """Words of a document as one array of structs, in the row; with ``sentence`` also the sentence's index ``n``."""
    sents = F.split("text", "(?<=[.!?…])" + T.WS)
    flat = F.flatten(F.transform(sents, lambda s, n: F.transform(F.split(s, T.WS), lambda w: F.struct(n.alias("n"), w.alias("word")))))
    n = ["n"] if sentence else []
    timed = F.transform(flat, lambda x, i: F.struct(*[x[c].alias(c) for c in n], x["word"].alias("word"), F.round(i * F.lit(0.4) + F.lit(0.9) * x["n"], 3).alias("start"), F.round(F.round(i * F.lit(0.4) + F.lit(0.9) * x["n"], 3) + 0.3, 3).alias("end")))
    return F.filter(timed, lambda x: x["word"] != "")


@query(
    "src1_read_transcripts",
    """SELECT source_id, count(*) AS n, min(start) AS first_start, max("end") AS last_end, md5(string_agg(word, ' ' ORDER BY pos)) AS digest FROM words GROUP BY 1""",
    (WORDS,),
)
def _(spark, sf):
    path = _tmp(spark, "transcripts")
    d = T.table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), F.col("lang").alias("language"), F.lit(0.0).alias("duration_sec"), _doc_words().alias("w"))
    seg = F.array(F.struct(F.lit("all").alias("text"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.col("w").alias("words")))
    d = d.withColumns({"segments": seg, "words": F.when(F.col("source_id") % 2 == 0, F.col("w")).otherwise(F.slice("w", 1, 0))}).drop("w")
    d.write.json(path)
    w, _segs = R.read_transcripts(spark, path)
    words = F.sort_array(F.collect_list(F.struct("pos", "word")))
    return w.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.md5(F.array_join(F.transform(words, lambda x: x["word"]), " ")).alias("digest")
    )


@query(
    "src2_normalize_asr",
    """, k AS (SELECT source_id, sent, count(*) AS n FROM words WHERE source_id % 3 = 0 GROUP BY 1, 2)
    SELECT source_id, count(*) AS n_words, count(DISTINCT sent) AS n_segments FROM words GROUP BY 1""",
    (SENTENCES,),
)
def _(spark, sf):
    path = _tmp(spark, "payloads")
    d = T.table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), _doc_words(sentence=True).alias("w")).filter(F.size("w") > 0)
    # sentence spans: the first word of a sentence up to just before the next one's; built in the row like the words
    n = F.transform("w", lambda x: x["n"])
    none = F.array(F.lit(None).cast("int"))
    first = F.array_compact(F.zip_with("w", F.concat(none, F.slice(n, 1, F.size(n) - 1)), lambda x, m: F.when(m.isNull() | (m != x["n"]), x["start"])))
    last = F.array_compact(F.zip_with("w", F.concat(F.slice(n, 2, F.size(n)), none), lambda x, m: F.when(m.isNull() | (m != x["n"]), x["end"] + 0.05)))
    words = F.transform("w", lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end")))
    d = d.select("source_id", words.alias("w"), F.zip_with(first, last, lambda s, e: F.struct(s.alias("start"), e.alias("end"))).alias("sp"))
    para = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.transform("sp", lambda x: F.struct(F.lit("s").alias("text"), x["start"].alias("start"), x["end"].alias("end"))).alias("sentences")))
    utt = F.transform("sp", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("u").alias("transcript")))
    k = F.col("source_id") % 3
    d = d.select("source_id", F.to_json(F.struct(F.col("w").alias("words"), F.when(k == 0, para).alias("paragraphs"), F.when(k == 1, utt).alias("utterances"))).alias("payload"))
    d.write.option("compression", "zstd").parquet(path)
    w, segs = R.normalize_asr(spark.read.parquet(path))
    a = w.filter("seg_idx is not null").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_words"))
    # sources without given segments are split at pauses and after 20 s; count their pauses only
    b = w.groupBy("source_id").agg(F.countDistinct("seg_idx").alias("n_segments"))
    plain = G.sessionize(w.filter(F.col("source_id") % 3 == 2).select("source_id", "pos", "start", "end"), max_span=None)
    c = plain.groupBy("source_id").agg(F.countDistinct("session").alias("_g"))
    return a.join(b, "source_id").join(c, "source_id", "left").select("source_id", "n_words", F.coalesce("_g", "n_segments").alias("n_segments"))


@query("src3_read_keyed_jsonl", """SELECT user_id::VARCHAR AS key, max_by(value, event_id) AS value FROM events WHERE event_id % 10 <> 3 GROUP BY 1""")
def _(spark, sf):
    path = _tmp(spark, "log")
    e = T.table(spark, sf, "events")
    line = F.to_json(F.struct(F.col("user_id").cast("string").alias("key"), F.struct(F.col("value").alias("v"), F.col("event_type").alias("kind")).alias("value")))
    broken = F.when(F.col("event_id") % 10 == 3, F.expr("left(line, 12)")).otherwise(F.col("line"))
    e.select("event_id", line.alias("line")).withColumn("line", broken).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("line").write.text(path)
    r = R.read_keyed_jsonl(spark, path, "struct<v:double,kind:string>")
    return r.select("key", F.col("value.v").alias("value"))


@query("src4_load_rules", f"""SELECT rule, count(*) AS n FROM ({PHRASES_SQL}) GROUP BY rule""", PHRASES, recursive=True)
def _(spark, sf):
    path = _tmp(spark, "rules")
    spark.createDataFrame([(n, p, k) for n, p, k in RULES], "word string, pattern string, word_count int").write.json(path)
    m = G.phrase_match(T.words(spark, sf), R.load_rules(spark, path))
    return m.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("src5_read_catalog", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000""")
def _(spark, sf):
    return R.read_catalog(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"], (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 50000))


@query("snk1_write_stage", """SELECT source_id, count(*) AS n, round(sum(strength), 6) AS strength FROM evidence GROUP BY 1""", (EVIDENCE,))
def _(spark, sf):
    path = _tmp(spark, "stage")
    S.write_stage(T.evidence(spark, sf), path, buckets=8)
    return S.read_stage(spark, path).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("strength"), 6).alias("strength"))


@query("snk2_write_run_stats", """SELECT source_id, count(*) AS n, round(avg(score), 6) AS mean_score, min(score) AS min_score, r AS run_id FROM clips, (SELECT unnest(['a', 'b']) AS r) GROUP BY source_id, r""", (CLIPS,))
def _(spark, sf):
    path = _tmp(spark, "stats")
    for run in ("a", "b"):
        S.write_run_stats(T.clips(spark, sf), path, run)
    return spark.read.parquet(path).withColumn("mean_score", F.round("mean_score", 6))


@query("snk3_export_selected", """SELECT source_id, id FROM evidence WHERE id % 5 = 0 AND agent <> 'view'""", (EVIDENCE,))
def _(spark, sf):
    path = _tmp(spark, "export")
    e = T.evidence(spark, sf)
    # ids paired with a foreign source must not be exported
    chosen = e.filter((F.col("id") % 5 == 0)).select(F.when(F.col("agent") == "view", F.col("source_id") + 1).otherwise(F.col("source_id")).alias("source_id"), "id")
    S.export_selected(e, chosen, path)
    return spark.read.parquet(path).select("source_id", "id")


@query(
    "snk4_cache_lookup",
    """WITH c AS (SELECT DISTINCT text, CASE WHEN doc_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS model FROM documents WHERE doc_id % 3 = 0)
    SELECT doc_id AS source_id, EXISTS (SELECT 1 FROM c WHERE c.text = d.text AND c.model = 'm1') AS hit FROM documents d""",
)
def _(spark, sf):
    d = T.table(spark, sf, "documents")
    cache = d.filter(F.col("doc_id") % 3 == 0).select(F.sha2("text", 256).alias("hash"), F.lit("b").alias("backend"), F.when(F.col("doc_id") % 2 == 0, "m1").otherwise("m2").alias("model"), F.col("doc_id").cast("string").alias("result"))
    src = d.select(F.col("doc_id").alias("source_id"), F.col("text").alias("content"), F.lit("b").alias("backend"), F.lit("m1").alias("model"))
    hits, misses = R.cache_lookup(src, cache)
    return hits.select("source_id", F.lit(True).alias("hit")).unionByName(misses.select("source_id", F.lit(False).alias("hit")))


# --- column functions ---------------------------------------------------------------------------


@query(
    "f_text_functions",
    r"""SELECT source_id, pos, lower(trim(trim(word), '.,!?;:…—"''«»()[]-')) AS stripped, regexp_matches(trim(word), '[.!?…]$') AS closes, left(regexp_replace(word, '[^A-Za-z0-9_-]', '-', 'g'), 32) AS safe,
      printf('%02d:%02d', floor(start / 60)::BIGINT, floor(start)::BIGINT % 60) AS clock, CASE WHEN length(word) <= 8 THEN word ELSE rtrim(left(word, 5)) || '...' END AS short FROM words""",
    (WORDS,),
)
def _(spark, sf):
    w = T.words(spark, sf)
    c = F.col("word")
    return w.select("source_id", "pos", X.strip_edges(c).alias("stripped"), X.ends_sentence(c).alias("closes"), X.safe_id(c).alias("safe"), X.clock(F.col("start")).alias("clock"), X.trim_text(c, 8).alias("short"))


@query(
    "f_tokens_and_clock",
    r"""SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: length(t) >= 3))) AS n_tokens, len(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda t: t <> ''))) AS n_words,
      md5(trim(regexp_replace(text, '[ \n\t\r]+', ' ', 'g'))) AS collapsed FROM documents""",
)
def _(spark, sf):
    d = T.table(spark, sf, "documents")
    return d.select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"), F.size(X.word_set(F.col("text"))).alias("n_words"), F.md5(X.collapse_spaces(F.col("text"))).alias("collapsed"))


@query(
    "f_lexicon_and_paths",
    r"""SELECT doc_id, CASE WHEN trim(text) = '' THEN 0.5::DOUBLE ELSE round(0.4::DOUBLE * least(1.0::DOUBLE, (contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'que')::INT) / 5.0::DOUBLE)
        + 0.6::DOUBLE * least(1.0::DOUBLE, (contains(lower(text), 'and')::INT + contains(lower(text), 'der')::INT + contains(lower(text), 'las')::INT) / 4.0::DOUBLE), 6) END AS score,
      list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: length(t) >= 3 AND t NOT IN ('the', 'und', 'que', 'and'))[1] AS first_word,
      md5(regexp_replace(replace(text, ' ', '/'), '(?:/[\w.\-]+){2,}', '<path>', 'g')) AS masked FROM documents""",
)
def _(spark, sf):
    d, t = T.table(spark, sf, "documents"), F.col("text")
    return d.select(
        "doc_id", F.round(X.lexicon_score(t, ["the", "und", "que"], ["and", "der", "las"]), 6).alias("score"), X.first_content_word(t, ["the", "und", "que", "and"]).alias("first_word"),
        F.md5(X.mask_paths(F.replace(t, F.lit(" "), F.lit("/")))).alias("masked"),
    )


@query(
    "f_shots_and_grid",
    """, e AS (SELECT *, (clip_id % 23) / 20.0::DOUBLE - 0.05 AS energy, ['dynamic', 'balanced', 'mkbhd_clean', 'documentary', 'other'][clip_id % 5 + 1] AS profile FROM clips),
      p AS (SELECT *, [1.2, 1.5, 1.8, 2.5, 1.5][clip_id % 5 + 1]::DOUBLE AS lo, [1.8, 2.5, 2.8, 3.5, 2.5][clip_id % 5 + 1]::DOUBLE AS mode, [4.0, 5.0, 5.5, 8.0, 5.0][clip_id % 5 + 1]::DOUBLE AS hi FROM e)
    SELECT clip_id, greatest(lo, least(hi, round(CASE WHEN greatest(0, least(1, energy)) < 0.3 THEN mode * 1.4::DOUBLE WHEN energy < 0.6 THEN mode WHEN energy < 0.8 THEN mode * 0.72::DOUBLE ELSE lo + 0.1::DOUBLE END, 2))) AS shot,
      printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS clock, list_transform([1, 2, 3], lambda i: round(start + i * (("end" - start) / 4), 6)) AS grid
    FROM (SELECT *, round_even(greatest(start, 0) * 100, 0)::BIGINT AS cs FROM p)""",
    (CLIPS,),
)
def _(spark, sf):
    c, i = T.clips(spark, sf), F.col("clip_id")
    profile = F.element_at(F.array(*map(F.lit, ("dynamic", "balanced", "mkbhd_clean", "documentary", "other"))), (i % 5 + 1).cast("int"))
    grid = F.transform(Z.even_grid(F.col("start"), F.col("end"), 3), lambda x: F.round(x, 6))
    return c.select("clip_id", Z.shot_duration((i % 23) / F.lit(20.0) - 0.05, profile).alias("shot"), X.clock_cs(F.col("start")).alias("clock"), grid.alias("grid"))


@query(
    "u2_jaccard_sets",
    r""", t AS (SELECT source_id, seg_idx, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS a FROM segments), n AS (SELECT *, lead(a) OVER (PARTITION BY source_id ORDER BY seg_idx) AS b FROM t)
    SELECT source_id, seg_idx, round(len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS sim FROM n WHERE b IS NOT NULL""",
    (SEGMENTS,),
)
def _(spark, sf):
    from cadenza.operators.ordered import lead, running

    s = T.segments(spark, sf).select("source_id", "seg_idx", X.word_set(F.col("text")).alias("a"))
    n = running(s, ["source_id"], ["seg_idx"], {"b": lead("a")}).filter("b is not null")
    return n.select("source_id", "seg_idx", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("sim"))


@query(
    "f_duration_curves",
    """SELECT clip_id, round(CASE WHEN d < 28 OR d > 75 THEN 0 WHEN d <= 42 THEN 0.5 + 0.5 * (d - 28) / 14 ELSE 1 - 0.5 * (d - 42) / 33 END, 6) AS tent, CASE WHEN d < 10 THEN 55 WHEN d < 20 THEN 78 WHEN d < 30 THEN 92 WHEN d <= 60 THEN 100 WHEN d <= 90 THEN 92 WHEN d <= 120 THEN 80 WHEN d <= 180 THEN 68 ELSE 55 END::DOUBLE AS steps
    FROM (SELECT clip_id, round(("end" - start) * (1 + clip_id % 4), 6) AS d FROM clips)""",
    (CLIPS,),
)
def _(spark, sf):
    d = F.round((F.col("end") - F.col("start")) * (1 + F.col("clip_id") % 4), 6)
    return T.clips(spark, sf).select("clip_id", F.round(A.duration_fit_tent(d), 6).alias("tent"), A.duration_fit_steps(d).alias("steps"))


@query(
    "f_json_extraction",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k FROM events""",
)
def _(spark, sf):
    e = T.table(spark, sf, "events")
    i = F.col("event_id") % 4
    raw = F.when(i == 0, F.col("props")).when(i == 1, F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```"))).when(i == 2, F.concat(F.lit("answer "), F.col("props"), F.lit(" done"))).otherwise(F.lit("no json here"))
    return e.select("event_id", F.get_json_object(extract_json(raw), "$.k").cast("long").alias("k"))


@query(
    "f_answer_parse",
    """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'yes' WHEN event_type = 'error' THEN 'no' ELSE 'unknown' END AS answer, CASE WHEN event_type IN ('click', 'view') THEN 0.9 WHEN event_type = 'error' THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence FROM events""",
)
def _(spark, sf):
    from cadenza.functions.answers import parse_answer

    e = T.table(spark, sf, "events")
    k = F.col("event_type")
    said = F.when(k == "click", " Yes, clearly.").when(k == "view", "yes").when(k == "error", "No.").when(k == "purchase", "Maybe").otherwise("")
    a, c = parse_answer(said)
    return e.select("event_id", a.alias("answer"), c.alias("confidence"))


@query(
    "f_frame_regions",
    """SELECT event_id, ['top', 'middle', 'bottom'][1 + least(2, floor(y * 3))::INT] || '-' || ['left', 'center', 'right'][1 + least(2, floor(x * 3))::INT] AS region, round(greatest(0, 1 - sqrt(power(x - 0.5, 2) + power(y - 0.5, 2)) / sqrt(0.5)), 6) AS centered FROM (SELECT event_id, (event_id % 97) / 97.0::DOUBLE AS x, (event_id % 89) / 89.0::DOUBLE AS y FROM events)""",
)
def _(spark, sf):
    from cadenza.functions.scoring import center_score, region9

    e = T.table(spark, sf, "events").select("event_id", ((F.col("event_id") % 97) / F.lit(97.0)).alias("x"), ((F.col("event_id") % 89) / F.lit(89.0)).alias("y"))
    return e.select("event_id", region9(F.col("x"), F.col("y")).alias("region"), F.round(center_score(F.col("x"), F.col("y")), 6).alias("centered"))


@query("f_param_hash", """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","type":"' || p_type || '"}') AS hash, true AS order_free FROM part""")
def _(spark, sf):
    p = T.table(spark, sf, "part")
    m1 = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    m2 = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))
    return p.select("p_partkey", R.param_hash(m1).alias("hash"), (R.param_hash(m1) == R.param_hash(m2)).alias("order_free"))


@query(
    "f_cosine_pair",
    """, n AS (SELECT item_id, v, lead(v) OVER (PARTITION BY source_id ORDER BY item_id) AS b FROM vectors) SELECT item_id, round(coalesce(list_cosine_similarity(v, b), 0), 6) AS retrieval, round(coalesce(list_cosine_similarity(v, b), 1), 6) AS continuity FROM n""",
    (VECTORS,),
)
def _(spark, sf):
    from cadenza.operators.ordered import lead, running

    n = running(T.vectors(spark, sf), ["source_id"], ["item_id"], {"b": lead("v")})
    return n.select("item_id", F.round(cosine(F.col("v"), F.col("b")), 6).alias("retrieval"), F.round(cosine_continuity(F.col("v"), F.col("b")), 6).alias("continuity"))


# --- model surface --------------------------------------------------------------------------------


def hash_embed(texts):
    """Deterministic stand-in for an embedding model: letter counts."""
    return [[float(t.lower().count(ch)) for ch in "aeiou"] for t in texts]


@query(
    "x1_map_model",
    """SELECT conv_id, turn, length(text) - length(replace(lower(text), 'e', '')) AS n_e, '' AS reason FROM conversations""",
)
def _(spark, sf):
    c = T.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    m = M.map_model(c, hash_embed, ["text"], "vec", PT.ArrayType(PT.DoubleType()))
    return m.select("conv_id", "turn", F.get("vec", F.lit(1)).cast("long").alias("n_e"), F.coalesce("failure_reason", F.lit("")).alias("reason"))


@query("x2_map_model_waves", """SELECT source_id, chunk, count(*) AS n, min(wave) AS first_wave, max(wave) AS last_wave FROM (SELECT source_id, chunk, 1 AS wave FROM evidence WHERE agent = 'click' UNION ALL SELECT source_id, chunk, 2 FROM evidence e WHERE agent <> 'click' AND (SELECT count(*) FROM evidence x WHERE x.source_id = e.source_id AND x.chunk = e.chunk AND agent = 'click') = 0) GROUP BY 1, 2""", (EVIDENCE,))
def _(spark, sf):
    e = T.evidence(spark, sf).select("source_id", "chunk", "id", "agent")
    out = M.map_model_waves(
        e,
        lambda c: c.filter("agent = 'click'"),
        lambda one: one.groupBy("source_id", "chunk").agg(F.count(F.lit(1)).alias("covered")),
        lambda c: c.filter("agent <> 'click' and covered is null").drop("covered"),
        ["source_id", "chunk"],
    )
    return out.groupBy("source_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("wave").alias("first_wave"), F.max("wave").alias("last_wave"))


@query(
    "x3_ensemble",
    """, v AS (SELECT source_id, id, start, least(1, strength * (1 + p)) AS score FROM evidence, (SELECT unnest([0.1, 0.2, 0.3]::DOUBLE[]) AS p))
    SELECT source_id, id, 3::BIGINT AS votes, round(median(score), 6) AS median_score FROM v GROUP BY 1, 2""",
    (EVIDENCE,),
)
def _(spark, sf):
    e = T.evidence(spark, sf).select("source_id", "id", "start", "end", F.concat_ws(" ", "text", F.col("id").cast("string")).alias("text"), "strength")
    votes = M.ensemble(e, [0.1, 0.2, 0.3], lambda d: d.withColumn("score", F.least(F.lit(1.0), F.col("strength") * (1 + F.col("parameter")))))
    return A.vote_aggregate(votes, veto=2, cap=10**9).select("source_id", "id", "votes", *r6("median_score"))


@query(
    "x4_improve_loop",
    """SELECT clip_id, greatest(score / 10, CASE WHEN score / 10 < 0.8 THEN score / 10 + 0.1::DOUBLE * (clip_id % 3 - 1) ELSE 0 END, CASE WHEN greatest(score / 10, score / 10 + 0.1::DOUBLE * (clip_id % 3 - 1)) < 0.8 THEN score / 10 + 0.2::DOUBLE * (clip_id % 3 - 1) ELSE 0 END)::DOUBLE AS s FROM clips""",
    (CLIPS,),
)
def _(spark, sf):
    c = T.clips(spark, sf).select("clip_id", (F.col("score") / 10).alias("score"))
    out = M.improve_loop(c, lambda d, r: d.withColumn("score", F.col("score") + F.lit(0.1) * r * (F.col("clip_id") % 3 - 1)), "clip_id", "score", threshold=0.8)
    return out.select("clip_id", F.col("score").alias("s"))


# --- flagship ----------------------------------------------------------------------------------------


@query(
    "flagship_diverse_passages",
    """, a AS (SELECT *, row_number() OVER (PARTITION BY source, left(trim(lower(lang)), 50) ORDER BY score DESC, rid) AS kk FROM (SELECT f.* FROM rk f JOIN walk USING (source, k) WHERE keep AND score >= 6)),
      b AS (SELECT *, CASE WHEN kk <= 2 AND score >= 7 THEN 1 ELSE 2 END AS pass_no FROM a WHERE kk <= 3)
    SELECT source, rid AS passage_id, lang, score, n_words, text, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pass_no, score DESC, rid) AS rank FROM b) WHERE rank <= 12""",
    (
        WORDS,
        """ sess AS (SELECT *, sum(o::INT) OVER (PARTITION BY source_id ORDER BY start, pos) - 1 AS session FROM (
          SELECT *, coalesce(round(start - lag("end") OVER (PARTITION BY source_id ORDER BY start, pos), 9) >= 0.75, true) AS o FROM words))""",
        f""" passage AS (SELECT p.*, d.source, d.lang, {TOKENS_SQL.replace('lower(text)', 'lower(p.text)')} AS tok FROM (
          SELECT source_id, session, count(*) AS n_words, string_agg(word, ' ' ORDER BY pos) AS text FROM sess GROUP BY 1, 2 HAVING count(*) >= 5) p JOIN documents d ON d.doc_id = p.source_id)""",
        """ scored AS (SELECT *, source_id * 1000000 + session AS rid, round(10 * (0.6::DOUBLE * (1 - least(1.0::DOUBLE, abs(n_words - 20) / 20.0::DOUBLE)) + 0.4::DOUBLE * least(1.0::DOUBLE, len(tok) / n_words::DOUBLE)), 4) AS score FROM passage)""",
        """ best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, session) <= 7)""",
        *greedy_sql("best", "source", "score DESC, rid", "r.tok", f"len(r.tok) = 0 OR len(list_filter(w.acc, lambda a: len(a) > 0 AND round({_JAC} - 0.85, 9) > 0)) = 0"),
    ),
    recursive=True,
)
def _(spark, sf):
    """Best diverse passages per document source.

    Words -> sessions -> passages with a length and lexicon score -> near-duplicates dropped within a source -> best per
    document -> topic-diverse ranking per source. No step handles a source or a document collection as one group.
    """
    w = T.words(spark, sf, extra=("source", "lang"))
    s = G.sessionize(w, max_span=None)
    rows = F.sort_array(F.collect_list(F.struct("pos", "word")))
    p = s.groupBy("source_id", "session", "source", "lang").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_words"), F.array_join(F.transform(rows, lambda x: x["word"]), " ").alias("text")
    )
    p = p.filter("n_words >= 5").withColumn("tok", X.tokens(F.col("text")))
    # length fit peaks at 20 words; distinct words count as richness
    fit = 1 - F.least(F.lit(1.0), F.abs(F.col("n_words") - 20) / F.lit(20.0))
    rich = F.size("tok") / F.col("n_words")
    p = p.withColumns({"score": F.round(10 * (0.6 * fit + 0.4 * F.least(F.lit(1.0), rich)), 4), "passage_id": F.col("source_id") * 1_000_000 + F.col("session")})
    w1 = Window.partitionBy("source_id").orderBy(F.desc("score"), "session")
    best = p.withColumn("_k", F.row_number().over(w1)).filter("_k <= 7").drop("_k")
    d = dedup_jaccard(best, id="passage_id", rank=[-F.col("score")], tokens="tok", threshold=0.85, key="source")
    r = K.rank_diverse_by_topic(d, 12, key=["source"], topic="lang", id="passage_id")
    return r.select("source", "passage_id", "lang", "score", "n_words", "text", "rank")
