"""Diverse selection: conflict filters, novelty ranking, clusters, quotas."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.vector import cosine
from cadenza.operators.greedy import FEW, SKETCH, greedy_select, jaccard, overlap_len, parity_sketch, time_buckets, token_buckets
from cadenza.operators.ordered import row_index, running
from cadenza.operators.vector_join import similar_vectors
from cadenza.session import materialize, materialize_by


def nms_overlap(df: DataFrame, *, id: str, score: str, start="start", end="end", key="source_id", limit: float = 0.4, width: float = 96.0) -> DataFrame:
    """Best first; a span that overlaps an accepted one by more than ``limit`` of the shorter span is dropped."""

    def conflict(a, b):
        inter = overlap_len(F.col(f"{a}.{start}"), F.col(f"{a}.{end}"), F.col(f"{b}.{start}"), F.col(f"{b}.{end}"))
        shorter = F.least(F.col(f"{a}.{end}") - F.col(f"{a}.{start}"), F.col(f"{b}.{end}") - F.col(f"{b}.{start}"))
        return (shorter > 0) & (F.round(inter - limit * shorter, 9) > 0)

    buckets = time_buckets(F.col(key), F.col(start), F.col(end), width)
    return greedy_select(df, id=id, rank=[-F.col(score)], buckets=buckets, conflict=conflict, payload=[start, end])


def dedup_jaccard(df: DataFrame, *, id: str, rank: Sequence[Column], tokens: str, threshold: float, key="source_id", strict: bool = True) -> DataFrame:
    """Best first; a row whose token Jaccard with an accepted row is above ``threshold`` is dropped.

    Rows without tokens stay. ``strict=False`` drops at the threshold already.
    """
    # rounds carry ids, ranks and hashes; the rows themselves are joined once, at the end
    ranks = [c.alias(f"_rk{i}") for i, c in enumerate(rank)]
    order = [f"_rk{i}" for i in range(len(rank))]
    tok = F.array_sort(F.transform(tokens, lambda x: F.xxhash64(x)))
    t = materialize(df.select(id, key, *ranks, tok.alias("_tok")))
    # of equal sets only the best can stay: what drops it drops all, and else it drops them
    alike = [key, F.xxhash64("_tok").alias("_h"), F.xxhash64(F.lit(1), "_tok").alias("_i")]
    sets = t.filter(F.size("_tok") > 0).select(id, *order, *alike)
    of = Window.partitionBy(key, "_h", "_i").orderBy(*order, id)
    copies = materialize(sets.withColumn("_c", F.row_number().over(of)).filter("_c > 1").select(id)) if threshold < 1 or not strict else sets.select(id).limit(0)
    t = t.join(F.broadcast(copies), id, "left_anti") if copies.count() <= FEW else materialize(t.join(copies, id, "left_anti"))

    def conflict(a, b):
        sim = jaccard(F.col(f"{a}._tok"), F.col(f"{b}._tok"))
        return F.round(sim - threshold, 9) > 0 if strict else F.round(sim - threshold, 9) >= 0

    def close_sizes(a, b):
        # and enough tokens must follow the first shared one, which their own bucket tells
        m, n = F.col(f"{a}._n"), F.col(f"{b}._n")
        both = F.least(m - F.col(f"{a}._q"), n - F.col(f"{b}._q"))
        return (F.least(m, n) >= threshold * F.greatest(m, n) - 1e-9) & (both >= threshold / (1 + threshold) * (m + n) - 1e-6)

    rows = token_buckets(t.filter(F.size("_tok") > 0), key, "_tok", threshold, [id, *order])
    rows = rows.select(id, *order, F.col("_n").cast("int").alias("_n"), F.posexplode("_tb").alias("_q", "_b"))
    kept = greedy_select(t, id=id, rank=[F.col(c) for c in order], rows=rows, conflict=conflict, payload=["_tok"], wide=True, quick=close_sizes, quick_payload=["_n", "_q"])
    return df.join(kept.select(id), id, "left_semi")


TILE_PAIRS = 20_000  # pairs of one tile, about


def similar_pairs(df: DataFrame, *, id: str, threshold: float, tokens: str | None = None, vec: str | None = None, metric: str = "jaccard", key="source_id") -> DataFrame:
    """(key, id_a, id_b, sim) with a similarity of at least ``threshold``: ``metric`` is "jaccard" of ``tokens`` or "cosine" of ``vec``.

    Equal token sets are represented by their smallest id: copies link to it, and only representatives are
    paired, over their rarest tokens. A group of copies therefore gives a row per copy, not per pair. Vectors: see
    :func:`cadenza.operators.vector_join.similar_vectors`.
    """
    if metric == "cosine":
        return similar_vectors(df, id=id, vec=vec, threshold=threshold, key=key)
    if metric != "jaccard":
        raise ValueError(f"unknown metric {metric}")
    d = materialize(df.select(key, id, F.array_sort(F.transform(tokens, lambda x: F.xxhash64(x))).alias("_tok")).filter(F.size("_tok") > 0))
    of = Window.partitionBy(key, "_h", "_i")
    same = materialize(d.select(key, id, F.xxhash64("_tok").alias("_h"), F.xxhash64(F.lit(1), "_tok").alias("_i")).withColumn("_rep", F.min(id).over(of)).filter(F.col(id) != F.col("_rep")).select(key, "_rep", id))
    copies = same.select(key, F.col("_rep").alias("id_a"), F.col(id).alias("id_b"), F.lit(1.0).alias("sim"))
    gone = same.select(id)
    r = d.join(F.broadcast(gone), id, "left_anti") if gone.count() <= FEW else materialize(d.join(gone, id, "left_anti"))
    x = token_buckets(r, key, "_tok", threshold, [id]).select(F.col(id).alias("_id"), F.col("_n").cast("int").alias("_n"), F.posexplode("_tb").alias("_p", "_b"))
    a, b = x.toDF("id_a", "_na", "_pa", "_b"), x.toDF("id_b", "_nb", "_pb", "_b")
    # a pair can reach the threshold only when the sizes are close, and enough tokens follow the first shared one
    both = F.least(F.col("_na") - F.col("_pa"), F.col("_nb") - F.col("_pb"))
    needed = threshold / (1 + threshold) * (F.col("_na") + F.col("_nb")) - 1e-6
    c = a.join(b, "_b").filter((F.col("id_a") < F.col("id_b")) & (both >= needed) & (F.least("_na", "_nb") >= threshold * F.greatest("_na", "_nb") - 1e-9))
    c = materialize(c.select("id_a", "id_b").distinct())
    # sketches first: sets are shuffled for the few pairs that they leave
    s = parity_sketch(r, "_tok", [id]).join(r.select(id, F.size("_tok").alias("_n")), id)
    c = c.join(s.toDF("id_a", "_sa", "_na"), "id_a").join(s.toDF("id_b", "_sb", "_nb"), "id_b")
    apart = F.aggregate(F.zip_with("_sa", "_sb", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, n: t + n)
    near = materialize(c.filter(apart <= (1 - threshold) / (1 + threshold) * (F.col("_na") + F.col("_nb")) + 1e-6).select("id_a", "id_b"))
    # sets go to tiles of pairs, once for each tile that needs them: pairs are grouped by their smallest relative, which families share
    low = near.groupBy("id_b").agg(F.min("id_a").alias("_l")).withColumnRenamed("id_b", "_x")
    near = near.join(low, near["id_a"] == low["_x"], "left").select("id_a", "id_b", F.coalesce("_l", "id_a").alias("_l"))
    size = near.groupBy("_l").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / TILE_PAIRS)).alias("_s"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("_s"))
    near = materialize(near.join(size, "_l").select("id_a", "id_b", F.xxhash64("_l", part("id_a"), part("id_b")).alias("_t")))
    asked = near.select("_t", F.explode(F.array("id_a", "id_b")).alias(id)).distinct()
    key_t, id_t = r.schema[key].dataType.simpleString(), r.schema[id].dataType.simpleString()
    sent = r.withColumnRenamed(key, "_k").join(asked.withColumnRenamed("_t", "_u"), id).select("_u", "_k", F.col(id).alias("_id"), "_tok")

    def compare(pairs: pa.Table, held: pa.Table) -> pa.Table:
        at = {x: i for i, x in enumerate(held["_id"].to_pylist())}
        keys, sets = held["_k"].to_pylist(), [x.values.to_numpy() for x in held["_tok"]]
        out: tuple[list, list, list, list] = ([], [], [], [])
        for x, y in zip(pairs["id_a"].to_pylist(), pairs["id_b"].to_pylist()):
            i, j = at[x], at[y]
            if keys[i] != keys[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            for col, value in zip(out, (keys[i], x, y, both / (len(sets[i]) + len(sets[j]) - both))):
                col.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, (held.schema.field("_k").type, pairs.schema.field("id_a").type, pairs.schema.field("id_b").type, pa.float64()))], names=[key, "id_a", "id_b", "sim"])

    near = near.groupBy("_t").cogroup(sent.groupBy("_u")).applyInArrow(compare, f"{key} {key_t}, id_a {id_t}, id_b {id_t}, sim double")
    near = near.filter(F.round(F.col("sim") - threshold, 9) >= 0)
    return near.select(key, "id_a", "id_b", "sim").unionByName(copies)


def _seg_inter(a: Column, b: Column) -> Column:
    """Total intersection of two lists of spans."""
    return F.aggregate(
        a, F.lit(0.0), lambda s, x: s + F.aggregate(b, F.lit(0.0), lambda t, y: t + overlap_len(x["s"], x["e"], y["s"], y["e"]))
    )


def _seg_len(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + (x["e"] - x["s"]))


def _seg_buckets(key: Column, segs: Column, width: float) -> Column:
    return F.array_distinct(F.flatten(F.transform(segs, lambda x: time_buckets(key, x["s"], x["e"], width))))


def dedup_iou(plans: DataFrame, *, id: str, score: str, segs: str = "segs", key="source_id", threshold: float = 0.7, width: float = 96.0) -> DataFrame:
    """Multi-span plans, best first; temporal intersection over union >= ``threshold`` drops a plan."""

    def conflict(a, b):
        sa, sb = F.col(f"{a}.{segs}"), F.col(f"{b}.{segs}")
        inter = _seg_inter(sa, sb)
        union = _seg_len(sa) + _seg_len(sb) - inter
        return (union > 0) & (F.round(inter - threshold * union, 9) >= 0)

    return greedy_select(plans, id=id, rank=[-F.col(score)], buckets=_seg_buckets(F.col(key), F.col(segs), width), conflict=conflict, payload=[segs])


# Thresholds of the plan filter (token Jaccard, vector cosine, share of a reused span).
STRICT = {"jaccard": 0.65, "cosine": 0.88, "overlap": 0.30}
LOOSE = {"jaccard": 0.88, "cosine": 0.92, "overlap": 1.01}
MIN_TOKENS = 8


SMALL_SOURCE = 256  # plans of a source up to which its texts are compared without token buckets


def _plan_tables(plans: DataFrame, params: dict, small: int, width: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slim plans, token sets, bucket rows) of plans; vectors and tokens are in none of the rows that rounds rewrite.

    Bucket rows (plan_id, _kd, _b) hold a level each, and every repetition of that level shares one: reused spans lie in one time bin
    (1), close vectors have a bucket per pair of different ones and one per group of equal ones (2), similar texts share one of
    their rarest tokens (3). The plans of a source with at most ``small`` of them share one bucket for their texts instead.
    """
    tok = F.array_sort(F.transform("tokens", lambda x: F.xxhash64(x)))
    p = materialize(plans.select("source_id", "plan_id", "score", "segs", "vec", tok.alias("_tok")))
    named = p.withColumns({"_n": F.greatest(F.size("_tok"), F.lit(0)), "_h": F.xxhash64("_tok"), "_i": F.xxhash64(F.lit(1), "_tok")})
    slim = materialize(parity_sketch(named, "_tok", ["source_id", "plan_id", "score", "segs", "_n", "_h", "_i"]))
    sets = materialize(named.filter("_n > 0").groupBy("_h", "_i").agg(F.first("_tok").alias("_tok")))

    # equal vectors are one in the join; copies are found by two hashes
    v = p.filter(F.col("vec").isNotNull()).select("source_id", "plan_id", "vec", F.xxhash64("vec").alias("_vh"), F.xxhash64(F.lit(1), "vec").alias("_vi"))
    reps = materialize(v.groupBy("source_id", "_vh", "_vi").agg(F.min("plan_id").alias("_rep"), F.first("vec").alias("vec")))
    close = lambda a, b: F.round(cosine(F.col(a), F.col(b)) - params["cosine"], 9) >= 0
    pairs = similar_vectors(reps, id="_rep", vec="vec", key="source_id", threshold=params["cosine"] - 1e-9, apart=True).select("id_a", "id_b")
    of = reps.select("_rep", "vec")
    pairs = materialize(pairs.join(of.toDF("id_a", "_va"), "id_a").join(of.toDF("id_b", "_vb"), "id_b").filter(close("_va", "_vb")).select("id_a", "id_b"))
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("_rep"), F.xxhash64("id_a", "id_b").alias("_b"))
    ends = ends.unionByName(reps.filter(close("vec", "vec")).select("_rep", F.xxhash64(F.lit("e"), "_rep").alias("_b")))
    near = v.select("plan_id", "source_id", "_vh", "_vi").join(reps.drop("vec"), ["source_id", "_vh", "_vi"]).join(ends, "_rep").select("plan_id", F.lit(2).alias("_kd"), "_b")

    size = slim.filter("_n > 0").groupBy("source_id").agg(F.count(F.lit(1)).alias("_m"))
    many = materialize(size.filter(F.col("_m") > small).select("source_id"))
    wordy = slim.filter("_n > 0").join(many, "source_id", "left_anti").select("plan_id", F.lit(3).alias("_kd"), F.xxhash64(F.lit("s"), "source_id").alias("_b"))
    if not many.isEmpty():
        large = p.filter(F.size("_tok") > 0).join(F.broadcast(many) if many.count() <= FEW else many, "source_id", "left_semi")
        x = token_buckets(large, "source_id", "_tok", params["jaccard"], ["plan_id"])
        wordy = wordy.unionByName(x.select("plan_id", F.lit(3).alias("_kd"), F.explode("_tb").alias("_b")))
    rows = near.unionByName(wordy)
    if params["overlap"] <= 1:
        bins = _seg_buckets(F.col("source_id"), F.col("segs"), width)
        rows = rows.unionByName(slim.select("plan_id", F.lit(1).alias("_kd"), F.explode(F.transform(bins, lambda x: F.xxhash64(F.lit("t"), x))).alias("_b")))
    return slim, sets, rows


def plan_buckets(plans: DataFrame, params: dict = STRICT, width: float = 96.0) -> DataFrame:
    """(plan_id, _pb): buckets of which plans that can repeat each other share one. No bucket is a source."""
    slim, _, rows = _plan_tables(plans, params, 0, width)
    named = rows.groupBy("plan_id").agg(F.collect_set(F.concat_ws("|", "_kd", "_b")).alias("_pb"))
    return slim.select("plan_id").join(named, "plan_id", "left").withColumn("_pb", F.coalesce("_pb", F.array().cast("array<string>")))


_PLAN_SIDE = ["_kd", "segs", "_n", "_h", "_i", "_s"]  # of a bucket row: what its level needs


def _plan_rows(slim: DataFrame, rows: DataFrame) -> DataFrame:
    """Bucket rows with what pairs are compared by: spans at level 1, sizes, sketches and names of token sets at level 3."""
    only = lambda c, k: F.when(F.col("_kd") == k, F.col(c)).alias(c)
    return rows.join(slim, "plan_id").select("plan_id", "source_id", "score", "_b", "_kd", only("segs", 1), *[only(c, 3) for c in ("_n", "_h", "_i", "_s")])


def _plan_clashes(pairs: DataFrame, sets: DataFrame, params: dict, keep: Sequence[str]) -> DataFrame:
    """``keep`` of the pairs of bucket rows (a: better, b: worse) that repeat each other at the level of their bucket."""
    t = params["jaccard"]
    a, b = F.col("a"), F.col("b")
    reused = F.exists(
        b["segs"], lambda y: F.exists(a["segs"], lambda x: F.round(overlap_len(x["s"], x["e"], y["s"], y["e"]) / F.greatest(F.lit(1e-6), y["e"] - y["s"]) - params["overlap"], 9) >= 0)
    )
    same = (a["_h"] == b["_h"]) & (a["_i"] == b["_i"])
    apart = F.bit_count(a["_s"][0].bitwiseXOR(b["_s"][0]))
    for i in range(1, SKETCH // 64):
        apart = apart + F.bit_count(a["_s"][i].bitwiseXOR(b["_s"][i]))
    both = a["_n"] + b["_n"]
    fits = (F.least(a["_n"], b["_n"]) >= t * F.greatest(a["_n"], b["_n"]) - 1e-9) & (apart <= (1 - t) / (1 + t) * both + 1e-6)
    level = F.when((a["_kd"] == 1) & reused, 1).when(a["_kd"] == 2, 2).when((a["_kd"] == 3) & (b["_n"] >= MIN_TOKENS) & fits, 3)
    sure = (a["_kd"] < 3) | same
    left = pairs.filter(a["_kd"] == b["_kd"]).withColumn("_l", level).filter("_l is not null")
    left = left.select(*keep, "_l", sure.alias("_sure"), *[x[c].alias(f"{c}{n}") for n, x in (("a", a), ("b", b)) for c in ("_h", "_i")])
    left = materialize(left.distinct())
    asked = left.filter("not _sure").select("_ha", "_ia", "_hb", "_ib").distinct()
    of = lambda n: sets.toDF(f"_h{n}", f"_i{n}", f"_t{n}")
    like = asked.join(of("a"), ["_ha", "_ia"]).join(of("b"), ["_hb", "_ib"]).filter(F.round(jaccard(F.col("_ta"), F.col("_tb")) - t, 9) >= 0)
    like = like.select("_ha", "_ia", "_hb", "_ib")
    return left.filter("_sure").select(*keep, "_l").unionByName(left.filter("not _sure").join(like, ["_ha", "_ia", "_hb", "_ib"], "left_semi").select(*keep, "_l"))


def unique_plans(plans: DataFrame, *, cap: Column | None = None, bound: int = 1000, params: dict = STRICT) -> DataFrame:
    """Plans (source_id, plan_id, score, segs, vec, tokens), best first, that repeat no accepted plan; with ``cap`` at most so many per source.

    A plan repeats another when one of its spans lies in an accepted span, when the mean vectors are close, or when
    long enough texts share words. Acceptance looks at better plans only, so the cap (``bound`` at most) is a limit on the rank, ``pick``;
    plans behind it are not compared.
    """
    slim, sets, rows = _plan_tables(plans, params, SMALL_SOURCE, 96.0)
    # a plan in no bucket repeats nothing
    kept = greedy_select(
        slim.select("source_id", "plan_id", "score"), id="plan_id", rank=[-F.col("score")], rows=_plan_rows(slim, rows), quick_payload=_PLAN_SIDE,
        settle=lambda pairs: _plan_clashes(pairs, sets, params, ["_id"]), cap=None if cap is None else ("source_id", cap, bound),
    )
    if cap is not None:
        w = Window.partitionBy("source_id").orderBy(F.desc("score"), "plan_id")
        ranked = kept.withColumns({"pick": F.row_number().over(w), "_cap": cap}).filter(F.col("pick") <= bound)
        kept = ranked.filter(F.col("pick") <= F.col("_cap"))
    kept = kept.drop("source_id", "score", "_cap")
    return plans.join(kept, "plan_id").select(*plans.columns, *(["pick"] if cap is not None else []))


def reject_levels(plans: DataFrame, kept: DataFrame, params: dict = STRICT) -> DataFrame:
    """Rejected plans per source by the first level that rejects them: reused span, vector, words.

    Plans are compared with the accepted ones of their buckets (see :func:`_plan_tables`) only.
    """
    slim, sets, rows = _plan_tables(plans, params, SMALL_SOURCE, 96.0)
    won = materialize(kept.select("plan_id"))
    x = _plan_rows(slim, rows).select("_b", "plan_id", "source_id", F.struct(-F.col("score"), "plan_id").alias("_r"), F.struct(*_PLAN_SIDE).alias("p"))
    mine = x.join(won, "plan_id", "left_anti").select("_b", "plan_id", "source_id", F.col("_r").alias("_rb"), F.col("p").alias("b"))
    theirs = x.join(won, "plan_id", "left_semi").select("_b", F.col("_r").alias("_ra"), F.col("p").alias("a"))
    lv = _plan_clashes(mine.join(theirs, "_b").filter(F.col("_ra") < F.col("_rb")), sets, params, ["source_id", "plan_id"])
    lv = lv.groupBy("source_id", "plan_id").agg(F.min("_l").alias("_l"))
    return lv.groupBy("source_id").agg(*[F.count(F.when(F.col("_l") == i, 1)).alias(n) for i, n in ((1, "reused_span"), (2, "near_vector"), (3, "same_words"))])


def unique_plans_relaxed(plans: DataFrame, *, low: Column, cap: Column, params: dict = STRICT, step: float = 0.15) -> DataFrame:
    """:func:`unique_plans`; sources left with fewer than ``low`` plans run again with a higher word threshold."""
    first = materialize(unique_plans(plans, cap=cap, params=params))
    n = first.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    short = n.withColumn("_low", low).filter(F.col("_n") < F.col("_low")).select("source_id")
    again = unique_plans(plans.join(short, "source_id", "left_semi"), cap=cap, params={**params, "jaccard": params["jaccard"] + step})
    return first.join(short, "source_id", "left_anti").withColumn("relaxed", F.lit(False)).unionByName(again.withColumn("relaxed", F.lit(True)))


def dedup_within_plan(segs: DataFrame, *, plan: Sequence[str], seg: str, id: str, start: str, end: str, share: float = 0.6) -> DataFrame:
    """Later segments of a plan covered by an accepted one on at least ``share`` of their length are dropped."""

    def conflict(a, b):
        own = F.greatest(F.lit(1e-6), F.col(f"{b}.{end}") - F.col(f"{b}.{start}"))
        inter = overlap_len(F.col(f"{a}.{start}"), F.col(f"{a}.{end}"), F.col(f"{b}.{start}"), F.col(f"{b}.{end}"))
        return F.round(inter / own - share, 9) >= 0

    bucket = F.array(F.concat_ws("|", *[F.col(c).cast("string") for c in plan]))
    return greedy_select(segs, id=id, rank=[F.col(seg)], buckets=bucket, conflict=conflict, payload=[start, end])


def ceiling_by_duration(duration: Column) -> Column:
    # fixed values: ceilings by minutes of source
    m = F.greatest(F.lit(0.0), duration) / 60
    return F.when(m < 10, 8).when(m < 15, 15).when(m < 30, 20).when(m < 60, 25).otherwise(30)


def cap_by_duration(plans: DataFrame, duration: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """Token dedup at ``threshold``, then at most a duration-dependent number per source."""
    kept = dedup_jaccard(plans, id="plan_id", rank=[-F.col("score")], tokens="tokens", threshold=threshold, strict=False)
    w = Window.partitionBy("source_id").orderBy(F.desc("score"), "plan_id")
    k = kept.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= 30)
    return k.join(duration.select("source_id", ceiling_by_duration(F.col("duration")).alias("_c")), "source_id").filter(F.col("pick") <= F.col("_c")).drop("_c")


def select_in_batches(
    ranked: DataFrame,
    key: str,
    *,
    cols: Sequence[str],
    step: Callable[[object, tuple], tuple | None],
    init: Callable[[], object],
    full: Callable[[object], bool],
    schema: str,
    batch: int = 4096,
    states: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Walk every key's rows in rank order (``_i`` = 1, 2, ...), a bounded batch per round, until ``full`` or exhausted.

    ``step(state, row)`` may change the state and returns an output row or None. The state must stay small; it meets its rows in
    the task, once per key and round, and is never copied to them. Returns the output rows and the final states (key, _state); a key of
    any size is never one group.
    """
    spark = ranked.sparkSession
    key_t = ranked.schema[key].dataType
    out_fields = T._parse_datatype_string(schema).fields
    outer = T.StructType([T.StructField(key, key_t), *out_fields, T.StructField("_state", T.BinaryType()), T.StructField("_full", T.BooleanType())])
    names = [f.name for f in out_fields]
    # written once by round, so that a round neither numbers the rows again nor reads those of others
    ranked = materialize_by(ranked.filter(F.col(key).isNotNull()).select(key, "_i", *cols, F.floor((F.col("_i") - 1) / batch).alias("_round")), "_round", key)
    top = ranked.groupBy(key).agg(F.max("_i").alias("_total"))
    live = top.withColumn("_state", F.lit(None).cast("binary"))
    if states is not None:
        live = top.join(states, key)
    live = materialize(live)

    def work(pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or held.empty:
            return pd.DataFrame({c: [] for c in [key, *names, "_state", "_full"]})
        pdf = pdf.sort_values("_i")
        raw = held["_state"].iloc[0]
        state = init() if raw is None else pickle.loads(bytes(raw))
        rows = []
        for r in pdf[list(cols)].itertuples(index=False, name=None):
            if full(state):
                break
            got = step(state, r)
            if got is not None:
                rows.append(got)
        k = pdf[key].iloc[0]
        table = [(k, *r, None, None) for r in rows]
        table.append((k, *[None] * len(names), pickle.dumps(state), full(state)))
        return pd.DataFrame(table, columns=[key, *names, "_state", "_full"])

    parts, finals, lo = [], [], 0
    while True:
        b = ranked.filter(F.col("_round") == lo // batch).select(key, "_i", *cols)
        done = materialize(b.groupBy(key).cogroup(live.select(key, "_state").groupBy(key)).applyInPandas(work, outer))
        parts.append(done.filter("_state is null").select(key, *names))
        st = done.filter("_state is not null").select(key, "_state", "_full")
        lo += batch
        nxt = live.select(key, "_total").join(st, key)
        over = F.col("_full") | (F.col("_total") <= lo)
        finals.append(nxt.filter(over).select(key, "_state"))
        live = materialize(nxt.filter(~over).select(key, "_total", "_state"))
        if live.isEmpty():
            break
    rows, ends = parts[0], finals[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    for p in finals[1:]:
        ends = ends.unionByName(p)
    return rows, ends


def _cos(a, b) -> float:
    if a is None or b is None or len(a) != len(b):
        return 0.0
    d = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(np.dot(a, b)) / d if d > 1e-9 else 0.0


# Limits of similarity to what is selected, by vectors and by words, and in the second pass.
NOVEL_COSINE, NOVEL_WORDS, NOVEL_SECOND = 0.72, 0.6, 0.85
FRONT = 64  # arcs of a source that are walked in one round
STATE_BYTES = 64 << 20  # selected vectors or words that a broadcast may carry


def _alike(a: Column, b: Column, words: bool) -> Column:
    return jaccard(a, b) if words else cosine(a, b)


def rank_novel(
    arcs: DataFrame, *, target: int, kind_cap: int = 2, words: bool = False, max_sim: float | None = None, second_sim: float = NOVEL_SECOND, min_len: float = 28.0, max_len: float = 75.0
) -> DataFrame:
    """Arcs (source_id, arc_id, chapter, kind, hook_score, arc_score, start, end, v) -> novel picks with final scores.

    Composite = .4 hook + .4 arc + .2 duration fit. First pass: at most ``kind_cap`` per closure kind and no arc too close to
    one selected. Second pass, when places are left: new chapters only, no kind cap, a looser limit. With ``words`` the rule compares
    ``tokens`` instead of ``v``, for when vectors are missing.

    A round walks the ``FRONT`` best arcs of every source that can still be selected; all others are then compared
    with what was selected, in parallel, and dropped when too close. The best one left is always selected, so there are at most
    ``target`` rounds a pass, however many arcs a source has.
    """
    from cadenza.operators.stats import duration_fit_tent

    max_sim = (NOVEL_WORDS if words else NOVEL_COSINE) if max_sim is None else max_sim
    d = F.col("end") - F.col("start")
    a = arcs.filter((d >= min_len) & (d <= max_len))
    a = a.withColumn("composite", 0.4 * F.col("hook_score") + 0.4 * F.col("arc_score") + 0.2 * duration_fit_tent(d))
    what = F.array_distinct(F.transform("tokens", lambda x: F.xxhash64(x).cast("double"))) if words else F.col("v")
    key_t = arcs.schema["source_id"].dataType.simpleString()
    ranked = materialize(a.select("source_id", "arc_id", F.col("chapter").cast("long").alias("chapter"), F.col("kind").cast("string").alias("kind"), "composite", what.alias("w"), (-F.round("composite", 9)).alias("_neg")))
    pick_schema = f"source_id {key_t}, arc_id long, rank long, final_score double, novelty double, pass_no long, chapter long, kind string, w array<double>, _neg double, _last_neg double, _last_arc long"

    def close(x, y) -> float:
        if not words:
            return _cos(x, y)
        x, y = set(x if x is not None else ()), set(y if y is not None else ())
        return len(x & y) / len(x | y) if x and y else 0.0

    def walk(pass_no: int, limit: float):
        def go(front: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            held = held.sort_values("rank")
            vecs, chapters = list(held["w"]), set(held["chapter"].tolist())
            kinds = held["kind"].value_counts().to_dict()
            rows, last = [], None
            for r in front.sort_values(["_neg", "arc_id"]).itertuples(index=False):
                if len(vecs) >= target:
                    break
                last = (r[6], r[1])
                source, arc, chapter, kind, comp, w, neg = r
                if kinds.get(kind, 0) >= kind_cap if pass_no == 1 else chapter in chapters:
                    continue
                nov = max(0.0, min(1.0, 1.0 - max((close(w, x) for x in vecs), default=0.0)))
                if round(nov - (1.0 - limit), 9) < 0:
                    continue
                vecs.append(w)
                chapters.add(chapter)
                kinds[kind] = kinds.get(kind, 0) + 1
                rows.append([source, arc, len(vecs), float(comp * nov), float(nov), pass_no, chapter, kind, w, neg])
            return pd.DataFrame([[*x, *(last or (None, None))] for x in rows], columns=[c.split()[0] for c in pick_schema.split(", ")])

        return go

    def left_over(rows: DataFrame, picked: DataFrame, fresh: DataFrame, pass_no: int, limit: float) -> DataFrame:
        """Arcs that may still be selected: behind what was walked, of a source with places left, unlike all that is selected."""
        s = picked.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"), F.collect_list("kind").alias("_kinds"), F.collect_set("chapter").alias("_chapters"))
        n = fresh.groupBy("source_id").agg(F.collect_list("w").alias("_ws"), F.max(F.struct("_last_neg", "_last_arc")).alias("_last"))
        s = materialize(s.join(n, "source_id").select(F.col("source_id").alias("_s"), "_n", "_kinds", "_chapters", "_ws", "_last"))
        size = s.agg(F.sum(F.aggregate("_ws", F.lit(0), lambda t, x: t + 8 * F.coalesce(F.size(x), F.lit(0)) + 64))).first()[0] or 0
        j = rows.join(F.broadcast(s) if size <= STATE_BYTES else s, rows["source_id"] == F.col("_s"))
        behind = F.struct(F.col("_neg"), F.col("arc_id")) > F.struct(F.col("_last._last_neg"), F.col("_last._last_arc"))
        open_ = (F.size(F.filter("_kinds", lambda k: k == F.col("kind"))) < kind_cap) if pass_no == 1 else ~F.array_contains("_chapters", F.col("chapter"))
        unlike = F.forall("_ws", lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.greatest(F.lit(0.0), _alike(F.col("w"), x, words)))) - (1.0 - limit), 9) >= 0)
        return j.filter((F.col("_n") < target) & behind & F.coalesce(open_, F.lit(True)) & unlike).select(*rows.columns)

    order = Window.partitionBy("source_id").orderBy("_neg", "arc_id")
    spark = arcs.sparkSession
    picked = spark.createDataFrame([], pick_schema)
    for pass_no, limit in ((1, max_sim), (2, second_sim)):
        rows = ranked
        if pass_no == 2:
            # places left: the second pass starts over with the arcs not selected, which must be unlike all that are
            ends = picked.withColumns({"_last_neg": F.lit(float("-inf")), "_last_arc": F.lit(-1).cast("long")})
            none = ranked.join(picked.select("source_id").distinct(), "source_id", "left_anti")
            rows = materialize(left_over(ranked, picked, ends, 2, limit).unionByName(none))
        for _ in range(target + 1):
            front = rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= FRONT).drop("_k")
            held = picked.select("source_id", "rank", "chapter", "kind", "w")
            fresh = materialize(front.groupBy("source_id").cogroup(held.groupBy("source_id")).applyInPandas(walk(pass_no, limit), pick_schema))
            if fresh.isEmpty():
                break
            picked = materialize(picked.unionByName(fresh))
            rows = materialize(left_over(rows, picked, fresh, pass_no, limit))
    return picked.select("source_id", "arc_id", "rank", "final_score", "novelty", "pass_no")


def leader_clusters(items: DataFrame, *, threshold: float = 0.72) -> DataFrame:
    """Items (source_id, item_id, v, _i) join the first cluster whose running mean is close enough, else open one.

    Order-dependent on purpose. Meant for the ranked pool, which :func:`dynamic_caps` limits to a few hundred rows per source, so
    that one round is the rule; a larger pool takes a round for every 4096 of a source's rows.
    """

    def step(state, row):
        item, v = row
        for c, (total, n) in enumerate(state):
            if round(_cos(v, total / n) - threshold, 9) >= 0:
                state[c] = (total + v, n + 1)
                return (item, c)
        state.append((np.array(v, dtype=float), 1))
        return (item, len(state) - 1)

    rows, _ = select_in_batches(items, "source_id", cols=["item_id", "v"], step=step, init=list, full=lambda s: False, schema="item_id long, cluster long")
    return rows


def quota_arc(ranked: DataFrame) -> DataFrame:
    """Per source: 1 hook, 2 setups and 1 development from the same material, 2 peaks, 1 payoff, filler up to five.

    ``ranked``: source_id, id, category, score. Only the best three per category are ever needed.
    """
    w = Window.partitionBy("source_id", "category").orderBy(F.desc("score"), "id")
    r = ranked.withColumn("_k", F.row_number().over(w)).filter("_k <= 3")
    c, k = F.col("category"), F.col("_k")
    role = (
        F.when((c == "hook_candidate") & (k <= 1), "hook")
        .when((c == "development_material") & (k <= 2), "setup")
        .when((c == "development_material") & (k == 3), "development")
        .when((c == "peak_candidate") & (k <= 2), "peak")
        .when((c == "payoff_candidate") & (k <= 1), "payoff")
        .when((c == "cutaway_material") & (k <= 2), "filler")
    )
    place = F.when(role == "hook", 0).when(role == "setup", 1).when(role == "development", 2).when(role == "peak", 3).when(role == "payoff", 4).otherwise(5)
    r = r.withColumns({"role": role, "_p": place}).filter("role is not null")
    w2 = Window.partitionBy("source_id").orderBy("_p", "_k")
    main = F.count(F.when(F.col("role") != "filler", 1)).over(Window.partitionBy("source_id"))
    r = r.withColumns({"position": F.row_number().over(w2), "_main": main})
    r = r.filter((F.col("role") != "filler") | (F.col("position") <= 5))
    return r.withColumn("role", F.when(F.col("role") == "filler", "development").otherwise(F.col("role"))).select("source_id", "id", "role", "position")
