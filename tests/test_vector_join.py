"""Vector joins and the plan filter against brute force; no bucket is a source."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cadenza.operators import select as X  # noqa: E402
from cadenza.operators import vector_join as V  # noqa: E402

SCHEMA = "k string, id long, v array<double>"


def brute(rows, threshold):
    """Pairs of different vectors, and copies with their first id."""
    first, out = {}, []
    for k, i, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or 0)):
        if k is None or i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        lead = first.setdefault((k, tuple(v)), i)
        if lead != i:
            out.append((k, lead, i))
    reps = [(k, i, np.array(v)) for (k, v), i in first.items()]
    for a, (k, i, x) in enumerate(reps):
        for k2, j, y in reps[:a]:
            if k == k2 and len(x) == len(y) and round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)) - threshold, 9) >= 0:
                out.append((k, min(i, j), max(i, j)))
    return sorted(out)


def clustered(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    return [centres[i % 40] + spread * rng.normal(size=dim) for i in range(n)]


@pytest.mark.parametrize("block", [2048, 16])
@pytest.mark.parametrize("threshold, spread", [(0.9, 0.15), (0.3, 1.0), (0.999, 0.01)])
def test_similar_vectors_brute_force(spark, threshold, spread, block):
    """With tiles of sixteen vectors as well; a third of the rows has one key."""
    vs = clustered(1, 400, 8, spread)
    rows = [("hot" if i % 3 == 0 else f"s{i % 5}", i, [float(x) for x in v]) for i, v in enumerate(vs)]
    rows += [("hot", 1000 + i, rows[0][2]) for i in range(5)] + [("s1", 2000, rows[0][2])]
    rows += [("hot", 3000, None), ("hot", 3001, []), ("hot", 3002, [0.0] * 8), ("hot", 3003, [float("nan")] * 8), ("hot", 3004, [None] * 8), ("hot", 3005, [1.0, 2.0]), ("hot", 3006, [2.0, 4.0]), (None, 3007, rows[0][2]), ("hot", None, rows[0][2])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = X.similar_pairs(df, id="id", vec="v", metric="cosine", threshold=threshold, key="k").collect() if block == 2048 else V.similar_vectors(df, id="id", vec="v", threshold=threshold, key="k", block=block).collect()
    assert sorted((r.k, r.id_a, r.id_b) for r in got) == brute(rows, threshold)
    assert len(got) > 6


def test_regions_lose_no_pair_and_prune(spark):
    vs = clustered(2, 3000, 8, 0.1)
    rows = [("a", i, [float(x) for x in v]) for i, v in enumerate(vs)]
    x = np.array(vs) / np.linalg.norm(vs, axis=1, keepdims=True)
    r = V.choose_regions(x[:2048], len(x), 0.98)
    assert r is not None  # close vectors in few dimensions: regions pay
    got = V.similar_vectors(spark.createDataFrame(rows, SCHEMA), id="id", vec="v", threshold=0.98).collect()
    s = np.triu(x @ x.T, 1)
    assert {(p.id_a, p.id_b) for p in got} == {(int(i), int(j)) for i, j in np.argwhere(s >= 0.98)}
    home, _ = r.home(x)
    guests = r.guests(x, home)
    size = np.bincount(home, minlength=len(r.p))
    assert float((size * (size + guests.sum(0))).sum()) < 0.5 * len(x) ** 2


def test_one_region_where_bounds_separate_nothing():
    x = np.random.default_rng(3).normal(size=(2048, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert V.choose_regions(x, 100_000, 0.4) is None


def test_empty_tables(spark):
    assert V.similar_vectors(spark.createDataFrame([], SCHEMA), id="id", vec="v", threshold=0.5).count() == 0
    with pytest.raises(ValueError):
        V.similar_vectors(spark.createDataFrame([], SCHEMA), id="id", vec="v", threshold=0.0)


PLAN = "source_id long, plan_id long, score double, segs array<struct<s:double,e:double>>, vec array<double>, tokens array<string>"


@pytest.fixture(scope="module")
def plans(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(110):
        src = 1 if i % 3 else 2 + i % 2
        s = float(rng.integers(0, 3000))
        vec = None if i % 11 == 0 else [float(x) for x in rng.normal(size=3)]
        words = [f"t{j}" for j in rng.choice(30, rng.integers(0, 16), replace=False)]
        rows.append((src, i, float(rng.integers(0, 9)), [{"s": s, "e": s + 40}, {"s": s + 500, "e": s + 520}], rows[-1][4] if i % 7 == 1 else vec, words))
    return spark.createDataFrame(rows, PLAN)


def repeats(a, b, p):
    for y in b.segs:
        for x in a.segs:
            if round(max(0.0, min(x.e, y.e) - max(x.s, y.s)) / max(1e-6, y.e - y.s) - p["overlap"], 9) >= 0:
                return 1
    if a.vec and b.vec and round(float(np.dot(a.vec, b.vec) / np.linalg.norm(a.vec) / np.linalg.norm(b.vec)) - p["cosine"], 9) >= 0:
        return 2
    s, t = set(a.tokens), set(b.tokens)
    if len(b.tokens) >= X.MIN_TOKENS and s and t and round(len(s & t) / len(s | t) - p["jaccard"], 9) >= 0:
        return 3
    return 0


@pytest.mark.parametrize("params", [X.LOOSE, {"jaccard": 0.3, "cosine": 0.95, "overlap": 0.5}])
def test_unique_plans_and_reject_levels(plans, params):
    by = {}
    for r in plans.collect():
        by.setdefault(r.source_id, []).append(r)
    kept, levels, best = set(), {}, []
    for src, rows in by.items():
        acc = []
        for r in sorted(rows, key=lambda r: (-r.score, r.plan_id)):
            lv = [repeats(a, r, params) for a in acc]
            if any(lv):
                levels.setdefault(src, []).append(min(x for x in lv if x))
            else:
                acc.append(r)
        kept |= {r.plan_id for r in acc}
        best += [(src, i + 1, r.plan_id) for i, r in enumerate(acc[:3])]
    all_kept = X.unique_plans(plans, params=params)
    assert {r.plan_id for r in all_kept.collect()} == kept
    assert sorted((r.source_id, r.pick, r.plan_id) for r in X.unique_plans(plans, cap=F.lit(3), params=params).collect()) == sorted(best)
    for r in X.reject_levels(plans, all_kept, params).collect():
        assert [r.reused_span, r.near_vector, r.same_words] == [levels[r.source_id].count(i) for i in (1, 2, 3)]


def test_no_bucket_holds_a_source(plans):
    b = X.plan_buckets(plans).select(F.explode("_pb").alias("b")).groupBy("b").count()
    assert b.agg(F.max("count")).first()[0] < plans.filter("source_id = 1").count() / 4


def test_novelty_rounds_do_not_grow_with_a_source(spark, monkeypatch):
    """A source of many near copies: every round drops them in parallel, so rounds are bounded by the picks."""
    rng = np.random.default_rng(1)
    n, base = 3000, rng.normal(size=(5, 6))
    rows = [(1, i, i, str(i % 9), 0.5, (i % 97) / 97, 0.0, 42.0, [float(x) for x in base[i % 5] + 1e-3 * rng.normal(size=6)]) for i in range(n)]
    df = spark.createDataFrame(rows, "source_id long, arc_id long, chapter long, kind string, hook_score double, arc_score double, start double, end double, v array<double>")
    rounds = []
    real = X.materialize
    monkeypatch.setattr(X, "materialize", lambda d: rounds.append(1) or real(d))
    got = X.rank_novel(df, target=5, max_sim=0.9).collect()
    assert len(rounds) < 40
    assert len(got) <= 5 and len({r.arc_id % 5 for r in got}) == len(got) >= 3


def test_plan_rounds_carry_no_texts(plans, monkeypatch):
    """Texts and vectors are written once per plan and once per different value; rounds rewrite slim rows only."""
    from cadenza.operators import greedy

    written = []
    for m in (X, greedy):
        monkeypatch.setattr(m, "materialize", lambda d, real=m.materialize: written.append(d.columns) or real(d))
    X.unique_plans(plans, params={"jaccard": 0.3, "cosine": 0.95, "overlap": 0.5}).count()
    assert not [c for c in written if "tokens" in c or "_p" in c and "vec" in c]
    assert len([c for c in written if "_tok" in c]) == 2  # the plans, the different sets
    assert len([c for c in written if "vec" in c]) == 2
    slim = X._plan_tables(plans, X.STRICT, 1000, 96.0)[2].filter("_kd = 3")
    assert slim.count() == slim.select("plan_id").distinct().count()  # one row for the text of a plan of a small source


def test_similar_pairs_in_tiles(spark, monkeypatch):
    """Families are cut into tiles that hold a set once; tiles of few pairs give the same pairs."""
    monkeypatch.setattr(X, "TILE_PAIRS", 3)
    rng = np.random.default_rng(8)
    rows = [(s, 100 * s + i, sorted({f"{s % 2}w{j}" for j in range(12)} - {f"{s % 2}w{j}" for j in rng.choice(12, 3)})) for s in (1, 2, 3) for i in range(12)]
    got = X.similar_pairs(spark.createDataFrame(rows, "source_id long, id long, tok array<string>"), id="id", tokens="tok", threshold=0.7).collect()
    first = {}
    for s, i, t in rows:
        first.setdefault((s, tuple(t)), i)
    want = {(s, first[s, tuple(t)], i, 1.0) for s, i, t in rows if first[s, tuple(t)] != i}
    reps = [(s, i, set(t)) for (s, t), i in first.items()]
    for s, i, t in reps:
        want |= {(s, i, j, round(len(t & u) / len(t | u), 6)) for r, j, u in reps if r == s and j > i and round(len(t & u) / len(t | u) - 0.7, 9) >= 0}
    assert {(x.source_id, x.id_a, x.id_b, round(x.sim, 6)) for x in got} == want
