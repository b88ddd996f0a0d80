"""Folds, chapters, budgets and hybrid dedup against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import dedup as D
from cadenza.operators import segment as G
from cadenza.operators.fold import fold_ordered


def test_fold_without_resets_crosses_blocks(spark):
    """Worst case: one key over all blocks and no reset; every block waits for its left neighbour."""
    r = random.Random(5)
    data = [(("hot" if i % 3 else f"k{i % 7}"), i, r.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(data, "k string, i long, x long")

    def step(state, row):
        state.append((state[-1] * 3 + row[2]) % 1009)
        state[:] = state[-1:]
        return [(row[0], row[1], state[0])]

    out = fold_ordered(df, ["k"], ["i"], cols=["k", "i", "x"], resets=None, init=lambda: [7], step=step, finish=lambda s: [], schema="k string, i long, y long")
    got = {(x["k"], x["i"]): x["y"] for x in out.collect()}
    assert len(got) == len(data)
    state = {}
    for k, i, x in sorted(data):
        state[k] = (state.get(k, 7) * 3 + x) % 1009
        assert got[(k, i)] == state[k]


def hybrid_loop(items, vec):
    def alike(a, b):
        def jac(x, y):
            x, y = set(x.lower().split()), set(y.lower().split())
            return len(x & y) / len(x | y) if x and y else 0.0

        if a[4] is not None and b[4] is not None:
            dot = sum(p * q for p, q in zip(a[4], b[4]))
            n = sum(p * p for p in a[4]) ** 0.5 * sum(q * q for q in b[4]) ** 0.5
            return dot / n >= 0.8 or jac(a[3], b[3]) >= 0.7
        return jac(a[3], b[3]) >= 0.5

    kept = []
    for it in sorted(items, key=lambda e: (e[0], -e[1], e[2])):
        for j in range(max(0, len(kept) - 5), len(kept)):
            if abs(kept[j][0] - it[0]) < 3.0 and alike(kept[j], it):
                if it[1] > kept[j][1]:
                    kept[j] = it
                break
        else:
            kept.append(it)
    return {k[2] for k in kept}


@pytest.mark.parametrize("with_vec", [False, True])
def test_dedup_hybrid(spark, with_vec):
    r = random.Random(11)
    words = "alpha beta gamma delta eps zeta".split()
    data = []
    for i in range(500):
        src = 1 if r.random() < 0.7 else r.randint(2, 5)
        vec = [r.random(), r.random(), r.random()] if with_vec and r.random() < 0.7 else None
        data.append((src, i, round(r.random() * 200, 1), round(r.random(), 2), " ".join(r.sample(words, 4)), vec))
    df = spark.createDataFrame(data, "source_id long, id long, start double, strength double, text string, v array<double>")
    got = {x["id"] for x in D.dedup_hybrid(df, vec="v" if with_vec else None).collect()}
    want = set()
    for s in {d[0] for d in data}:
        want |= hybrid_loop([(d[2], d[3], d[1], d[4], d[5]) for d in data if d[0] == s], with_vec)
    assert got == want


def chapters_loop(bounds, duration, ends):
    ch, prev = [], 0.0
    for at, c in sorted(bounds):
        ch.append([prev, at, c])
        prev = at
    ch.append([prev, duration, 0.6 if bounds else 0.7])
    out, i = [], 0
    while i < len(ch):
        s, e, c = ch[i]
        right = ch[i + 1] if i + 1 < len(ch) else None
        if round(e - s, 9) >= 60:
            out.append(ch[i])
            i += 1
        elif out and (right is None or out[-1][2] <= right[2]):
            out[-1] = [out[-1][0], e, min(out[-1][2], c)]
            i += 1
        elif right is not None:
            out.append([s, right[1], min(c, right[2])])
            i += 2
        else:
            out.append(ch[i])
            i += 1

    def split(s, e, c):
        if round(e - s, 9) <= 300:
            return [(round(s, 6), round(e, 6), round(c, 6))]
        mid = (s + e) / 2
        near = [x for x in ends if abs(x - mid) <= 15]
        at = min(near, key=lambda x: (abs(x - mid), x)) if near else mid
        at = at if s < at < e else mid
        return split(s, at, c * 0.9) + split(at, e, c * 0.9)

    return [p for x in out for p in split(*x)]


def test_chapters(spark):
    r = random.Random(2)
    bounds, dur, ends = [], [], []
    for src in range(6):
        total = r.choice([40.0, 700.0, 1500.0, 2600.0])
        dur.append((src, total))
        pts = sorted({round(r.uniform(1, total - 1), 1) for _ in range(r.choice([0, 3, 12]))})
        bounds += [(src, p, r.choice([0.2, 0.5, 0.9])) for p in pts]
        ends += [(src, round(r.uniform(0, total), 1)) for _ in range(80)]
    got = G.chapters(
        spark.createDataFrame(bounds, "source_id long, at double, confidence double"), spark.createDataFrame(dur, "source_id long, duration double"),
        spark.createDataFrame(ends, "source_id long, end double"),
    ).orderBy("source_id", "ch_no").collect()
    for src, total in dur:
        want = chapters_loop([(p, c) for s, p, c in bounds if s == src], total, sorted({e for s, e in ends if s == src}))
        have = [(round(x["start"], 6), round(x["end"], 6), round(x["confidence"], 6)) for x in got if x["source_id"] == src]
        assert have == want
        assert have[0][0] == 0.0 and have[-1][1] == total


def trim_loop(segs, limit):
    if round(sum(s[3] for s in segs), 9) <= limit:
        return {s[0] for s in segs}
    crit = [s for s in segs if s[1] in ("hook", "peak", "payoff")]
    left = limit - sum(s[3] for s in crit)
    if round(left, 9) <= 0:
        hook = next((s for s in crit if s[1] == "hook"), None)
        end = next((s for s in reversed(crit) if s[1] != "hook"), None)
        return {s[0] for s in (hook, end) if s}
    used, kept = 0.0, {s[0] for s in crit}
    for s in sorted((s for s in segs if s not in crit), key=lambda s: (-s[4], s[2])):
        if round(used + s[3], 9) <= round(left, 9):
            used += s[3]
            kept.add(s[0])
    return kept


def test_trim_to_budget(spark):
    r = random.Random(8)
    data, i = [], 0
    for p in range(40):
        for n in range(r.randint(1, 9)):
            data.append((p, i, n, r.choice(["hook", "setup", "development", "peak", "payoff"]), r.randint(4, 160) / 4, r.randint(0, 9) / 10))
            i += 1
    df = spark.createDataFrame(data, "p long, id long, seg_no long, role string, dur double, score double")
    got = {}
    for x in G.trim_to_budget(df, ["p"]).collect():
        got.setdefault(x["p"], set()).add(x["id"])
    for p in range(40):
        assert got.get(p, set()) == trim_loop([(d[1], d[3], d[2], d[4], d[5]) for d in data if d[0] == p], 80.0)


def test_split_long_keeps_every_word(spark):
    r = random.Random(4)
    texts = [(i, " ".join("w" * r.randint(1, 12) for _ in range(r.randint(0, 200)))) for i in range(20)]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {}
    for x in G.split_long(df, "text", 40).orderBy("id", "piece_no").collect():
        got.setdefault(x["id"], []).append(x["piece"])
    for i, t in texts:
        assert " ".join(p for p in got[i] if p) == t
        for p in got[i]:
            cost = [-(-len(w) // 4) for w in p.split()]
            assert sum(cost) <= 40 or len(cost) == 1


def test_two_pauses_and_fillers(spark):
    """A long pause and the head are cut; lexical fillers ignore punctuation, rule fillers do not."""
    from cadenza.functions.text import is_filler
    from cadenza.operators.series import silence_ranges

    w = [(1, 0, "hello", 0.1, 0.5), (1, 1, "friends", 0.55, 1.0), (1, 2, "today", 6.0, 6.7), (1, 3, "now", 6.75, 7.3)]
    df = spark.createDataFrame(w, "source_id long, pos long, word string, start double, end double")
    d = spark.createDataFrame([(1, 8.0)], "source_id long, duration double")
    got = sorted((round(x["start"], 3), round(x["end"], 3)) for x in silence_ranges(df, d).collect())
    assert got == [(1.08, 5.92), (7.38, 8.0)]
    t = spark.createDataFrame([("ну,",), ("Ну",), ("важное",)], "w string")
    assert [x[0] for x in t.select(is_filler(F.col("w"))).collect()] == [True, True, False]
    rules = [("ну", r"^ну+$", 1), ("как бы", r"^как\s+бы$", 2)]
    w2 = [(1, i, x, i * 1.0, i + 0.4) for i, x in enumerate("ну как бы ну, важное как бы бы".split())]
    m = G.phrase_match(spark.createDataFrame(w2, "source_id long, pos long, word string, start double, end double"), rules)
    assert sorted((x["start"], x["rule"]) for x in m.collect()) == [(0.0, "ну"), (1.0, "как бы"), (5.0, "как бы")]


def test_stage_stream_equals_loop(spark, sf):
    from cadenza.plans import load
    from cadenza.plans.registry import QUERIES

    load()
    got = {(x["job"], x["run"], x["stage"]): x["seconds"] for x in QUERIES["st1_stage_durations_stream"](spark, sf).collect()}
    ev = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) / 1e6 as t", "event_type").collect()
    want = {}
    by = {}
    for e in ev:
        by.setdefault(e["user_id"], []).append((e["t"], e["event_id"], e["event_type"]))
    for u, seq in by.items():
        run, cur, since, acc = 0, None, 0.0, {}
        for t, _, s in sorted(seq):
            if cur is not None:
                acc[cur] = acc.get(cur, 0.0) + t - since
            cur, since = s, t
            if s == "purchase":
                acc.setdefault(s, 0.0)
                want.update({(u, run, k): v for k, v in acc.items()})
                run, cur, acc = run + 1, None, {}
    done = {k: v for k, v in got.items() if k in want}
    assert set(done) == set(want)
    for k, v in want.items():
        assert done[k] == pytest.approx(v, abs=2e-3)


def test_run_lengths_are_rounded(spark):
    from cadenza.operators.stats import monotone_runs

    # 30 s long, but the difference of the doubles is a little more
    rows = [(1, 0, 0.0, 4.0, "a"), (1, 1, 2.34, 32.34, "a"), (2, 0, 0.0, 4.0, "a"), (2, 1, 2.34, 32.341, "a")]
    assert 32.34 - 2.34 > 30
    got = monotone_runs(spark.createDataFrame(rows, "source_id long, seg_idx long, start double, end double, speaker string"), need=1)
    assert {r["source_id"]: (r["issues"], r["longest"]) for r in got.collect()} == {1: (0, 0), 2: (1, 1)}
