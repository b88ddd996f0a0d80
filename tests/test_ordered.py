"""Running windows and segmentation on keys that span many blocks, against sequential Python."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.operators import cuts
from cadenza.operators import ordered as O
from cadenza.operators.cuts import open_segments
from pyspark.sql import functions as F


def rows(seed, n=600):
    """A third and more of the rows under one key, repeated times, some nulls."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if r.random() < 0.6 else f"k{r.randint(0, 6)}"
        out.append((key, float(r.randint(0, n // 3)), i, None if r.random() < 0.2 else float(r.randint(0, 50))))
    return out


def by_key(data):
    g = {}
    for k, t, i, x in sorted(data, key=lambda q: (q[0], q[1], q[2])):
        g.setdefault(k, []).append((t, i, x))
    return g


@pytest.mark.parametrize("blocks", [1, 7, 32])
def test_carried_matches_sequential(spark, blocks):
    data = rows(1)
    df = spark.createDataFrame(data, "k string, t double, i long, x double")
    b = O.ordered_blocks(df, ["k"], ["t", "i"], blocks)
    runs = {
        "lag": O.lag("x"), "lead": O.lead("x"), "s": O.run_sum("x"), "sb": O.run_sum("x", False), "mx": O.run_max("x"), "mxb": O.run_max("x", False),
        "mn": O.run_min("x"), "last": O.last_value("x"), "lastb": O.last_value("x", False), "nxt": O.next_value("x"), "nxtb": O.next_value("x", False), "rn": O.row_index(),
    }
    got = {(r["k"], r["i"]): r for r in O.carried(b, ["k"], ["t", "i"], runs).collect()}
    assert len(got) == len(data)
    for k, seq in by_key(data).items():
        xs = [x for _, _, x in seq]
        for n, (_, i, _x) in enumerate(seq):
            r = got[(k, i)]
            before, upto = [x for x in xs[:n] if x is not None], [x for x in xs[: n + 1] if x is not None]
            after, since = [x for x in xs[n + 1 :] if x is not None], [x for x in xs[n:] if x is not None]
            want = {
                "lag": xs[n - 1] if n else None, "lead": xs[n + 1] if n + 1 < len(xs) else None, "s": sum(upto), "sb": sum(before), "mx": max(upto, default=None),
                "mxb": max(before, default=None), "mn": min(upto, default=None), "last": upto[-1] if upto else None, "lastb": before[-1] if before else None,
                "nxt": since[0] if since else None, "nxtb": after[0] if after else None, "rn": n + 1,
            }
            assert {c: r[c] for c in want} == want, (k, i)


def test_exact_percentile(spark):
    data = rows(2)
    df = spark.createDataFrame(data, "k string, t double, i long, x double")
    got = {r["k"]: (r["p10"], r["med"]) for r in O.exact_percentile(df, ["k"], "x", {"p10": 0.1, "med": 0.5}).collect()}

    def pct(v, q):
        v = sorted(v)
        at = (len(v) - 1) * q
        lo = math.floor(at)
        return v[lo] + (v[math.ceil(at)] - v[lo]) * (at - lo)

    for k, seq in by_key(data).items():
        v = [x for _, _, x in seq if x is not None]
        assert got[k] == pytest.approx((pct(v, 0.1), pct(v, 0.5)))


def walk(seq):
    """Opening rows of (v, w, b) triples: break at v >= b or w > b."""
    out, base = [], None
    for v, w, b in seq:
        brk = base is None or (v is not None and v >= base) or (w is not None and w > base)
        out.append(brk)
        if brk:
            base = b
    return out


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=60), st.integers(-5, 45))
@settings(max_examples=300, deadline=None)
def test_what_leaves_a_block_equals_the_walk(pairs, base):
    """A block answers for every base what walking it answers, and names every base that can leave it."""
    import numpy as np

    v = np.array([float(a) for a, _ in pairs])
    b = np.array([float(c) for _, c in pairs])
    cur = float(base)
    for x, y in zip(v, b):
        if x >= cur:
            cur = y
    assert cuts._through(v, b, np.array([float(base)]))[0] == cur
    _, out = cuts._marks(v, b, float(base))
    assert out == cur
    outs, top = cuts.reach(v, b)
    assert cur in outs or (cur == base and base > top)


@pytest.mark.parametrize("blocks,span", [(1, 20.0), (16, 20.0), (16, 5000.0), (40, 3.0)])
def test_open_segments_hot_key(spark, blocks, span):
    r = random.Random(3)
    data = []
    for k, n in (("a", 30), ("hot", 900), ("z", 25), ("one", 1)):
        t = 0.0
        for i in range(n):
            t += r.choice([0.5, 1.0, 2.5])
            data.append((k, t, i, t + r.choice([0.2, 4.0])))
    df = spark.createDataFrame(data, "k string, s double, i long, e double")
    b = O.ordered_blocks(df, ["k"], ["s", "i"], blocks)
    got = open_segments(b, ["k"], ["s", "i"], v=F.col("e") - span, b=F.col("s"), blocked=True)
    res = {(x["k"], x["i"]): x["opens"] for x in got.collect()}
    assert len(res) == len(data)
    for k in {d[0] for d in data}:
        seq = sorted((s, i, e) for kk, s, i, e in data if kk == k)
        want = walk([(e - span, None, s) for s, i, e in seq])
        assert [res[(k, i)] for _, i, _ in seq] == want
    strict = open_segments(b, ["k"], ["s", "i"], v_strict=F.col("s") - 4.0, b=F.col("s"), blocked=True)
    res = {(x["k"], x["i"]): x["opens"] for x in strict.collect()}
    for k in {d[0] for d in data}:
        seq = sorted((s, i) for kk, s, i, _ in data if kk == k)
        assert [res[(k, i)] for _, i in seq] == walk([(None, s - 4.0, s) for s, _ in seq])


def test_one_key_over_many_blocks_equals_the_loop(spark, monkeypatch):
    """An evenly spaced key over 64 blocks: what can leave a block is a short list."""
    from pyspark.sql import functions as F

    from cadenza.operators import cuts, ordered

    for m in (ordered, cuts):
        monkeypatch.setattr(m, "block_count", lambda df: 64)
    n = 6400
    df = spark.range(n).select(F.lit(1).alias("source_id"), F.col("id"), (F.col("id") * 0.4).alias("t"))
    got = cuts.open_segments(df, ["source_id"], ["t", "id"], v=F.col("t") - 20, b=F.col("t")).orderBy("id").select("opens").collect()
    want, base = [], None
    for i in range(n):
        t = i * 0.4
        opens = base is None or t - 20 >= base
        base = t if opens else base
        want.append(opens)
    assert [r.opens for r in got] == want


@pytest.mark.parametrize("rows", [1_000, 200_000])
def test_few_bases_leave_evenly_spaced_rows(rows):
    """However many rows a block has, what it hands on stays short."""
    import numpy as np

    t = np.arange(rows) * 0.4
    for v, b in ((t - 20, t), (np.cumsum(np.full(rows, 7.0)) - 900, np.cumsum(np.full(rows, 7.0)) - 7), (t, t + 0.3)):
        assert len(cuts.reach(v, b)[0]) < 200
    assert len(cuts.reach(t - 20, t)[0]) < 100


def test_whole_keys_stream_through_small_batches(spark, monkeypatch):
    """Keys marked as bounded are neither counted nor grouped: rows stream by key, whatever batches they come in."""
    import random

    from cadenza.operators import cuts
    from cadenza.operators.ordered import BOUNDED
    from cadenza.operators.segment import sessionize

    def no_count(df):
        raise AssertionError("whole keys need no count")

    monkeypatch.setattr(cuts, "block_count", no_count)
    r, rows, want = random.Random(4), [], {}
    for src in range(40):
        t, opened, session, last = 0.0, None, -1, None
        for pos in range(r.choice([1, 2, 3, 7, 20])):
            t = round(t + r.choice([0.4, 1.9]), 3)
            end = round(t + 0.3, 3)
            if last is None or round(t - last, 9) >= 0.75 or round(end - 2.0 - opened, 9) >= 0:
                session, opened = session + 1, t
            rows.append((src, pos, t, end))
            want[src, pos] = session
            last = end
    df = spark.createDataFrame(rows, "source_id long, pos long, start double, end double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            got = sessionize(df.select(F.col("source_id").alias("source_id", metadata=BOUNDED), "pos", "start", "end"), max_span=2.0).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        assert {(x.source_id, x.pos): x.session for x in got} == want
    monkeypatch.setattr(cuts, "block_count", lambda d: 9)
    assert {(x.source_id, x.pos): x.session for x in sessionize(df, max_span=2.0).collect()} == want


def test_open_segments_keeps_payload_out_of_pandas(spark, monkeypatch):
    from pyspark.sql import GroupedData

    asked = []
    real = GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, fn, schema: asked.append(str(schema)) or real(self, fn, schema))
    rows = [(1 if i < 60 else 2, i, float(i), [{"w": None if i % 3 else f"t{i}"}] if i % 2 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, i long, t double, notes array<struct<w:string>>")
    b = cuts.ordered_blocks(df, ["k"], ["i"], 4)
    out = cuts.open_segments(b, ["k"], ["i"], v=F.col("t") - 7, b=F.col("t"), blocked=True, number="seg")
    got = {r["i"]: r for r in out.collect()}
    assert [got[i]["seg"] for i in range(80)] == [(i if i < 60 else i - 60) // 7 for i in range(80)]
    assert all(got[i]["notes"] == (None if n is None else [tuple(x.values()) for x in n]) for _, i, _, n in rows)
    assert not any("notes" in x for x in asked)
