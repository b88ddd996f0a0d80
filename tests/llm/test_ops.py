"""Small tables: brute force, defined results for odd rows, held-out accuracy, exact round trips."""

import collections
import hashlib
import math
import os
import random
import re
import sys
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from cadenza.llm import exact_dedup, jaccard_join, mixing, passages, pieces, pii, quality, secrets, sharding, spans, vantage  # noqa: E402
from cadenza.llm.common import components, fold_words  # noqa: E402
from cadenza.llm.queries import model_path  # noqa: E402
from cadenza.session import materialize  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_row` string, `_key` string, shard string, kept string, box string"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, ties, clashing names."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "other"
    rows = [
        (1, base, "en", "b"), (2, base, "en", "a"), (3, " ".join(near), "en", None), (4, base.upper(), None, "a"), (5, "", "en", "a"), (6, None, "en", "b"),
        (7, " \t\n", "fr", "b"), (8, long, "en", "c"), (9, long + " tail", "en", "c"), (10, "one two", "en", "c"), (11, "two one", "en", "c"), (12, "one two", "en", "c"),
        (None, "no key here at all", "en", "a"), (None, None, None, None), (13, base.replace(" ", "\n\t"), "en", "a"), (14, "x" * 5000, "en", "a"), (14, "x" * 5000, "en", "a"),
        (15, "Straße ▁ 😀 \u0000 é ", "de", "é"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "q", "r", "s", "t", "u") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (3, 1, 0), (None, 1, 0), (8, 1, None)], "doc_id long, quality int, toxic int")


def pydict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- sharding


def test_shards(spark, odd, empty):
    rows = sharding.place(odd, key="doc_id", text="text", weights=[1.0] * 4).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 4)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            body = (text[r.doc_id] or "").encode()
            assert (r["size"], r.text_crc32) == (len(body) + 1, zlib.crc32(body))
    assert sharding.place(empty, key="doc_id", text="text", weights=[1.0]).count() == 0


def test_weights_steer_shares_and_removal_moves_only_its_own(spark):
    ids = spark.range(20_000)
    w = [1.0, 2.0, 0.0, 5.0]
    got = ids.select("id", sharding.rendezvous(F.col("id"), w).alias("s"), sharding.rendezvous(F.col("id"), [1.0, 2.0, 0.0, 0.0]).alias("t")).collect()
    n = collections.Counter(r.s for r in got)
    assert 2 not in n and all(abs(n[i] / 20_000 - w[i] / 8) < 0.015 for i in (0, 1, 3))
    assert all(r.s == r.t for r in got if r.s != 3)


def test_written_shards(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "x"), key="doc_id", weights=[1, 1, 1])
    back = spark.read.parquet(str(tmp_path / "x"))
    assert back.count() == odd.count() and set(back.columns) == set(odd.columns)


# ---- exact dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_brute_force(spark, odd, empty):
    rows = odd.select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    got = exact_dedup.exact_duplicates(odd).collect()
    assert len(got) == len(rows)
    for r in rows:
        g = groups[norm(r.text)]
        keep = min((x for x in g if x is not None), default=None)
        mine = [x for x in got if x.doc_id == r.doc_id and x.text_sha256 == hashlib.sha256(norm(r.text).encode()).hexdigest()]
        assert mine and all((x.keep_id, x.group_size) == (keep, len(g)) for x in mine)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_drop_exact_keeps_one_row_of_each(spark, odd, empty):
    out = exact_dedup.drop_exact(odd)
    assert out.columns == odd.columns
    kept = [norm(r.text) for r in out.collect()]
    assert sorted(kept) == sorted({norm(r.text) for r in odd.collect()})
    assert exact_dedup.drop_exact(empty).count() == 0


def test_chunks_follow_content():
    rng = random.Random(1)
    body = bytes(rng.randrange(97, 123) for _ in range(200_000))
    cuts = exact_dedup.cut_points(body)
    assert cuts[-1] == len(body) and max(b - a for a, b in zip([0, *cuts], cuts)) <= exact_dedup.LONGEST
    moved = exact_dedup.cut_points(b"Z" + body)
    assert len(set(c + 1 for c in cuts) & set(moved)) > 0.95 * len(cuts)
    assert exact_dedup.cut_points(b"") == []


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    chunk = "struct<fp:long,len:int,sha:binary>"
    rows = [(1, 1, "a", [(7, 3, b"x")]), (2, 2, "b", [(7, 3, b"y")]), (3, 3, "a", [(7, 3, b"x")]), (4, 4, "c", [(8, 3, b"x")])]
    df = spark.createDataFrame(rows, f"_key long, _row long, text_sha256 string, recipe array<{chunk}>")
    ids = {r._key: tuple(r.ids) for r in exact_dedup.identify(df).collect()}
    assert ids[1] == ids[3] and len({ids[1], ids[2], ids[4]}) == 3


# ---- n-gram Jaccard


def brute_links(rows, k, share):
    sets = []
    for _, t in rows:
        w = fold_words(t.encode() if t else None)
        sets.append(({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) if w else set())
    n = len(rows)
    link = [[j for j in range(n) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j])] for i in range(n)]
    comp = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return [len(s) for s in sets], comp, [len(x) for x in link]


def check_classes(df, k, share, **more):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    n, comp, links = brute_links(rows, k, share)
    want = sorted(((r[0], a, b, c) for r, a, b, c in zip(rows, n, comp, links)), key=repr)
    got = sorted((tuple(r) for r in jaccard_join.similarity_classes(df, shingle=k, share=share, **more).collect()), key=repr)
    assert got == want


def test_jaccard_odd_rows(spark, odd, empty):
    check_classes(odd, 4, 85)
    assert jaccard_join.similarity_classes(empty).count() == 0
    assert jaccard_join.drop_near(odd, share=85).columns == odd.columns


@pytest.mark.parametrize("leaf", [1024, 24])
def test_jaccard_brute_force(spark, leaf):
    """A large group of near copies (split into tiles when leaves are small), small groups, short texts, chains."""
    rng = random.Random(5)
    base, rows = [rng.choice(WORDS) for _ in range(150)], []
    for i in range(70):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(150)] = rng.choice(WORDS)
        rows.append((i, " ".join(t)))
    for i in range(70, 130):
        n = rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 40, 300])
        t = [rng.choice(WORDS[:3] if n < 9 else WORDS) for _ in range(n)]
        rows.append((2 * i, " ".join(t)))
        t[rng.randrange(n)] = rng.choice(WORDS)
        rows.append((2 * i + 1, " ".join(t) + rng.choice(["", " end"])))
    check_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, leaf_rows=leaf)


def test_pivots_split_regions_without_losing_links(spark):
    """One region of many unrelated families: pivots part it, the union of leaves has every link."""
    rng = np.random.default_rng(2)
    sets, rows = [], []
    for f in range(12):
        base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        for _ in range(12):
            s = base.copy()
            s[rng.integers(0, 60, 3)] = rng.integers(0, 1 << 62, 3).astype(np.uint64)
            sets.append(np.unique(s))
    for i, s in enumerate(sets):
        rows.append((77, i, 1, 0, bytearray(s.tobytes())))
    df = spark.createDataFrame(rows, "region long, cls long, w long, mask long, s binary")
    leaves = jaccard_join.split_regions(df, 85, leaf_rows=20)
    assert leaves.select("region").distinct().count() > 3
    j = leaves.repartition("region").sortWithinPartitions("region", "cls").mapInArrow(jaccard_join._leaf(85), "a long, b long, links long")
    got = {r.a: r.n for r in j.groupBy("a").agg(F.sum("links").alias("n")).collect()}
    want = {}
    for i, a in enumerate(sets):
        k = sum(1 for m, b in enumerate(sets) if m != i and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)))
        if k:
            want[i] = k
    assert got == want


def test_linked_sets_share_a_range():
    rng = np.random.default_rng(4)
    for _ in range(400):
        n = int(rng.integers(6, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, max(1, n // 8)))
        b = np.unique(np.concatenate([np.delete(a, rng.choice(len(a), drop, replace=False)), rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 12)))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            assert len(np.intersect1d(jaccard_join.range_keys(a, 85), jaccard_join.range_keys(b, 85)))


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(5000, 5100), rng.randrange(5000, 5100)) for _ in range(60)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200))
    for a, b in edges:
        assert got[a] == got[b] <= min(a, b)


# ---- mixing


def test_mix(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(0, 90)), rng.choice(["a", "b", "b", "b", "b", "b", "c", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df).collect()))
    size = collections.Counter()
    taken = collections.Counter()
    target = {}
    src = {r[0]: r[2] for r in rows}
    for r in got:
        size[src[r.doc_id]] += r["size"]
        taken[src[r.doc_id]] += r.taken
        target[src[r.doc_id]] = r.target
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    total = sum(size.values())
    order = [*sorted(s for s in size if s is not None), None]
    want, open_ = {}, dict(zip(order, (5, 2, 1, 5)))
    while open_:
        left, w = total - sum(want.values()), sum(open_.values())
        over = [s for s in open_ if left * open_[s] / w > 3 * size[s] + 1e-9]
        if not over:
            want.update({s: left * open_[s] / w for s in open_})
            break
        for s in over:
            want[s] = 3.0 * size[s]
            del open_[s]
    for s in size:
        assert math.isclose(target[s], want[s], rel_tol=1e-9)
        assert abs(taken[s] - want[s]) <= 90
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(odd).count() == odd.count()
    assert mixing.take(odd).columns == odd.columns
    m = mixing.take(df)
    c = {r.doc_id: r["count"] for r in m.groupBy("doc_id").count().collect()}
    assert c == {r.doc_id: r.copies for r in got if r.copies}


def test_draws_do_not_hang_on_how_a_scan_is_split(spark):
    rng = random.Random(31)
    rows = [(i, prose(rng, rng.randrange(1, 40)), rng.choice("abc")) for i in range(600)]
    rows += [rows[5]] * 9 + [(7, rows[7][1], "b"), (7, rows[7][1], "c"), (None, "same text", None), (None, "same text", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [df.repartition(n) for n in (2, 7)]
    a, b = (sorted(map(str, mixing.mix(x).collect())) for x in runs)
    assert a == b
    a, b = (sorted(map(str, mixing.take(x).collect())) for x in runs)
    assert a == b


def test_pivot_is_unbiased_and_keeps_the_sum():
    rng = random.Random(8)
    size = [rng.randrange(1, 50) for _ in range(40)]
    p = [rng.random() for _ in range(40)]
    mean = np.zeros(40)
    for seed in range(1500):
        q, left = mixing.pivot(size, p, list(range(40)), seed)
        assert math.isclose(sum(a * b for a, b in zip(size, q)), sum(a * b for a, b in zip(size, p)), rel_tol=1e-9)
        assert all(x in (0.0, 1.0) or i == left for i, x in enumerate(q))
        mean += q
    assert np.abs(mean / 1500 - p).max() < 0.06


def test_many_leaves_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 16)
    monkeypatch.setattr(mixing, "FAN", 4)
    df = spark.createDataFrame([(i, " ".join(["x"] * (1 + i % 30)), "ab"[i % 4 == 0]) for i in range(2000)], "doc_id long, text string, source string")
    by = mixing.mix(df).groupBy("target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r.t - r.target) <= 30 for r in by)


# ---- personal data and secrets


def plain(kind, rx, ok, t):
    return [(kind, *m.span()) for m in re.finditer(rx, t) if ok(m)]


def ref_pii(t):
    digits = lambda m: [c for c in m[0] if c.isdigit()]
    return (
        plain("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True, t)
        + plain("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split(".")), t)
        + plain("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and pii.luhn("".join(digits(m))), t)
        + plain("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15, t)
    )


def ref_secrets(t):
    return (
        plain("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8, t)
        + plain("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16, t)
        + plain("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32, t)
    )


def test_base_spans_equal_plain_patterns():
    rng = random.Random(6)
    bits = ["a@b.co", "@", "x.y@z", ".com", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (988) 555-2485", "+1", " ", ".", "-", "9", "00", "AKIA", "AKIAABCDEFGHIJKL", "token", "=", ": ", '"', "api_key", "PASSWD", "deadbeef", "0123456789abcdef", "é", "ſecret", "x"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert spans.render(pii.base_spans(t), pii.KINDS) == spans.render(ref_pii(t), pii.KINDS), t
        assert spans.render(secrets.base_spans(t), secrets.KINDS) == spans.render(ref_secrets(t), secrets.KINDS), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "@" * 100_000, "+" * 100_000, "1." * 100_000, "a@" * 100_000, "f" * 31 + " ", "token" * 50_000):
        pii.base_spans(t)
        pii.proposals(t)
        secrets.candidates(t, secrets.base_spans(t))


@pytest.fixture(scope="module")
def personal(spark):
    """Numbers written with and without their usual marks, and numbers that are nobody's."""
    rng = random.Random(12)
    rows = []
    for i in range(900):
        n = f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        t = [f"call +1 {n} now", f"phone {n} please", f"count {rng.randrange(10**7, 10**9)} items", f"mail j{i}@ex{i % 7}.com soon", f"host {rng.randrange(256)}.{rng.randrange(256)}.3.{rng.randrange(256)} up", "nothing here"][i % 6]
        rows.append((i, prose(rng, 8) + " " + t))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_pii_adds_to_the_base(spark, personal, odd, empty):
    got = pydict(pii.find(personal))
    text = pydict(personal)
    for i, r in got.items():
        assert r.base == spans.render(ref_pii(text[i].text), pii.KINDS)
        assert set(x for x in r.base.split(",") if x) <= set(r.spans.split(","))
    plain_found = sum(bool(got[i].spans) for i in got if i % 6 == 1)
    assert plain_found > 100
    assert sum(bool(got[i].spans) for i in got if i % 6 in (2, 5)) < 0.05 * 300
    assert pii.find(odd).count() == odd.count() and pii.find(empty).count() == 0
    red = pydict(pii.redacted(personal))
    assert "555" not in red[0].text and "[PHONE]" in red[0].text


def test_secret_novelty(spark, odd, empty):
    key = "Zq8vT2mX9bLw4RkP7sYd3Nf6"
    rows = [(1, f"Authorization Bearer {key} sent"), (2, "Authorization Bearer default_default_config_01 sent"), (3, f"plain words around {key} nothing else"), (4, 'token = "0123456789abcdef0123456789abcdef"')]
    got = pydict(secrets.find(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1].spans.startswith("novel:21:") and got[2].spans == "" and got[3].spans == ""
    assert got[4].base == got[4].spans == spans.render(ref_secrets(rows[3][1]), secrets.KINDS)
    assert secrets.find(odd).count() == odd.count() and secrets.find(empty).count() == 0


def test_added_spans_never_overlap():
    base = [("ip", 5, 9)]
    out = spans.add_best(base, [(0.9, ("phone", 0, 5)), (0.8, ("phone", 4, 6)), (0.95, ("card", 20, 30)), (0.99, ("phone", 29, 35)), (0.5, ("card", 9, 12))])
    assert sorted(out) == sorted([("ip", 5, 9), ("phone", 0, 5), ("phone", 29, 35), ("card", 9, 12)])


# ---- quality


def kneser_ney(texts, query):
    """Modified Kneser-Ney over symbol tuples, straight from its definition."""
    n, a = quality.ORDER, quality.SYMBOLS
    pad = [quality._START] * (n - 1)
    grams = {n: collections.Counter()}
    for t in texts:
        s = pad + quality.symbols(t.encode()).tolist()
        grams[n].update(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    for k in range(n - 1, 0, -1):
        grams[k] = collections.Counter(g[1:] for g in grams[k + 1])

    def discount(k, c):
        m = collections.Counter(grams[k].values())
        if not c:
            return 0.0
        i = min(c, 3)
        if not (m[1] and m[2] and m[i]):
            return 0.5
        v = i - (i + 1) * m[1] / (m[1] + 2 * m[2]) * m[i + 1] / m[i]
        return v if 0 < v <= i else 0.5

    def p(k, g):
        if k == 0:
            return 1.0 / a
        rest = [(h, c) for h, c in grams[k].items() if h[:-1] == g[:-1]]
        low = p(k - 1, g[1:])
        if not rest:
            return low
        total = sum(c for _, c in rest)
        c = grams[k][g]
        return (c - discount(k, c)) / total + sum(discount(k, x) for _, x in rest) / total * low

    s = pad + quality.symbols(query.encode()).tolist()
    return -sum(math.log2(p(n, tuple(s[i : i + n]))) for i in range(len(s) - n + 1))


def test_kneser_ney_by_definition(spark):
    texts = ["the cat sat on the mat. The cat ran!", "a dog and the cat", "the dog sat; dogs run."]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(9, "the rat sat? 77", "en"), (10, "zz##", "xx")], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    got = {r._key: r.bits for r in quality.scored(df, lab).collect()}
    for i, t in [(0, texts[0]), (9, "the rat sat? 77"), (10, "zz##")]:
        assert math.isclose(got[i], kneser_ney(texts, t), rel_tol=1e-4)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([("en", bytearray(b"abracadabra and more abra cadabra")), ("fr", bytearray("été à la plage".encode()))], "_lang string, _text binary")
    probs, backs = quality.model_tables(df)
    for lang in ("en", "fr", quality.POOL):
        t = quality._collect(probs, [lang], ("code", "p"))[lang]
        b = quality._collect(backs, [lang], ("ctx", "back"))[lang]
        full = 2.0 ** quality.dense(t, b).reshape(-1, quality.SYMBOLS).astype(float)
        assert np.abs(full.sum(1) - 1).max() < 1e-3


def test_quality_on_held_out_labels(spark, sf):
    """Trained on half of the trusted documents, judged on the other labelled ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = pydict(quality.classify(docs, lab.filter("doc_id % 2 = 0")))
    held = [r for r in lab.filter("doc_id % 2 = 1").collect()]
    good = [got[r.doc_id].keep for r in held if r.quality == 1 and r.toxic == 0]
    bad = [got[r.doc_id].keep for r in held if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.35 * len(bad)


def test_few_trusted_texts_do_not_reject_a_language(spark):
    rng = random.Random(21)
    # trusted texts per language: xx and null rows have one, yy just enough for a model of its own
    trusted = [("en", 120, 100), ("xx", 1, 4), (None, 1, 4), ("yy", quality.LEAST_TRUSTED, 8)]
    rows, lab, clean = [], [], set()
    for lang, n, size in trusted:
        for i in range(n + 20):
            rows.append((len(rows), prose(rng, size if i < n else 60), lang))
            if i < n:
                lab.append((rows[-1][0], 1, 0))
            else:
                clean.add(rows[-1][0])
    junk = len(rows)
    rows += [(junk + i, "#%&~=" * 60, lang) for i, (lang, *_) in enumerate(trusted)]
    got = pydict(quality.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int")))
    lost = collections.Counter(got[i].lang for i in clean if not got[i].keep)
    assert not lost, lost
    assert not any(got[i].keep for i in range(junk, len(rows)))


def test_quality_odd_rows(spark, odd, empty, labels):
    got = quality.classify(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(not r.keep and r.perplexity is None for r in got if r.n_symbols == 0)
    none = quality.classify(odd, labels.filter("false")).collect()
    assert all(r.keep == (r.n_symbols > 0) for r in none)
    assert quality.classify(empty, labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


# ---- nearest neighbours


def brute_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    def product(a, b):
        out = 0.0  # the built-in sum compensates rounding, a plain loop does not
        for x, y in zip(a, b):
            out += float(x) * float(y)
        return out

    out = {}
    for i, q in ok:
        if i % 5 == 0:
            s = sorted((-product(q, v), j) for j, v in ok if j != i and len(v) == len(q))
            out[i] = [j for _, j in s[:k]]
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append(r.vec_id)
    return dict(out)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 8)) * 3
    rows = [(i, [float(x) for x in (centers[i % 20] + rng.normal(size=8)).round(2)]) for i in range(1200)]
    rows += [(1300, None), (1305, [0.0] * 8), (1310, [1.0, None] + [0.0] * 6), (1315, [float("nan")] * 8), (1320, [float("inf")] * 8), (1325, [1.0, 2.0]), (1330, [2.0, 1.0]), (None, [1.0] * 8), (1335, rows[0][1]), (1340, rows[0][1]), (1345, [])]
    return rows


def test_vantage_exact(spark, vectors):
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, score string")
    args = dict(key="vec_id", vector="embedding", is_query=F.pmod("vec_id", F.lit(5)) == 0, k=7)
    want = brute_nearest(vectors, 7)
    assert found(vantage.nearest(df, **args)) == want
    assert found(vantage.nearest(df, **args, shard_rows=300, block_queries=60)) == want
    assert vantage.nearest(df.filter("false"), **args).count() == 0
    loose = found(vantage.nearest(df, **args, relax=1.4))
    hit = sum(len(set(want[q]) & set(loose.get(q, []))) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.9


def test_relaxing_prunes():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(500, 4)) + c for c in rng.normal(size=(8, 4)) * 6])
    tree = vantage.VantageTree(x, leaf=32)
    seen = collections.Counter()

    def run(relax):
        def score(at, rows):
            seen[relax] += len(at) * len(rows)
            return -np.linalg.norm(x[at][:, None] - x[rows][None], axis=2)

        return vantage.search(tree, x, score, 5, relax)[1]

    exact = run(1.0)
    assert all(set(exact[i]) == set(np.argsort(np.linalg.norm(x - x[i], axis=1))[:5]) for i in range(0, 4000, 397))
    run(2.0)
    assert seen[2.0] < seen[1.0] < 0.6 * len(x) ** 2


def test_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(3000)], "vec_id long, embedding array<double>")
    got = found(vantage.nearest(df, key="vec_id", vector="embedding", is_query=F.col("vec_id") == 5, k=3))
    assert got == {5: [0, 1, 2]}


# ---- passages


def brute_chain(pos, rpos):
    best = {}
    for i in sorted(range(len(pos)), key=lambda i: (pos[i], -rpos[i])):
        best[i] = passages.ANCHOR + max([0.0] + [best[j] - passages.GAP * (pos[i] - pos[j] + rpos[i] - rpos[j]) for j in best if pos[j] < pos[i] and rpos[j] < rpos[i]])
    return max(best.values())


def test_chains_are_best():
    rng = random.Random(4)
    for _ in range(200):
        m = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(1, 25))})
        pos, rpos = np.array([a for a, _ in m]), np.array([b for _, b in m])
        got = passages.chains(pos, rpos)
        c = got[0]
        assert all(pos[a] < pos[b] and rpos[a] < rpos[b] for a, b in zip(c, c[1:]))
        score = passages.ANCHOR * len(c) - passages.GAP * (pos[c[-1]] - pos[c[0]] + rpos[c[-1]] - rpos[c[0]])
        assert math.isclose(score, brute_chain(pos, rpos))
        assert sorted(i for x in got for i in x) == list(range(len(m)))


def test_common_words():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(12))], [rng.randrange(5) for _ in range(rng.randrange(12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert passages.common_words(np.array(a), np.array(b)) == t[-1][-1]


def test_repeated_passages(spark, odd, empty):
    rng = random.Random(10)
    plant = [prose(rng, 60) for _ in range(5)]
    rows, want = [], {}
    for i in range(120):
        head, tail = rng.randrange(0, 40), rng.randrange(0, 40)
        body = plant[i % 8] if i % 8 < 5 else ""
        if body and i % 3 == 0:
            w = body.split()
            w[25] = "changed"
            body = " ".join(w)
        a, b = prose(rng, head), prose(rng, tail)
        rows.append((i, " ".join(x for x in (a, body, b) if x)))
        if body:
            want[i] = (head, head + 60)
    got = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = {k: min(i for i in want if i % 8 == k) for k in range(5)}
    hit = collections.defaultdict(list)
    for r in got:
        assert r.other < r.doc_id and r.agree >= 0.8 * (r.end - r.start)
        hit[r.doc_id].append((r.start, r.end))
    assert set(hit) == {i for i in want if i != first[i % 8]}
    for i, s in hit.items():
        assert any(abs(a - want[i][0]) <= 3 and abs(b - want[i][1]) <= 3 for a, b in s)
    assert passages.repeats(empty).count() == 0
    pairs = {(r.doc_id, r.other) for r in passages.repeats(odd).collect()}
    assert {(2, 1), (3, 1), (4, 1), (13, 1), (9, 8)} <= pairs
    cut = pydict(passages.without_repeats(spark.createDataFrame(rows[:20], "doc_id long, text string")))
    assert len(cut[8].text.split()) < len(rows[8][1].split()) - 50


def test_two_passages_of_a_pair_do_not_erase_each_other(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for i, gap in enumerate([30, 100, 300, 1000]):
        head, foot = prose(rng, 60), prose(rng, 60)
        for j in (0, 1):
            rows.append((2 * i + j, " ".join([prose(rng, 7), head, prose(rng, gap), foot, prose(rng, 9)])))
        want[2 * i + 1] = [(7, 67), (67 + gap, 127 + gap)]
    hit = collections.defaultdict(list)
    for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.other == r.doc_id - 1 and r.agree >= 0.8 * max(r.end - r.start, r.other_end - r.other_start)
        hit[r.doc_id].append((r.start, r.end))
    for d, places in want.items():
        for a, b in places:
            assert any(s <= a + 3 and e >= b - 3 for s, e in hit[d]), (d, hit[d])
        if d > 1:
            assert len(hit[d]) == 2


def test_parts_of_a_chain():
    a = np.arange(1000, dtype=np.uint32)
    b = a.copy()
    b[60:160] += 5000  # two exact runs, and one of which every tenth word differs
    b[400:800] += 7000
    b[800::10] += 9000
    x = np.array([3, 30, 52, 160, 300, 391, 811, 991])
    parts = passages.split(x, x, a, b, 50, 0.8)
    assert [(s, e) for s, e, *_ in parts] == [(0, 60), (160, 400), (801, 1000)]
    assert all(n >= 0.8 * (e - s) and (s, e) == (rs, re_) for s, e, rs, re_, n in parts)


def test_keys_that_are_no_numbers(spark):
    rng = random.Random(1)
    p = prose(rng, 80)
    df = spark.createDataFrame([("a", p), ("b", p + " more"), ("c", prose(rng, 70)), (None, p)], "doc_id string, text string")
    got = {frozenset((r.doc_id, r.other)) for r in passages.repeats(df).collect()}
    assert frozenset(("a", "b")) in got or frozenset(("a", None)) in got


# ---- pieces


@pytest.fixture(scope="module")
def bpe():
    return pieces.load_model(model_path())


def test_bpe_equals_the_library(spark, bpe, odd, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rng = random.Random(7)
    letters = "etaoin shrdluéß\n\t  .,0123▁😀中"
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randrange(200)))) for i in range(150)]
    rows += [(900, "http" * 40), (901, "a" * 61), (902, "  lead and  double   spaces "), (903, "▁"), (904, "deadbeef" * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (10**6, 0):
        got = pieces.encode(df, bpe, most_words=words).collect()
        assert len(got) == len(rows)
        have = collections.Counter((r.doc_id, tuple(r.ids)) for r in got)
        assert have == collections.Counter((i, tuple(lib.encode(t or ""))) for i, t in rows)
    back = pieces.decode(pieces.encode(df, bpe), bpe).collect()
    text = dict(rows)
    assert all(r.decoded == (text[r.doc_id] or "").replace("▁", " ") for r in back if r.doc_id is not None)
    assert pieces.encode(empty, bpe).count() == 0


@pytest.mark.parametrize("byte", [True, False])
def test_unigram_viterbi(spark, byte):
    """A hand-made piece table with scores: the fold equals the best of all segmentations."""
    table = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("c", -4.0, 1), ("ab", -3.2, 1), ("bc", -5.0, 1), ("abc", -6.5, 1), ("▁a", -3.5, 1), ("▁ab", -5.9, 1), ("ca", -3.1, 1)]
    n = len(table)
    if byte:
        table += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    m = pieces.PieceModel([t[0] for t in table], [t[1] for t in table], [t[2] for t in table], pieces.UNIGRAM, True, {i: n + i for i in range(256)} if byte else {})
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abc abcé") for _ in range(rng.randrange(12)))) for i in range(80)]
    got = pydict(pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), m))
    score = {p: s for p, s, k in table if k == 1}
    worst = -pieces.unknown_cost(m)

    def best(s):
        top = [0.0] + [float("-inf")] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(e):
                v = score.get(s[b:e], worst if e == b + 1 else float("-inf"))
                top[e] = max(top[e], top[b] + v)
        return top[-1]

    for i, t in rows:
        s = "▁" + t.replace(" ", "▁") if t else ""
        ids = list(got[i].ids)
        total, j, text = 0.0, 0, ""
        while j < len(ids):
            if byte and ids[j] >= n:
                total, j, text = total + worst, j + 2, text + "é"
            elif ids[j] == 0:
                total, j, text = total + worst, j + 1, text + "é"
            else:
                total, j, text = total + table[ids[j]][1], j + 1, text + table[ids[j]][0]
        assert text == s and math.isclose(total, best(s), abs_tol=1e-6)


def test_pii_counts_per_kind(spark):
    rows = [(1, "a@b.c 1.2.3.4 x@y.zz"), (2, "4111 1111 1111 1111 +1 (22) 333-4444"), (3, None), (4, "0" * 5000 + "1.2.3.4")]
    got = pii.counted(pii.find(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id")
    assert {r[0]: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got.collect()} == {1: (2, 1, 0, 0), 2: (0, 0, 1, 1), 3: (0, 0, 0, 0), 4: (0, 1, 0, 0)}


def test_secret_counts_per_kind(spark):
    rows = [(1, "password=abcdefgh token: 'x1234567'"), (2, "AKIAABCDEFGHIJKL " + "0a" * 16), (3, None)]
    got = secrets.counted(secrets.find(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id")
    assert {r[0]: (r.n_assign, r.n_access, r.n_hex) for r in got.collect()} == {1: (2, 0, 0), 2: (0, 1, 1), 3: (0, 0, 0)}


def test_pii_learns_from_every_candidate(spark, monkeypatch):
    """A table beyond any former sample: all labelled candidates carry weight in the fit."""
    from pyspark.ml.classification import GBTClassifier

    seen = []
    plain = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df, *a: (seen.append(df.agg(F.sum("weight")).first()[0]), plain(self, df, *a))[1])
    n = 60_000
    flat = spark.range(n).select(F.col("id").alias("_row"), F.lit("phone").alias("kind"), F.col("id").cast("int").alias("start"), F.col("id").cast("int").alias("end"), (F.col("id") % 2).cast("int").alias("label"), F.array((F.col("id") % 2).cast("double"), (F.col("id") % 5).cast("double")).alias("x"))
    model, cut = pii.fit(flat)
    held = flat.filter(F.pmod(F.xxhash64("_row", F.lit(12)), F.lit(3)) == 0).count()
    assert seen == [n - held] and set(cut) == {"phone"}


# ---- what large tables take


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    t = materialize(spark.range(5000).withColumn("k", F.col("id") % 7).repartition(4, "k"))
    assert t.count() == 5000
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    # count() has an exchange of one row for each task
    assert len({f.split("_")[1] for f in shuffle_files(spark) - before}) <= 1


def test_rows_that_visit_all_pivots_come_in_small_batches():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 2000).astype(np.uint64)
    texts = [np.unique(np.append(base, np.uint64(i))).tobytes() for i in range(300)]
    b = pa.RecordBatch.from_arrays([pa.array([7] * 300), pa.array(range(300)), pa.array([1] * 300), pa.array([0] * 300), pa.array(texts, pa.binary())], ["region", "cls", "w", "mask", "s"])
    out = list(jaccard_join._voronoi({7: texts[:40]}, 85, 0)(iter([b])))
    assert sum(x.num_rows for x in out) > 300 and max(x.nbytes for x in out) < 10_000_000
    assert {x for o in out for x in o.column("cls").to_pylist()} == set(range(300))


def test_classes_of_one_name_stay_together(spark):
    """Classes travel under half of their digest; two linked ones of one name are no edge, and still meet."""
    rng = np.random.default_rng(8)
    rows = []
    for f in range(20):
        base = np.unique(rng.integers(0, 1 << 62, 50).astype(np.uint64))
        rows += [(5, (j << 40) + f, 1, 0, bytearray(np.delete(base, j).tobytes())) for j in range(2)]
    df = spark.createDataFrame(rows, "region long, cls long, w long, mask long, s binary")
    leaves = jaccard_join.split_regions(df, 85)
    j = leaves.repartition("region").sortWithinPartitions("region", "cls").mapInArrow(jaccard_join._leaf(85), "a long, b long, links long")
    assert {r.a: r.links for r in j.collect()} == {r[1]: 1 for r in rows}


def test_parts_have_dictionaries_of_their_own(spark, bpe):
    """More words than a dictionary may hold: texts are dealt into parts, and no text is shuffled."""
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    rng = random.Random(12)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12)) + " and the " + "x" * 70) for i in range(200)]
    out = pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), bpe, most_words=500)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: list(r.ids) for r in out.collect()} == {i: lib.encode(t) for i, t in rows}
