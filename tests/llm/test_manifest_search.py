"""Search, manifest and decontamination: brute force on small tables, defined results for odd rows."""

import collections
import hashlib
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from cadenza.llm import decontam, maxsketch, merkle  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_key` string, `_addr` string, `_g` string, path string, digest string, score string, item_id string"
WORDS = [f"w{i}" for i in range(60)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, n)) for i, n in enumerate([30, 25, 10, 9, 4, 1, 0, 12])]
    rows += [(8, rows[0][1] + " tail one"), (9, None), (None, prose(rng, 20)), (3, prose(rng, 15)), (11, "a a a a a a a a a a a a"), (12, "Grüße, WELT! 😀 x_y")]
    return spark.createDataFrame([(*r, "q") for r in rows], "item_id long, text string, doc_id string")


@pytest.fixture(scope="module")
def odd(spark, items):
    """Nulls in every column, empty and very long texts, repeated rows and keys, planted passages, clashing names."""
    rng = random.Random(7)
    held = [r.text for r in items.collect()]
    rows = [(i, prose(rng, rng.choice([3, 40, 200])), "en", f"s{i % 4}") for i in range(80)]
    rows += [(100 + i, f"{prose(rng, 20)}. {t.upper() if i % 2 else t}; {prose(rng, 7)}", "en", "s9") for i, t in enumerate(held) if t]
    rows += [(200, held[0][10:] + " " + held[1], "en", "é"), (201, None, None, None), (202, "", "en", ""), (203, " \t\n.,", "en", "s1"), (None, held[0], "en", "s1"), (None, None, None, None)]
    rows += [(7, rows[7][1], "en", "s3"), (7, rows[8][1], "fr", "s3"), (204, "a " * 500, "en", "s2"), (205, prose(rng, 20_000), "en", "s2"), (206, "line\nline\n\n", None, "s2")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *"abcdefg") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


# ---- decontamination


def hits(docs, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(10, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[a : a + m])].add(i)
    lengths = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for m in lengths:
            for a in range(len(w) - m + 1):
                if tuple(w[a : a + m]) in windows:
                    hit |= set(range(a, a + m))
                    ids |= windows[tuple(w[a : a + m])]
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [decontam.HIT_ROWS, 0])
def test_contamination_brute_force(spark, odd, items, rows, monkeypatch):
    monkeypatch.setattr(decontam, "HIT_ROWS", rows)
    want = hits([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = decontam.contamination(odd, items)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(x[5] for x in want) and not all(x[5] for x in want)


def test_every_span_of_ten_is_found_whatever_surrounds_it(spark):
    rng = random.Random(2)
    item = [rng.choice(WORDS) for _ in range(40)]
    docs = []
    for i in range(60):
        a = rng.randrange(31)
        docs.append((i, " ".join([*(f"x{rng.randrange(9)}" for _ in range(rng.randrange(12))), *item[a : a + 10 - i % 2], *(f"y{rng.randrange(9)}" for _ in range(rng.randrange(12)))])))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(map(tuple, decontam.contamination(d, b).collect()), key=repr) == hits(docs, [(1, " ".join(item))])


def test_common_phrases_do_not_multiply(spark):
    """Many items share a line: their list is made once, and the documents with it all get it."""
    line = "the same line of more than ten words stands in very many items here"
    docs = spark.createDataFrame([(i, f"{line} and {i}") for i in range(200)], "doc_id long, text string")
    items = [(i, f"item {i} says {line}") for i in range(150)]
    found = decontam.occurrences(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert found.sets.count() == 150 and found.hits.count() == 200
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.items_sha256 for r in got} == {hashlib.sha256(",".join(sorted(str(i) for i in range(150))).encode()).hexdigest()}


def test_contamination_empty_tables(spark, odd, items, empty):
    none = items.limit(0)
    assert decontam.contamination(empty, items).count() == 0
    assert decontam.contamination(odd, none).filter("contaminated").count() == 0
    clean = decontam.without_contamination(odd, items)
    assert clean.columns == odd.columns
    assert clean.count() == decontam.contamination(odd, items).filter("not contaminated").count()


# ---- manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(row):
    """Levels of a ternary tree, leaves first."""
    out = [row]
    while len(row) > 1:
        row = [H(*row[i : i + 3]) for i in range(0, len(row), 3)]
        out.append(row)
    return out


def way(levels, i):
    out = []
    for row in levels[:-1]:
        a = i - i % 3
        out.append(("".join(row[a:i]), "".join(row[i + 1 : a + 3])))
        i //= 3
    return out


def proved(rows):
    leaf = lambda r, text: H(*map(field, (r.doc_id, r.source, r.lang, r.n_chars, text)))
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = climb([x[2] for x in by[s]])
    top = climb([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for at, s in enumerate(names):
        for i, (_, _, mine, r) in enumerate(by[s]):
            path = [*way(trees[s], i), *way(top, at)]
            lost = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            shown = leaf(r, r.text.replace("\n", "")) if lost and r.text is not None else mine
            for x, y in path:
                shown = H(x, shown, y)
            out.append((r.doc_id, mine, trees[s][-1][0], root, H(*(x + y for x, y in path)), shown, shown == root))
    return sorted(out, key=repr)


def shown():
    lost = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    return {"text": F.when(lost, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


@pytest.mark.parametrize("height", [6, 2, 1])
def test_manifest_brute_force(spark, odd, height):
    """Blocks of one and two levels take the same trees through many levels of blocks."""
    want = proved(odd.collect())
    got = sorted(map(tuple, merkle.verify(odd, shown=shown(), height=height).collect()), key=repr)
    assert got == want
    assert {x[6] for x in want} == {True, False}


def test_one_row_and_no_row(spark, odd, empty):
    one = odd.filter("doc_id = 206")
    r = merkle.verify(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == H() and r.verified
    out = merkle.verify(empty)
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_layout_is_a_permutation_and_splits_at_half_height():
    for levels in range(1, 8):
        at = [merkle.address(d, np.arange(3**d), levels) for d in range(levels)]
        assert sorted(np.concatenate(at).tolist()) == list(range(merkle.nodes(levels)))
        # the lower half of any subtree below the middle lies together
        if levels > 1:
            top = levels // 2
            for part in (0, 3**top - 1):
                mine = np.concatenate([at[d].reshape(3**top, -1)[part] for d in range(top, levels)])
                assert mine.max() - mine.min() + 1 == len(mine) == merkle.nodes(levels - top)


def test_paths_fold_to_the_root(spark, odd):
    rows = odd.select("source", "doc_id", F.unhex(merkle.leaf_digest([F.col("doc_id"), F.col("text")])).alias("digest"))
    m = merkle.manifest(rows, group="source", order=["doc_id"], payload=["doc_id"])
    out = merkle.paths(m).collect()
    assert len(out) == odd.count()
    assert {merkle.fold(bytes(r.digest).hex(), [(s.l, s.r) for s in r.path]) for r in out} == {m.root()}


# ---- search


def ranked(docs, items, k=20):
    tf = [collections.Counter(words(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    N, L = sum(x > 0 for x in n), sum(n)
    df = collections.Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        best = []
        for (d, _), c, x in zip(docs, tf, n):
            s = 0
            for t in words(text):
                if t in c:
                    m = 75 + (25 * x * N) // L
                    s += math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                best.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(best)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("coordinates, vocabulary, queries", [(256, 4_000_000, 512), (1, 0, 3)])
def test_search_brute_force(spark, odd, items, coordinates, vocabulary, queries, monkeypatch):
    """With one coordinate, no vocabulary and batches of three queries as well."""
    for name, v in (("VOCABULARY", vocabulary), ("QUERIES", queries)):
        monkeypatch.setattr(maxsketch, name, v)
    got = sorted(map(tuple, maxsketch.search(odd, items, coordinates=coordinates).collect()), key=repr)
    assert got == ranked([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert len(got) > 100


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(1)
    vocabulary = np.sort(rng.integers(-(1 << 60), 1 << 60, 500))
    q = maxsketch.Batch(vocabulary, rng.integers(0, 9000, 500), [0, 1], [rng.choice(500, 30, False), rng.choice(500, 5, False)], [rng.integers(1, 3, 30), rng.integers(1, 3, 5)])
    row, at = np.repeat(np.arange(40), 25), rng.integers(0, 500, 1000)
    impact = rng.integers(1, 10**9, 1000)
    bound = maxsketch.sketches(row, q.coordinates()[at], impact, 40) @ q.matrix().T
    for i in (0, 1):
        times = np.zeros(500, np.int64)
        times[q.terms[i]] = q.times[i]
        best = np.zeros((40, 500), np.int64)
        np.maximum.at(best, (row, at), impact)
        assert (bound[:, i] >= (best * times).sum(1)).all()


def test_search_empty_tables(spark, odd, items, empty):
    assert maxsketch.search(empty, items).count() == 0
    none = maxsketch.search(odd, items.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
