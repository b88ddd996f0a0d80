"""Every stage of the pipeline against a brute-force version of it, on whole small tables and on odd rows."""

import collections
import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as cp  # noqa: E402
from cadenza.llm import quality  # noqa: E402
from cadenza.llm.queries import model_path  # noqa: E402
from cadenza.session import materialize  # noqa: E402


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def components(rows, k, share):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) if w else set())
    low = {i: i for i, _ in rows}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                low[y] = x
    return {i for i, _ in rows if find(i) == i}


def walk(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, f in cp.STAGES:
        docs = materialize(f(spark, docs, sf))
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def stages(spark, sf):
    return walk(spark, sf)


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_and_exact_copies(spark, sf, stages):
    docs, good, exact = ([(r.doc_id, r.text) for r in s.collect()] for s in stages[:3])
    verdict = {r.doc_id: r.keep for r in quality.classify(stages[0], spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert sorted(i for i, _ in good) == sorted(i for i, _ in docs if verdict[i])
    first = {}
    for i, t in good:
        first[norm(t)] = min(i, first.get(norm(t), i))
    assert sorted(i for i, _ in exact) == sorted(first.values())
    lab = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [i for i, v in lab.items() if v == (1, 0)]
    assert sum(verdict[i] for i in clean) >= 0.97 * len(clean)


def test_near_copies(stages):
    before, after = ([(r.doc_id, r.text) for r in s.collect()] for s in stages[2:4])
    assert {i for i, _ in after} == components(before, 5, 80)


def test_mixture(stages):
    before, after = (s.collect() for s in stages[3:5])
    words = {r.doc_id: len(norm(r.text).split()) for r in before}
    size, taken, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in before:
        size[r.source] += words[r.doc_id]
        longest[r.source] = max(longest[r.source], words[r.doc_id])
    copies = collections.Counter(r.doc_id for r in after)
    for r in after:
        taken[r.source] += words[r.doc_id]
    assert max(copies.values()) <= 3
    open_, goal = dict(zip(sorted(size), [5, 2, 1] * 99)), {}
    while open_:
        left, w = sum(size.values()) - sum(goal.values()), sum(open_.values())
        over = [s for s in open_ if left * open_[s] / w > 3 * size[s] + 1e-9]
        for s in over or list(open_):
            goal[s] = 3 * size[s] if over else left * open_[s] / w
        open_ = {s: v for s, v in open_.items() if s not in goal}
    assert all(abs(taken[s] - goal[s]) <= longest[s] for s in size)


def test_tokens(spark, sf, stages):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path())
    want = sorted((r.doc_id, lib.encode(r.text)) for r in stages[4].collect())
    assert sorted((r.doc_id, list(r.ids)) for r in stages[5].collect()) == want
    assert sorted((r.doc_id, list(r.ids)) for r in cp.run(spark, sf).collect()) == want


def test_odd_rows_and_empty_tables(spark, tmp_path):
    cols = "doc_id long, text string, lang string, source string, n_chars long, `_addr` string"
    rows = [(1, "the cat sat", "en", "a", 3, "x"), (1, "the cat sat", "en", "a", 3, "x"), (2, None, None, None, None, None), (None, "no key", "en", None, 1, "y"), (3, "", "en", "a", 0, "x"), (4, "long " * 20_000, "en", "b", 1, "x"), (5, "the  cat\tsat", "xx", "b", 1, None)]
    for name, data in (("odd", rows), ("none", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(data, cols).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        out = walk(spark, sf)
        assert all(s.columns == out[0].columns for s in out[:-1])
        if not data:
            assert all(s.count() == 0 for s in out)
        else:
            texts = [norm(r.text) for r in out[2].collect()]
            assert len(texts) == len(set(texts)) and "" not in texts
            assert {r.doc_id for r in out[5].collect()} <= {1, None, 4}
