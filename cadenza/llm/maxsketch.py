"""Ranked lexical search with hashed max-sketches.

Every document is read once: its length and, for the terms that some query asks for, how often it has them. What a term adds to a
document's score is its impact. A document's sketch has ``COORDINATES`` numbers: each term is hashed to one, which holds the largest
impact of the terms there. A query adds up the coordinates of its terms, which is never less than its score; one matrix product
gives these bounds for a batch of queries and a batch of documents. Documents are then scored exactly in the order of
their bounds until the bound falls below the score of the k-th best found so far.

Terms are compared by 64-bit hashes. All that goes to the tasks is bounded: the hashes of a vocabulary, and one batch of queries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import slices
from cadenza.session import materialize

COORDINATES = 256
DOCS = 2048  # documents bounded at once
STEP = 32  # documents scored exactly before the threshold is looked at again
QUERIES = 512  # queries of a batch
BATCH_TERMS = 200_000  # terms of a batch's queries, repeats counted, but for a batch of one query
VOCABULARY = 4_000_000  # query terms by which documents are thinned out: 32 MB; with more, documents keep all their terms

_BESIDE = bytes(c for c in range(128) if not chr(c).isalnum())
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BESIDE, b"abcdefghijklmnopqrstuvwxyz" + b" " * len(_BESIDE))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of letters and digits, all of non-ASCII counted as letters; A-Z in lower case."""
    return text.translate(_TABLE).split() if text else []


def term_hash(term: bytes) -> int:
    v = xxhash.xxh3_64_intdigest(term)
    return v - (1 << 64) if v >> 63 else v


class Known(dict):
    """term -> its hash if the vocabulary has it, else None; emptied when full."""

    def __init__(self, vocabulary: np.ndarray | None, most: int = 200_000):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, term: bytes) -> int | None:
        if len(self) >= self.most:
            self.clear()
        h = term_hash(term)
        v = self.vocabulary
        if v is not None:
            i = int(np.searchsorted(v, h))
            h = h if i < len(v) and v[i] == h else None
        self[term] = h
        return h


def _count(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(None if vocabulary is None else vocabulary.value)
        for b in slices(batches):
            n, flat, ends = [], [], [0]
            for v in b.column("_text"):
                words = terms(v.as_py())
                n.append(len(words))
                flat += [h for h in map(known.__getitem__, words) if h is not None]
                ends.append(len(flat))
            h = np.array(flat, np.int64)
            row = np.repeat(np.arange(len(n)), np.diff(ends))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(first)
            tf = np.diff(np.append(at, len(h)))
            offsets = pa.array(np.searchsorted(row[at], np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h[at], tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "_text"), pa.array(n, pa.int64()), *lists], [*(c for c in b.schema.names if c != "_text"), "n", "terms", "tf"])

    return run


_COUNTED = "n long, terms array<long>, tf array<long>"


def counted(df: DataFrame, key: str, text: str, vocabulary=None) -> DataFrame:
    """(_key, n, terms, tf): words of every text, and its distinct terms in the order of their hashes; only those of a vocabulary, if given."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(_count(vocabulary), f"_key {df.schema[key].dataType.simpleString()}, {_COUNTED}")


def weight(df: Column, docs: int) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * docs + 2.0) / (F.lit(2.0) * df + F.lit(1.0)))).cast("long")


@dataclass
class Batch:
    """Queries as a sparse matrix over their terms, which are sorted by hash."""

    vocabulary: np.ndarray  # distinct term hashes
    weights: np.ndarray
    numbers: list[int]  # of the queries
    terms: list[np.ndarray]  # places in the vocabulary, by query
    times: list[np.ndarray]  # repeats of a term in its query
    width: int = COORDINATES

    def coordinates(self) -> np.ndarray:
        return (self.vocabulary.view(np.uint64) % np.uint64(self.width)).astype(np.int64)

    def matrix(self) -> np.ndarray:
        """How often each query asks for each coordinate."""
        out, c = np.zeros((len(self.numbers), self.width)), self.coordinates()
        for i, (t, n) in enumerate(zip(self.terms, self.times)):
            np.add.at(out[i], c[t], n)
        return out


def sketches(row: np.ndarray, coordinate: np.ndarray, impact: np.ndarray, rows: int, width: int = COORDINATES) -> np.ndarray:
    """Largest impact by document and coordinate."""
    out = np.zeros(rows * width, np.int64)
    np.maximum.at(out, row * width + coordinate, impact)
    return out.reshape(rows, width)


class Best:
    """The k best (score, key order) of one query."""

    def __init__(self, k: int):
        self.k, self.found = k, []

    def add(self, more: list[tuple]) -> None:
        self.found = sorted([*self.found, *more])[: self.k]

    @property
    def floor(self) -> int:
        """Score that a document must reach to come in; equal ones may by their key."""
        return -self.found[-1][0] if len(self.found) == self.k else 1


def _search(packed, k: int, docs: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Batch = packed.value
        asks, place = q.matrix(), q.coordinates()
        best = [Best(k) for _ in q.numbers]
        wanted = np.zeros(len(q.vocabulary), np.int64)
        kind = None
        for b in slices(batches, DOCS):
            kind = b.schema.field("_key").type
            lists = b.column("terms")
            ends = lists.offsets.to_numpy().astype(np.int64)
            lo, ends = int(ends[0]), ends - int(ends[0])
            h = lists.values.slice(lo, int(ends[-1])).to_numpy()
            tf = b.column("tf").values.slice(int(b.column("tf").offsets[0].as_py()), int(ends[-1])).to_numpy()
            at = np.searchsorted(q.vocabulary, h)
            at[at == len(q.vocabulary)] = 0
            mine = q.vocabulary[at] == h
            row = np.repeat(np.arange(b.num_rows), np.diff(ends))[mine]
            at, tf = at[mine], tf[mine]
            m = 75 + np.array([25 * x * docs // total for x in b.column("n").to_pylist()], np.int64)
            impact = q.weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
            # sums of whole numbers far below 2^53, but for a query of many millions of words: hence the margin
            bounds = (sketches(row, place[at], impact, b.num_rows, q.width).astype(np.float64) @ asks.T) * (1 + 1e-9)
            starts = np.searchsorted(row, np.arange(b.num_rows + 1))
            keys = b.column("_key").to_pylist()
            for i, query in enumerate(best):
                close = np.flatnonzero(bounds[:, i] >= query.floor)
                if not len(close):
                    continue
                close = close[np.argsort(-bounds[close, i], kind="stable")]
                wanted[q.terms[i]] = q.times[i]
                for j in range(0, len(close), STEP):
                    if bounds[close[j], i] < query.floor:
                        break
                    part = close[j : j + STEP]
                    sizes = starts[part + 1] - starts[part]
                    each = np.repeat(starts[part] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
                    s = np.zeros(len(part), np.int64)
                    np.add.at(s, np.repeat(np.arange(len(part)), sizes), impact[each] * wanted[at[each]])
                    floor = query.floor
                    query.add([(-int(v), keys[d] is None, keys[d]) if keys[d] is not None else (-int(v), True, 0) for d, v in zip(part.tolist(), s.tolist()) if v >= floor])
                wanted[q.terms[i]] = 0
        rows = [(n, None if z else key, -s) for n, query in zip(q.numbers, best) for s, z, key in query.found]
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], kind), pa.array(cols[2], pa.int64())], ["_q", "_key", "score"])

    return run


def _batches(queries: DataFrame) -> Iterator[list[tuple[int, list[int], list[int]]]]:
    """Queries (_q, terms, tf) in batches of bounded size; the driver holds one at a time."""
    batch: list = []
    words = 0
    for r in queries.toLocalIterator():
        n = len(r["terms"])
        if batch and (len(batch) == QUERIES or words + n > BATCH_TERMS):
            yield batch
            batch, words = [], 0
        batch.append((r["_q"], r["terms"], r["tf"]))
        words += n
    if batch:
        yield batch


def _packed(rows: Sequence[tuple[int, list[int], list[int]]], weights: dict[int, int], width: int) -> Batch:
    vocabulary = np.unique(np.concatenate([np.array(t, np.int64) for _, t, _ in rows]))
    w = np.array([weights.get(int(h), 0) for h in vocabulary], np.int64)
    places = [np.searchsorted(vocabulary, np.array(t, np.int64)) for _, t, _ in rows]
    return Batch(vocabulary, w, [n for n, _, _ in rows], places, [np.array(n, np.int64) for _, _, n in rows], width)


def search(docs: DataFrame, queries: DataFrame, *, key: str = "doc_id", text: str = "text", query: str = "item_id", query_text: str = "text", k: int = 20, coordinates: int = COORDINATES) -> DataFrame:
    """(query, rank, key, score): each query's k best documents with a score above 0, equal scores by key, null keys last; other columns are not read.

    Texts that are null or have no terms match nothing. Rows that repeat a query are queries of their own, as are repeated documents.
    Empty tables give an empty table. Queries are answered in batches; what is read again for each batch are the counts of the documents' query terms.
    """
    spark = docs.sparkSession
    qk, dk = queries.schema[query].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    asked = materialize(counted(queries, query, query_text).filter("n > 0").withColumn("_q", F.monotonically_increasing_id()))
    words = materialize(asked.select(F.explode("terms").alias("t")).distinct())
    n_words = words.count()
    vocabulary = None
    if n_words <= VOCABULARY:
        vocabulary = spark.sparkContext.broadcast(np.sort(words.toArrow()["t"].to_numpy().astype(np.int64)))
    index = materialize(counted(docs, key, text, vocabulary).filter("n > 0"))
    s = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total")).first()
    empty = spark.createDataFrame([], f"`{query}` {qk}, rank int, `{key}` {dk}, score long")
    if not s["docs"] or not n_words:
        return empty
    n_docs, total = int(s["docs"]), int(s["total"])
    seen = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    weights = materialize(seen.join(words, "t", "left_semi").select("t", weight(F.col("df"), n_docs).alias("w")))
    parts = []
    for rows in _batches(asked.select("_q", "terms", "tf")):
        own = sorted({t for _, ts, _ in rows for t in ts})
        got = weights if n_words <= BATCH_TERMS else weights.join(F.broadcast(spark.createDataFrame([(t,) for t in own], "t long")), "t", "left_semi")
        packed = _packed(rows, {r["t"]: r["w"] for r in got.toLocalIterator()}, coordinates)
        sent = spark.sparkContext.broadcast(packed)
        parts.append(materialize(index.mapInArrow(_search(sent, k, n_docs, total), f"_q long, _key {dk}, score long")))
        sent.unpersist()
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("_q").orderBy(F.col("score").desc(), F.col("_key").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = top.join(asked.select("_q", F.col("_key").alias("_qkey")), "_q")
    return named.select(F.col("_qkey").alias(query), F.col("rank").cast("int").alias("rank"), F.col("_key").alias(key), "score")
