"""Nearest neighbours by vantage-point trees, one per shard.

Largest inner product becomes smallest distance when every vector gets one more component, sqrt(M^2 - |v|^2) with M the
largest norm, and queries get 0 there. A tree node splits its vectors by the median distance to a vantage point; the triangle inequality skips a side when
the query's distance to the border is larger than the distance of its worst neighbour so far, divided by ``relax``. Factor 1 is exact,
larger factors skip more.

Rows are dealt to shards by hash, queries to blocks by hash; a task joins one shard with one block of queries, so its memory is
bounded whatever the table. Only the best k of each shard leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import materialize

SHARD_ROWS = 16_384
BLOCK_QUERIES = 2_048
LEAF = 256


class VantageTree:
    """Tree over the rows of ``x``; children hold row numbers, leaves at most ``leaf`` of them."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # the row farthest from the first one lies at the edge of the set: a good vantage point, and repeatable
        far = np.linalg.norm(self.x[rows] - self.x[rows[0]], axis=1)
        v = int(np.argmax(far))
        d = np.linalg.norm(self.x[rows] - self.x[rows[v]], axis=1)
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        inner, outer = rows[order[:half]], rows[order[half:]]
        din, dout = d[order[half - 1]], d[order[half]]
        if din == d[order[0]] and dout == d[order[-1]] and din == dout:
            return rows if len(rows) <= 4 * self.leaf else _Flat([rows[i : i + self.leaf] for i in range(0, len(rows), self.leaf)])
        return (rows[v], d[order[0]], din, dout, d[order[-1]], self._build(inner), self._build(outer))


class _Flat(list):
    """Row lists without order: all their rows lie equally far from the vantage point."""


def search(tree: VantageTree, q: np.ndarray, score, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
    """Best k rows for every query: (scores, rows), worst place filled with -1. ``score(queries, rows)`` gives exact scores; it also hides rows a query may not see."""
    n = len(q)
    best = np.full((n, k), -np.inf)
    who = np.full((n, k), -1, np.int64)
    reach = np.full(n, np.inf)  # distance of the k-th neighbour so far

    def leaf(at: np.ndarray, rows: np.ndarray) -> None:
        if not len(at) or not len(rows):
            return
        s = score(at, rows)
        allv = np.concatenate([best[at], s], axis=1)
        allr = np.concatenate([who[at], np.broadcast_to(rows, s.shape)], axis=1)
        # larger score first, then smaller row number (rows are sorted by id)
        order = np.lexsort((np.where(allr < 0, np.iinfo(np.int64).max, allr), -allv), axis=1)[:, :k]
        best[at] = np.take_along_axis(allv, order, 1)
        who[at] = np.take_along_axis(allr, order, 1)
        full = who[at][:, -1] >= 0
        worst = at[full]
        gap = tree.x[who[worst, -1]] - q[worst]
        reach[worst] = np.sqrt((gap * gap).sum(1))

    def visit(node, at: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, _Flat):
            for rows in node:
                leaf(at, rows)
            return
        if isinstance(node, np.ndarray):
            leaf(at, node)
            return
        v, lo_in, hi_in, lo_out, hi_out, inner, outer = node
        d = np.sqrt(((q[at] - tree.x[v]) ** 2).sum(1))
        gap_in = np.maximum(np.maximum(lo_in - d, d - hi_in), 0)
        gap_out = np.maximum(np.maximum(lo_out - d, d - hi_out), 0)
        first_in = gap_in <= gap_out
        slack = 1e-9
        for side, (near, far, g_near, g_far) in ((first_in, (inner, outer, gap_in, gap_out)), (~first_in, (outer, inner, gap_out, gap_in))):
            me = at[side]
            if not len(me):
                continue
            visit(near, me[g_near[side] * relax <= reach[me] * (1 + slack) + slack])
            visit(far, me[g_far[side] * relax <= reach[me] * (1 + slack) + slack])

    visit(tree.root, np.arange(n))
    return best, who


def inner_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Products added from the first component to the last, as a plain loop would, for every pair."""
    out = np.zeros((len(q), len(v)))
    for i in range(q.shape[1]):
        out += q[:, i, None] * v[None, :, i]
    return out


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    norm = (x * x).sum(1)
    return np.concatenate([x, np.sqrt(np.maximum(top - norm, 0))[:, None]], axis=1)


def _search(k: int, relax: float, top: float):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(rows):
            return empty
        rows = rows.sort_values("vec_id", kind="stable")
        qid, vid = queries["query_id"].to_numpy(), rows["vec_id"].to_numpy()
        q, x = np.stack(queries["v"].to_numpy()).astype(np.float64), np.stack(rows["v"].to_numpy()).astype(np.float64)
        tree = VantageTree(_lift(x, top))
        lifted = np.concatenate([q, np.zeros((len(q), 1))], axis=1)

        def score(at, which):
            s = inner_products(q[at], x[which])
            s[qid[at][:, None] == vid[which][None, :]] = -np.inf
            return s

        best, who = search(tree, lifted, score, k, relax)
        a, b = np.nonzero((who >= 0) & np.isfinite(best))
        return pd.DataFrame({"query_id": qid[a], "vec_id": vid[who[a, b]], "score": best[a, b]})

    return run


def nearest(df: DataFrame, *, key: str, vector: str, is_query, k: int = 20, relax: float = 1.0, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where ``is_query`` holds the k rows, not itself, of largest inner product.

    Ties go to the smaller id. Null vectors, vectors of zeros, and vectors with null or non-finite components take no part,
    nor do rows without id; vectors of different length never meet. Of repeated ids every row is a candidate, never for a query of
    the same id, and a repeated query is searched once. Fewer than k candidates give fewer rows; an empty table gives an empty table. Other columns are not read.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.col(key).isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("_v"), is_query.alias("_q"), v.alias("v"))
    rows = rows.filter(F.col("_v").isNotNull()).filter(sound).select("vec_id", "_q", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("norm"))
    rows = materialize(rows)
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_q"), 1)).alias("q"), F.max("norm").alias("top")).first()
    shards, blocks = max(1, -(-s["n"] // shard_rows)), max(1, -(-s["q"] // block_queries))
    shard = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = rows.filter("_q").select(F.col("vec_id").alias("query_id"), "v", "dim", block.alias("block")).dropDuplicates(["query_id", "v"]).withColumn("shard", every(shards))
    x = rows.select("vec_id", "v", "dim", shard.alias("shard")).withColumn("block", every(blocks))
    keys = ["shard", "block", "dim"]
    found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(_search(k, relax, s["top"] or 0.0), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
