"""Greedy segmentation of ordered rows, in parallel.

Many sequential rules have one shape: a segment opens at row *i* with a base value ``b_i``;
the first later row *j* with ``v_j >= b_i`` opens the next one. Sessions with a span limit
(``v = end - 20``, ``b = start``), character budgets (``v = chars so far - size``), refractory
picks (``v = t - gap``, ``b = t``) and non-overlap rules (``v = start``, ``b = end``) all fit;
a forced break is ``v = +inf``.

What a block of rows does to an *unknown* base coming from the left depends on that base only, and few bases can come: a block is
left with the base of its last opening row, and chains that start anywhere in it soon meet. So every block first says which
bases can leave it, then what it makes of those that can reach it from the left; both are short lists, however many rows a
block has. The lists of the blocks that one key runs through are walked in order (a row per block), and a
last parallel pass marks the opening rows. No source is ever handled as one group; one number per block reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.ordered import BLOCK, block_count, holds_whole_keys, ordered_blocks  # noqa: F401  (tests set block_count here)
from cadenza.session import materialize


def _first_at_least(v: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each i: the first j > i with v[j] >= b[i], or n."""
    n = len(v)
    if n and np.all(v[1:] >= v[:-1]):
        return np.maximum(np.searchsorted(v, b, side="left"), np.arange(n) + 1)
    # range-maximum levels: level k holds max(v[j : j + 2**k])
    levels = [v]
    while (1 << len(levels)) <= n:
        prev, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.maximum(prev[: len(prev) - half], prev[half:]))
    at = np.arange(n) + 1
    for k in range(len(levels) - 1, -1, -1):
        lv, step = levels[k], 1 << k
        fits = at + step <= n
        idx = np.where(fits, at, 0)
        skip = fits & (lv[idx] < b)
        at = np.where(skip, at + step, at)
    return at


def _marks(v: np.ndarray, b: np.ndarray, incoming: float | None) -> tuple[np.ndarray, float]:
    """Opening rows of one block given the base that enters it; and the base that leaves it."""
    n = len(v)
    nxt = _first_at_least(v, b)
    if incoming is None or np.isnan(incoming):
        at = 0
    else:
        hit = np.nonzero(v >= incoming)[0]
        at = int(hit[0]) if len(hit) else n
    open_at = np.zeros(n, dtype=bool)
    base = incoming if incoming is not None else np.nan
    while at < n:
        open_at[at] = True
        base = b[at]
        at = int(nxt[at])
    return open_at, float(base)


def _last_bases(v: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The base that leaves the block when row i opens a segment, for each i."""
    n = len(v)
    nxt = _first_at_least(v, b)
    at = np.where(nxt < n, nxt, np.arange(n))
    while True:
        far = at[at]
        if np.array_equal(far, at):
            return b[at]
        at = far


def reach(v: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Bases that can leave a block whatever comes in, and the largest ``v``: bases above it cross the block unchanged."""
    top = np.maximum.accumulate(v)
    record = np.r_[True, top[1:] > top[:-1]]
    return np.unique(_last_bases(v, b)[record]), float(top[-1])


def _through(v: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The bases that leave a block for those that come in."""
    at = np.searchsorted(np.maximum.accumulate(v), x, side="left")
    return np.where(at < len(v), _last_bases(v, b)[np.minimum(at, len(v) - 1)], x)


def _key_starts(pdf: pd.DataFrame, key: Sequence[str]) -> np.ndarray:
    """Rows whose key is not the one of the row before."""
    first = np.zeros(len(pdf), dtype=bool)
    first[:1] = True
    for c in key:
        col = pdf[c].to_numpy()
        first[1:] |= col[1:] != col[:-1]
    return first


_REACH = "run int, seq int, outs array<double>, top double"
_CHANGE = "run int, seq int, xs array<double>, ys array<double>"


def _in_order(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over the block rows of every run in order; a run's rows stream through one task, one per block."""
    return df.repartition("run").sortWithinPartitions("run", "seq").mapInPandas(fn, schema)


def _incoming(batches):
    """(run, seq, xs): bases that can come into each block but the first of its run."""
    here: np.ndarray | None = None
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            outs = np.asarray(r.outs, dtype=float)
            if r.seq:
                rows.append((r.run, r.seq, here.tolist()))
                here = np.union1d(outs, here[here > r.top])
            else:
                here = outs
        yield pd.DataFrame(rows, columns=["run", "seq", "xs"])


def _followed(batches):
    """(run, seq, base): what leaves each block."""
    base = float("nan")
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            base = float(r.ys[np.searchsorted(r.xs, base)]) if r.seq else float(r.ys[0])
            rows.append((r.run, r.seq, base))
        yield pd.DataFrame(rows, columns=["run", "seq", "base"])


def open_segments(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    *,
    v: Column | None = None,
    v_strict: Column | None = None,
    b: Column,
    blocked: bool = False,
    flag: str = "opens",
    number: str | None = None,
) -> DataFrame:
    """Add the boolean ``flag``: True on every row that opens a segment; with ``number`` also the segment's place in its key, from 0.

    ``v`` breaks when ``v >= b``; ``v_strict`` when ``v > b``. Keeps ``_blk`` so that
    :func:`cadenza.operators.ordered.carried` can follow without another write.
    """
    key, order = list(key), list(order)
    t = df if blocked else ordered_blocks(df, key, order)
    t = t.withColumns(
        {
            "_v": (v if v is not None else F.lit(None)).cast("double"),
            "_w": (v_strict if v_strict is not None else F.lit(None)).cast("double"),
            "_b": b.cast("double"),
        }
    )
    whole_keys = holds_whole_keys(t)
    edges: list = []
    if not whole_keys:
        # v and b may hold windows: evaluate them once, three passes read the table
        t = materialize(t)
        name, at = F.struct(*key), F.struct(*key, *order)
        # one row per block: the keys at its two ends
        edges = sorted(
            t.groupBy(BLOCK).agg(F.min_by(name, at).alias("head"), F.max_by(name, at).alias("tail")).collect(), key=lambda r: r[BLOCK]
        )
    continued = {cur[BLOCK] for prev, cur in zip(edges, edges[1:]) if prev["tail"] == cur["head"]}
    whole = {e[BLOCK] for e in edges if e["head"] == e["tail"]}

    def arrays(pdf: pd.DataFrame):
        pdf = pdf.sort_values([*key, *order], kind="stable").reset_index(drop=True)
        va = np.fmax(
            pdf["_v"].to_numpy(dtype=float, na_value=-np.inf),
            np.nextafter(pdf["_w"].to_numpy(dtype=float, na_value=-np.inf), -np.inf),
        )
        va = np.where(np.isnan(va), -np.inf, va)
        fresh = _key_starts(pdf, key)
        fresh[0] = int(pdf[BLOCK].iloc[0]) not in continued
        va = np.where(fresh, np.inf, va)
        return pdf, va, pdf["_b"].to_numpy(dtype=float)

    bases: dict[int, float] = {}
    if continued:
        # blocks whose last key goes on in the next block
        need = {edges[i][BLOCK] for i in range(len(edges) - 1) if edges[i + 1][BLOCK] in continued}

        # a run: the block in which a key starts, then the blocks that it fills
        place: dict[int, tuple[int, int]] = {}
        for prev, cur in zip([None, *edges], edges):
            blk = cur[BLOCK]
            if blk in need:
                inner = blk in continued and blk in whole
                place[blk] = (place[prev[BLOCK]][0], place[prev[BLOCK]][1] + 1) if inner else (len(place), 0)

        def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
            blk = int(pdf[BLOCK].iloc[0])
            _, va, ba = arrays(pdf)
            if place[blk][1]:
                outs, top = reach(va, ba)
            else:  # the last key starts inside this block: its base out is already known
                outs, top = np.array([_marks(va, ba, np.inf if blk in continued else None)[1]]), np.inf
            return pd.DataFrame({"run": [place[blk][0]], "seq": [place[blk][1]], "outs": [outs.tolist()], "top": [top]})

        def change(pdf: pd.DataFrame, coming: pd.DataFrame) -> pd.DataFrame:
            _, va, ba = arrays(pdf)
            c = coming.iloc[0]
            xs = np.asarray(c["xs"], dtype=float)
            return pd.DataFrame({"run": [c["run"]], "seq": [c["seq"]], "xs": [xs.tolist()], "ys": [_through(va, ba, xs).tolist()]})

        slim = t.select(BLOCK, *dict.fromkeys([*key, *order]), "_v", "_w", "_b")
        # what comes in ends at a forced break: of a block that has one only the rows from its last one on matter
        forced = t.filter(F.col("_v") == float("inf")).groupBy(BLOCK).agg(F.max(at).alias("_from"))
        slim = slim.join(F.broadcast(forced), BLOCK, "left").filter(F.col("_from").isNull() | (at >= F.col("_from"))).drop("_from")
        steps = materialize(slim.filter(F.col(BLOCK).isin(sorted(need))).groupBy(BLOCK).applyInPandas(summarise, _REACH))
        changes = steps.filter("seq = 0").select("run", "seq", F.array().cast("array<double>").alias("xs"), F.col("outs").alias("ys"))
        longest = max(q for _, q in place.values())
        if longest:
            spark = t.sparkSession
            names = spark.createDataFrame([(blk, *p) for blk, p in place.items() if p[1]], f"{BLOCK} int, run int, seq int")
            coming = materialize(_in_order(steps, _incoming, "run int, seq int, xs array<double>").join(F.broadcast(names), ["run", "seq"]))
            inner = slim.filter(F.col(BLOCK).isin(sorted(blk for blk, p in place.items() if p[1])))
            changes = changes.unionByName(inner.groupBy(BLOCK).cogroup(coming.groupBy(BLOCK)).applyInPandas(change, _CHANGE))
        # one number per block
        leaves = {(r["run"], r["seq"]): r["base"] for r in _in_order(materialize(changes), _followed, "run int, seq int, base double").collect()}
        for prev, cur in zip(edges, edges[1:]):
            if cur[BLOCK] in continued:
                bases[cur[BLOCK]] = leaves[place[prev[BLOCK]]]

    schema = T.StructType([f for f in t.schema.fields if f.name not in ("_v", "_w", "_b")]
                          + [T.StructField(flag, T.BooleanType())] + ([T.StructField(number, T.LongType())] if number else []))

    names = schema.names

    def mark(pdf: pd.DataFrame, wanted=None) -> pd.DataFrame:
        pdf, va, ba = arrays(pdf)
        opens, _ = _marks(va, ba, bases.get(int(pdf[BLOCK].iloc[0])))
        pdf[flag] = opens
        if number:
            begin = np.flatnonzero(_key_starts(pdf, key))
            seen = np.cumsum(opens)
            pdf[number] = seen - np.repeat((seen - opens)[begin], np.diff(np.append(begin, len(pdf)))) - 1
        return pdf[wanted or names]

    def mark_block(block: pa.Table) -> pa.Table:
        # what the rule does not look at stays in Arrow: texts as Python objects would take many times their size
        seen = block.select(list(dict.fromkeys([BLOCK, *key, *order, "_v", "_w", "_b"]))).to_pandas()
        at = seen.sort_values([*key, *order], kind="stable").index.to_numpy()
        found = mark(seen, [flag, *([number] if number else [])])
        block = block.take(pa.array(at))
        return pa.table([pa.array(found[n].to_numpy()) if n in found else block[n] for n in names], names=names)

    def stream(batches):
        # keys are whole and sorted: a batch is cut behind its last complete key
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            cut = int(np.flatnonzero(_key_starts(pdf, key))[-1])
            joins = bool(held) and all(held[-1][c].iloc[-1] == pdf[c].iloc[0] for c in key)
            if held and not (joins and cut == 0):
                head = [*held, pdf.iloc[:cut]] if joins else held
                yield mark(pd.concat(head))
                held = []
                if not joins and cut:
                    yield mark(pdf.iloc[:cut])
            elif cut:
                yield mark(pdf.iloc[:cut])
            held.append(pdf.iloc[cut:])
        if held:
            yield mark(pd.concat(held))

    if whole_keys:
        # the rows lie so already when v or b hold windows over the key
        return t.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(stream, schema)
    out = materialize(t.groupBy(BLOCK).applyInArrow(mark_block, schema))
    if not number:
        return out
    last = out.groupBy(*key, BLOCK).agg((F.max(number) + 1).alias("_c"))
    before = Window.partitionBy(*key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_c", F.sum("_c").over(before)).filter("_c is not null").select(*key, BLOCK, "_c")
    # at most two rows per block: a key's later blocks
    out = out.join(F.broadcast(last), [*key, BLOCK], "left")
    return out.withColumn(number, F.col(number) + F.coalesce("_c", F.lit(0))).drop("_c")
