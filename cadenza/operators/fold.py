"""Ordered folds.

Two forms. :func:`fold_small` runs a native ``F.aggregate`` over one sorted array per group and is meant
for groups whose size a rule bounds (the segments of a plan, the words of a cue span). :func:`fold_ordered` takes groups of any
size: rows are cut into balanced blocks, every block folds from its first *reset* row on, and the
rows before it wait for the state of the block to their left, one round per link. A reset is a row at which
earlier rows no longer matter (a new key, a long gap), so one or two rounds are the rule.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.ordered import BLOCK, block_count, carried, lag, ordered_blocks
from cadenza.session import materialize, materialize_by


def fold_small(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    init: Column,
    step: Callable[[Column, Column], Column],
    finish: Callable[[Column], Column] | None = None,
    out: str = "folded",
) -> DataFrame:
    """One row per group with the folded state. The group's rows travel as one array."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *[c for c in cols if c not in order])))
    folded = F.aggregate(F.col("_rows"), init, step, finish) if finish else F.aggregate(F.col("_rows"), init, step)
    return df.groupBy(*key).agg(rows.alias("_rows")).withColumn(out, folded).drop("_rows")


def fold_ordered(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    *,
    cols: Sequence[str],
    resets: Callable[[DataFrame], Column] | None,
    lookback: dict[str, Column] | None = None,
    init: Callable[[], object],
    step: Callable[[object, tuple], list[tuple]],
    finish: Callable[[object], list[tuple]],
    schema: str,
) -> DataFrame:
    """Rows emitted by a sequential rule over (key, order).

    ``step(state, row)`` changes ``state`` in place and returns rows to emit; ``finish(state)`` returns what
    the state still holds when a reset or the end arrives. ``resets`` gives a boolean over the
    row and the previous row's columns (``lookback`` names -> column to lag).
    """
    key, order = list(key), list(order)
    cols = list(cols)
    rows = df.select(*dict.fromkeys([*key, *order, *cols]))
    b = ordered_blocks(rows, key, order, block_count(rows))
    runs = {"_has": lag(F.lit(1)), **{n: lag(c) for n, c in (lookback or {}).items()}}
    c = carried(b, key, order, runs)
    flag = F.col("_has").isNull()
    if resets is not None:
        flag = flag | F.coalesce(resets(c), F.lit(False))
    # a round reads the folders of the blocks that are ready
    t = materialize_by(c.withColumn("_reset", flag).select(BLOCK, *dict.fromkeys([*key, *order, *cols]), "_reset"), BLOCK)

    # one row per block: does it start with rows that depend on its left neighbour?
    heads = {
        r[BLOCK]: (not r["f"], r["any"])
        for r in t.groupBy(BLOCK).agg(F.min_by("_reset", F.struct(*key, *order)).alias("f"), F.max("_reset").alias("any")).collect()
    }
    order_of = sorted(heads)
    waiting = {blk for blk in order_of if heads[blk][0]}
    feeds = {order_of[i] for i in range(len(order_of) - 1) if order_of[i + 1] in waiting}

    names = [f.name for f in T._parse_datatype_string(schema).fields]
    outer = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_state_of", T.IntegerType()), T.StructField("_state", T.BinaryType())])

    def run(pdf: pd.DataFrame, state, part: str):
        pdf = pdf.sort_values([*key, *order], kind="stable")
        blk = int(pdf[BLOCK].iloc[0])
        flags = pdf["_reset"].to_numpy()
        first = int(flags.argmax()) if flags.any() else len(flags)
        lo, hi = (0, first) if part == "head" else (first, len(flags))
        emitted: list[tuple] = []
        values = list(pdf[cols].itertuples(index=False, name=None))
        for i in range(lo, hi):
            if flags[i] or state is None:
                if state is not None:
                    emitted.extend(finish(state))
                state = init()
            emitted.extend(step(state, values[i]))
        # the open state goes on when this part ends the block and the next block waits for it
        at_end = hi == len(flags)
        onward = None
        if state is not None:
            if at_end and blk in feeds:
                onward = pickle.dumps(state)
            elif hi > lo or part == "head":
                emitted.extend(finish(state))
        res = pd.DataFrame(emitted, columns=names)
        res["_state_of"] = None
        res["_state"] = None
        if onward is not None:
            res.loc[len(res)] = [None] * len(names) + [blk, onward]
        return res

    def resume(known: dict):
        def go(pdf: pd.DataFrame) -> pd.DataFrame:
            return run(pdf, pickle.loads(known[int(pdf[BLOCK].iloc[0])]), "head")

        return go

    done = materialize(t.groupBy(BLOCK).applyInPandas(lambda pdf: run(pdf, None, "body"), outer))
    parts = [done]
    states = {r["_state_of"]: bytes(r["_state"]) for r in done.filter("_state is not null").select("_state_of", "_state").collect()}
    while waiting:
        left_of = {order_of[i + 1]: order_of[i] for i in range(len(order_of) - 1)}
        ready = {blk: states[left_of[blk]] for blk in waiting if left_of[blk] in states}
        if not ready:
            raise RuntimeError("fold_ordered found no block to continue")
        sub = t.filter(F.col(BLOCK).isin(sorted(ready)))
        heads_done = materialize(sub.groupBy(BLOCK).applyInPandas(resume(ready), outer))
        parts.append(heads_done)
        for r in heads_done.filter("_state is not null").select("_state_of", "_state").collect():
            states[r["_state_of"]] = bytes(r["_state"])
        waiting -= set(ready)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("_state is null").select(*names)
