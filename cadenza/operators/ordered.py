"""Running windows over keys of any size.

``Window.partitionBy(source_id)`` sends a whole source to one task. Here rows are first cut
into blocks by a range partitioning on (key, order): blocks are balanced whatever the key
distribution is. Windows then run per (key, block), and what has to cross a block border
(running sums, last values, ...) travels through a carry table with one row per
(key, block) of the keys that span several blocks. At most ``2 * blocks`` such rows exist,
which is the bound that makes the broadcast of the carry table safe.

A source reader may mark a key column with :data:`BOUNDED` metadata when one key's rows all come from one
row of the table read (the words of a document). Such keys cannot grow with the data, so plain windows per key are
used and nothing is written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import materialize

BLOCK = "_blk"
BOUNDED = {"bounded_key": True}
WHOLE = {"whole_keys": True}


def holds_whole_keys(blocked: DataFrame) -> bool:
    """True when no key of a block table crosses a block border by construction."""
    return bool(blocked.schema[BLOCK].metadata.get("whole_keys"))


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, rows: int = 65_536) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that hold whole keys, from batches sorted by the whole number ``key``."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        k = t[key].fill_null(-(1 << 62)).to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1])
        if not len(cut):
            continue
        at = int(cut[-1]) + 1
        yield t.slice(0, at)
        held = t.slice(at).combine_chunks().to_batches()
        n = n - at
    if held:
        yield pa.Table.from_batches(held)


BLOCK_ROWS = 250_000


def block_count(df: DataFrame) -> int:
    """Blocks for a table: one per ``BLOCK_ROWS`` counted rows, and at least one per core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // BLOCK_ROWS))


def ordered_blocks(df: DataFrame, key: Sequence[str], order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Add ``_blk``: consecutive in (key, order), frozen by a written table.

    ``order`` must end with a column that is unique within the key.
    """
    if blocks is None and any(df.schema[c].metadata.get("bounded_key") for c in key):
        return df.drop(BLOCK).select("*", F.lit(0).alias(BLOCK, metadata=WHOLE))
    n = blocks or block_count(df)
    cols = [F.col(c) for c in [*key, *order]]
    return materialize(df.repartitionByRange(n, *cols).withColumn(BLOCK, F.spark_partition_id()))


@dataclass(frozen=True)
class Run:
    """One running value. ``kind``: lag, lead, sum, min, max, last, first.

    ``last``/``first`` skip nulls: the nearest value behind/ahead. ``inclusive`` counts the
    current row in (ignored by lag/lead).
    """

    kind: str
    col: Column
    inclusive: bool = True


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def run_sum(c, inclusive=True):
    return Run("sum", _col(c), inclusive)


def lag(c):
    return Run("lag", _col(c))


def lead(c):
    return Run("lead", _col(c))


def run_max(c, inclusive=True):
    return Run("max", _col(c), inclusive)


def run_min(c, inclusive=True):
    return Run("min", _col(c), inclusive)


def last_value(c, inclusive=True):
    return Run("last", _col(c), inclusive)


def next_value(c, inclusive=True):
    return Run("first", _col(c), inclusive)


def row_index():
    """1-based position within the key."""
    return Run("sum", F.lit(1).cast("long"), True)


def carried(blocked: DataFrame, key: Sequence[str], order: Sequence[str], runs: dict[str, Run]) -> DataFrame:
    """Evaluate ``runs`` over (key, order) on a table made by :func:`ordered_blocks`."""
    key, order = list(key), list(order)
    whole = holds_whole_keys(blocked)
    parts = key if whole else [*key, BLOCK]
    w = Window.partitionBy(*parts).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    # looking ahead: a running frame over the reversed order (frames up to the far end are quadratic)
    back = Window.partitionBy(*parts).orderBy(*[F.col(c).desc() for c in order])
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    since = back.rowsBetween(Window.unboundedPreceding, 0)
    pos = F.struct(*order)

    inputs = {f"_i_{n}": r.col for n, r in runs.items()}
    df = blocked.withColumns(inputs)

    aggs, carries, local = [], {}, {}
    ws = Window.partitionBy(*key).orderBy(BLOCK)
    s_before = ws.rowsBetween(Window.unboundedPreceding, -1)
    s_after = Window.partitionBy(*key).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    for name, r in runs.items():
        i, s = F.col(f"_i_{name}"), F.col(f"_s_{name}")
        present = F.when(i.isNotNull(), pos)
        frame = (upto if r.inclusive else before)
        if r.kind == "lag":
            aggs.append(F.max_by(i, pos).alias(f"_s_{name}"))
            carries[name] = F.lag(s).over(ws)
            local[name] = F.lag(i).over(w)
        elif r.kind == "lead":
            aggs.append(F.min_by(i, pos).alias(f"_s_{name}"))
            carries[name] = F.lead(s).over(ws)
            local[name] = F.lead(i).over(w)
        elif r.kind in ("sum", "max", "min"):
            fn = {"sum": F.sum, "max": F.max, "min": F.min}[r.kind]
            aggs.append(fn(i).alias(f"_s_{name}"))
            carries[name] = fn(s).over(s_before)
            local[name] = fn(i).over(frame)
        elif r.kind == "last":
            aggs.append(F.max_by(i, present).alias(f"_s_{name}"))
            carries[name] = F.last(s, ignorenulls=True).over(s_before)
            local[name] = F.last(i, ignorenulls=True).over(frame)
        elif r.kind == "first":
            aggs.append(F.min_by(i, present).alias(f"_s_{name}"))
            carries[name] = F.last(s, ignorenulls=True).over(s_after)
            local[name] = F.last(i, ignorenulls=True).over(since if r.inclusive else after)
        else:
            raise ValueError(f"unknown running kind {r.kind!r}")

    if whole:
        zero = {n: F.coalesce(c, F.lit(0)) if runs[n].kind == "sum" else c for n, c in local.items()}
        return df.withColumns(zero).drop(*[f"_i_{n}" for n in runs])

    summary = df.groupBy(*key, BLOCK).agg(*aggs)
    summary = summary.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    summary = summary.withColumns({f"_c_{n}": c for n, c in carries.items()})
    carry = summary.filter("_n > 1").select(*key, BLOCK, *[f"_c_{n}" for n in runs])

    edge = {}
    kinds = {r.kind for r in runs.values()}
    if "lag" in kinds:
        edge["_first"] = F.row_number().over(w) == 1
    if "lead" in kinds:
        edge["_last"] = F.lead(F.lit(1)).over(w).isNull()
    df = df.withColumns({**{f"_l_{n}": c for n, c in local.items()}, **edge})
    df = df.join(F.broadcast(carry), [*key, BLOCK], "left")

    out = {}
    for name, r in runs.items():
        lo, ca = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if r.kind == "lag":
            out[name] = F.when(F.col("_first"), ca).otherwise(lo)
        elif r.kind == "lead":
            out[name] = F.when(F.col("_last"), ca).otherwise(lo)
        elif r.kind == "sum":
            zero = F.lit(0)
            out[name] = F.coalesce(lo, zero) + F.coalesce(ca, zero)
        elif r.kind == "max":
            out[name] = F.greatest(lo, ca)
        elif r.kind == "min":
            out[name] = F.least(lo, ca)
        else:
            out[name] = F.coalesce(lo, ca)
    df = df.withColumns(out)
    drop = [f"_{p}_{n}" for n in runs for p in "ilc"]
    return df.drop(*drop, *edge)


def running(df: DataFrame, key: Sequence[str], order: Sequence[str], runs: dict[str, Run]) -> DataFrame:
    """:func:`ordered_blocks` + :func:`carried` in one step; drops the block column."""
    return carried(ordered_blocks(df, key, order), key, order, runs).drop(BLOCK)


def exact_percentile(df: DataFrame, key: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per key without holding a key's values in one buffer.

    Equal values are counted first; ranks come from running sums over blocks, and only the two
    rows around each requested rank are kept.
    """
    key = list(key)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("_k"))
    ranked = running(counts, key, [value], {"_hi": run_sum("_k")})
    totals = counts.groupBy(*key).agg(F.sum("_k").alias("_t"))
    both = ranked.join(totals, key)
    aggs = []
    keep = F.lit(False)
    for name, q in fractions.items():
        at = (F.col("_t") - 1) * F.lit(float(q))
        lo_at, hi_at = F.floor(at), F.ceil(at)
        lo_here = (F.col("_hi") > lo_at) & (F.col("_hi") - F.col("_k") <= lo_at)
        hi_here = (F.col("_hi") > hi_at) & (F.col("_hi") - F.col("_k") <= hi_at)
        keep = keep | lo_here | hi_here
        lo = F.max(F.when(lo_here, F.col(value)))
        hi = F.max(F.when(hi_here, F.col(value)))
        frac = F.max(at - lo_at)
        aggs.append((lo + (hi - lo) * frac).alias(name))
    picked = both.filter(keep)
    return picked.groupBy(*key).agg(*aggs)
