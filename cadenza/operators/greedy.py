"""Greedy conflict filters as rounds of joins.

"Accept in rank order unless the row conflicts with an accepted one" has one answer however it
is computed. Rows carry bucket keys such that conflicting rows share a bucket. In a round, only the best
``front`` undecided rows of every bucket are looked at: a row that is in the front of all its
buckets sees all of its better-ranked undecided rivals, so it can be accepted as soon as none of them
conflicts. Accepted rows (a front per bucket at most) then knock out the rows they conflict with.
A bucket is therefore never paired with itself: work per round is ``front`` comparisons per row,
also when one bucket holds a third of the table. The front doubles from round to round up to a
limit, so that a bucket of many rows that do not conflict is worked off in few rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.session import materialize, release


FEW = 1_000_000  # counted rows that may be broadcast


def greedy_select(
    items: DataFrame,
    *,
    id: str,
    rank: Sequence[Column],
    buckets: Column | None = None,
    rows: DataFrame | None = None,
    conflict: Callable[[str, str], Column] | None = None,
    payload: Sequence[str] = (),
    front: int = 24,
    most: int = 512,
    wide: bool = False,
    quick: Callable[[str, str], Column] | None = None,
    quick_payload: Sequence[str] = (),
    settle: Callable[[DataFrame], DataFrame] | None = None,
    cap: tuple[str, Column, int] | None = None,
    max_rounds: int = 10_000,
) -> DataFrame:
    """Rows of ``items`` that survive.

    ``rank`` sorts ascending, best first, ``id`` breaks ties. ``conflict(better, worse)`` gets two
    struct column names holding ``payload`` and returns a predicate. Rows without buckets conflict
    with nothing. With ``wide``, a big payload stays in one table by id instead of being copied to every bucket, and is
    joined to the pairs that pass ``quick`` (a cheap necessary condition over ``quick_payload``).

    ``rows`` may give the buckets of a written table ``items``, one per row: ``id``, the columns of ``rank`` and ``quick_payload``, ``_b``.
    A bucket with one row decides nothing and is left out. ``settle`` may stand for ``conflict``: it gets pairs with the structs of
    ``quick_payload`` and returns those that conflict (their ``_id`` at least).

    ``cap`` = (key, limit, bound): only the ``limit`` best survivors of a key are wanted, never more than ``bound``. Once a key has
    that many, what ranks behind them is no longer looked at; some of it may be returned undecided, so filter by rank afterwards.
    """
    owner, limit, bound = cap or ("", F.lit(0), 0)
    place = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], F.col(id).alias("id"))
    if rows is None:
        # the input is read by several branches and once more at the end
        items = materialize(items)
        base = items.withColumns({"_ck": F.col(owner) if cap else F.lit(0), "_cap": limit, "_bs": F.array_distinct(buckets), "_r": place})
        loose = base.filter((F.size("_bs") <= 0) | F.col("_bs").isNull()).select(F.col(id).alias("_id"), "_ck", "_cap", "_r")
        open_rows = materialize(
            base.filter(F.size("_bs") > 0).select(
                F.col(id).alias("_id"),
                "_r", "_ck", "_cap",
                F.size("_bs").alias("_nb"),
                F.struct(*(quick_payload if wide else payload)).alias("_p") if (quick_payload or not wide) else F.struct("_r").alias("_p"),
                F.explode("_bs").alias("_b"),
            )
        )
    else:
        r = rows.select(F.col(id).alias("_id"), place.alias("_r"), (F.col(owner) if cap else F.lit(0)).alias("_ck"), limit.alias("_cap"), F.struct(*quick_payload).alias("_p"), "_b")
        shared = materialize(r.withColumn("_nb", F.count(F.lit(1)).over(Window.partitionBy("_b"))).filter("_nb > 1").drop("_nb"))
        open_rows = materialize(shared.join(shared.groupBy("_id").agg(F.count(F.lit(1)).alias("_nb")), "_id"))
        release(shared)
        loose = materialize(items.select(F.col(id).alias("_id"), (F.col(owner) if cap else F.lit(0)).alias("_ck"), limit.alias("_cap"), place.alias("_r")).join(open_rows.select("_id").distinct(), "_id", "left_anti"))
    big = items.select(F.col(id).alias("_pid"), F.struct(*payload).alias("_big")) if wide else None

    def clashing(pairs: DataFrame) -> DataFrame:
        """Pairs (_aid, a, _id, b) that conflict."""
        if settle is not None:
            return settle(pairs)
        if not wide:
            return pairs.filter(conflict("a", "b"))
        if quick is not None:
            pairs = pairs.filter(quick("a", "b"))
        p = materialize(pairs.select("_aid", "_id").distinct())
        ids = p.select(F.explode(F.array("_aid", "_id")).alias("_pid")).distinct()
        # only what the pairs ask for is shuffled
        asked = big.join(F.broadcast(ids), "_pid", "left_semi") if p.count() <= FEW else big
        p = p.join(asked.toDF("_aid", "a"), "_aid").join(asked.toDF("_id", "b"), "_id")
        return p.filter(conflict("a", "b"))

    accepted = [loose.select("_id")]
    best = None

    def enough(won: DataFrame) -> DataFrame:
        """Drop open rows that rank behind the wanted number of survivors of their key."""
        nonlocal best
        now = won.unionByName(loose) if best is None else won.unionByName(best)
        w = Window.partitionBy("_ck").orderBy("_r")
        best = materialize(now.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= bound) & (F.col("_n") <= F.col("_cap"))))
        full = best.filter(F.col("_n") == F.least(F.col("_cap"), F.lit(bound))).select(F.col("_ck").alias("_fk"), F.col("_r").alias("_last"))
        best = best.drop("_n")
        left = open_rows.join(full, open_rows["_ck"].eqNullSafe(F.col("_fk")), "left")
        return left.filter(F.col("_last").isNull() | (F.col("_r") < F.col("_last"))).drop("_fk", "_last")

    for _ in range(max_rounds):
        if open_rows.isEmpty():
            break
        w = Window.partitionBy("_b").orderBy("_r")
        top = open_rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= front).drop("_k")
        front = min(2 * front, max(front, most))
        ready = top.groupBy("_id", "_nb").agg(F.count(F.lit(1)).alias("_seen"), F.first("_ck").alias("_ck"), F.first("_cap").alias("_cap"), F.first("_r").alias("_r")).filter("_seen = _nb").select("_id", "_ck", "_cap", "_r")
        x = top.select("_b", F.col("_id").alias("_aid"), F.col("_r").alias("_ra"), F.col("_p").alias("a"))
        y = top.select("_b", F.col("_id"), F.col("_r").alias("_rb"), F.col("_p").alias("b"))
        blocked = clashing(x.join(y, "_b").filter(F.col("_ra") < F.col("_rb"))).select("_id").distinct()
        won = materialize(ready.join(blocked, "_id", "left_anti"))
        accepted.append(won.select("_id"))
        winners = top.join(won, "_id", "left_semi").select("_b", F.col("_id").alias("_aid"), F.col("_r").alias("_ra"), F.col("_p").alias("a"))
        rest = open_rows.select("_b", "_id", F.col("_r").alias("_rb"), F.col("_p").alias("b"))
        lost = clashing(rest.join(winners, "_b").filter(F.col("_ra") < F.col("_rb"))).select("_id")
        before = open_rows
        open_rows = open_rows.join(won.select("_id").unionByName(lost).distinct(), "_id", "left_anti")
        open_rows = materialize(enough(won) if cap else open_rows)
        release(before)
    else:
        raise RuntimeError("greedy_select did not settle")
    kept = accepted[0]
    for part in accepted[1:]:
        kept = kept.unionByName(part)
    return items.join(kept.withColumnRenamed("_id", id), id, "left_semi")


def time_buckets(key: Column, start: Column, end: Column, width: float) -> Column:
    """Buckets for interval conflicts: overlapping intervals of one key share a bin."""
    return F.transform(
        F.sequence(F.floor(start / width), F.floor(end / width)),
        lambda b: F.concat_ws("|", key.cast("string"), b.cast("string")),
    )


COMMON_TOKENS = 1_000_000  # tokens whose counts every task gets: 9 bytes each


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


SKETCH = 512  # bits


def parity_sketch(items: DataFrame, tokens: str, keep: Sequence[str]) -> DataFrame:
    """(``keep`` columns, ``_s``): one bit per hash range, set when an odd number of tokens falls in it.

    Two sets differ by at least as many tokens as their sketches by bits, so no similar pair is lost.
    """

    def run(batches):
        for b in batches:
            lists = b.column("_tok")
            n = np.array(lists.value_lengths().fill_null(0), np.int64)
            bit = _mixed(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(SKETCH)
            held = np.bincount(np.repeat(np.arange(len(n)), n) * SKETCH + bit.astype(np.int64), minlength=len(n) * SKETCH) & 1
            words = np.packbits(held.astype(np.uint8)).view(np.int64)
            ends = pa.array((np.arange(len(n) + 1) * (SKETCH // 64)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.ListArray.from_arrays(ends, pa.array(words))], names=[*keep, "_s"])

    schema = T.StructType([*(items.schema[c] for c in keep), T.StructField("_s", T.ArrayType(T.LongType()))])
    return items.select(*keep, F.col(tokens).alias("_tok")).mapInArrow(run, schema)


def token_buckets(items: DataFrame, key: str, tokens: str, threshold: float, keep: Sequence[str]) -> DataFrame:
    """(``keep`` columns, ``_n`` tokens, ``_tb``): prefix-filter buckets for Jaccard >= threshold; ``tokens`` holds 64-bit hashes without repeats.

    Two sets that similar share one of their ``n - ceil(t*n) + 1`` first tokens in any one order; only those become buckets, numbered
    by key and token and listed in that order. The order goes by rarity: the logarithm of a token's count, then its hash. The counts reach the tasks as at most
    ``COMMON_TOKENS`` numbers: the least count that is told apart doubles until they fit, and no sets are shuffled.
    """
    spark = items.sparkSession
    freq = materialize(items.select(F.explode(tokens).alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_f")).filter("_f > 1"))
    least = 2
    while freq.filter(F.col("_f") >= least).count() > COMMON_TOKENS:
        least *= 2
    t = freq.filter(F.col("_f") >= least).toArrow()
    names = t["_t"].to_numpy()
    order = np.argsort(names)
    common = spark.sparkContext.broadcast((names[order], np.log2(t["_f"].to_numpy()[order] + 0.5).astype(np.int8)))
    release(freq)

    def run(batches):
        known, levels = common.value
        for b in batches:
            lists = b.column("_tok")
            n = np.array(lists.value_lengths().fill_null(0), np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            level = np.zeros(len(flat), np.int8)
            if len(known) and len(flat):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                level = np.where(known[at] == flat, levels[at], 0)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, level, row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            most = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            use = order[place < most[row]]
            size = np.minimum(most, n)
            size[n == 0] = 0
            names = _mixed(flat[use].view(np.uint64) ^ _mixed(b.column("_kh").to_numpy().view(np.uint64))[row[use]]).view(np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            out = [b.column(c) for c in keep] + [pa.array(n), pa.ListArray.from_arrays(ends, pa.array(names))]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "_n", "_tb"])

    schema = T.StructType([*(items.schema[c] for c in keep), T.StructField("_n", T.LongType()), T.StructField("_tb", T.ArrayType(T.LongType()))])
    return items.select(*keep, F.xxhash64(key).alias("_kh"), F.col(tokens).alias("_tok")).mapInArrow(run, schema)


def overlap_len(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token arrays without repeats; 0 when one is empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / union).otherwise(F.lit(0.0))
