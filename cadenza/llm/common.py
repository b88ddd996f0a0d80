"""Helpers shared by the operators: tables, word hashing, sorted runs, components, size-checked joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import materialize, release

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
# A join side with at most this many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(side: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted rows allow it, else leave the join to a shuffle."""
    n = side.count() if rows is None else rows
    return F.broadcast(side) if n <= most else side


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when full, so a worker's memory stays bounded."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def fold_words(text: bytes | None) -> list[bytes]:
    """Words of a text, A-Z in lower case; bytes.split() cuts at exactly x20 and x09-x0D."""
    return [] if not text else text.lower().split()


_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams of a sequence of word hashes, by position."""
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        s = np.full(n, k, np.uint64)
        for i in range(k):
            s += h[i : i + n] * (_K[i % 8] + np.uint64(2 * (i // 8)))  # word hashes are mixed already
    return mix64(s)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-gram hashes; a shorter sequence counts as one gram, an empty one has none."""
    if len(h) == 0:
        return h
    return np.unique(gram_hashes(h, min(k, len(h))))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a task derives from one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def weighed(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows whose binary ``column`` has at most ``most`` bytes, or of one row."""
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n, dtype=np.int64)
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            to = min(max(to, at + 1), at + rows)
            yield b.slice(at, to - at)
            at = to


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables in which every run of equal ``key`` (rows already sorted by it) is whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows == 0:
            continue
        k = b.column(key)
        last = k[b.num_rows - 1].as_py()
        v = k.to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(v, last, side="left"))
        if cut == 0:
            if held and held[-1].column(key)[held[-1].num_rows - 1].as_py() != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b)
            continue
        yield pa.Table.from_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, component) for the ends of ``edges`` (a, b): component is the smallest id that is connected.

    Alternating large and small stars; minima are pre-aggregated, joins are left to the skew handling, and
    every round is written to the shared folder, so no lineage grows and lost executors cost one round.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = e0 = materialize(e)
    before = None
    for _ in range(max_rounds):
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        # large star: what hangs on u moves to u's smallest neighbour
        up = e.select(F.col("v").alias("x"), F.col("u").alias("y")).join(low.toDF("x", "m"), "x", "left")
        big = up.select("y", F.coalesce("m", "x").alias("v")).unionByName(low.select(F.col("u").alias("y"), F.col("m").alias("v")))
        big = big.select(F.greatest("y", "v").alias("u"), F.least("y", "v").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours of u move to the smallest of them
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        j = big.join(low2, "u")
        e = j.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(j.select("u", F.col("m").alias("v"))).distinct()
        e, old = materialize(e), e0
        release(old)
        e0 = e
        s = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        now = (s["n"], s["h"])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def boxed(df: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``df`` as one struct, so that helper columns cannot clash with them; ``box.*`` brings them back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("box"), *[c.alias(n) for n, c in more.items()])


def word_count(text: Column) -> Column:
    """Number of words; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
