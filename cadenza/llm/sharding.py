"""Rendezvous sharding: stable record keys over weighted shards, DataFrame functions only.

Every shard draws a number from (key, shard); the key goes to the shard with the largest weighted draw. A new shard
therefore takes keys only into itself, a removed one gives up only its own, and weights steer shares.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import materialize

# Sub-buckets of a shard in which positions are counted: the first three hex digits of the order hash.
BUCKET_DIGITS = 3


def _draw(key: Column, shard: int) -> Column:
    """Uniform in (0, 1) with 52 bits, from a digest that other systems can repeat."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(shard))).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number for a key; a null key is a key of its own. Shards of weight 0 get nothing."""
    k = F.coalesce(key.cast("string"), F.lit("null"))
    live = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a weight")
    tries = [F.struct((F.lit(w) / -F.log(_draw(k, i))).alias("score"), F.lit(-i).alias("neg")) for i, w in live]
    return (-F.greatest(*tries)["neg"]).cast("int") if len(tries) > 1 else F.lit(live[0][0])


def place(df: DataFrame, *, key: str, text: str, weights: Sequence[float], grown: float = 1.0) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) for every row; other columns are not read.

    size: UTF-8 bytes plus 1 (null: 1). text_crc32 of a null text is that of an empty one. ``slot`` numbers a shard's rows
    from 0 without gaps, in the order of a hash of the row. Rows that repeat an earlier one get slots of their own.
    ``grown_shard`` is the shard after one more of weight ``grown`` is added. An empty table gives an empty table.

    A position is a row's rank within (shard, first hash digits) plus the rows of earlier digits, so no task sees a whole
    shard; the offsets are at most 4096 rows for each shard.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = df.select(
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    # drawn once: the larger set of shards differs from the smaller only where the new shard wins
    rows = rows.withColumn("shard", rendezvous(F.col("_key"), weights)).withColumn("grown_shard", rendezvous(F.col("_key"), [*weights, grown]))
    rows = rows.withColumn("_o", F.md5(F.concat_ws(":", F.coalesce(F.col("_key").cast("string"), F.lit("null")), F.col("size").cast("string"), F.col("text_crc32").cast("string")).cast("binary")))
    rows = materialize(rows.withColumn("_b", F.substring("_o", 1, BUCKET_DIGITS)))
    n = rows.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = n.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_o", "_key", "size", "text_crc32"))
    out = rows.withColumn("_r", rank).join(F.broadcast(start), ["shard", "_b"])
    return out.select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_start") + F.col("_r") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(df: DataFrame, path: str, *, key: str, weights: Sequence[float], files: int = 1) -> None:
    """Write whole rows as one folder per shard, each of ``files`` pieces; a column named shard is replaced."""
    piece = F.pmod(F.xxhash64(F.col(key)), F.lit(files))
    shard = rendezvous(F.col(key), weights)
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != "shard"]
    df.select(*kept, shard.alias("shard")).repartition(len(weights) * files, shard, piece).write.partitionBy("shard").parquet(path)
