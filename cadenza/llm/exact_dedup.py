"""Exact duplicates from recipes of content-defined chunks.

A text, with white space made single, is cut where a rolling hash of its last 16 bytes has zero low bits, so that equal
passages give equal chunks. A chunk is known by a cheap 64-bit fingerprint and its length; the fingerprint is verified
by SHA-256: where a fingerprint stands for one content it is the chunk's identifier, else the digest is added. Texts are equal when
their ordered lists of identifiers are. Only fingerprints and digests travel; texts are read once and stay where they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import SPACE, boxed, small_side
from cadenza.session import materialize

_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
MASK_BITS = 10
SHORTEST, LONGEST = 256, 16_384
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint32)


def cut_points(body: bytes) -> list[int]:
    """Ends of the chunks of a text; the last is its length. Depends on content only."""
    n = len(body)
    if n <= SHORTEST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(body, np.uint8)]
    for step in (1, 2, 4, 8):  # window of 16 bytes by doubling
        rolled = (h[:-step] << np.uint32(step)) | (h[:-step] >> np.uint32(32 - step))
        h[step:] ^= rolled
    ends = np.flatnonzero((h & np.uint32((1 << MASK_BITS) - 1)) == 0) + 1
    out, last = [], 0
    for e in ends.tolist():
        while e - last > LONGEST:
            last += LONGEST
            out.append(last)
        if e - last >= SHORTEST:
            out.append(e)
            last = e
    while n - last > LONGEST:
        last += LONGEST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def fingerprint(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = pa.struct([("fp", pa.int64()), ("len", pa.int32()), ("sha", pa.binary())])
    for b in batches:
        whole, recipe = [], []
        for v in b.column("_text"):
            body = _SPACES.sub(b" ", v.as_py() or b"")
            whole.append(hashlib.sha256(body).hexdigest())
            last, parts = 0, []
            for e in cut_points(body):
                c = body[last:e]
                parts.append({"fp": fingerprint(c), "len": e - last, "sha": hashlib.sha256(c).digest()[:16]})
                last = e
            recipe.append(parts)
        yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_row"), pa.array(whole), pa.array(recipe, pa.list_(chunk))], ["_key", "_row", "text_sha256", "recipe"])


def recipes(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """One row per input row: key, a row number for ties, SHA-256 of the normalised text, and its chunks in order."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.col(text).cast("binary").alias("_text"))
    out = rows.mapInArrow(_recipes, f"_key {kind}, _row long, text_sha256 string, recipe array<struct<fp:long,len:int,sha:binary>>")
    return materialize(out)


def collisions(chunks: DataFrame) -> DataFrame:
    """(fp, len) that stand for more than one content."""
    c = chunks.select(F.explode("recipe").alias("c")).select("c.fp", "c.len", "c.sha")
    return c.groupBy("fp", "len").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi")).filter("lo <> hi").select("fp", "len")


def identify(chunks: DataFrame) -> DataFrame:
    """Add ``ids``: the ordered list of verified chunk identifiers as one binary value.

    An identifier is (fp, len), or (fp, len, digest) for a fingerprint that stands for several contents.
    """
    bad = materialize(collisions(chunks))
    n = bad.count()
    plain = F.transform("recipe", lambda c: F.concat_ws(":", c["fp"].cast("string"), c["len"].cast("string")))
    full = F.transform("recipe", lambda c: F.concat_ws(":", c["fp"].cast("string"), c["len"].cast("string"), F.hex(c["sha"])))
    if n == 0:
        return chunks.select("_key", "_row", "text_sha256", plain.alias("ids"))
    flat = chunks.select("_row", F.explode("recipe").alias("c")).select("_row", "c.fp", "c.len")
    hit = flat.join(small_side(bad, n), ["fp", "len"], "left_semi").select("_row").distinct().withColumn("_hit", F.lit(True))
    return chunks.join(hit, "_row", "left").select("_key", "_row", "text_sha256", F.when(F.col("_hit"), full).otherwise(plain).alias("ids"))


def exact_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256), one row per input row; other columns are not read.

    Texts are equal when equal after every run of x20 and x09-x0D becomes one space; null counts as empty. The row with
    the smallest key stays; null keys come last, and of rows that share the smallest key one stays. An empty table gives an empty table.
    """
    ids = identify(recipes(df, key=key, text=text))
    first = F.min(F.struct(F.col("_key").isNull().alias("z"), F.col("_key").alias("k"), F.col("_row").alias("r")))
    groups = ids.groupBy("ids").agg(first.alias("f"), F.count(F.lit(1)).alias("group_size"))
    # only groups of several rows are looked up: a hot one stays where its rows are while the groups fit a broadcast
    many = materialize(groups.filter("group_size > 1"))
    out = ids.join(small_side(many), "ids", "left")
    alone = F.col("f").isNull()
    return out.select(
        F.col("_key").alias(key),
        F.when(alone, F.col("_key")).otherwise(F.col("f.k")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("f.r") == F.col("_row"))).alias("kept"),
        "text_sha256",
    )


def normalised_sha(text: str):
    """SHA-256 of the normalised text as a column expression: the stable address of a text."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ").cast("binary"), 256)


def drop_exact(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Input rows that stay, with all their columns.

    Rows are found again by (key, address of the text). Where a row repeats key and text of the one that stays, one of them stays.
    """
    d = materialize(exact_duplicates(df, key=key, text=text))
    groups = d.filter("group_size > 1").groupBy(F.col(key).alias("k"), F.col("text_sha256").alias("s")).agg(F.max("kept").alias("any"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups)
    n = groups.count()
    x = boxed(df, k=F.col(key), s=normalised_sha(text))
    # null keys compare like values
    g = groups.select(F.col("k").alias("gk"), F.col("s").alias("gs"), "any", "n")
    j = x.join(small_side(g, n), x["k"].eqNullSafe(F.col("gk")) & (x["s"] == F.col("gs")), "left")
    once = j.filter("gs is null or (any and n = 1)").select("box.*")
    if groups.filter("any and n > 1").isEmpty():
        return once
    again = j.filter("any and n > 1").dropDuplicates(["k", "s"]).select("box.*")
    return once.unionByName(again)
