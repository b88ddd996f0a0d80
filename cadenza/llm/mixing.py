"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target/size ratio r is taken floor(r) times for certain and once more with probability
r - floor(r). Those fractional probabilities are rounded in pairs: mass, weighted by document size, moves at random from one of the pair to the other until one of
them is 0 or 1. Every step keeps each document's expected copies and the source's expected words,
so a source misses its target by less than one document. Pairs are formed in a tree: documents of one leaf are paired in
one task, the one document that a leaf leaves undecided goes up, and so on to the root. Draws are hashes, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import boxed, small_side, sorted_runs, word_count
from cadenza.session import materialize

LEAF = 4096  # documents paired in one leaf, on average
FAN = 64  # leaves that meet in one node of the next level


def targets(sizes: DataFrame, *, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources in code point order, null last, get the weights in turn and share the sum of all sizes. A share above
    ``most`` times the source's size stops there; the excess is shared again by weight until none is above.
    """
    # one row per source: the order is taken over the summary, never over documents
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = materialize(sizes.withColumn("weight", w))
    total = s.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level = -1.0
    while True:
        # sources stopped at the last level stay stopped: the level only rises
        stop = (F.lit(level) * F.col("weight") > most * F.col("source_size")) if level >= 0 else F.lit(False)
        r = s.agg(F.sum(F.when(stop, most * F.col("source_size")).otherwise(0.0)).alias("fixed"), F.sum(F.when(stop, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        now = (total - r["fixed"]) / r["open"]
        if now <= level:
            break
        level = now
    share = F.lit(max(level, 0.0)) * F.col("weight")
    return s.select("source", "source_size", F.least(share, most * F.col("source_size")).alias("target"))


def _uniform(seed: int, a: int, b: int) -> float:
    return (xxhash.xxh3_64_intdigest(b"%d:%d:%d" % (seed, a, b)) + 0.5) / 2.0**64


def pivot(size: list[float], p: list[float], tag: list[int], seed: int) -> tuple[list[float], int]:
    """Round fractional ``p``, in order; returns them and the position left undecided (-1: none)."""
    eps = 1e-12
    p = list(p)
    i = -1
    for j in range(len(p)):
        if p[j] <= eps or p[j] >= 1 - eps:
            p[j] = float(round(p[j]))
            continue
        if i < 0:
            i = j
            continue
        ratio = size[j] / size[i]
        up = min(1 - p[i], p[j] * ratio)  # what i can gain
        down = min(p[i], (1 - p[j]) * ratio)  # what i can lose
        if _uniform(seed, tag[i], tag[j]) * (up + down) < down:
            p[i], p[j] = p[i] + up, p[j] - up / ratio
        else:
            p[i], p[j] = p[i] - down, p[j] + down / ratio
        if p[j] <= eps or p[j] >= 1 - eps:
            p[j] = float(round(p[j]))
            if p[i] <= eps or p[i] >= 1 - eps:
                p[i] = float(round(p[i]))
                i = -1
        else:
            p[i] = float(round(p[i]))
            i = j
    return p, i


def _round_level(seed: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, "_node"):
            node = t["_node"].to_numpy()
            size, p, tag = t["size"].to_numpy(), t["_p"].to_numpy(), t["_tag"].to_numpy()
            cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
            new, open_ = np.empty(len(node)), np.zeros(len(node), bool)
            for a, b in zip(cuts, cuts[1:]):
                q, left = pivot(size[a:b].tolist(), p[a:b].tolist(), tag[a:b].tolist(), seed)
                if left >= 0 and last:
                    q[left] = float(_uniform(seed, int(tag[a + left]), -1) < q[left])
                    left = -1
                new[a:b] = q
                if left >= 0:
                    open_[a + left] = True
            out = t.select(["_row", "size", "_tag", "_leaf", "_src"]).append_column("_p", pa.array(new)).append_column("_open", pa.array(open_))
            yield from out.to_batches()

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """Add _nth: 0, or a number from 1 on among rows that share address and source; 256 parts of such a group are numbered apart."""
    docs = docs.withColumn("_same", F.xxhash64("_addr", "source", F.col("source").isNull())).withColumn("_part", F.pmod("_row", F.lit(256)))
    part = docs.filter("size > 0").groupBy("_same", "_part").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy("_same")
    before = F.coalesce(F.sum("_c").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = materialize(part.withColumn("_all", F.sum("_c").over(group)).withColumn("_before", before).filter("_all > 1").select("_same", "_part", "_before"))
    if part.isEmpty():
        return docs.drop("_same", "_part").withColumn("_nth", F.lit(0).cast("long"))
    at = F.row_number().over(Window.partitionBy("_same", "_part").orderBy("_row"))
    many = docs.filter("size > 0").join(small_side(part), ["_same", "_part"]).select("_row", (F.col("_before") + at).cast("long").alias("_nth"))
    return docs.drop("_same", "_part").join(small_side(materialize(many)), "_row", "left").withColumn("_nth", F.coalesce("_nth", F.lit(0).cast("long")))


def _mixed(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 1) -> DataFrame:
    docs = materialize(df.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.xxhash64(F.col(key), F.col(text)).alias("_addr"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    stats = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("_n"))
    stats = materialize(stats)
    goal = targets(stats.select("source", "source_size"), weights=weights, most=most)
    goal = materialize(goal.join(stats.select(F.col("source").alias("_s"), "_n"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    sized = docs.withColumnRenamed("source", "_s").join(goal, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    # what is drawn hangs on the rows alone, not on how a scan was split: only equal rows are numbered
    sized = _numbered(sized)
    tag = F.xxhash64(F.col("_key"), F.col("size"), F.col("_addr"), F.col("_nth"))
    leaves = F.greatest(F.lit(1), F.ceil(F.col("_n") / LEAF)).cast("long")
    sized = materialize(
        sized.select(
            "_row", "_addr", "_key", "size", "source_size", "target", F.floor(ratio).alias("_whole"), (ratio - F.floor(ratio)).alias("_p"), tag.alias("_tag"),
            F.xxhash64("source", F.col("source").isNull()).alias("_src"), F.pmod(tag, leaves).alias("_leaf"), leaves.alias("_leaves"),
        )
    )
    widest = sized.agg(F.max("_leaves").alias("m")).first()["m"] or 1
    rest = sized.filter("size > 0").select("_row", F.col("size").cast("double").alias("size"), "_tag", "_leaf", "_src", "_p")
    decided = []
    while True:
        last = widest <= 1
        parts = rest.withColumn("_node", F.xxhash64("_src", "_leaf")).repartition("_node").sortWithinPartitions("_node", F.desc("size"), "_tag")
        done = materialize(parts.mapInArrow(_round_level(seed, last), "_row long, size double, _tag long, _leaf long, _src long, _p double, _open boolean"))
        decided.append(done.filter("not _open").select("_row", F.col("_p").alias("_extra")))
        if last:
            break
        # the next level meets FAN leaves in a node; one residual at most comes from each
        rest = done.filter("_open").select("_row", "size", "_tag", F.floor(F.col("_leaf") / FAN).cast("long").alias("_leaf"), "_src", "_p")
        widest = -(-widest // FAN)
    extra = decided[0]
    for d in decided[1:]:
        extra = extra.unionByName(d)
    out = sized.join(extra, "_row", "left")
    copies = (F.col("_whole") + F.round(F.coalesce("_extra", F.lit(0.0)))).cast("long")
    return out.select("_addr", F.col("_key").alias(key), F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 1) -> DataFrame:
    """(key, size, source_size, target, copies, taken), one row per input row; other columns are not read.

    size: words of the text (null: 0); a document without words is never taken. ``copies`` is the ratio of target to source size, which is
    at most ``most``, rounded down or up; ``taken`` is copies times size. Repeated rows are drawn separately. An empty table gives
    an empty table.
    """
    return _mixed(df, key=key, text=text, source=source, weights=weights, most=most, seed=seed).drop("_addr")


def take(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 1) -> DataFrame:
    """Input rows as often as the mix takes them, with all their columns.

    Rows are found again by a hash of key and text; rows that repeat both share their draws in turn.
    """
    m = materialize(_mixed(df, key=key, text=text, source=source, weights=weights, most=most, seed=seed).select("_addr", "copies"))
    by = materialize(m.groupBy("_addr").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("n")).filter("c > 0"))
    x = boxed(df, _addr=F.xxhash64(F.col(key), F.col(text))).join(small_side(by), "_addr")
    if not by.filter("n > 1").isEmpty():
        # the i-th of n rows with equal key and text, in an order that hangs on their columns
        turn = F.row_number().over(Window.partitionBy("_addr").orderBy(F.xxhash64("box")))
        many = x.filter("n > 1").withColumn("i", turn).withColumn("c", F.floor(F.col("c") / F.col("n")) + (F.col("i") <= F.col("c") % F.col("n")).cast("long")).drop("i")
        x = x.filter("n = 1").unionByName(many).filter("c > 0")
    return x.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c")))).select("box.*")
