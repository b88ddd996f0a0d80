"""Interval and nearest-match joins.

Range predicates become equi-joins on (key, level, bin): an interval is binned at the level
whose bin width first reaches its length, so it touches two bins at most however long it is.
The exact predicate is applied after the equi-join, and each pair is produced once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.operators.ordered import carried, lag, last_value, lead, next_value, ordered_blocks, run_max, running, whole_keys

_FACTOR = 8


def _bins(start: Column, end: Column, width: float, own: Column, levels: int) -> Column:
    """(level, bin) pairs from the interval's own level up."""
    def at_level(k: int) -> Column:
        covered = F.sequence(F.floor(start / (width * _FACTOR**k)), F.floor(end / (width * _FACTOR**k)))
        return F.transform(covered, lambda b: F.struct(F.lit(k).alias("lvl"), b.alias("bin")))

    none = F.array().cast("array<struct<lvl:int,bin:bigint>>")
    per_level = [F.when(F.lit(k) >= own, at_level(k)).otherwise(none) for k in range(levels)]
    return F.flatten(F.array(*per_level))


def _level(start: Column, end: Column, width: float, levels: int) -> Column:
    lvl = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        lvl = F.when(end - start <= width * _FACTOR**k, F.lit(k)).otherwise(lvl)
    return lvl


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    key: Sequence[str],
    lspan: tuple[str, str],
    rspan: tuple[str, str],
    *,
    width: float,
    levels: int = 1,
    closed: bool = False,
) -> DataFrame:
    """Inner join of rows of equal key whose spans overlap (half-open; ``closed`` keeps touching spans).

    Span columns must have different names on both sides. Widen a span first to search nearby. ``levels=1`` suits
    spans of about ``width``; more levels (each 8 times wider) keep very long spans from covering many bins.
    """
    key = list(key)

    def binned(df, span, tag):
        s, e = F.col(span[0]), F.greatest(F.col(span[0]), F.col(span[1]))
        if levels == 1:
            df = df.withColumn("_bin", F.explode(F.sequence(F.floor(s / width), F.floor(e / width))))
            return df.withColumns({"_lvl": F.lit(0), f"_own_{tag}": F.lit(0)})
        df = df.withColumn(f"_own_{tag}", _level(s, e, width, levels))
        df = df.withColumn("_p", F.explode(_bins(s, e, width, F.col(f"_own_{tag}"), levels)))
        return df.withColumns({"_lvl": F.col("_p.lvl"), "_bin": F.col("_p.bin")}).drop("_p")

    pairs = binned(left, lspan, "l").join(binned(right, rspan, "r"), [*key, "_lvl", "_bin"])
    w = F.lit(float(width)) * F.pow(F.lit(float(_FACTOR)), F.col("_lvl"))
    ls, le, rs, re = (F.col(c) for c in (*lspan, *rspan))
    once = (F.col("_lvl") == F.greatest("_own_l", "_own_r")) & (F.col("_bin") == F.floor(F.greatest(ls, rs) / w))
    hit = (ls <= re) & (rs <= le) if closed else (ls < re) & (rs < le)
    return pairs.filter(once & hit).drop("_lvl", "_bin", "_own_l", "_own_r")


def point_join(
    points: DataFrame,
    spans: DataFrame,
    key: Sequence[str],
    at: str,
    span: tuple[str, str],
    *,
    width: float,
    levels: int = 1,
) -> DataFrame:
    """Inner join of points with the spans that hold them, both ends included."""
    p = points.withColumn("_at2", F.col(at))
    return overlap_join(p, spans, key, (at, "_at2"), span, width=width, levels=levels, closed=True).drop("_at2")


def asof(
    points: DataFrame,
    anchors: DataFrame,
    key: Sequence[str],
    at: str,
    anchor_at: str,
    *,
    id: str,
    carry: dict[str, str] | None = None,
) -> DataFrame:
    """Nearest anchor at or before (``prev_*``) and at or after (``next_*``) every point.

    One union, one range partitioning, two running values: no pairs are built, and a source of
    any size is spread over blocks. ``carry`` maps output suffixes to anchor columns.
    Ties between anchors at one time are resolved by the smallest ``carry`` struct.
    """
    key = list(key)
    carry = carry or {}
    if one_pass(anchors, key):
        j = asof_edges(points, anchors, key, {"": (at, anchor_at)}, carry=carry)
        names = {"at": "at", **{n: n for n in carry}}
        return j.select(
            *[F.col(c) for c in points.columns],
            *[F.col("_prev").getField(f).alias(f"prev_{n}") for f, n in names.items()],
            *[F.col("_next").getField(f).alias(f"next_{n}") for f, n in names.items()],
        )
    vals = F.struct(F.col(anchor_at).cast("double").alias("at"), *[F.col(c).alias(n) for n, c in carry.items()])
    a = anchors.select(*key, F.col(anchor_at).cast("double").alias("_t"), vals.alias("_a"))
    a = a.groupBy(*key, "_t").agg(F.min("_a").alias("_a"))
    row = F.struct(*[F.col(c) for c in points.columns])
    p = points.select(*key, F.col(at).cast("double").alias("_t"), F.col(id).alias("_id"), row.alias("_row"))
    u = a.withColumn("_k", F.lit(0)).unionByName(p.withColumn("_k", F.lit(1)), allowMissingColumns=True)
    order = ["_t", "_k", "_id"]
    blocked = ordered_blocks(u, key, order)
    runs = {"_prev": last_value("_a"), "_next": next_value("_a")}
    out = carried(blocked, key, order, runs).filter("_k = 1")
    # anchors sort before points of the same time: the exact one is always in `_prev`
    exact = F.col("_prev.at") == F.col("_t")
    out = out.withColumn("_next", F.when(exact, F.col("_prev")).otherwise(F.col("_next")))
    names = {"at": "at", **{n: n for n in carry}}
    return out.select(
        "_row.*",
        *[F.col(f"_prev.{f}").alias(f"prev_{n}") for f, n in names.items()],
        *[F.col(f"_next.{f}").alias(f"next_{n}") for f, n in names.items()],
    )


def one_pass(df: DataFrame, key: Sequence[str]) -> bool:
    """Is the key one whole number whose rows all come from one row of the table read?"""
    return len(key) == 1 and bool(df.schema[key[0]].metadata.get("bounded_key")) and df.schema[key[0]].dataType in (T.LongType(), T.IntegerType())


def asof_edges(points: DataFrame, anchors: DataFrame, key: Sequence[str], edges: dict[str, tuple[str, str]], *, carry: dict[str, str] | None = None) -> DataFrame:
    """:func:`asof` for several times of a point at once, on keys that :func:`one_pass` accepts.

    ``edges``: suffix -> (time of the point, time of the anchor). Adds ``_prev<suffix>`` and ``_next<suffix>``, structs of ``at`` and
    what is carried. Anchors and points are shuffled once, by key; each task goes through its keys in order.
    """
    key, carry = list(key), carry or {}
    of = points.schema
    row = F.struct(*[F.col(c) for c in points.columns])
    a = anchors.select(*key, F.struct(*[F.col(c).alias(n) for n, c in carry.items()]).alias("_a") if carry else F.lit(None).cast("int").alias("_a"), *[F.col(y).cast("double").alias(f"_t{n}") for n, (_, y) in edges.items()])
    p = points.select(*key, *[F.col(x).cast("double").alias(f"_t{n}") for n, (x, _) in edges.items()], row.alias("_row"))
    both = a.unionByName(p, allowMissingColumns=True)
    kept = a.schema["_a"].dataType
    near = T.StructType([T.StructField("at", T.DoubleType()), *(kept.fields if carry else [])])
    schema = T.StructType([*of.fields, *[T.StructField(f"{side}{n}", near) for n in edges for side in ("_prev", "_next")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_keys(batches, key[0]):
            is_point = t["_row"].is_valid().to_numpy()
            group = key_groups(t[key[0]])
            rows = t.filter(pa.array(is_point))["_row"].combine_chunks()
            if not len(rows):
                continue
            held, pg, ag = t["_a"].filter(pa.array(~is_point)), group[is_point], group[~is_point]
            out = rows.flatten()
            for n in edges:
                x = t[f"_t{n}"].to_numpy()
                out += _around(x[is_point], pg, x[~is_point], ag, held if carry else None, near)
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return both.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def key_groups(key: pa.ChunkedArray) -> np.ndarray:
    """Number of every row's key in a table sorted by it."""
    k = key.fill_null(-(1 << 62)).to_numpy()
    return np.cumsum(np.r_[False, k[1:] != k[:-1]])


def count_before(ag: np.ndarray, a: np.ndarray, pg: np.ndarray, p: np.ndarray, *, inclusive: bool) -> np.ndarray:
    """For every (pg, p) the number of (ag, a), which are in order, before it; with ``inclusive`` equal ones count."""
    is_point = np.arange(len(a) + len(p)) >= len(a)
    order = np.lexsort((is_point if inclusive else ~is_point, np.r_[a, p], np.r_[ag, pg]))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(~is_point[order])
    return out[len(a) :]


def _around(p: np.ndarray, pg: np.ndarray, a: np.ndarray, ag: np.ndarray, held: pa.ChunkedArray | None, near: T.StructType) -> list[pa.Array]:
    """The anchors (time ``a`` in group ``ag``) at or before and at or after the points; empty times of anchors are left out."""
    use = np.flatnonzero(~np.isnan(a))
    use = use[np.lexsort((a[use], ag[use]))]
    at, g = a[use], ag[use]
    fresh = np.r_[True, (at[1:] != at[:-1]) | (g[1:] != g[:-1])][: len(at)]
    if held is not None and not fresh.all():
        # of anchors at one time the least of what they carry
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        run = np.cumsum(fresh)
        t = pa.table([pa.array(run[tied]), *held.take(pa.array(use[tied])).combine_chunks().flatten()], names=["_g", *near.names[1:]])
        i = pc.sort_indices(t, sort_keys=[(c, "ascending") for c in t.column_names], null_placement="at_start").to_numpy()
        use[tied] = use[tied][i]
    use, at, g = use[fresh], at[fresh], g[fresh]
    last = count_before(g, at, pg, np.where(np.isnan(p), -np.inf, p), inclusive=True) - 1
    ok = (last >= 0) & (g[np.maximum(last, 0)] == pg) if len(g) else np.zeros(len(p), bool)
    exact = ok & (at[np.maximum(last, 0)] == p) if len(g) else ok
    first = np.where(exact, last, last + 1)
    fits = (first < len(g)) & (g[np.minimum(first, len(g) - 1)] == pg) if len(g) else ok
    out = []
    for i, good in ((last, ok), (first, fits)):
        i = np.where(good, i, 0)
        if not len(g):
            none = [pa.nulls(len(p), pa.float64())] + [pa.nulls(len(p), f.type) for f in (held.type if held is not None else [])]
        else:
            none = [pa.array(at[i], mask=~good)]
            if held is not None:
                none += held.take(pa.array(use[i], mask=~good)).combine_chunks().flatten()
        out.append(pa.StructArray.from_arrays(none, near.names, mask=pa.array(~good)))
    return out


def nearest_within(points, anchors, key, at, anchor_at, tol, *, id, out="snapped", carry=None) -> DataFrame:
    """Nearest anchor within ``tol`` of every point; the earlier one on a tie; null if none."""
    j = asof(points, anchors, key, at, anchor_at, id=id, carry=carry)
    use_prev, use_next = _nearer(F.col(at), F.col("prev_at"), F.col("next_at"), tol)
    cols = {out: F.when(use_prev, F.col("prev_at")).when(use_next, F.col("next_at"))}
    for n in carry or {}:
        cols[f"{out}_{n}"] = F.when(use_prev, F.col(f"prev_{n}")).when(use_next, F.col(f"next_{n}"))
    j = j.withColumns(cols)
    return j.drop("prev_at", "next_at", *[f"{s}_{n}" for n in (carry or {}) for s in ("prev", "next")])


def _nearer(at: Column, prev: Column, following: Column, tol: float) -> tuple[Column, Column]:
    back, fwd = at - prev, following - at
    return (back <= tol) & (fwd.isNull() | (back <= fwd)), fwd <= tol


def nearest_edges(points: DataFrame, anchors: DataFrame, key, edges: dict[str, tuple[str, str]], tol: float, *, id: str) -> DataFrame:
    """:func:`nearest_within` for several times of a point: ``edges`` maps output -> (time of the point, time of the anchor)."""
    if not one_pass(anchors, key):
        for out, (at, anchor_at) in edges.items():
            points = nearest_within(points, anchors, key, at, anchor_at, tol, id=id, out=out)
        return points
    j = asof_edges(points, anchors, key, edges)
    cols = {}
    for out, (at, _) in edges.items():
        prev, following = F.col(f"_prev{out}.at"), F.col(f"_next{out}.at")
        use_prev, use_next = _nearer(F.col(at), prev, following, tol)
        cols[out] = F.when(use_prev, prev).when(use_next, following)
    return j.withColumns(cols).select(*points.columns, *edges)


def gaps_between(spans: DataFrame, key, start, end, *, id, duration: DataFrame | None = None, eps: float = 0.001) -> DataFrame:
    """Complement of possibly overlapping spans, with the head; with the tail when ``duration`` is given.

    Output ``gap_start, gap_end``. ``duration`` holds one ``duration`` per key.
    """
    key = list(key)
    b = ordered_blocks(spans.select(*key, start, end, id), key, [start, id])
    r = carried(b, key, [start, id], {"_seen": run_max(end, inclusive=False)})
    seen = F.coalesce(F.col("_seen"), F.lit(0.0))
    inner = r.filter(F.col(start) > seen + eps).select(*key, seen.alias("gap_start"), F.col(start).alias("gap_end"))
    if duration is None:
        return inner
    last = b.groupBy(*key).agg(F.max(end).alias("_e"))
    tail = duration.filter("duration > 0").join(last, key, "left").select(
        *key, F.greatest(F.coalesce("_e", F.lit(0.0)), F.lit(0.0)).alias("gap_start"), F.col("duration").alias("gap_end")
    )
    return inner.unionByName(tail.filter(F.col("gap_start") < F.col("gap_end") - eps))


def subtract_pairs(cuts: DataFrame, pairs: DataFrame, ids, cut, hole, *, min_len=0.05) -> DataFrame:
    """Pieces of every cut outside the holes paired with it (``ids`` + cut + hole columns).

    Pieces of at most ``min_len`` are dropped. Output: ``ids, piece_start, piece_end``.
    """
    ids = list(ids)
    cs, ce = cut
    hs, he = hole
    holes = pairs.select(*ids, cs, ce, F.greatest(hs, cs).alias("_hs"), F.least(he, ce).alias("_he"))
    # the end of a cut acts as one last empty hole
    stop = cuts.select(*ids, cs, ce, F.col(ce).alias("_hs"), F.col(ce).alias("_he"))
    rows = holes.unionByName(stop).groupBy(*ids, cs, ce, "_hs").agg(F.max("_he").alias("_he"))
    out = running(rows, ids, ["_hs"], {"_seen": run_max("_he", inclusive=False)})
    begin = F.greatest(F.col("_seen"), F.col(cs))
    out = out.select(*ids, begin.alias("piece_start"), F.col("_hs").alias("piece_end"))
    return out.filter(F.round(F.col("piece_end") - F.col("piece_start"), 9) > min_len)


def subtract_spans(cuts: DataFrame, holes: DataFrame, key, cut_id, cut, hole, *, width, min_len=0.05) -> DataFrame:
    """Pieces of every cut outside all holes of its source."""
    ids = [*key, *cut_id]
    pairs = overlap_join(cuts.select(*ids, *cut), holes.select(*key, *hole), key, cut, hole, width=width)
    return subtract_pairs(cuts, pairs, ids, cut, hole, min_len=min_len)


def words_text(words: DataFrame, spans: DataFrame, ids, span, *, mode: str = "start", width: float = 16.0, label: str | None = None) -> DataFrame:
    """Text of the words of every span, in order.

    ``mode``: ``inside`` (whole word), ``start`` (starts inside) or ``overlap``. With ``label``, a span without
    whole words falls back to overlapping words, then to its label.
    """
    ids = list(ids)
    s, e = span
    keep = {
        "inside": (F.col("start") >= F.col(s)) & (F.col("end") <= F.col(e)),
        "start": (F.col("start") >= F.col(s)) & (F.col("start") < F.col(e)),
        "overlap": (F.col("start") < F.col(e)) & (F.col("end") > F.col(s)),
    }
    j = overlap_join(words.select("source_id", "pos", "word", "start", "end"), spans.select(*ids, s, e), ["source_id"], ("start", "end"), span, width=width, closed=True)

    def text(cond):
        got = F.sort_array(F.collect_list(F.when(cond, F.struct("pos", "word"))))
        return F.array_join(F.transform(got, lambda x: x["word"]), " ")

    if label is None:
        t = j.groupBy(*ids).agg(text(keep[mode]).alias("text"))
        return spans.join(t, ids, "left").withColumn("text", F.coalesce("text", F.lit("")))
    t = j.groupBy(*ids).agg(text(keep["inside"]).alias("_in"), text(keep["overlap"]).alias("_ov"))
    out = spans.join(t, ids, "left")
    return out.withColumn(
        "text", F.coalesce(F.when(F.col("_in") != "", F.col("_in")), F.when(F.col("_ov") != "", F.col("_ov")), F.col(label))
    ).drop("_in", "_ov")


def evidence_near(moments: DataFrame, evidence: DataFrame, *, window: float, fallback: float, min_n: int, hard_min: int = 2, width: float) -> DataFrame:
    """(moment, evidence) pairs within ``window``; within ``fallback`` for moments with fewer than ``min_n``.

    One join on the wider window serves both; moments that stay below ``hard_min`` are dropped.
    ``moments``: source_id, moment_id, m_start, m_end.
    """
    far = max(window, fallback)
    m = moments.withColumns({"_ws": F.greatest(F.lit(0.0), F.col("m_start") - far), "_we": F.col("m_end") + far})
    j = overlap_join(m, evidence, ["source_id"], ("_ws", "_we"), ("start", "end"), width=width, levels=3)
    near = (F.col("start") < F.col("m_end") + window) & (F.col("end") > F.greatest(F.lit(0.0), F.col("m_start") - window))
    j = j.withColumn("_near", near)
    n = j.groupBy("source_id", "moment_id").agg(F.count(F.when(F.col("_near"), 1)).alias("_n"), F.count(F.lit(1)).alias("_all"))
    n = n.withColumn("_wide", F.col("_n") < min_n).filter(F.when(F.col("_wide"), F.col("_all")).otherwise(F.col("_n")) >= hard_min)
    out = j.join(n, ["source_id", "moment_id"]).filter(F.col("_wide") | F.col("_near"))
    return out.withColumn("used_window", F.when(F.col("_wide"), F.lit(far)).otherwise(F.lit(float(window)))).drop("_ws", "_we", "_near", "_n", "_all", "_wide")


def best_overlap(left: DataFrame, right: DataFrame, ids, lspan, rspan, *, take: dict[str, str], rid: str, width: float, min_ratio: float = 0.0) -> DataFrame:
    """For every left span the right row with the largest overlap share; null below ``min_ratio``."""
    ids = list(ids)
    vals = F.struct(*[F.col(c).alias(n) for n, c in take.items()])
    r = right.select("source_id", F.col(rspan[0]).alias("_rs"), F.col(rspan[1]).alias("_re"), F.col(rid).alias("_rid"), vals.alias("_vals"))
    j = overlap_join(left.select(*ids, *lspan), r, ["source_id"], lspan, ("_rs", "_re"), width=width, levels=3)
    inter = F.least(F.col(lspan[1]), F.col("_re")) - F.greatest(F.col(lspan[0]), F.col("_rs"))
    ratio = F.round(inter / F.greatest(F.lit(0.001), F.col(lspan[1]) - F.col(lspan[0])), 9)
    j = j.withColumn("_ratio", ratio).filter((F.col("_ratio") >= min_ratio) & (F.col("_ratio") > 0))
    b = j.groupBy(*ids).agg(F.max_by("_vals", F.struct("_ratio", (-F.col("_rid")).alias("_t"))).alias("_vals"), F.max("_ratio").alias("overlap"))
    return left.join(b, ids, "left").select(*left.columns, "overlap", *[F.col(f"_vals.{n}").alias(n) for n in take])


def parent_by_midpoint(children: DataFrame, parents: DataFrame, ids, cspan, pspan, *, idx: str, take: str, default, eps: float = 0.05, width: float) -> DataFrame:
    """Child takes ``take`` from the first parent (by ``idx``) that holds its midpoint."""
    ids = list(ids)
    c = children.withColumn("_mid", (F.col(cspan[0]) + F.col(cspan[1])) / 2)
    p = parents.select("source_id", (F.col(pspan[0]) - eps).alias("_ps"), (F.col(pspan[1]) + eps).alias("_pe"), F.col(idx).alias("_idx"), F.col(take).alias("_take"))
    j = point_join(c.select(*ids, "_mid"), p, ["source_id"], "_mid", ("_ps", "_pe"), width=width, levels=3)
    b = j.groupBy(*ids).agg(F.min_by("_take", "_idx").alias(take))
    return children.join(b, ids, "left").withColumn(take, F.coalesce(take, F.lit(default)))


def interpolate_at(points: DataFrame, series: DataFrame, at: str, t: str, value: str, *, id: str, out: str = "value_at") -> DataFrame:
    """Value at a point from the samples on both sides, empty samples included.

    Both filled: linear interpolation; one filled: that one; none: the nearest filled sample at most two away
    from the sample before the point (the first sample when there is none), earlier ones first; else null. Samples of
    one time stand by their values, empty ones first.
    """
    order = ["_at", "_val"]
    s = ordered_blocks(series.select("source_id", F.col(t).alias("_at"), F.col(value).alias("_val")), ["source_id"], order)
    s = carried(s, ["source_id"], order, {"_b1": lag("_val"), "_a1": lead("_val")})
    s = carried(s, ["source_id"], order, {"_b2": lag("_b1"), "_a2": lead("_a1")})
    s = s.select("source_id", "_at", "_val", F.coalesce("_b1", "_a1", "_b2", "_a2").alias("_near"))
    j = asof(points, s, ["source_id"], at, "_at", id=id, carry={"val": "_val", "near": "_near"})
    span = F.col("next_at") - F.col("prev_at")
    lin = F.col("prev_val") + (F.col("next_val") - F.col("prev_val")) * (F.col(at) - F.col("prev_at")) / span
    both = F.col("prev_val").isNotNull() & F.col("next_val").isNotNull() & (span > 0)
    near = F.when(F.col("prev_at").isNotNull(), F.col("prev_near")).otherwise(F.col("next_near"))
    v = F.when(both, lin).otherwise(F.coalesce("prev_val", "next_val", near))
    return j.withColumn(out, v).drop("prev_at", "next_at", "prev_val", "next_val", "prev_near", "next_near")


def exclude_overlapping(items: DataFrame, occupied: DataFrame, ids, span, ospan, *, gap: float, width: float) -> DataFrame:
    """Items at least ``gap`` seconds away from every occupied span of their source."""
    ids = list(ids)
    o = occupied.select("source_id", (F.col(ospan[0]) - gap).alias("_os"), (F.col(ospan[1]) + gap).alias("_oe"))
    hit = overlap_join(items.select(*ids, *span), o, ["source_id"], span, ("_os", "_oe"), width=width, levels=3).select(*ids).distinct()
    return items.join(hit, ids, "left_anti")


def extend_near_markers(spans: DataFrame, markers: DataFrame, ids, span, *, near: float = 0.2, width: float) -> DataFrame:
    """Spans whose end lies within ``near`` of a marker (m_t, m_hold) grow by the largest hold."""
    ids = list(ids)
    m = markers.select("source_id", (F.col("m_t") - near).alias("_ms"), (F.col("m_t") + near).alias("_me"), "m_t", "m_hold")
    j = point_join(spans.select(*ids, F.col(span[1]).alias("_e")), m, ["source_id"], "_e", ("_ms", "_me"), width=width)
    j = j.filter(F.round(F.abs(F.col("m_t") - F.col("_e")), 9) < near).groupBy(*ids).agg(F.max("m_hold").alias("_hold"))
    return spans.join(j, ids, "left").withColumn(span[1], F.col(span[1]) + F.coalesce("_hold", F.lit(0.0))).drop("_hold")
