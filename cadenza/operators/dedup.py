"""Deduplication by value, time and similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_content_hash(df: DataFrame, content: str, id: str) -> DataFrame:
    """Every row with the first id of its exact content; only digests are shuffled."""
    h = df.select(id, F.sha2(F.col(content), 256).alias("_h"))
    first = h.groupBy("_h").agg(F.min(id).alias("kept_id"))
    return h.join(first, "_h").select(id, "kept_id")


def _overlap_words(a: frozenset, b: frozenset) -> float:
    if not a or not b:
        return 0.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def dedup_hybrid(
    ev: DataFrame,
    *,
    window: float = 3.0,
    keepers: int = 5,
    min_cos: float = 0.80,
    vec: str | None = None,
    key: Sequence[str] = ("source_id",),
) -> DataFrame:
    """Same thought within seconds: a row near one of the last keepers is dropped, or replaces it when stronger.

    Rows come by start, stronger first. With vectors on both sides: cosine >= ``min_cos`` or word Jaccard >= .7;
    without: Jaccard >= .5. Only keepers within ``window`` matter, so a gap of that length resets the rule.
    """
    from cadenza.operators.fold import fold_ordered

    cols = ["start", "strength", "text", "id"] + ([vec] if vec else [])
    e = ev.withColumn("_neg", -F.col("strength"))
    names = [*key, *cols]
    k = len(key)

    def alike(a, b):
        if vec and a[3] is not None and b[3] is not None and len(a[3]) == len(b[3]):
            dot = sum(x * y for x, y in zip(a[3], b[3]))
            na, nb = sum(x * x for x in a[3]) ** 0.5, sum(x * x for x in b[3]) ** 0.5
            if na * nb > 1e-9 and dot / (na * nb) >= min_cos:
                return True
            return _overlap_words(a[2], b[2]) >= 0.7
        return _overlap_words(a[2], b[2]) >= 0.5

    def step(state, row):
        start, strength, text, rid = row[k : k + 4]
        item = (start, strength, frozenset((text or "").lower().split()), row[k + 4] if vec else None, row[:k], rid)
        for i, kept in enumerate(state):
            if abs(kept[0] - start) < window and alike(kept, item):
                if strength > kept[1]:
                    state[i] = item
                return []
        state.append(item)
        if len(state) > keepers:
            old = state.pop(0)
            return [(*old[4], old[5])]
        return []

    def finish(state):
        return [(*s[4], s[5]) for s in state]

    key_types = ", ".join(f"{c} {ev.schema[c].dataType.simpleString()}" for c in [*key, "id"])
    kept = fold_ordered(
        e, key, ["start", "_neg", "id"], cols=names,
        lookback={"_ps": F.col("start")}, resets=lambda d: F.round(F.col("start") - F.col("_ps"), 9) >= 2 * window,
        init=list, step=step, finish=finish, schema=key_types,
    )
    return ev.join(kept, [*key, "id"], "left_semi")
