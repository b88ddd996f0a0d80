"""Vector expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _cosine(a: Column, b: Column, missing: float) -> Column:
    den = norm(a) * norm(b)
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(missing)).when(den <= 1e-9, F.lit(missing)).otherwise(dot(a, b) / den)


def cosine(a: Column, b: Column) -> Column:
    """Cosine for retrieval: a missing vector resembles nothing (0)."""
    return _cosine(a, b, 0.0)


def cosine_continuity(a: Column, b: Column) -> Column:
    """Cosine for segmentation: a missing vector is no reason for a cut (1)."""
    return _cosine(a, b, 1.0)


def centroid(df: DataFrame, key: list[str], vec: str, out: str = "centroid", dim: int | None = None) -> DataFrame:
    """Element-wise mean per key with map-side partial sums; null when its norm is below 1e-9.

    Vectors of another length than ``dim`` (default: the key's largest) are skipped.
    """
    v = df.filter(F.col(vec).isNotNull() & (F.size(vec) > 0))
    if dim is None:
        longest = v.groupBy(*key).agg(F.max(F.size(vec)).alias("_d"))
        v = v.join(longest, key).filter(F.size(vec) == F.col("_d"))
    else:
        v = v.filter(F.size(vec) == dim)
    cells = v.select(*key, F.posexplode(vec).alias("_i", "_x"))
    means = cells.groupBy(*key, "_i").agg(F.avg("_x").alias("_m"))
    arr = F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"])
    out_df = means.groupBy(*key).agg(arr.alias(out))
    return out_df.withColumn(out, F.when(norm(F.col(out)) >= 1e-9, F.col(out)))
