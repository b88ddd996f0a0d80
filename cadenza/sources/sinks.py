"""Sinks: stage products, run statistics, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, *, key: str = "source_id", buckets: int = 64) -> None:
    """Stage table in folders by key hash: few folders however many keys there are.

    Rows are spread by key hash and a salt, so a key with very many rows is written by several tasks.
    """
    b = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    # rebalancing splits oversized buckets at run time
    b.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_stage(spark, path: str, *, key_value=None, key_type: str = "bigint", buckets: int = 64) -> DataFrame:
    """Stage table; with ``key_value`` only its folder is read."""
    t = spark.read.parquet(path)
    if key_value is not None:
        k = F.lit(key_value).cast(key_type)
        t = t.filter(F.col("bucket") == F.pmod(F.xxhash64(k), F.lit(buckets)).cast("int")).filter(F.col("source_id") == k)
    return t.drop("bucket")


def write_run_stats(df: DataFrame, path: str, run_id: str, key: str = "source_id", score: str = "score") -> None:
    """Append one summary row per source and run."""
    s = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.min(score).alias("min_score"))
    s.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def export_selected(items: DataFrame, chosen: DataFrame, path: str, key=("source_id", "id")) -> int:
    """Write the chosen rows that belong to their source; an empty result is an error. Returns the row count."""
    out = items.join(chosen.select(*key).distinct(), list(key), "left_semi")
    out.write.mode("overwrite").parquet(path)
    n = items.sparkSession.read.schema(out.schema).parquet(path).count()
    if n == 0:
        raise ValueError("none of the chosen ids belongs to its source")
    return n
