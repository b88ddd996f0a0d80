"""Session helpers: builder defaults and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_fallback_dir: str | None = None


def local_session(cpus: str | int = "*", memory: str = "16g") -> SparkSession:
    """Session for tests and the bench; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cadenza")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def durable_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster's ``spark.checkpoint.dir`` wins. Only where a session names none and runs in one process does it get a
    folder of its own beside the warehouse, removed at exit; a cluster without the setting is an error.
    """
    global _fallback_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _fallback_dir is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
        _fallback_dir = os.path.join(warehouse, f"_tables-{os.getpid()}")
        atexit.register(shutil.rmtree, _fallback_dir, ignore_errors=True)
    return _fallback_dir


# Files that a finished execution shuffled are removed at once, not when the driver happens to collect its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is planned inside, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives executor loss, and freezes values that would differ on
    re-evaluation (range partition ids). Reading back also gives Catalyst true sizes, so a
    broadcast is chosen only for a side whose size is known. What the write shuffled is removed when it ends.
    ``batch_rows``: rows of an Arrow batch, for rows that carry texts.
    """
    spark = df.sparkSession
    path = os.path.join(durable_dir(spark), f"cadenza-{uuid.uuid4().hex}")
    with settings(spark, TIDY | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)} if batch_rows else {})):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, column: str, *spread: str) -> DataFrame:
    """:func:`materialize` with one folder per value of ``column``: a filter on it reads those folders only. ``spread`` deals a value to several tasks."""
    spark = df.sparkSession
    path = os.path.join(durable_dir(spark), f"cadenza-{uuid.uuid4().hex}")
    with settings(spark, TIDY):
        df.repartition(column, *spread).write.option("compression", "zstd").partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def release(df: DataFrame) -> None:
    """Remove the folder of a table that :func:`materialize` wrote and nothing reads any more."""
    spark = df.sparkSession
    home = durable_dir(spark).rstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cadenza-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{folder.rsplit('/', 1)[1]}")
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
