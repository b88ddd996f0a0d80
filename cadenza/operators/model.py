"""User functions over rows in batches; a failing batch becomes rows with a reason, never a failed job."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.session import materialize


def map_model(
    df: DataFrame, fn: Callable[[list], list], inputs: Sequence[str], out: str, out_type: T.DataType, *, batch: int = 90, placeholder: str = "(empty)", concurrency: int | None = None
) -> DataFrame:
    """Add ``out`` and ``failure_reason``: ``fn`` gets up to ``batch`` inputs and returns as many results.

    One input column is passed as values, several as tuples. Empty texts are sent as ``placeholder``. A wrong number of
    results or an exception gives nulls and a reason. ``concurrency`` bounds the parallel calls through the partition count.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, out_type), T.StructField("failure_reason", T.StringType())])
    src = df.repartition(concurrency) if concurrency else df
    cols = list(inputs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch].copy()
                if len(cols) == 1:
                    vals = [placeholder if v is None or (isinstance(v, str) and not v.strip()) else v for v in part[cols[0]]]
                else:
                    vals = list(part[cols].itertuples(index=False, name=None))
                reason = None
                try:
                    got = list(fn(vals))
                    if len(got) != len(vals):
                        got, reason = [None] * len(vals), "length_mismatch"
                except Exception as exc:
                    got, reason = [None] * len(vals), f"{type(exc).__name__}: {exc}"[:200]
                part[out] = pd.Series(got, index=part.index, dtype=object)
                part["failure_reason"] = reason
                yield part

    return src.mapInPandas(run, schema)


def map_model_waves(
    chunks: DataFrame, first: Callable[[DataFrame], DataFrame], coverage: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], key: Sequence[str]
) -> DataFrame:
    """Two waves: the second sees what the first covered (``coverage`` columns joined on ``key``)."""
    one = materialize(first(chunks))
    two = second(chunks.join(coverage(one), list(key), "left"))
    return one.withColumn("wave", F.lit(1)).unionByName(two.withColumn("wave", F.lit(2)), allowMissingColumns=True)


def ensemble(df: DataFrame, parameters: Sequence[float], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` on every row with every parameter: columns ``judge`` (from 1) and ``parameter``."""
    p = F.array(*[F.struct(F.lit(i + 1).alias("judge"), F.lit(float(v)).alias("parameter")) for i, v in enumerate(parameters)])
    return run(df.withColumn("_p", F.explode(p)).select(*df.columns, "_p.judge", "_p.parameter"))


def improve_loop(df: DataFrame, run: Callable[[DataFrame, int], DataFrame], id: str, score: str, *, threshold: float, rounds: int = 2) -> DataFrame:
    """Re-run rows below ``threshold`` up to ``rounds`` times; each row keeps its best result.

    ``run(rows, round)`` returns the same columns with a new score. Only unfinished rows are worked on.
    """
    best = materialize(run(df, 0))
    for r in range(1, rounds + 1):
        todo = best.filter(F.col(score) < threshold)
        if todo.isEmpty():
            break
        again = run(df.join(todo.select(id), id, "left_semi"), r)
        both = best.withColumn("_r", F.lit(0)).unionByName(again.withColumn("_r", F.lit(1)))
        cols = [c for c in best.columns if c != id]
        pick = F.max_by(F.struct(*cols), F.struct(F.col(score), (-F.col("_r")).alias("t")))
        best = materialize(both.groupBy(id).agg(pick.alias("_b")).select(id, "_b.*").select(*best.columns))
    return best
