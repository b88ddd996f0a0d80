"""Operators on plans (ordered groups of segments) and on parent/child tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.series import truncate_running


def plan_length_gate(segs: DataFrame, key, order, start: str, end: str, *, low: float, high: float, min_piece=0.25) -> DataFrame:
    """Plans whose valid segments reach ``low`` seconds, cut back to ``high``."""
    d = F.least(F.col(end) - F.col(start), F.lit(float(high)))
    valid = segs.filter(F.round(F.col(end) - F.col(start), 9) >= min_piece)
    long_enough = valid.groupBy(*key).agg(F.sum(d).alias("_t")).filter(F.col("_t") >= low).select(*key)
    return truncate_running(valid.join(long_enough, list(key), "left_semi"), key, order, start, end, limit=high, min_piece=min_piece)


def with_children(parents: DataFrame, children: DataFrame, key: str, aggs: dict[str, Column]) -> DataFrame:
    """Left join of aggregated children: they are reduced before the join, so a parent with very many stays one row."""
    return parents.join(children.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()]), key, "left")


def with_references(rows: DataFrame, table: DataFrame, id: str, refs: dict[str, str], cols: Sequence[str]) -> DataFrame:
    """Left join of one table under several names: ``refs`` maps a name to the column of ``rows`` that refers to it.

    Adds a struct of ``cols`` per name, null where nothing is referred to or found. The table is read once: each name takes the
    rows that are referred to by it.
    """
    wanted = table.select(F.col(id).alias("_id"), F.struct(*cols).alias("_row"))
    for name, column in refs.items():
        rows = rows.join(wanted.toDF("_rid", name), F.col(column) == F.col("_rid"), "left").drop("_rid")
    return rows


def task_grid(rows: DataFrame, **axes: Sequence) -> DataFrame:
    """Every row with every combination of the given fixed axes."""
    for name, values in axes.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return rows
