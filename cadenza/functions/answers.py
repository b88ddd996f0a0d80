"""Answers of vision models as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_answer(text: Column) -> tuple[Column, Column]:
    """(yes / no / unknown, confidence) from the first word of an answer."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    yes, no = t.rlike(r"^yes\b"), t.rlike(r"^no\b")
    return F.when(yes, "yes").when(no, "no").otherwise("unknown"), F.when(yes | no, F.lit(0.9)).otherwise(F.lit(0.3))
