"""Geometry scores over relative coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def center_score(x: Column, y: Column) -> Column:
    """1 in the middle of the frame, 0 in a corner."""
    d = F.sqrt(F.pow(x - 0.5, F.lit(2)) + F.pow(y - 0.5, F.lit(2)))
    return F.greatest(F.lit(0.0), 1 - d / math.sqrt(0.5))


def region9(x: Column, y: Column) -> Column:
    """Ninth of the frame a centre lies in, as row-column."""
    col = F.when(x < 1 / 3, "left").when(x < 2 / 3, "center").otherwise("right")
    row = F.when(y < 1 / 3, "top").when(y < 2 / 3, "middle").otherwise("bottom")
    return F.concat_ws("-", row, col)


def even_grid(start: Column, end: Column, n: int) -> Column:
    """``n`` evenly spaced times strictly inside a span."""
    step = (end - start) / (n + 1)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: start + i * step)


# Shortest, usual and longest shot of the pacing profiles, in seconds.
SHOTS = {"dynamic": (1.2, 1.8, 4.0), "balanced": (1.5, 2.5, 5.0), "mkbhd_clean": (1.8, 2.8, 5.5), "documentary": (2.5, 3.5, 8.0)}


def shot_duration(energy: Column, profile: Column) -> Column:
    """Target length of a shot: calm passages get longer shots, peaks nearly the shortest; unknown profiles count as balanced.

    Below .3: 1.4 times the usual length; below .6: the usual one; below .8: .72 of it; else the shortest plus .1. To two digits,
    within the profile's limits.
    """
    e = F.greatest(F.lit(0.0), F.least(F.lit(1.0), energy))

    def of(low: float, usual: float, high: float) -> Column:
        target = F.when(e < 0.3, round(usual * 1.4, 2)).when(e < 0.6, round(usual, 2)).when(e < 0.8, round(usual * 0.72, 2)).otherwise(round(low + 0.1, 2))
        return F.greatest(F.lit(low), F.least(F.lit(high), target))

    out = of(*SHOTS["balanced"])
    for name, limits in SHOTS.items():
        out = F.when(profile == name, of(*limits)).otherwise(out)
    return out
