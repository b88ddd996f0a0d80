"""Text spans in code points: rendering, digests, overlaps, redaction."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Sequence
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

Span = tuple[str, int, int]


def render(spans: Iterable[Span], kinds: Sequence[str]) -> str:
    """``kind:start:end`` by start, then kind in the given order, then end; comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank.get(s[0], len(rank)), s[2])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def parse(text: str) -> list[Span]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in text.split(",") if x)]


def count_kind(rendered: str, kind: str) -> Column:
    """Number of spans of one kind in a rendered column. A second lambda parameter would be the element's index."""
    return F.size(F.filter(F.split(rendered, ","), lambda x: x.startswith(f"{kind}:"))).cast("long")


class Cover:
    """Answers whether a range meets one of the spans, in logarithmic time."""

    def __init__(self, spans: Iterable[Span] = ()):
        at = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in at]
        self.reach = list(accumulate((b for _, b in at), max))

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)  # spans that start before b
        return i > 0 and self.reach[i - 1] > a


def add_best(base: list[Span], more: Iterable[tuple[float, Span]]) -> list[Span]:
    """Base spans, and of the others, best score first, those that overlap nothing taken so far."""
    cover, taken = Cover(base), []
    for _, s in sorted(more, key=lambda x: (-x[0], x[1][1], x[1][2], x[1][0])):
        i = bisect_left(taken, (s[1], s[2], s[0]))
        free = (i == 0 or taken[i - 1][1] <= s[1]) and (i == len(taken) or taken[i][0] >= s[2])
        if free and not cover.meets(s[1], s[2]):
            taken.insert(i, (s[1], s[2], s[0]))
    return [*base, *((k, a, b) for a, b, k in taken)]


def redact(text: str | None, spans: Iterable[Span]) -> str | None:
    """Every span becomes its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    out, last = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{k.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])
