"""Personal data: base patterns, and further spans that boosted trees select from high-recall candidates.

Generators propose number-like and address-like spans of loose form; they overlap each other. Trees see their format
(digits, groups, separators, checks) and context (neighbouring characters, cue words), not the pattern that made a base
span, so they can recognise the same data written another way. They learn from base spans (stripped of their marker), from bare
numbers without a cue, and from base spans damaged so that they break their check; other candidates are left unlabelled. A threshold per
kind is the lowest score at which held-out precision reaches the goal; a kind that never reaches it adds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import boxed
from cadenza.llm.spans import Cover, Span, add_best, count_kind, parse, redact, render
from cadenza.session import materialize

KINDS = ("email", "ip", "card", "phone")
GOAL = 0.97  # held-out precision asked of added spans
LEAST_HELD = 30  # held-out candidates above a threshold before it counts

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the look-behind only skips starts inside a run of digits, which fail or match like the run's own start
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_NUMBER = re.compile(r"(?<![0-9A-Za-z])[(]?[0-9](?:[ ().-]{0,2}[0-9]){6,24}(?![0-9A-Za-z])")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[.·] ?[0-9]{1,3}){3}(?![0-9])")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\bdot\b|\.) ?[A-Za-z0-9-]{1,63}){1,4}")
# fixed values: cue words of the data that a span may hold
CUES = ("mail", "contact", "write", "reach", "tel", "phone", "call", "fax", "mobile", "card", "visa", "credit", "account", " ip ", "host", "server", "address", "version")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > last and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append(("email", a, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            d = "".join(filter(str.isdigit, m[0]))
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def features(kind: str, body: str, before: str, after: str) -> list[float]:
    """Format and context of a candidate, without the marks that make it a base span."""
    d = "".join(c for c in body if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", body)
    size = [len(g) for g in groups] or [0]
    low = before.lower()
    cue = [float(c in low) for c in CUES]
    return [
        float(KINDS.index(kind)), float(len(body)), float(len(d)), float(len(groups)), float(max(size)), float(min(size)), float(body.count(" ")), float(body.count("-")),
        float(body.count(".")), float(body.count("(")), float(bool(d) and luhn(d)), float(bool(groups) and max(size) < 4 and all(int(g) <= 255 for g in groups)),
        float(sum(c.isalpha() for c in body)), float(len(set(d))), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "+#/=:"),
        float(sum("0" <= c <= "9" for c in before + after)), float(before[-1:] == " "), float(body[-4:-3] == "." or body[-3:-2] == "."), *cue,
    ]


def _core(span: Span, text: str) -> tuple[int, int]:
    """A base span without its marker: the plus of a phone number."""
    return (span[1] + (span[0] == "phone"), span[2])


def proposals(text: str) -> list[Span]:
    out: list[Span] = []
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            out.append(("ip", *m.span()))
        for m in _NUMBER.finditer(text):
            n = sum(map(str.isdigit, m[0]))
            if n >= 12:
                out.append(("card", *m.span()))
            if n <= 15:
                out.append(("phone", *m.span()))
    if " at " in text or "at)" in text or "at]" in text:
        out += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    return out


def _damaged(kind: str, body: str) -> str | None:
    """A span that looks alike and breaks its check."""
    if kind == "card":
        return body[:-1] + str((int(body[-1]) + 1) % 10)
    if kind == "ip":
        p = body.split(".")
        return ".".join([str(int(p[0][-2:]) + 300), *p[1:]])
    if kind == "phone":
        return body[: len(body) // 2]
    return body.replace("@", " ").replace(".", " ")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("add", pa.bool_()), ("x", pa.list_(pa.float64()))])
    for b in batches:
        base, cands = [], []
        for v in b.column("_text"):
            t = v.as_py() or ""
            spans = base_spans(t)
            mine = []
            for s in spans:
                a, e = _core(s, t)
                body, near = t[a:e], (t[max(0, a - 40) : a].removesuffix("+"), t[e : e + 20])
                mine.append({"kind": s[0], "start": a, "end": e, "label": 1, "add": False, "x": features(s[0], body, *near)})
                bad = _damaged(s[0], body)
                if bad:
                    mine.append({"kind": s[0], "start": a, "end": e, "label": 0, "add": False, "x": features(s[0], bad, *near)})
            cover = Cover(spans)
            for k, a, e in proposals(t):
                if not cover.meets(a, e):
                    # bare digits without a cue are nobody's; what looks better is left open
                    bare = t[a:e].isdigit() and not any(c in t[max(0, a - 40) : a].lower() for c in CUES)
                    mine.append({"kind": k, "start": a, "end": e, "label": 0 if bare else -1, "add": True, "x": features(k, t[a:e], t[max(0, a - 40) : a], t[e : e + 20])})
            base.append(render(spans, KINDS))
            cands.append(mine)
        yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_row"), pa.array(base), pa.array(cands, pa.list_(item))], ["_key", "_row", "base", "cands"])


def fit(flat: DataFrame, seed: int = 11):
    """(model, {kind: threshold}), from all labelled candidates; model is None when they have one label only.

    Two thirds of the rows, by hash, fit the trees; the others set the thresholds. Candidates that look the same are one, with their number as weight.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    flat = flat.filter("label >= 0").withColumn("held", F.pmod(F.xxhash64("_row", F.lit(seed + 1)), F.lit(3)) == 0)
    same = materialize(flat.groupBy("held", "kind", "label", "x").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    same = same.withColumn("features", array_to_vector("x"))
    train, held = same.filter("not held"), same.filter("held")
    if train.select("label").distinct().count() < 2:
        return None, {}
    model = GBTClassifier(labelCol="label", weightCol="weight", maxDepth=4, maxIter=12, stepSize=0.3, seed=seed, maxBins=32).fit(train.select("label", "weight", "features"))
    bins = model.transform(held).select("kind", "label", "weight", F.floor(vector_to_array("probability")[1] * 200).cast("int").alias("bin"))
    bins = bins.groupBy("kind", "bin").agg(F.sum(F.col("label") * F.col("weight")).cast("long").alias("pos"), F.sum("weight").cast("long").alias("n"))
    by: dict[str, list[tuple[int, int, int]]] = {}
    for r in bins.collect():  # at most four kinds of 201 bins
        by.setdefault(r["kind"], []).append((r["bin"], r["pos"], r["n"]))
    cut = {}
    for kind, rows in by.items():
        pos = n_above = 0
        rows = sorted(rows, reverse=True)
        for i, (b, p, m) in enumerate(rows):
            pos, n_above = pos + p, n_above + m
            if n_above >= LEAST_HELD and pos / n_above >= GOAL:
                # half way to the next lower score that was seen: scores between were never seen wrong
                lower = rows[i + 1][0] if i + 1 < len(rows) else 0
                cut[kind] = max(0.5, (b + lower) / 400)
    return model, cut


def find(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans) with one row per input row: base spans, and all spans, as text; other columns are not read.

    Null texts count as empty, texts without spans get empty strings. Added spans never overlap base ones or each
    other. Rows that repeat are scanned separately. An empty table gives an empty table.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    scanned = materialize(rows.mapInArrow(_scan, f"_key {kind}, _row long, base string, cands array<struct<kind:string,start:int,end:int,label:int,add:boolean,x:array<double>>>"))
    flat = scanned.select("_row", F.explode("cands").alias("c")).select("_row", "c.*")
    model, cut = fit(flat)
    if not cut:
        return scanned.select(F.col("_key").alias(key), "base", F.col("base").alias("spans"))
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(cut.items()) for x in kv]), F.col("kind")), F.lit(2.0))
    scored = model.transform(flat.filter("add").withColumn("features", array_to_vector("x"))).withColumn("p", vector_to_array("probability")[1])
    more = scored.filter(F.col("p") >= limit).groupBy("_row").agg(F.collect_list(F.struct("p", "kind", "start", "end")).alias("more"))

    @F.udf("string")
    def merged(base, extra):
        return render(add_best(parse(base), [(m["p"], (m["kind"], m["start"], m["end"])) for m in extra or ()]), KINDS)

    out = scanned.select("_key", "_row", "base").join(more, "_row", "left")
    return out.select(F.col("_key").alias(key), "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(merged("base", "more")).alias("spans"))


def counted(found: DataFrame, key: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Numbers of base spans per kind and the digest of the base spans."""
    n = [count_kind("base", k).alias(f"n_{k}") for k in kinds]
    return found.select(key, *n, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def redacted(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Input rows with the spans of every text replaced by their kind; keys must be unique."""
    found = find(df, key=key, text=text).filter("spans <> ''").select(F.col(key).alias("k"), "spans")

    @F.udf("string")
    def apply(t, s):
        return redact(t, parse(s)) if s else t

    clean = boxed(df, k=F.col(key), t=F.col(text)).join(found, "k", "left").select("box", apply("t", "spans").alias("t"))
    return clean.select(*[F.col("t").alias(c) if c == text else F.col("box").getField(c).alias(c) for c in df.columns])

