"""Secrets: base patterns, and strings that a primed compressor cannot predict in a sensitive context.

A candidate's novelty is the number of bytes it adds when zstandard compresses it after its surroundings, primed with a
dictionary of the identifiers that the corpus uses most. Names, words and repeats cost little; keys cost close to their length. Candidates next to
a sensitive word whose bytes per character reach the limit are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.spans import Cover, Span, add_best, count_kind, parse, render
from cadenza.session import materialize

KINDS = ("assign", "access", "hex", "novel")
DICTIONARY_BYTES = 65_536  # bound of the dictionary that every task receives
LIMIT = 0.66  # marginal bytes per character that make a candidate novel
LEAST = 16  # shortest candidate
BEFORE, AFTER = 256, 64  # surrounding code that primes the compressor

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_STRING = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_NAME = re.compile(r"([A-Za-z_][A-Za-z0-9_.]{2,63})[\"']?\x20{0,4}[:=]")
# fixed values: words that make a context sensitive
_SENSITIVE = re.compile(r"pass|pwd|secret|token|key|auth|bearer|credential|private|signature|session|cookie|jwt|login", re.IGNORECASE | re.ASCII)
# fixed values: words of code that are common everywhere
COMMON = "import return function class public static void const let var null true false self this string int float bool list dict config default value name type http https www example com localhost content json xml html utf base64 begin end public key certificate version request response header".split()


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Long strings with a digit, outside base spans, with a sensitive word around."""
    if not _SENSITIVE.search(text):
        return []
    out, cover = [], Cover(base)
    for m in _STRING.finditer(text):
        a, e = m.span()
        if any(c.isdigit() for c in m[0]) and not cover.meets(a, e):
            around = text[max(0, a - 48) : a] + " " + text[e : e + 16]
            if _SENSITIVE.search(around):
                out.append((a, e))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("near", pa.string()), ("body", pa.string())])
    for b in batches:
        base, cands, names = [], [], []
        for v in b.column("_text"):
            t = v.as_py() or ""
            spans = base_spans(t)
            base.append(render(spans, KINDS))
            cands.append([{"start": a, "end": e, "near": t[max(0, a - BEFORE) : a] + "\n" + t[e : e + AFTER], "body": t[a:e]} for a, e in candidates(t, spans)])
            names.append(_NAME.findall(t) if "=" in t or ":" in t else [])
        yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_row"), pa.array(base), pa.array(cands, pa.list_(item)), pa.array(names, pa.list_(pa.string()))], ["_key", "_row", "base", "cands", "names"])


def identifier_dictionary(names: DataFrame, most: int = DICTIONARY_BYTES) -> bytes:
    """Most used identifiers of all documents, the commonest last, where the compressor finds it cheapest."""
    top = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "name").limit(most // 4)
    out: list[bytes] = [" ".join(COMMON).encode()]
    size = len(out[0])
    for r in top.toLocalIterator():
        w = r["name"].encode()
        if size + len(w) + 1 > most:
            break
        out.append(w)
        size += len(w) + 1
    return b" ".join(reversed(out))


def novelty(near: str, body: str, squeeze: zstandard.ZstdCompressor) -> float:
    """Marginal compressed bytes per byte of ``body`` after ``near``."""
    n, b = near.encode(), body.encode()
    return max(0, len(squeeze.compress(n + b)) - len(squeeze.compress(n))) / max(1, len(b))


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=d, write_checksum=False, write_content_size=False)


def find(df: DataFrame, *, key: str = "doc_id", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """(key, base, spans), one row per input row: base spans and all spans as text; other columns are not read.

    Null texts count as empty, texts without spans get empty strings. Added spans have the kind ``novel`` and overlap no
    other span. Rows that repeat are scanned separately. An empty table gives an empty table.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    scanned = materialize(rows.mapInArrow(_scan, f"_key {kind}, _row long, base string, cands array<struct<start:int,end:int,near:string,body:string>>, names array<string>"))
    primed = identifier_dictionary(scanned.select(F.explode("names").alias("name")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = compressor(primed)
        for b in batches:
            out = []
            for base, cands in zip(b.column("base").to_pylist(), b.column("cands").to_pylist()):
                more = [(novelty(c["near"], c["body"], squeeze), ("novel", c["start"], c["end"])) for c in cands]
                more = [m for m in more if m[0] >= limit]
                out.append(render(add_best(parse(base), more), KINDS) if more else base)
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("base"), pa.array(out, pa.string())], [key, "base", "spans"])

    return scanned.select("_key", "base", "cands").mapInArrow(judge, f"`{key}` {kind}, base string, spans string")


def counted(found: DataFrame, key: str) -> DataFrame:
    """Numbers of base spans per kind and the digest of the base spans."""
    n = [count_kind("base", k).alias(f"n_{k}") for k in KINDS[:3]]
    return found.select(key, *n, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
