"""Benchmark decontamination by winnowing, DataFrame functions only.

A text's fingerprints are the smallest hash of every ``WINDOW`` consecutive k-grams of words. Two texts that share
``WINDOW + GRAM - 1`` = 10 words in a row have the same hashes there, hence share the smallest of them: no span of that length is missed.
Fingerprints of documents meet the distinct ones of the benchmark (a semi-join: no fan-out, however common a phrase is), and what is
left is extended: a fingerprint carries the hashes of the spans of ten words that it lies in, and these
meet the benchmark's distinct spans. Items of fewer than ten words are spans themselves, looked up by their own length.

Words are compared by 64-bit hashes, spans by a hash of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import small_side
from cadenza.session import materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BESIDE = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
SPAN, GRAM = 10, 6
WINDOW = SPAN - GRAM + 1
HIT_ROWS = 200_000  # hit documents (about 130 bytes each) that a broadcast may carry; more are joined by a shuffle
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LONGS = "array<bigint>"


def terms(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null has none."""
    body = F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(_BESIDE))
    return _let(body, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SEPARATORS)))


def word_count(text: Column) -> Column:
    body = F.split(F.coalesce(text, F.lit("")), SEPARATORS)
    # only the first and the last part can be empty
    return _let(body, lambda w: (F.size(w) - F.when(F.element_at(w, 1) == "", 1).otherwise(0) - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)).cast("long"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; naming it in a lambda alone would compute it for every element."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: Column) -> Column:
    return F.transform(terms(text), lambda w: F.xxhash64(w))


def _run(a: Column, x: Column, i: Column, k: int) -> list[Column]:
    """x, the element i of a, and the k - 1 elements after it; single elements, as a slice copies its whole array first."""
    return [x, *[F.get(a, i + d) for d in range(1, k)]]


def grams(h: Column, k: int) -> Column:
    """Hash of the k words from each position on; the last k - 1 have too few words and mean nothing."""
    return F.transform(h, lambda x, i: F.xxhash64(*_run(h, x, i, k)))


def _span(g: Column, i: Column) -> Column:
    """Hash of the ten words from position i on, from their first and last k-gram."""
    return F.xxhash64(F.get(g, i), F.get(g, i + (WINDOW - 1)))


_PRINTS = "array<struct<fp:bigint,at:int,spans:array<bigint>>>"


def fingerprints(h: Column) -> Column:
    """array of (fp, at, spans): the smallest k-gram hash of every window, where windows go on to another k-gram only.

    Of equal smallest hashes the last one counts. ``at`` is the first window that has this k-gram, ``spans`` are the hashes of the spans from
    there on that can have it: five windows hold a k-gram; beyond the end of the text they are null. Fewer than ten words have no window.
    """

    def chosen(v: Column, g: Column, m: Column) -> Column:
        last = F.size(v) - SPAN
        # a window has another k-gram than the one before if its last is not above the earlier minimum, or if that minimum left it
        fresh = lambda i: (i == 0) | (F.get(g, i + (WINDOW - 1)) <= F.get(m, i - 1)) | (F.get(m, i) > F.get(m, i - 1))
        spans = lambda i: F.array(_span(g, i), *[F.when(i + d <= last, _span(g, i + d)) for d in range(1, WINDOW)])
        one = lambda i: F.struct(F.get(m, i).alias("fp"), i.alias("at"), spans(i).alias("spans"))
        return F.transform(F.filter(F.sequence(F.lit(0), last), fresh), one)

    def least(v: Column, g: Column) -> Column:
        return _let(F.transform(g, lambda x, i: F.least(*_run(g, x, i, WINDOW))), lambda m: chosen(v, g, m))

    return _let(h, lambda v: F.when(F.size(v) >= SPAN, _let(grams(v, GRAM), lambda g: least(v, g))).otherwise(F.array().cast(_PRINTS)))


def benchmark_spans(benchmark: DataFrame, *, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, m, span) of all items, m being the words of a span: ten, or all of a shorter item. Items without words have none."""

    def spans(h: Column) -> Column:
        whole = lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - SPAN), lambda i: _span(g, i))
        out = F.when(F.size(h) >= SPAN, F.struct(F.lit(SPAN).alias("m"), _let(grams(h, GRAM), whole).alias("spans")))
        for k in range(1, SPAN):
            out = out.when(F.size(h) == k, F.struct(F.lit(k).alias("m"), F.slice(grams(h, k), 1, 1).alias("spans")))
        return out

    rows = benchmark.select(F.col(item).cast("string").alias("item"), _let(word_hashes(F.col(text)), spans).alias("s")).filter("s is not null")
    return rows.select("item", F.col("s.m").alias("m"), F.explode("s.spans").alias("span")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated), one row per input row; other columns are not read.

    A word is hit when it lies in ten consecutive words (or all words of a shorter item) that an item has too. ``items_sha256`` is the
    digest of the hit items' ids as sorted strings, comma-joined. Null and empty texts have no words. Items without id hit words but are
    not listed; rows that share an item id are one item. Repeated rows get equal results; an empty table gives an empty table, an
    empty benchmark hits nothing.
    """
    found = occurrences(docs, benchmark, key=key, text=text, item=item, item_text=item_text)
    names = F.sort_array(F.collect_set("item"))
    sets = found.sets.groupBy("set").agg(F.count_distinct("item").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"))
    hits = materialize(found.hits.drop("spans").join(sets, "set", "left"))
    hits = small_side(hits.withColumnRenamed("_key", "_hk").withColumnRenamed("_addr", "_ha"), most=HIT_ROWS)
    rows = docs.select(F.col(key).alias("_key"), _address(text).alias("_addr"), word_count(F.col(text)).alias("n_words"))
    j = rows.join(hits, (rows["_addr"] == F.col("_ha")) & rows["_key"].eqNullSafe(F.col("_hk")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return j.select(F.col("_key").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


class Occurrences:
    """``hits``: (_key, _addr, n_hit, spans, set) per document that is hit; ``sets``: (set, item), the items of each set of spans."""

    def __init__(self, hits: DataFrame, sets: DataFrame):
        self.hits, self.sets = hits, sets


def _address(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def occurrences(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> Occurrences:
    """Where benchmark spans occur; a document is known by its key and a hash of its text."""
    spans = materialize(benchmark_spans(benchmark, item=item, text=item_text))
    lengths = sorted(r["m"] for r in spans.select("m").distinct().collect())  # ten at most
    # spans that the same items have are one class: a line that many items share brings their list once
    of = spans.groupBy("m", "span").agg(F.count("item").alias("c"), F.coalesce(F.sum(F.xxhash64("item").cast("decimal(38,0)")), F.lit(0)).alias("s1"), F.coalesce(F.sum(F.xxhash64("item", F.lit(1)).cast("decimal(38,0)")), F.lit(0)).alias("s2"))
    classes = materialize(of.select("m", "span", F.xxhash64("c", "s1", "s2").alias("cls")))
    rows = docs.select(F.col(key).alias("_key"), _address(text).alias("_addr"), F.col(text).alias("_text"))

    # texts are read once: for fingerprints and, if the benchmark has short items, for runs of their lengths
    def tagged(h: Column) -> Column:
        tag = lambda m, fp, at, spans: F.struct(F.lit(m).alias("m"), fp.alias("fp"), at.alias("at"), spans.alias("spans"))
        none = F.array().cast(f"array<struct<m:int,fp:bigint,at:int,spans:{_LONGS}>>")

        def short(m: int) -> Column:
            runs = F.slice(grams(h, m), 1, F.size(h) - (m - 1))
            return F.when(F.size(h) >= m, F.transform(runs, lambda x, i: tag(m, x, i, F.array(x)))).otherwise(none)

        parts = [short(m) for m in lengths if m < SPAN]
        if SPAN in lengths:
            parts.append(F.transform(fingerprints(h), lambda x: tag(SPAN, x["fp"], x["at"], x["spans"])))
        return F.concat(none, *parts)

    prints = rows.select("_key", "_addr", F.explode(_let(word_hashes(F.col("_text")), tagged)).alias("f")).select("_key", "_addr", "f.*")
    known = benchmark.select(F.explode(fingerprints(word_hashes(F.col(item_text)))).alias("f")).select(F.lit(SPAN).alias("m"), F.col("f.fp").alias("fp"))
    known = materialize(known.unionByName(classes.filter(F.col("m") < SPAN).select("m", F.col("span").alias("fp"))).distinct())
    near = prints.join(small_side(known), ["m", "fp"], "left_semi")
    # extension: the spans that hold a fingerprint; the span of a short item is what was looked up
    at = near.select("_key", "_addr", "m", "at", F.posexplode("spans").alias("i", "span")).filter("span is not null").select("_key", "_addr", "m", "span", (F.col("at") + F.col("i")).alias("start"))
    met = at.join(small_side(classes), ["m", "span"])
    # per document: covered words, and the classes of its spans
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("n"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    per = met.groupBy("_key", "_addr").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("m")).alias("end")))).alias("spans"), F.sort_array(F.collect_set("cls")).alias("classes"))
    hits = materialize(per.select("_key", "_addr", F.aggregate("spans", zero, step)["n"].alias("n_hit"), "spans", "classes", F.xxhash64("classes").alias("set")))
    # the items of each set of classes that occurs, once for all documents that have it
    members = hits.groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes").alias("cls"))
    lead = classes.groupBy("cls").agg(F.min(F.struct("m", "span")).alias("r")).select("cls", "r.m", "r.span")
    listed = lead.join(spans, ["m", "span"]).filter("item is not null").select("cls", "item")
    return Occurrences(hits.drop("classes"), members.join(listed, "cls").select("set", "item").distinct())


def without_contamination(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Input rows in which no benchmark span occurs, with all their columns."""
    hits = small_side(occurrences(docs, benchmark, key=key, text=text, item=item, item_text=item_text).hits.select(F.col("_key").alias("_hk"), F.col("_addr").alias("_ha")), most=HIT_ROWS)
    boxes = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("box"), F.col(key).alias("_key"), _address(text).alias("_addr"))
    return boxes.join(hits, (boxes["_addr"] == F.col("_ha")) & boxes["_key"].eqNullSafe(F.col("_hk")), "left_anti").select("box.*")
