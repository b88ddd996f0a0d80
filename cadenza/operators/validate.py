"""Loosely typed model output -> typed rows. Bad values become null first, then rows are dropped or repaired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names the model output may use.
HOOK_KINDS = ("question", "bold_claim", "counter_intuitive", "emotional_trigger", "pattern_break", "stat_shock", "story_open")
CLOSURE_KINDS = ("conclusion", "punchline", "revelation", "callback", "question", "emotional")
ROLES = ("hook", "setup", "development", "peak", "payoff")
CATEGORIES = ("hook_candidate", "peak_candidate", "payoff_candidate", "development_material", "cutaway_material")
PEAK_KINDS = ("surprise", "triumph", "anger", "sadness", "humor", "tension")
STRENGTH_FIELD = {"emotion_reader": "intensity", "humor_specialist": "funniness", "story_tracker": "significance"}
KNOWN_FIELDS = ("start", "end", "text", "speaker", "theme_id", "motif_id", "pairs_with_theme_id", "strength", "intensity", "funniness", "significance")


def number(v: Column) -> Column:
    return v.try_cast("double")


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def one_of(v: Column, allowed: Sequence[str], default: str | None) -> Column:
    low = F.lower(F.trim(v))
    return F.when(low.isin(*allowed), low).otherwise(F.lit(default))


def extract_json(text: Column) -> Column:
    """JSON text inside an answer: as is, from a fenced block, or between the outermost brackets. Null when none."""
    t = F.trim(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    outer = F.regexp_extract(t, r"(?s)([\[{].*[\]}])", 1)
    return F.when(t.rlike(r"(?s)^[\[{].*[\]}]$"), t).when(fenced != "", fenced).when(outer != "", outer)


def parse_items(df: DataFrame, raw: str, field: str = "items") -> DataFrame:
    """Explode ``field`` (or a top-level array) of a JSON answer into maps (``item``); unreadable answers give no rows."""
    j = extract_json(F.col(raw))
    arr = F.coalesce(
        F.from_json(F.get_json_object(j, f"$.{field}"), "array<map<string,string>>"),
        F.from_json(F.when(F.startswith(F.trim(j), F.lit("[")), j), "array<map<string,string>>"),
    )
    return df.withColumn("item", F.explode(F.filter(arr, lambda m: m.isNotNull()))).drop(raw)


def quarantine(df: DataFrame, raw: str) -> DataFrame:
    """Rows whose answer holds no readable JSON."""
    j = extract_json(F.col(raw))
    ok = F.coalesce(F.from_json(j, "map<string,string>").isNotNull(), F.lit(False)) | F.coalesce(
        F.from_json(F.when(F.startswith(F.trim(j), F.lit("[")), j), "array<map<string,string>>").isNotNull(), F.lit(False)
    )
    return df.filter(~ok)


def validate_evidence(df: DataFrame, agent: str = "agent") -> DataFrame:
    """``item`` maps -> evidence rows: numeric span, text, strength by agent, unknown fields in ``extra``."""
    m = F.col("item")
    field = F.lit("strength")
    for a, f in STRENGTH_FIELD.items():
        field = F.when(F.col(agent) == a, F.lit(f)).otherwise(field)
    strength = F.coalesce(number(F.try_element_at(m, field)), number(m["strength"]), F.lit(0.5))
    out = df.withColumns(
        {
            "start": number(m["start"]),
            "end": number(m["end"]),
            "text": F.trim(F.coalesce(m["text"], F.lit(""))),
            "strength": clamp(strength, 0.0, 1.0),
            "speaker": m["speaker"],
            "theme_id": m["theme_id"],
            "motif_id": F.coalesce(m["motif_id"], m["pairs_with_theme_id"]),
            "extra": F.map_filter(m, lambda k, v: ~k.isin(*KNOWN_FIELDS)),
        }
    )
    return out.filter((F.col("end") > F.col("start")) & (F.col("text") != "")).drop("item")


def validate_clips(df: DataFrame, *, slack: float = 3.0, low: float = 28.0, high: float = 90.0) -> DataFrame:
    """``item`` maps with chunk bounds (c_start, c_end) -> clips: relative times repaired, clamped, typed."""
    m = F.col("item")
    s0, e0 = number(m["start_sec"]), number(m["end_sec"])
    rel = (F.col("c_start") > 1.0) & (e0 < F.col("c_start")) & (e0 <= F.col("c_end") - F.col("c_start") + 5.0)
    s = F.greatest(F.greatest(F.lit(0.0), F.col("c_start") - slack), F.when(rel, s0 + F.col("c_start")).otherwise(s0))
    e = F.least(F.col("c_end") + slack, F.when(rel, e0 + F.col("c_start")).otherwise(e0))
    sc = m["score"]
    score = F.coalesce(sc.try_cast("int"), F.when(sc.rlike(r"^-?\d+\.\d*$"), number(sc).try_cast("int")))
    score = F.when(F.col("item")["score"].isNull(), F.lit(0)).otherwise(score)

    def txt(name, n):
        return F.substring(F.trim(F.coalesce(m[name], F.lit(""))), 1, n)

    out = df.withColumns(
        {
            "start": F.when(s0.isNotNull() & e0.isNotNull(), s),
            "end": F.when(s0.isNotNull() & e0.isNotNull(), e),
            "hook": txt("hook", 300),
            "payoff": txt("payoff", 350),
            "topic": txt("topic", 120),
            "score": F.when(score.isNotNull(), F.greatest(F.lit(5), F.least(F.lit(10), score))),
            "hook_kind": one_of(m["hook_kind"], HOOK_KINDS, "bold_claim"),
            "closure": one_of(m["closure_type"], CLOSURE_KINDS, "conclusion"),
        }
    )
    d = F.col("end") - F.col("start")
    return out.filter((d >= low) & (d <= high) & (F.col("hook") != "") & F.col("score").isNotNull()).drop("item")


def validate_hooks(df: DataFrame, *, shortest: float = 1.6, longest: float = 9.6, trim_to: float = 8.0) -> DataFrame:
    """Hooks (start, end, score, kind as text) inside chapters (p_start, p_end)."""
    s = F.greatest(number(F.col("start")), F.col("p_start"))
    e = F.least(number(F.col("end")), F.col("p_end"))
    e = F.when(F.round(e - s, 9) > longest, s + trim_to).otherwise(e)
    out = df.withColumns({"start": s, "end": e})
    out = out.withColumns({"score": clamp(F.coalesce(number(F.col("score")), F.lit(0.5)), 0.0, 1.0), "kind": one_of(F.col("kind"), HOOK_KINDS, "bold_claim")})
    return out.filter(F.round(F.col("end") - F.col("start"), 9) >= shortest)


def validate_arcs(df: DataFrame, *, low: float = 28.0, high: float = 75.0, coherence: float = 0.5) -> DataFrame:
    """Arcs inside chapters: duration range, required closure kind, coherence, at most five sentences of 300 characters.

    The hook moves with the start when clamping shifted it by more than 0.1 s.
    """
    s = F.greatest(F.col("start"), F.col("p_start"))
    e = F.least(F.col("end"), F.col("p_end"))
    moved = F.abs(s - F.col("hook_start")) > 0.1
    out = df.withColumns(
        {
            "hook_end": F.when(moved, F.least(s + (F.col("hook_end") - F.col("hook_start")), e)).otherwise(F.col("hook_end")),
            "hook_start": F.when(moved, s).otherwise(F.col("hook_start")),
            "closure": one_of(F.col("closure"), CLOSURE_KINDS, None),
            "development": F.slice(F.transform("development", lambda t: F.substring(t, 1, 300)), 1, 5),
            "start": s,
            "end": e,
        }
    )
    d = F.round(F.col("end") - F.col("start"), 9)
    return out.filter((d >= low) & (d <= high) & F.col("closure").isNotNull() & (F.col("coherence") >= coherence))


def validate_ranked(df: DataFrame, agents: Sequence[str], default_agent: str = "hook_hunter") -> DataFrame:
    """Ranked rows with text scores, categories and agents of any spelling."""
    return df.withColumns(
        {
            "score": clamp(F.coalesce(number(F.col("score")), F.lit(0.5)), 0.0, 1.0),
            "category": one_of(F.col("category"), CATEGORIES, "development_material"),
            "agent": one_of(F.col("agent"), agents, default_agent),
        }
    )


def validate_story(df: DataFrame, evidence: DataFrame) -> DataFrame:
    """Story rows (source_id, id, role, start?, end?, payoff_conclusion?): role whitelist, conclusion on payoffs only.

    Missing times come from the evidence, else a row starts at 0 and ends one second after its start.
    """
    e = evidence.select("source_id", "id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    j = df.filter(F.lower(F.trim("role")).isin(*ROLES)).withColumn("role", F.lower(F.trim("role"))).join(e, ["source_id", "id"], "left")
    j = j.withColumns(
        {
            "start": F.coalesce(number(F.col("start")), F.col("_s"), F.lit(0.0)),
            "end": F.coalesce(number(F.col("end")), F.col("_e"), F.coalesce(number(F.col("start")), F.col("_s"), F.lit(0.0)) + 1.0),
            "payoff_conclusion": F.when(F.col("role") == "payoff", F.coalesce(F.col("payoff_conclusion"), F.lit(False))).otherwise(F.lit(False)),
        }
    )
    return j.filter(F.col("end") > F.col("start")).drop("_s", "_e")


# Kinds of a story's variants and emotional beats of its segments.
VARIANT_KINDS = ("long_philosophical", "package_of_shorts", "punchy_summary", "deep_dive")
BEATS = ("strain", "relief", "reveal", "triumph", "neutral")


def emotional_beat(beat: Column) -> Column:
    """A known beat in lower case, else neutral."""
    low = F.lower(beat)
    return F.when(low.isin(*BEATS), low).otherwise("neutral")


def validate_variants(df: DataFrame, evidence: DataFrame) -> DataFrame:
    """Segments of story variants (source_id, variant_no, kind, label?, target?, predicted?, id, role, start?, end?, beat?).

    The kind may carry the prefix ``variant_`` and any case; unknown kinds go with all their segments. Segments follow
    :func:`validate_story`'s rules for roles and missing times, start at 0 at the earliest; a variant without a sound segment is gone.
    Adds ``variant_id``, ``beat``, and per variant ``label`` (default: the kind in words), ``target`` (at least 0, default 0) and
    ``predicted`` (default: the length of its segments).
    """
    kind = F.regexp_replace(F.lower(F.coalesce(F.col("kind"), F.lit(""))), "^variant_", "")
    e = evidence.select("source_id", "id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    role = F.lower(F.col("role"))
    j = df.withColumn("kind", kind).filter(F.col("kind").isin(*VARIANT_KINDS) & role.isin(*ROLES)).withColumn("role", role).join(e, ["source_id", "id"], "left")
    # times that are given but are no numbers make a segment unsound
    j = j.filter((F.col("start").isNull() | number(F.col("start")).isNotNull()) & (F.col("end").isNull() | number(F.col("end")).isNotNull()))
    s = F.coalesce(number(F.col("start")), F.col("_s"), F.lit(0.0))
    j = j.withColumns({"_a": s, "_b": F.coalesce(number(F.col("end")), F.col("_e"), s + 1.0)}).filter(F.col("_b") > F.col("_a"))
    j = j.withColumns({"start": F.greatest(F.lit(0.0), F.col("_a")), "end": F.greatest(F.col("_a"), F.col("_b"))}).drop("_s", "_e", "_a", "_b")
    total = j.groupBy("source_id", "variant_no").agg(F.sum(F.col("end") - F.col("start")).alias("_len"))
    j = j.join(total, ["source_id", "variant_no"])
    return j.withColumns(
        {
            "variant_id": F.concat(F.lit("variant_"), F.col("kind")), "beat": emotional_beat(F.col("beat")),
            "label": F.coalesce("label", F.replace("kind", F.lit("_"), F.lit(" "))),
            "target": F.greatest(F.lit(0.0), F.coalesce(number(F.col("target")), F.lit(0.0))),
            "predicted": F.greatest(F.lit(0.0), F.coalesce(number(F.col("predicted")), F.col("_len"))),
        }
    ).drop("_len")


def validate_compressed(df: DataFrame) -> DataFrame:
    """Compressed chunks: summary required; quotes need text; peaks of known kinds; a missing range is the chunk's."""
    out = df.filter(F.length(F.trim(F.coalesce("summary", F.lit("")))) > 0)
    return out.withColumns(
        {
            "quotes": F.filter(F.coalesce("quotes", F.array().cast("array<struct<sec:double,text:string>>")), lambda q: F.length(F.trim(q["text"])) > 0),
            "peaks": F.filter(F.coalesce("peaks", F.array().cast("array<struct<sec:double,kind:string>>")), lambda p: p["kind"].isin(*PEAK_KINDS)),
            "r_start": F.coalesce("r_start", "c_start"),
            "r_end": F.coalesce("r_end", "c_end"),
        }
    )


def sanitize_segments(df: DataFrame, text: str, *, longest: int = 1000, word: int = 60) -> DataFrame:
    """Drop monster segments, then monster words; a segment with no words left goes too."""
    kept = F.filter(F.split(F.trim(F.col(text)), "[ \n\t\r]+"), lambda w: (w != "") & (F.length(w) <= word))
    return df.filter(F.length(text) <= longest).withColumn(text, F.array_join(kept, " ")).filter(F.col(text) != "")


def lookup_by_key(left: DataFrame, right: DataFrame, take: Sequence[str]) -> DataFrame:
    """Left join on (source, rounded start, first 80 characters); the last right row of a key wins."""
    k = ["source_id", "_s", "_x"]
    r = right.select("source_id", F.bround("start", 1).alias("_s"), F.substring(F.coalesce("text", F.lit("")), 1, 80).alias("_x"), "id", *take)
    r = r.groupBy(*k).agg(F.max_by(F.struct(*take), "id").alias("_t"))
    l = left.withColumns({"_s": F.bround("start", 1), "_x": F.substring(F.coalesce("text", F.lit("")), 1, 80)})
    return l.join(r, k, "left").select(*left.columns, *[F.col(f"_t.{c}").alias(c) for c in take])


def backfill(ranked: DataFrame, pool: DataFrame, *, need: int = 20, cap: int = 60) -> DataFrame:
    """Sources with fewer than ``need`` ranked rows are topped up to ``cap`` from the pool by strength.

    A pool row is skipped when its start, rounded to a tenth, is taken already.
    """
    n = ranked.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    few = pool.select("source_id").distinct().join(n, "source_id", "left").fillna({"_n": 0}).filter(F.col("_n") < need)
    taken = ranked.select("source_id", F.bround("start", 1).alias("_s")).distinct()
    w = Window.partitionBy("source_id").orderBy(F.desc("strength"), "id")
    p = pool.withColumn("_s", F.bround("start", 1)).join(taken, ["source_id", "_s"], "left_anti")
    # one row per rounded start: the strongest
    p = p.groupBy("source_id", "_s").agg(F.max_by(F.struct("id", "start", "strength"), F.struct("strength", (-F.col("id")).alias("t"))).alias("_r")).select("source_id", "_r.*")
    p = p.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= cap).join(few, "source_id").filter(F.col("_k") <= cap - F.col("_n"))
    return ranked.select("source_id", "id", "start", F.lit(False).alias("backfilled")).unionByName(p.select("source_id", "id", "start", F.lit(True).alias("backfilled")))


def drop_flagged(items: DataFrame, flags: DataFrame, strictness: str = "soft") -> DataFrame:
    """Remove ids flagged with enough confidence: .75 when soft, .5 when strict."""
    need = {"soft": 0.75, "strict": 0.5}[strictness]
    bad = flags.filter(F.col("confidence") >= need).select("source_id", "id").distinct()
    return items.join(bad, ["source_id", "id"], "left_anti")


def chunk_diagnostics(chunks: DataFrame, raw: DataFrame, valid: DataFrame) -> DataFrame:
    """One row per chunk, failed ones too: characters, raw and valid items, error, and a score histogram.

    ``chunks``: source_id, chunk, chars, error. Scores are a handful of values, so their counts are bounded.
    """
    key = ["source_id", "chunk"]
    r = raw.groupBy(*key).agg(F.count(F.lit(1)).alias("raw_items"))
    v = valid.groupBy(*key, "score").agg(F.count(F.lit(1)).alias("_n"))
    v = v.groupBy(*key).agg(
        F.sum("_n").alias("valid_items"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("score", "_n"))), lambda x: F.concat_ws(":", x["score"].cast("int").cast("string"), x["_n"].cast("string"))), ",").alias("scores"),
    )
    out = chunks.join(r, key, "left").join(v, key, "left")
    return out.fillna({"raw_items": 0, "valid_items": 0, "scores": "", "error": ""})
