"""Rule tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Story and visual weight per profile, and the agents a profile leaves out.
PROFILE_WEIGHTS = {
    "talking_head": (0.7, 0.3),
    "fashion": (0.2, 0.8),
    "travel": (0.3, 0.7),
    "screencast": (0.5, 0.5),
    "custom": (0.5, 0.5),
}
AGENTS = ("hook_hunter", "theme_finder", "humor_specialist", "emotion_reader", "quote_miner", "story_tracker")
PROFILE_WITHOUT = {
    "fashion": ("theme_finder", "quote_miner", "story_tracker"),
    "travel": ("theme_finder", "quote_miner", "story_tracker"),
    "screencast": ("humor_specialist",),
}


def reweight_by_profile(df: DataFrame, profile: str, score: str, visual: Column) -> DataFrame:
    """Score times 1 + (weight - 0.5); the weight depends on the profile and on visual support."""
    w = F.lit(0.5)
    for name, (story, vis) in PROFILE_WEIGHTS.items():
        w = F.when(F.col(profile) == name, F.when(visual, vis).otherwise(story)).otherwise(w)
    return df.withColumn(score, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score) * (1 + (w - 0.5)))))


def enabled_agents(df: DataFrame, profile: str, vision: str) -> DataFrame:
    """One row per agent the profile runs; all of them when vision is off."""
    off = F.array().cast("array<string>")
    for name, without in PROFILE_WITHOUT.items():
        off = F.when(F.col(profile) == name, F.array(*map(F.lit, without))).otherwise(off)
    every = F.array(*map(F.lit, AGENTS))
    return df.withColumn("agent", F.explode(F.when(F.col(vision), F.array_except(every, off)).otherwise(every)))


# Thresholds of the profile and mode rules.
WPM_LOW, WPM_HIGH, SILENCE_HIGH, FACE_MID = 40.0, 120.0, 0.70, 0.50


def _clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def classify_profile(df: DataFrame, wpm: str = "wpm", silence: str = "silence_ratio", face: str = "face_share") -> DataFrame:
    """``profile``, ``confidence`` and ``reasons`` from words per minute, silence and face share (nullable)."""
    w, s, f = F.col(wpm), F.col(silence), F.col(face)
    quiet = (w < WPM_LOW) & (s > SILENCE_HIGH)
    faces = F.coalesce(f > FACE_MID, F.lit(False))
    talk = (w > WPM_HIGH) & (f.isNull() | (f > FACE_MID))
    c_w = _clip01((WPM_LOW - w) / WPM_LOW)
    c_s = _clip01((s - SILENCE_HIGH) / (1.0 - SILENCE_HIGH))
    c_f = _clip01((f - FACE_MID) / FACE_MID)
    c_hi = _clip01((w - WPM_HIGH) / WPM_HIGH)
    profile = F.when(quiet & faces, "fashion").when(quiet, "travel").otherwise("talking_head")
    conf = (
        F.when(quiet & faces, (c_w + c_s + c_f) / 3)
        .when(quiet, (c_w + c_s) / 2)
        .when(talk, (c_hi + F.when(f.isNull(), F.lit(0.5)).otherwise(c_f)) / 2)
        .otherwise(F.lit(0.3))
    )
    reasons = F.array_compact(
        F.array(
            F.when(quiet, "low word rate"),
            F.when(quiet, "much silence"),
            F.when(quiet & faces, "faces in view").when(quiet & f.isNull(), "no vision data").when(quiet, "few faces"),
            F.when(~quiet & talk, "high word rate"),
            F.when(~quiet & talk & f.isNull(), "no vision data").when(~quiet & talk, "faces in view"),
            F.when(~quiet & ~talk, "middle range"),
        )
    )
    return df.withColumns({"profile": profile, "profile_confidence": conf, "profile_reasons": reasons})


def classify_mode(df: DataFrame, words: str, duration: str, voiced: str, *, min_words: int = 50, min_wpm: float = 30.0, max_silence: float = 0.70) -> DataFrame:
    """``mode`` dialogue or travel with the first reason that decided."""
    n, d, v = F.col(words), F.col(duration), F.col(voiced)
    wpm = F.when(d > 0, n / F.nullif(d, F.lit(0.0)) * 60).otherwise(F.lit(0.0))
    sil = F.when(d > 0, 1 - _clip01(v / F.nullif(d, F.lit(0.0)))).otherwise(F.lit(0.0))
    reason = F.when(d <= 0, "no duration").when(n < min_words, "few words").when(wpm < min_wpm, "slow").when(sil > max_silence, "silent").otherwise("speech")
    mode = F.when(reason.isin("few words", "slow", "silent"), "travel").otherwise("dialogue")
    return df.withColumns({"mode": mode, "mode_reason": reason})


# Allowed range per numeric parameter.
SAFETY_LIMITS = {
    "pause_compression_keep_sec": (0.15, 0.5),
    "pause_compression_threshold_sec": (0.2, 2.0),
    "breath_compression_keep_sec": (0.08, 0.25),
    "breath_compression_threshold_sec": (0.15, 0.5),
    "punch_in_zoom_scale": (1.0, 1.15),
    "punch_in_zoom_probability": (0.0, 0.6),
    "punchline_hold_after_sec": (0.15, 0.8),
    "onset_snap_max_shift_sec": (0.02, 0.2),
    "ken_burns_scale_per_sec": (0.001, 0.01),
    "ken_burns_max_scale": (1.005, 1.05),
    "coherence_threshold": (0.3, 0.8),
}
FALLBACK_CONFIDENCE = 0.4


def clamp_config(df: DataFrame, limits: dict[str, tuple[float, float]] = SAFETY_LIMITS) -> DataFrame:
    """Parameters forced into their range; ``clamped`` lists the ones that moved."""
    present = [c for c in limits if c in df.columns]
    moved = F.array_compact(F.array(*[F.when((F.col(c) < limits[c][0]) | (F.col(c) > limits[c][1]), F.lit(c)) for c in present]))
    out = df.withColumn("clamped", moved)
    return out.withColumns({c: F.greatest(F.lit(limits[c][0]), F.least(F.lit(limits[c][1]), F.col(c))) for c in present})


def advise_config(df: DataFrame) -> DataFrame:
    """Parameters from audio features (wps, pitch_std, mean_gap, gap_kurtosis, rhythm_cv, confidence, snr, content), before clamping.

    ``evidence`` holds one struct per decision: parameter, value, confidence.
    """
    wps, pitch, cv, kurt = F.col("wps"), F.col("pitch_std"), F.col("rhythm_cv"), F.col("gap_kurtosis")
    pacing = (
        F.when(pitch >= 40, F.when(wps < 2.0, "documentary").when(wps < 3.5, "balanced").otherwise("dynamic"))
        .when(pitch >= 20, F.when(wps < 2.0, "documentary").when(wps < 2.8, "balanced").when(wps < 3.5, "mkbhd_clean").otherwise("dynamic"))
        .otherwise(F.when(wps < 2.8, "documentary").otherwise("mkbhd_clean"))
    )
    snap = F.when(cv < 0.3, "beat").when(cv < 0.5, "both").when(cv < 0.8, "onset").otherwise("off")
    composer = F.when((pitch > 40) & (wps > 3.0), "tight_context").when(kurt > 3, "balanced").when(wps < 2.0, "thematic_free").otherwise("balanced")
    punch = F.col("content").isin("talking_head", "interview", "unknown") & (pitch > 25)
    burns = (wps < 2.0) | (F.col("content") == "interview")
    out = df.withColumns(
        {
            "pacing_profile": pacing,
            "pause_compression_enabled": F.col("mean_gap") > 0.25,
            "pause_compression_threshold_sec": F.greatest(F.lit(0.3), F.col("mean_gap") * 0.7),
            "pause_compression_keep_sec": F.when(kurt > 3, 0.35).when(kurt < 1, 0.20).otherwise(F.lit(0.25)),
            "breath_compression_enabled": (wps > 3.0) & (cv < 0.4),
            "filler_removal_enabled": (F.col("confidence") > 0.6) & (F.col("snr") > 15),
            "snap_strategy": snap,
            "rhythm_aware_cuts": snap.isin("beat", "both"),
            "onset_snap_max_shift_sec": F.when(cv < 0.25, 0.08).when(cv > 0.5, 0.2).otherwise(F.lit(0.12)),
            "coherence_threshold": F.when(pitch > 35, 0.35).when(pitch < 15, 0.25).otherwise(F.lit(0.5)),
            "composer_strategy": composer,
            "punchline_hold_after_sec": F.when(wps < 2.0, 0.55).when(wps > 3.5, 0.30).otherwise(F.lit(0.45)),
            "punch_in_zoom_enabled": punch,
            "punch_in_zoom_scale": F.when(punch, F.when(wps > 3.5, 1.10).when(wps < 2.0, 1.04).otherwise(F.lit(1.06))),
            "punch_in_zoom_probability": F.when(punch, F.when(wps > 3.5, 0.45).when(wps < 2.0, 0.2).otherwise(F.lit(0.3))),
            "ken_burns_enabled": burns,
            "ken_burns_scale_per_sec": F.when(burns, F.when(wps < 1.5, 0.005).otherwise(F.lit(0.003))),
        }
    )

    def ev(name, conf, only=None):
        s = F.struct(F.lit(name).alias("parameter"), F.col(name).cast("string").alias("value"), (F.lit(conf) if not isinstance(conf, Column) else conf).alias("confidence"))
        return s if only is None else F.when(only, s)

    evidence = F.array_compact(
        F.array(
            ev("pacing_profile", F.when(wps > 0, 0.85).otherwise(F.lit(0.4))),
            ev("pause_compression_enabled", 0.8),
            ev("breath_compression_enabled", 0.75, F.col("breath_compression_enabled")),
            ev("filler_removal_enabled", 0.85, F.col("filler_removal_enabled")),
            ev("snap_strategy", 0.75),
            ev("onset_snap_max_shift_sec", 0.7),
            ev("coherence_threshold", 0.7),
            ev("composer_strategy", 0.7),
            ev("punchline_hold_after_sec", 0.75),
            ev("punch_in_zoom_enabled", F.when(F.col("punch_in_zoom_enabled"), 0.75).otherwise(F.lit(0.6))),
            ev("ken_burns_enabled", 0.7),
        )
    )
    return out.withColumn("evidence", evidence)


def meta_confidence(df: DataFrame) -> DataFrame:
    """``meta_confidence``, ``needs_review`` and ``warnings`` from snr, confidence, n_words, duration, content, failures, wps, max_gap."""
    snr, conf, n = F.col("snr"), F.col("confidence"), F.col("n_words")
    m = (
        F.when(snr < 10, 0.5).when(snr < 18, 0.8).otherwise(F.lit(1.0))
        * F.when((conf < 0.5) & (n > 0), 0.6).when((conf < 0.7) & (n > 0), 0.85).otherwise(F.lit(1.0))
        * F.when(F.col("duration") < 120, 0.7).otherwise(F.lit(1.0))
        * F.when(F.col("content") == "unknown", 0.85).otherwise(F.lit(1.0))
        * F.greatest(F.lit(0.5), 1.0 - 0.1 * F.size("failures"))
    )
    df = df.withColumn("meta_confidence", F.bround(m, 3))
    warn = F.array_compact(
        F.array(
            F.when(snr < 10, "noisy audio"),
            F.when((conf < 0.4) & (n > 0), "unsure transcript"),
            F.when((F.col("wps") < 0.5) & (n > 0), "little speech"),
            F.when(F.col("meta_confidence") < FALLBACK_CONFIDENCE, "low confidence"),
            F.when(F.size("failures") > 0, "missing features"),
            F.when(F.col("max_gap") > 8.0, "long pauses"),
        )
    )
    return df.withColumns({"needs_review": F.col("meta_confidence") < FALLBACK_CONFIDENCE, "warnings": warn})


# What a model may choose, within which limits, and how sure its choices are.
COMPOSERS = ("tight_context", "balanced", "thematic_free")
PACINGS = ("dynamic", "balanced", "mkbhd_clean", "documentary")
COHERENCE_LOW, COHERENCE_HIGH, COHERENCE_STEP, MODEL_CONFIDENCE = 0.3, 0.7, 0.01, 0.6


def merge_overrides(config: DataFrame, overrides: DataFrame) -> DataFrame:
    """A model's choices over the rules' configuration, with a record of each that changed something.

    ``config``: source_id, composer_strategy, coherence_threshold, pacing_profile, meta_confidence, evidence; ``overrides``: source_id and
    strings composer_strategy, coherence_threshold, pacing_profile, narrative_notes. Unknown names and unreadable numbers change nothing; the
    threshold is clamped first. Sources with an override row are at least as sure as the model is.
    """
    o = overrides.select("source_id", *[F.col(c).alias(f"_{c}") for c in ("composer_strategy", "coherence_threshold", "pacing_profile", "narrative_notes")], F.lit(True).alias("_asked"))
    j = config.join(o, "source_id", "left")
    note = F.coalesce("_narrative_notes", F.lit("LLM narrative advisor"))
    given = F.col("_coherence_threshold").try_cast("double")
    # least and greatest pass nulls over
    clamped = F.when(given.isNotNull(), F.greatest(F.lit(COHERENCE_LOW), F.least(F.lit(COHERENCE_HIGH), given)))

    def record(name: str, value: Column, why: Column) -> Column:
        return F.struct(F.lit(name).alias("parameter"), value.cast("string").alias("value"), F.lit(MODEL_CONFIDENCE).alias("confidence"), F.lit("llm").alias("source"), why.alias("reasoning"))

    new = {
        "composer_strategy": (F.col("_composer_strategy").isin(*COMPOSERS) & (F.col("_composer_strategy") != F.col("composer_strategy")), F.col("_composer_strategy"), note),
        "coherence_threshold": (F.round(F.abs(clamped - F.col("coherence_threshold")), 9) > COHERENCE_STEP, F.bround(clamped, 2), F.lit("LLM narrative refinement")),
        "pacing_profile": (F.col("_pacing_profile").isin(*PACINGS) & (F.col("_pacing_profile") != F.col("pacing_profile")), F.col("_pacing_profile"), note),
    }
    more = F.array_compact(F.array(*[F.when(F.coalesce(change, F.lit(False)), record(name, value, why)) for name, (change, value, why) in new.items()]))
    sure = F.when(F.col("_asked"), F.greatest("meta_confidence", F.lit(MODEL_CONFIDENCE))).otherwise(F.col("meta_confidence"))
    out = j.withColumns({"evidence": F.concat("evidence", more), "meta_confidence": sure, **{n: F.when(F.coalesce(c, F.lit(False)), v).otherwise(F.col(n)) for n, (c, v, _) in new.items()}})
    return out.drop("_composer_strategy", "_coherence_threshold", "_pacing_profile", "_narrative_notes", "_asked")


def apply_toggles(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """User switches win: with zoom off, zoom and drift are off. Missing rows mean on. ``overrides``: source_id, zoom_enabled."""
    j = df.join(overrides, "source_id", "left")
    on = F.coalesce("zoom_enabled", F.lit(True))
    return j.withColumns({"punch_in_zoom_enabled": F.col("punch_in_zoom_enabled") & on, "ken_burns_enabled": F.col("ken_burns_enabled") & on}).drop("zoom_enabled")


def layered_config(sources: DataFrame, stored: DataFrame, override: DataFrame, defaults: dict[str, tuple[str, object]], legacy: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """One typed row per source: defaults, then stored rows, then per-job overrides.

    ``stored``/``override``: source_id, key, value_json. Unknown keys and unreadable values are ignored; ``legacy`` maps old
    values per key; ``defaults`` maps a key to (type, value).
    """

    def pivot(df, tag):
        known = df.filter(F.col("key").isin(*defaults))
        text = F.trim(F.get_json_object(F.concat(F.lit('{"v":'), F.col("value_json"), F.lit("}")), "$.v"))
        for k, m in (legacy or {}).items():
            for old, new in m.items():
                text = F.when((F.col("key") == k) & (text == old), new).otherwise(text)
        known = known.withColumn("_v", text)
        return known.groupBy("source_id").agg(
            *[F.max(F.when(F.col("key") == k, F.col("_v").try_cast(t))).alias(f"_{tag}_{k}") for k, (t, _) in defaults.items()]
        )

    out = sources.join(pivot(stored, "s"), "source_id", "left").join(pivot(override, "o"), "source_id", "left")
    return out.select(
        *sources.columns, *[F.coalesce(F.col(f"_o_{k}"), F.col(f"_s_{k}"), F.lit(v).cast(t)).alias(k) for k, (t, v) in defaults.items()]
    )


def merge_reference_table(current: DataFrame, shipped: DataFrame, legacy_keys: list[str]) -> DataFrame:
    """Three-way merge by content hash: (key, action, content).

    ``current``: key, content, base_hash (hash of the shipped text it came from); ``shipped``: key, content. A row still equal to its
    base migrates to the new text; an edited one is preserved; missing ones are added; legacy keys go.
    """
    c = current.select("key", F.col("content").alias("_c"), "base_hash")
    s = shipped.select("key", F.col("content").alias("_n"))
    j = c.join(s, "key", "full_outer")
    edited = F.sha2("_c", 256) != F.col("base_hash")
    action = (
        F.when(F.col("key").isin(*legacy_keys), "delete")
        .when(F.col("_c").isNull(), "add")
        .when(F.col("_n").isNull(), "keep")
        .when(edited, F.when(F.col("_c") == F.col("_n"), "keep").otherwise("preserve"))
        .when(F.col("_c") == F.col("_n"), "keep")
        .otherwise("migrate")
    )
    content = F.when(action.isin("add", "migrate"), F.col("_n")).otherwise(F.col("_c"))
    return j.select("key", action.alias("action"), content.alias("content"))
