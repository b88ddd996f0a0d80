"""Text expressions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Filler words that are removed by the lexicon test.
FILLERS = (
    "эм", "эмм", "эмэ", "ам", "амм", "аа", "ээ", "мм", "ммм", "ну", "нуу", "вот", "типа", "короче", "блин", "э", "а",
    "uh", "uhh", "um", "umm", "uhm", "hm", "hmm", "mhm", "mhmm", "mm", "mmm", "eh", "err", "erm",
)
SENTENCE_END = r"[.!?…]$"
# letters and digits of any script; the reference-compatible pattern covers Latin and Cyrillic only
TOKEN = r"[\p{L}\p{N}]+"
TOKEN_LATIN_CYRILLIC = r"[a-zа-яё0-9]+"


def tokens(text: Column, min_len: int = 3, pattern: str = TOKEN) -> Column:
    """Distinct lower-case tokens of at least ``min_len`` characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= min_len))


def word_set(text: Column) -> Column:
    """Distinct lower-case whitespace words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \n\t\r]+", " "))


def trim_text(text: Column, n: int, empty: str = "") -> Column:
    """Trimmed text of at most ``n`` characters, the cut marked by three dots."""
    clean = F.trim(F.coalesce(text, F.lit(empty)))
    return F.when(F.length(clean) <= n, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, n - 3)), F.lit("...")))


def safe_id(text: Column, n: int = 32) -> Column:
    cleaned = F.substring(F.regexp_replace(text, "[^A-Za-z0-9_-]", "-"), 1, n)
    return F.when(cleaned == "", F.lit("r")).otherwise(cleaned)


def ends_sentence(text: Column) -> Column:
    return F.trim(text).rlike(SENTENCE_END)


def strip_edges(word: Column) -> Column:
    """Lower-case word without punctuation at its edges."""
    edge = "[.,!?;:…—\"'«»()\\[\\]\\-]"
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(word), f"^{edge}+", ""), f"{edge}+$", ""))


def is_filler(word: Column, lexicon=FILLERS) -> Column:
    return strip_edges(word).isin(*lexicon)


def lexicon_score(text: Column, universal: list[str], profile: list[str]) -> Column:
    """0.4 * universal hits / 5 + 0.6 * profile hits / 4, each part capped at 1; 0.5 without text."""
    low = F.lower(text)

    def hits(words):
        return sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))

    score = 0.4 * F.least(F.lit(1.0), hits(universal) / 5.0) + 0.6 * F.least(F.lit(1.0), hits(profile) / 4.0)
    return F.when(F.trim(text) == "", F.lit(0.5)).otherwise(score)


def mask_paths(text: Column) -> Column:
    """Absolute paths in messages replaced by a marker.

    Possessive, which matches the same: a repeated group that can backtrack recurses once per repeat and ends the JVM on long paths.
    """
    return F.regexp_replace(text, r"(?:/[\w.\-]++){2,}+", "<path>")


def first_content_word(text: Column, stop: list[str]) -> Column:
    ws = F.filter(tokens(text, 3), lambda t: ~t.isin(*stop))
    return F.when(F.size(ws) > 0, ws[0])


def clock(sec: Column) -> Column:
    """mm:ss."""
    s = F.floor(F.greatest(sec, F.lit(0.0)))
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def clock_cs(sec: Column) -> Column:
    """h:mm:ss.cc."""
    cs = F.bround(F.greatest(sec, F.lit(0.0)) * 100).cast("long")
    return F.format_string(
        "%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100
    )
