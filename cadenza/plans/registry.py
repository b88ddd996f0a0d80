"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS = r"""
arrs AS (SELECT doc_id AS source_id, string_split_regex(text, '[ \n\t\r]+') AS arr FROM documents),
raw_words AS (
  SELECT source_id, unnest(range(len(arr))) AS pos, unnest(arr) AS word FROM arrs),
numbered AS (
  SELECT source_id, pos, word, coalesce(sum(CASE WHEN regexp_matches(word, '[.!?…]$') THEN 1 ELSE 0 END)
      OVER (PARTITION BY source_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent FROM raw_words),
words AS (
  SELECT source_id, pos, word, start, round(start + 0.3::DOUBLE, 3) AS "end", sent FROM (
    SELECT source_id, pos, word, sent, round(pos * 0.4::DOUBLE + 0.9::DOUBLE * sent, 3) AS start FROM numbered) WHERE word <> '')"""

SENTENCES = WORDS + """,
sentences AS (SELECT *, ((sent * 37 + source_id) % 100) / 100.0::DOUBLE AS sim FROM (
  SELECT source_id, sent, min(start) AS start, max("end") AS "end", count(*) AS n_words, (sum(length(word) + 1) - 1)::BIGINT AS chars FROM words GROUP BY 1, 2))"""

SEGMENTS = """
segments AS (
  SELECT source_id, seg_idx, start, round(start + dur, 3) AS "end", text, speaker FROM (
    SELECT conv_id AS source_id, turn AS seg_idx, text, role AS speaker, length(text) * 0.06::DOUBLE AS dur,
      round(coalesce(sum(length(text) * 0.06::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        + 0.5::DOUBLE * turn, 3) AS start
    FROM conversations))"""

POINTS = """
points AS (SELECT user_id AS source_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, value, event_type AS kind FROM events)"""

EVIDENCE = """
ev0 AS (SELECT user_id AS source_id, event_id AS id, event_type AS agent, value, event_type || ' ' || props AS text,
   round(epoch_us(ts) / 1e6::DOUBLE - min(epoch_us(ts) / 1e6::DOUBLE) OVER (PARTITION BY user_id), 3) AS start FROM events),
evidence AS (SELECT source_id, id, agent, floor(start / 86400)::BIGINT AS chunk, start, round(start + 5 + value, 3) AS "end", text,
   least(1.0::DOUBLE, value / 500) AS strength FROM ev0)"""

CLIPS = EVIDENCE + """,
clips AS (SELECT source_id, id AS clip_id, chunk, start, round(start + 28 + id % 48, 3) AS "end", agent AS topic,
   (5 + id % 6)::DOUBLE AS score FROM evidence)"""

DENSE = CLIPS + """,
dense AS (SELECT source_id, clip_id, chunk, s AS start, round(s + "end" - start, 3) AS "end", topic, score
  FROM (SELECT *, round(start / 400, 3) AS s FROM clips))"""

ARCSEG = CLIPS + """,
arcseg AS (SELECT source_id, i // 12 AS arc_no, i % 12 AS seg_no, clip_id AS id,
  CASE topic WHEN 'click' THEN 'hook' WHEN 'view' THEN 'setup' WHEN 'error' THEN 'development' WHEN 'purchase' THEN 'peak' ELSE 'payoff' END AS role,
  start, round(start + dur, 3) AS "end", dur, score, clip_id % 2 = 0 AS closing FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start, clip_id) - 1 AS i, (28 + clip_id % 48) / 4.0::DOUBLE AS dur FROM clips))"""

VECTORS = """
vectors AS (SELECT label AS source_id, vec_id AS item_id, embedding::DOUBLE[] AS v FROM embeddings)"""


def query(name: str, oracle: str | None = None, ctes: tuple[str, ...] = (), recursive: bool = False):
    """Register a query; ``ctes`` are put before the oracle's own text."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            head = ""
            if ctes:
                head = ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(ctes)
            body = oracle.strip()
            sep = ""
            if ctes and body.startswith(","):
                sep = ""
            ORACLES[name] = f"{head}{sep}\n{body}"
        return fn

    return add
