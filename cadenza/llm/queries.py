"""Queries of the operators on the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontam, exact_dedup, jaccard_join, maxsketch, merkle, mixing, passages, pieces, pii, quality, secrets, sharding, vantage
from cadenza.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn

    return add


SHARDS = 8

_DRAW = "('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || {i}), 1, 13))::BIGINT"


def _best(n: int) -> str:
    tries = ", ".join(_DRAW.format(i=i) for i in range(n))
    return f"(list_position([{tries}], list_max([{tries}])) - 1)::INTEGER"


@query(
    "op1_rendezvous_sharding",
    f"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
crc AS (
  SELECT doc_id, n + 1 AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(range(n), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM sized, crc_table),
placed AS (
  SELECT doc_id, size, text_crc32, {_best(SHARDS)} AS shard, {_best(SHARDS + 1)} AS grown_shard,
    md5(coalesce(doc_id::VARCHAR, 'null') || ':' || size || ':' || text_crc32) AS o FROM crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY o, doc_id, size, text_crc32) - 1)::BIGINT AS slot, grown_shard
FROM placed
""",
)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    out = sharding.place(table(spark, sf, "documents"), key="doc_id", text="text", weights=[1.0] * SHARDS, grown=1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op5_pivotal_mixing")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    out = mixing.mix(table(spark, sf, "documents"), weights=(5, 2, 1), most=3.0)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query(
    "op6_chunk_recipes",
    r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
""",
)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf, "documents"))


SHINGLES = r"""
lowered AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM lowered)"""


@query(
    "op3_metric_jaccard_join",
    f"""
WITH RECURSIVE {SHINGLES},
flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS inter
    FROM flat x JOIN flat y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  WHERE 100 * inter >= 85 * (na + nb - inter)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, coalesce(k, 0)::BIGINT AS n_links
FROM sets LEFT JOIN low ON low.a = doc_id LEFT JOIN deg ON deg.a = doc_id
""",
)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.similarity_classes(table(spark, sf, "documents"), shingle=4, share=85)


@query(
    "op10_vantage_trees",
    """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
sound AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, x.e) DESC, x.vec_id) AS rank
  FROM sound q JOIN sound x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id AND len(q.e) = len(x.e))
WHERE rank <= 20
""",
)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vantage.nearest(e, key="vec_id", vector="embedding", is_query=F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=20, relax=1.0)


@query("op7_boosted_pii")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return pii.counted(pii.find(table(spark, sf, "documents")), "doc_id")


@query("op8_kneser_ney_quality")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_compression_novelty")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.counted(secrets.find(table(spark, sf, "documents")), "doc_id")


@query("op2_collinear_chains")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    out = passages.repeats(table(spark, sf, "documents"))
    return out.select("doc_id", F.col("other").alias("other_id"), "start", "end", "other_start", "other_end", "agree")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the machine keeps its public tokenizer files."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op4_piece_lattice")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf, "documents"), pieces.load_model(model_path()))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op13_winnowing_decontamination",
    f"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS MATERIALIZED (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM iw)),
spots AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS t FROM (
  SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
met AS MATERIALIZED (SELECT r, i, m, item_id FROM spots JOIN win USING (m, t)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM met) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS d FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM met WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(d, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
""",
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(
    "op11_max_sketch_search",
    f"""
WITH d AS (SELECT r, doc_id, t, count(*) AS tf FROM (SELECT row_number() OVER () AS r, doc_id, unnest({_WORDS}) AS t FROM documents) GROUP BY ALL),
length AS (SELECT r, sum(tf)::BIGINT AS n FROM d GROUP BY r),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM length),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM d GROUP BY t), total),
q AS (SELECT q, item_id, t, count(*) AS c FROM (SELECT row_number() OVER () AS q, item_id, unnest({_WORDS}) AS t FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT q, item_id, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN d USING (t) JOIN w USING (t) JOIN length USING (r), total GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
""",
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return maxsketch.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=20)


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _tree(leaves: str, group: str) -> str:
    """Levels of ternary trees over (group, i, h, n), and of each leaf the digests left and right of its way up, as 'left|right'."""
    return f"""SELECT {group}, 0 AS lvl, i, h, n FROM {leaves}
  UNION ALL SELECT {group}, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {{0}} WHERE n > 1 GROUP BY {group}, lvl, i // 3, n"""


_FOLD = "list_reduce([{0}] || path, lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2)))"
_PATH = "list(coalesce((SELECT string_agg(b.h, '' ORDER BY b.i) FROM {0} b WHERE b.g IS NOT DISTINCT FROM a.g AND b.lvl = a.lvl AND b.i // 3 = a.i // 3 AND b.i < a.i), '') || '|' || coalesce((SELECT string_agg(b.h, '' ORDER BY b.i) FROM {0} b WHERE b.g IS NOT DISTINCT FROM a.g AND b.lvl = a.lvl AND b.i // 3 = a.i // 3 AND b.i > a.i), '') ORDER BY a.lvl)"


@query(
    "op12_veb_merkle_manifest",
    f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
hashed AS MATERIALIZED (
  SELECT doc_id, source AS g, sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || {_field('text')}) AS h,
    sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || {_field("replace(text, chr(10), '')")}) AS cut,
    xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(doc_id::VARCHAR)), lambda k: ascii(substr(doc_id::VARCHAR, (k + 1)::BIGINT, 1))::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS crc
  FROM documents, crc_table),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed),
t AS ({_tree('leaves', 'g').format('t')}),
subs AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM (SELECT g AS s, 0 AS g, h FROM t WHERE n = 1)),
u AS ({_tree('subs', 'g').format('u')}),
-- every leaf's nodes on its way up, but for the last one
low AS (SELECT l.g, l.i AS leaf, {_PATH.format('t')} AS path FROM leaves l JOIN t a ON a.g IS NOT DISTINCT FROM l.g AND a.i = l.i // pow(3, a.lvl)::BIGINT AND a.n > 1 GROUP BY l.g, l.i),
high AS (SELECT s.s, {_PATH.format('u')} AS path FROM subs s JOIN u a ON a.i = s.i // pow(3, a.lvl)::BIGINT AND a.n > 1 GROUP BY s.s),
whole AS (
  SELECT l.doc_id, l.h, CASE WHEN crc % 2 = 0 THEN l.cut ELSE l.h END AS shown, s.h AS subroot, coalesce(low.path, []) || coalesce(high.path, []) AS path
  FROM leaves l JOIN subs s ON s.s IS NOT DISTINCT FROM l.g LEFT JOIN low ON low.g IS NOT DISTINCT FROM l.g AND low.leaf = l.i LEFT JOIN high ON high.s IS NOT DISTINCT FROM l.g)
SELECT doc_id, h AS leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
  {_FOLD.format('shown')} AS folded_root, {_FOLD.format('shown')} = (SELECT h FROM u WHERE n = 1) AS verified
FROM whole
""",
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    lost = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    return merkle.verify(docs, shown={"text": F.when(lost, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))})
