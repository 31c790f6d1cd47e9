"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cap_filters, language_id, ngram_join, packing, quality_model, quality_rules, secret_scan, suffix_dedup, warc
from .common import read


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The contract's columns are of 400 bytes; the text lacks passages of 50 words, most of which are shorter.
    return suffix_dedup.digests(read(spark, sf_dir, "documents"), passage=200, least_words=50)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(read(spark, sf_dir, "pages"))
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def remainder(by: int) -> F.Column:
    """crc32 of the id as text, modulo by: what decides who may be learned from."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % by


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> dict:
    """A quality model from the labelled rows of docs that may be learned from."""
    return quality_model.fit(docs, read(spark, sf_dir, "labels").where(remainder(3) != 1))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality_model.score(docs, quality(spark, docs, sf_dir)).select(
        "doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(remainder(4) != 2))
    return language_id.predict(docs, model).select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near(read(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(read(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_bpe, op3_packing, op4_warc, op5_ngram_join, op6_quality_model, op7_cap_filters, op8_quality_rules, op9_secret_scan, op10_language_id)}

OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
w AS (SELECT payload_digest, max(page_id) AS winner FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN winner IS NULL OR winner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN winner <> page_id THEN winner END AS refers_to
FROM d LEFT JOIN w USING (payload_digest)
"""

OP8_SQL = r"""
WITH raw AS (
  SELECT doc_id, coalesce('+' || lang, '-') AS g_lang, coalesce('+' || source, '-') AS g_source, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM raw
), base AS (
  SELECT doc_id, g_lang, g_source, words, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM split
), pos AS (
  SELECT doc_id, words, unnest(range(1, n_words - 1)) AS i FROM base WHERE n_words >= 3
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS c FROM pos
), rep AS (
  SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM win, range(3) t(k) WHERE c >= 2 GROUP BY 1
), f AS (
  SELECT b.* EXCLUDE (words), coalesce(n, 0) AS n_repeat_words,
    n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed,
    100 * word_chars // greatest(n_words, 1) AS f_len, 10000 * n_symbols // greatest(word_chars, 1) AS f_sym,
    1000 * n_dup_lines // greatest(n_lines, 1) AS f_dup, 1000 * coalesce(n, 0) // greatest(n_words, 1) AS f_rep
  FROM base b LEFT JOIN rep USING (doc_id)
), long AS (
  SELECT g_lang, g_source, u.feature, u.x FROM f,
    LATERAL (VALUES ('f_len', f_len, 60), ('f_sym', f_sym, 100), ('f_dup', f_dup, 100), ('f_rep', f_rep, 60)) u(feature, x, w) WHERE NOT base_failed
), low AS (
  SELECT g_lang, g_source, feature, CASE WHEN x < 64 THEN x ELSE (x >> (length(bin(x)) - 6)) << (length(bin(x)) - 6) END AS b FROM long
), lv AS (
  SELECT 0 AS level, g_lang, g_source, feature, b FROM low UNION ALL SELECT 1, g_lang, '', feature, b FROM low UNION ALL SELECT 2, '', '', feature, b FROM low
), q AS (
  SELECT level, g_lang, g_source, feature, count(*) AS total,
    list_sort(list(b))[CAST(ceil(count(*) / 4.0) AS BIGINT)] AS q1, list_sort(list(b))[CAST(ceil(3 * count(*) / 4.0) AS BIGINT)] AS q3
  FROM lv GROUP BY 1, 2, 3, 4
), fence AS (
  SELECT level, g_lang, g_source, feature, total,
    q1 - 4 * greatest(q3 - q1, CASE feature WHEN 'f_len' THEN 60 WHEN 'f_rep' THEN 60 ELSE 100 END) AS lo,
    q3 + 4 * greatest(q3 - q1, CASE feature WHEN 'f_len' THEN 60 WHEN 'f_rep' THEN 60 ELSE 100 END) AS hi FROM q
), use AS (
  SELECT g.g_lang, g.g_source, a.feature,
    CASE WHEN s.total >= 200 THEN s.lo WHEN l.total >= 200 THEN l.lo ELSE a.lo END AS lo,
    CASE WHEN s.total >= 200 THEN s.hi WHEN l.total >= 200 THEN l.hi ELSE a.hi END AS hi
  FROM (SELECT DISTINCT g_lang, g_source FROM f) g CROSS JOIN (SELECT * FROM fence WHERE level = 2) a
  LEFT JOIN fence s ON s.level = 0 AND s.g_lang = g.g_lang AND s.g_source = g.g_source AND s.feature = a.feature
  LEFT JOIN fence l ON l.level = 1 AND l.g_lang = g.g_lang AND l.feature = a.feature
), bad AS (
  SELECT DISTINCT f.doc_id FROM f JOIN use USING (g_lang, g_source)
  WHERE CASE feature WHEN 'f_len' THEN f_len WHEN 'f_sym' THEN f_sym WHEN 'f_dup' THEN f_dup ELSE f_rep END NOT BETWEEN lo AND hi
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND bad.doc_id IS NULL AS kept FROM f LEFT JOIN bad USING (doc_id)
"""

OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS sh FROM w
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
t AS (SELECT doc_id, unnest(sh) AS sh FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n_shingles + y.n_shingles - shared)
), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS root FROM (SELECT DISTINCT a FROM u) UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1)
SELECT doc_id, n_shingles, coalesce(root, doc_id) AS component_id FROM n LEFT JOIN c USING (doc_id)
"""

ORACLE_SQL = {"op4_warc": OP4_SQL, "op5_ngram_join": OP5_SQL, "op8_quality_rules": OP8_SQL}
