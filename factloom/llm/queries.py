"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import read
from factloom.llm.jaccard_join import jaccard_components
from factloom.llm.langid import language_id
from factloom.llm.license_scan import license_scan
from factloom.llm.line_dedup import dedup_lines
from factloom.llm.media import text_media
from factloom.llm.mixing import mix
from factloom.llm.packing import pack
from factloom.llm.quality import quality_rules
from factloom.llm.toxicity import toxicity
from factloom.llm.warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"), temperature=0.5, epochs=1.0, seed="mix")
    return mixed.select("doc_id", "replica", "shuffle_key", "source", "lang", "n_chars", "text")


OP1_SQL = """
WITH sizes AS (
  SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY source
), totals AS (
  SELECT sum(size) AS size, sum(pow(CAST(size AS DOUBLE), 0.5)) AS weight FROM sizes
), rates AS (
  SELECT s.source, CASE WHEN s.size > 0 THEN round(pow(CAST(s.size AS DOUBLE), 0.5) / t.weight * t.size / s.size, 9) ELSE 0 END AS rate
  FROM sizes s, totals t
), terms AS (
  SELECT source, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) ELSE CAST(k = 0 AS DOUBLE) END AS p
  FROM rates, range(0, 200) r(k)
), cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
), draws AS (
  SELECT *, CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents
), copies AS (
  SELECT d.doc_id, count(*) AS n FROM draws d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= d.u GROUP BY d.doc_id
)
SELECT d.doc_id, r.k AS replica, md5('mix:order:' || d.doc_id || ':' || r.k) AS shuffle_key, d.source, d.lang, d.n_chars, d.text
FROM documents d JOIN copies USING (doc_id), range(0, 200) r(k) WHERE r.k < copies.n
"""


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary(), 2048)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read(spark, sf_dir, "pages"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
         max(page_id) OVER (PARTITION BY payload) AS owner
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND owner <> page_id THEN owner END AS refers_to
FROM d
"""


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), owners AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT doc_id, line, pos, coalesce(doc_id > owner, false) AS dropped
  FROM keyed LEFT JOIN owners USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_media_columns": op2_media_columns,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity_chain": op8_toxicity_chain,
    "op9_license_scan": op9_license_scan,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op1_source_mixing": OP1_SQL,
    "op5_warc": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
}
