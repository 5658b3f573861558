"""The registered queries of the text operators: each applies its operator to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wardline.llm.byte_bpe import encode_documents
from wardline.llm.common import read_table
from wardline.llm.divergence import source_divergence
from wardline.llm.exact_dedup import exact_duplicates
from wardline.llm.fingerprint import fingerprint_documents
from wardline.llm.near_dedup import near_duplicates
from wardline.llm.packing import pack_documents
from wardline.llm.quality import score_quality
from wardline.llm.secret_scan import scan_secrets
from wardline.llm.suffix_dedup import repeated_passages
from wardline.llm.toxicity import score_toxicity
from wardline.llm.trie_join import jaccard_join
from wardline.llm.url_filter import filter_urls, word_counts
from wardline.llm.whitening import whiten_embeddings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(function):
    QUERIES[function.__name__] = function
    return function


@register
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@register
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


SQL["op6_exact_dedup"] = """
WITH texts AS (
  SELECT doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM texts
"""


@register
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


@register
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return filter_urls(pages, word_counts(pages, "html"))


@register
def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))


@register
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=3, parts=85, whole=100)


@register
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))


@register
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"), words=3, parts=90, whole=100)


@register
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


SQL["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS of_lang FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT w.lang, w.source, w.term, count(*) AS c FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), sizes AS (
  SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM groups g
  LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
), langs AS (
  SELECT lang, count(*) AS v, sum(of_lang) AS n_lang FROM kept GROUP BY lang
), dense AS (
  SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c,
         CAST(1 + (1000000000 * CAST(coalesce(c.c, 0) + 2 AS BIGINT)) // CAST(s.n + 2 * l.v AS BIGINT) AS BIGINT) AS p,
         CAST(1 + (1000000000 * CAST(k.of_lang + 2 AS BIGINT)) // CAST(l.n_lang + 2 * l.v AS BIGINT) AS BIGINT) AS q
  FROM sizes s JOIN langs l ON s.lang = l.lang JOIN kept k ON s.lang = k.lang
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
), terms AS (
  SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM dense WHERE c > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (
    SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms
  ) WHERE rank <= 10
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked
"""


@register
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(read_table(spark, sf_dir, "embeddings"))
