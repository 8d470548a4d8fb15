"""The operators applied to whole tables: one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, codebooks, content_sort, html_template, id_files, katz, media, mixing, near_dup, resample, topk, url_lists
from .common import table


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.digest(table(spark, sf_dir, "pages"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"), width=4)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.digest(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.digest(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.result(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.judge(url_lists.fetched(pages), url_lists.derived_events(pages))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op12_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.groups(table(spark, sf_dir, "documents"))


def op13_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.digest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_template": op1_html_template,
    "op2_near_dup": op2_near_dup,
    "op3_bpe": op3_bpe,
    "op4_webp": op4_webp,
    "op5_top_k": op5_top_k,
    "op6_mixing": op6_mixing,
    "op7_katz": op7_katz,
    "op8_id_files": op8_id_files,
    "op9_resampling": op9_resampling,
    "op10_url_lists": op10_url_lists,
    "op11_token_align": op11_token_align,
    "op12_content_sort": op12_content_sort,
    "op13_filtering_lloyd": op13_filtering_lloyd,
}

OP10_SQL = r"""
WITH captures AS (
  SELECT page_id, url,
         TIMESTAMP '2024-01-01' + to_days(('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 4))::INT % 365) AS fetched_at,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1)) AS part
  FROM pages),
known AS (SELECT DISTINCT host AS h, part, ('0x' || substr(md5(host), 1, 4))::INT AS n FROM captures WHERE host <> ''),
hosts AS (SELECT DISTINCT h, n FROM known),
domains AS (
  SELECT h, ('0x' || substr(md5(h), 1, 4))::INT AS n
  FROM (SELECT DISTINCT array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') AS h FROM hosts)),
events AS (
  SELECT 'hosts' AS list, 'block' AS verdict, h AS k, n % 200 AS d, 'add' AS event FROM hosts
  UNION ALL SELECT 'hosts', 'block', h, n % 200 + 60 + n % 50, 'remove' FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT 'hosts', 'block', h, n % 200 + 150, 'add' FROM hosts WHERE n % 6 = 0
  UNION ALL SELECT 'paths', 'allow', h || '/' || part, n % 300, 'add' FROM known WHERE n % 2 = 0 AND part <> ''
  UNION ALL SELECT 'domains', 'block', h, 30 + n % 100, 'add' FROM domains
  UNION ALL SELECT 'domains', 'block', h, 180 + n % 100, 'remove' FROM domains),
dated AS (SELECT list, verdict, k, event, TIMESTAMP '2024-01-01' + to_days(d::INT) AS happened FROM events),
intervals AS (
  SELECT * FROM (
    SELECT list, verdict, k, event, happened AS valid_from, lead(happened) OVER (PARTITION BY list, verdict, k ORDER BY happened, event) AS valid_to FROM dated)
  WHERE event = 'add' AND (valid_to IS NULL OR valid_to > valid_from)),
looked AS (
  SELECT page_id, fetched_at, host AS k FROM captures WHERE host <> ''
  UNION SELECT page_id, fetched_at, array_to_string(list_slice(labels, i, -1), '.')
        FROM (SELECT *, string_split(host, '.') AS labels FROM captures WHERE host <> ''), unnest(range(2, len(labels) + 1)) AS t(i)
  UNION SELECT page_id, fetched_at, host || '/' || part FROM captures WHERE host <> '' AND part <> ''),
hits AS (
  SELECT page_id, verdict, l.k, list, valid_from,
         row_number() OVER (PARTITION BY page_id ORDER BY verdict <> 'allow', length(l.k) DESC, l.k, list, valid_from) AS rn,
         count(*) OVER (PARTITION BY page_id) AS n
  FROM looked l JOIN intervals v ON l.k = v.k AND valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to))
SELECT c.page_id, c.url, c.fetched_at, coalesce(h.verdict, 'none') AS verdict, coalesce(h.n, 0) AS n_entries, h.k AS entry, h.valid_from AS listed_since
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.rn = 1
"""

OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST) AS place FROM texts)
SELECT doc_id, first(doc_id ORDER BY place) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256
FROM placed
"""

ORACLE_SQL = {"op10_url_lists": OP10_SQL, "op12_content_sort": OP12_SQL}
