"""Queries 5, 6 and 8 with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import linededup, mixing, warc


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with every source brought to a share of characters ** 0.7 by Poisson replication."""
    return mixing.mix(documents(spark, sf_dir))


OP5 = """
WITH per AS (
  SELECT source, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS mass FROM documents GROUP BY source
), shares AS (
  SELECT source, (pow(mass::DOUBLE, 0.7) / sum(pow(mass::DOUBLE, 0.7)) OVER ())
    * (CASE WHEN mass > 0 THEN (sum(mass) OVER ())::DOUBLE / mass ELSE count(*) OVER () END) AS rate FROM per
), steps AS (
  SELECT source, rate, unnest(range(greatest(0, floor(rate - 12 * sqrt(rate) - 20))::BIGINT, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM shares
), masses AS (
  SELECT source, k, CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END AS p,
    greatest(0, floor(rate - 12 * sqrt(rate) - 20))::BIGINT AS first FROM steps
), cdf AS (
  SELECT source, k, first, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM masses
), drawn AS (
  SELECT *, md5(coalesce(text, '')) AS digest,
    ('0x' || md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')))[1:13])::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.digest, any_value(c.first) + count(*) FILTER (WHERE c.c <= d.u) AS n
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, copy, md5('mix-1-order|' || coalesce(doc_id::VARCHAR, '') || '|' || digest || '|' || copy::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1))::INT AS copy FROM counted)
"""


def archive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as archive records: a full response of every page and a later not-modified revisit of its URL.

    pages carries no capture data, so times and validators follow from page_id and
    html: every fifth revisit holds another entity tag, every seventh a date
    only, every eleventh no validator, and revisits come under another spelling
    of the URL.
    """
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    i = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    day = F.concat(F.lit("day-"), F.pmod(i, F.lit(97)).cast("string"))
    when = (i * 7919) % 1000003 * 1000
    entry = lambda *kv: F.map_from_arrays(F.array(*[F.lit(k) for k in kv[::2]]), F.array(*kv[1::2]))
    response = p.select(
        (i * 2).alias("record_id"), F.lit("response").alias("record_type"), F.col("url").alias("target_uri"), when.alias("ts"), F.lit(200).alias("status"),
        F.when(i % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag).alias("etag"), day.alias("last_modified"),
        entry("Content-Type", F.lit("text/html"), "Content-Length", F.length("html").cast("string"), "ETag", tag, "Cache-Control", F.lit("max-age=60"), "X-Served-By", F.lit("origin")).alias("headers"),
        F.col("html").alias("payload"),
    )
    revisit = p.select(
        (i * 2 + 1).alias("record_id"), F.lit("revisit").alias("record_type"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("target_uri"), (when + 500).alias("ts"), F.lit(304).alias("status"),
        F.when((i % 7 == 0) | (i % 11 == 0), F.lit(None)).when(i % 5 == 0, F.lit('"changed"')).otherwise(tag).alias("etag"), F.when(i % 11 != 0, day).alias("last_modified"),
        entry("content-length", F.lit("0"), "cache-control", F.lit("max-age=3600"), "Date", when.cast("string")).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


def op6_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of archive_records() with its outcome, merged headers and payload."""
    records = archive_records(spark, sf_dir)
    return warc.with_payloads(warc.resolve_revisits(records), records)


OP6 = r"""
WITH base AS (
  SELECT page_id AS i, html, '"' || md5(html)[1:16] || '"' AS tag, 'day-' || (page_id % 97)::VARCHAR AS day, (page_id * 7919) % 1000003 * 1000 AS t,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare
  FROM pages
), split AS (
  SELECT *, regexp_extract(bare, '^([^?]*)', 1) AS front, list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))) AS q FROM base
), canon AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(front, '^([^/]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(front, '^[^/]*(.*)$', 1), '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_uri
  FROM split
), rev AS (
  SELECT i * 2 + 1 AS record_id, canonical_uri, t + 500 AS ts, CASE WHEN i % 7 = 0 OR i % 11 = 0 THEN NULL WHEN i % 5 = 0 THEN '"changed"' ELSE tag END AS tag,
    CASE WHEN i % 11 <> 0 THEN day END AS day, t AS sent FROM canon
), picked AS (
  SELECT r.*, max({'t': c.t, 'id': c.i * 2}) AS b FROM rev r LEFT JOIN canon c ON c.canonical_uri = r.canonical_uri AND c.t < r.ts GROUP BY ALL
), judged AS (
  SELECT p.*, c.i AS bi, c.html, c.tag AS btag, c.day AS bday FROM picked p LEFT JOIN canon c ON p.b.id = c.i * 2
), final AS (
  SELECT *, CASE WHEN bi IS NULL THEN 'no_base' WHEN tag IS NOT NULL THEN CASE WHEN tag = btag THEN 'resolved' ELSE 'mismatch' END
    WHEN day IS NOT NULL THEN CASE WHEN day = bday THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS outcome FROM judged
)
SELECT record_id, canonical_uri, ts, outcome, bi * 2 AS base_record_id, b.t AS base_ts,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=3600' || chr(10) || 'content-length: ' || length(html)::VARCHAR || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || sent::VARCHAR || chr(10) || 'etag: ' || btag || chr(10) || 'x-served-by: origin' END AS headers,
  CASE WHEN outcome = 'resolved' THEN html END AS payload
FROM final
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keep bitmap of every document's lines over all documents."""
    return linededup.keep_bitmaps(documents(spark, sf_dir)).drop("text_hash")


OP8 = r"""
WITH lines AS (
  SELECT doc_id, md5(coalesce(text, '')) AS h, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), keyed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM lines
), marked AS (
  SELECT doc_id, h, pos, CASE WHEN key = '' THEN 1 WHEN row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h, pos) = 1 THEN 1 ELSE 0 END AS keep FROM keyed
), islands AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, h, keep ORDER BY pos) AS island FROM marked
), runs AS (
  SELECT doc_id, h, keep, min(pos) AS start_at, count(*) AS n FROM islands GROUP BY doc_id, h, keep, island
), joined AS (
  SELECT doc_id, h, string_agg(n::VARCHAR, ',' ORDER BY start_at) AS r, sum(n) AS n_lines, sum(CASE WHEN keep = 1 THEN n ELSE 0 END) AS n_kept, min_by(keep, start_at) AS first FROM runs GROUP BY doc_id, h
)
SELECT doc_id, n_lines::INT AS n_lines, n_kept::INT AS n_kept, CASE WHEN first = 0 THEN '0,' || r ELSE r END AS keep_runs FROM joined
"""

QUERIES = {"op5_poisson_mixing": op5_poisson_mixing, "op6_revisit_resolution": op6_revisit_resolution, "op8_line_dedup": op8_line_dedup}
ORACLES = {"op5_poisson_mixing": OP5, "op6_revisit_resolution": OP6, "op8_line_dedup": OP8}
