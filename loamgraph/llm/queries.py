"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact, html, lines, minhash, mixing, secrets, toxicity, urls, warc
from .common import table
from .secrets_sql import secrets_sql


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(spark, f"{sf_dir}/documents.parquet")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's line counts and the digest and length of what is left of its text."""
    left = lines.dedup_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", "n_lines", "n_cut", F.char_length(text).cast("long").alias("left_chars"), F.sha2(text, 256).alias("left_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_mixing": op2_mixing,
    "op3_html": op3_html,
    "op4_decontam": op4_decontam,
    "op5_exact": op5_exact,
    "op6_lines": op6_lines,
    "op7_warc": op7_warc,
    "op8_urls": op8_urls,
    "op9_minhash": op9_minhash,
    "op10_toxicity": op10_toxicity,
}

#: What SQL can't express (training, alignment, similarity, page structure, edit distance) is tested against brute force in tests/llm.
ORACLE: dict[str, str] = {
    "op1_secrets": secrets_sql(),
    "op2_mixing": """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
r AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(t)) || ':0'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / CASE WHEN t = '' THEN 1.0::DOUBLE ELSE greatest(0.05::DOUBLE, CAST(length(translate(t, '#$%&*@{}[]<>|^~=_', '')) AS DOUBLE) / length(t)) END AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, 3.0::DOUBLE * source_size AS cap, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
o AS (SELECT *, cap / weight AS ratio,
  ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS share
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CASE WHEN ratio <= (SELECT arg_min(share, ratio) FROM o WHERE ratio > share) THEN cap ELSE weight * coalesce((SELECT arg_min(share, ratio) FROM o WHERE ratio > share), 0) END AS target FROM o),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-9), 3) ELSE 0 END AS epochs FROM g),
q AS (SELECT *, greatest(0, target - epochs * source_size) AS left_over FROM p),
x AS (SELECT r.doc_id, r.size, q.*, coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY key, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN before + size / 2.0::DOUBLE <= left_over AND epochs < 3 AND left_over > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x""",
    "op5_exact": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) WINDOW w AS (PARTITION BY t)""",
    "op7_warc": """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN strlen(h) >= 1000 AND page_id <> max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h FROM pages) WINDOW w AS (PARTITION BY h)""",
}
