"""Queries of the training-data operators over the supplied tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import ann, exact_dedup, html_text, language_id, mixing, near_dedup, packing, substring_dedup, token_blocks, warc


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pieces and their places in bins."""
    return packing.pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of near duplicates."""
    return near_dedup.assign(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first copy and number of copies."""
    return exact_dedup.assign(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours, among all vectors, of every vector whose id is divisible by 50."""
    return ann.neighbours(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("vec_id") % 50 == 0)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a mix of all sources with equal weight draws."""
    return mixing.sample(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), max_epochs=math.inf).select("doc_id", "source", "copy_no")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 50 words or more that repeat across documents."""
    return substring_dedup.repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, read from WARC files that hold them."""
    return warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language family and language as predicted from its whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return language_id.identify(spark, docs).select("doc_id", "lang", "langid.*", F.col("langid.predicted").isNotNull().alias("accepted"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids as patched frame-of-reference blocks."""
    return token_blocks.write_tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_source_mixing": op5_source_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_warc_reader": op7_warc_reader,
    "op8_language_id": op8_language_id,
    "op9_html_extraction": op9_html_extraction,
    "op10_token_blocks": op10_token_blocks,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id,
               CASE WHEN text IS NULL THEN doc_id ELSE coalesce(min(doc_id) OVER (PARTITION BY text), doc_id) END AS keep_id,
               CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS copies
        FROM documents""",
    "op5_source_mixing": """
        WITH per_source AS (
            SELECT coalesce(source, '') AS src, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS total
            FROM documents GROUP BY 1),
        whole AS (SELECT sum(total) AS budget, CAST(count(*) FILTER (WHERE total > 0) AS DOUBLE) AS w FROM per_source),
        plan AS (
            SELECT src, CASE WHEN total > 0 THEN CAST(floor(budget * 1.0::DOUBLE / w / total * 1000000) AS BIGINT) ELSE 0 END AS e,
                   CAST('0x' || substr(md5('1:' || src), 1, 8) AS BIGINT) % 1000000 AS u
            FROM per_source, whole),
        placed AS (
            SELECT doc_id, source, e, u,
                   CAST(sum(e) OVER (PARTITION BY src ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
            FROM documents JOIN plan ON coalesce(source, '') = src WHERE e > 0),
        drawn AS (SELECT doc_id, source, (cum + u) // 1000000 - (cum - e + u) // 1000000 AS copies FROM placed)
        SELECT doc_id, source, CAST(unnest(generate_series(1, copies)) AS INTEGER) AS copy_no FROM drawn WHERE copies > 0""",
    "op7_warc_reader": """
        SELECT page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url, html, strlen(html) AS n_bytes, true AS digest_ok
        FROM pages""",
}
