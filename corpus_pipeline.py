"""From raw documents to packed bins: language ID, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the
last return the columns of documents. run() writes each stage's result as Parquet in the shared folder
and reads it again as the next one's input, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import exact_dedup, language_id, mixing, near_dedup, packing
from leafmill.llm._spark import drop_table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: neither empty, nor without letters, nor in a foreign language.

    Null, empty and letterless texts go; rows with a null doc_id or label are judged alike but train nothing. Very long
    texts are read whole. Repeated rows are judged alike and all stay or go. Without labelled rows all go. No rows: no
    rows. Columns stay, whatever their names.
    """
    marked = language_id.identify(spark, docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang"))
    return marked.where("langid.predicted is not null").select("row.*")


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the least doc_id, null ids last, among equal ids any one.

    Null texts all stay, empty ones are copies of each other; very long texts are compared whole; of repeated rows one
    stays. No rows: no rows. Columns stay, whatever their names.
    """
    return exact_dedup.dedup(spark, docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id.

    Null, empty and wordless texts, and rows with a null doc_id, all stay; very long texts are compared whole; of
    repeated rows one stays. No rows: no rows. Columns stay, whatever their names.
    """
    return near_dedup.dedup(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources with equal weight; a document that is drawn more than once is there as often.

    A null source is the empty name; null and empty texts are drawn like the others of their source, but a source
    without any character yields nothing. Ties in the hashed order go by doc_id, nulls first, then by text; repeated
    rows are drawn each by itself. No rows: no rows. Columns stay, whatever their names.
    """
    return mixing.sample(spark, docs, max_epochs=math.inf, copy_column=None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces lie in bins of 8192 characters.

    Null and empty texts have one row of length 0 without a bin; very long texts are cut into pieces; rows with a null
    doc_id and repeated rows are packed each by itself. No rows: no rows. Only doc_id and text are read.
    """
    return packing.pack(spark, docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("exact_dedup", one_of_each_text),
    ("near_dedup", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language ID, near-dedup and packing can't be said in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents in order. A stage's table is deleted once the next one is written; that of the
    last but one stays in the shared folder, as the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        done = written(stage(spark, docs, sf_dir), name)
        if k:
            drop_table(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
