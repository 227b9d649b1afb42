"""Pages of documents: order, insertion, removal, selection, contents and resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.numbers import numbers_of


def join_contents(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, digest, parts): the parts in order with line ends between, by the MD5 of the whole."""
    xs = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("t")))), lambda x: x["t"])
    return parts.groupBy(key).agg(F.md5(F.array_join(xs, "\n")).alias("digest"), F.count("*").alias("parts"))


def renumber(pages: DataFrame, doc: str, *order: Column | str) -> DataFrame:
    """pages with page: 1, 2, .. within the document."""
    return pages.withColumn("page", F.row_number().over(Window.partitionBy(doc).orderBy(*order)))


def remove(pages: DataFrame, gone: DataFrame, doc: str, page: str) -> DataFrame:
    """pages without those in gone (doc, page), numbered anew."""
    return renumber(pages.join(gone.select(doc, page).distinct(), [doc, page], "left_anti"), doc, page)


def insert(pages: DataFrame, new: DataFrame, doc: str, page: str) -> DataFrame:
    """pages and new ones, each before the page of its number: from 0 down first, beyond the end last."""
    both = pages.withColumn("_new", F.lit(1)).unionByName(new.withColumn("_new", F.lit(0)))
    return renumber(both, doc, page, "_new").drop("_new")


def replace(pages: DataFrame, content: DataFrame, keys: list[str], column: str) -> DataFrame:
    """pages with the content of those that content names, in their places."""
    return pages.join(content.withColumnRenamed(column, "_content"), keys, "left").withColumn(column, F.coalesce("_content", column)).drop("_content")


def select(pages: DataFrame, ranges: Column, page: str) -> DataFrame:
    """pages whose number lies in ranges such as 1-3,7."""
    return pages.where(F.array_contains(numbers_of(ranges), F.col(page)))


def inherited(own: Column, *ancestors: Column) -> Column:
    """A property of a page or else of its nearest ancestor that has it."""
    return F.coalesce(own, *ancestors)
