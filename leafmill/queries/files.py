"""Files made of conversations and documents, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import graph
from leafmill.queries import query, table
from leafmill.queries.content import STREAM_SQL
from leafmill.sources import content as C
from leafmill.sources import pdf


def _files(spark: SparkSession, d: str, packed: bool) -> DataFrame:
    """Each conversation as a file with a page for every turn."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("c"))
    return t.select("conv_id", pdf.pages_file(F.transform("c", lambda x: x["text"]), packed).alias("content"))


@query("s1_file_round_trip", f"WITH {STREAM_SQL} SELECT doc_id, md5(stream) AS digest, 5::BIGINT AS objects FROM s")
def s1_file_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents' streams in files with a cross-reference table, read back."""
    s = C.with_streams(table(spark, d, "documents").select("doc_id", "lang", "text"))
    o = pdf.objects(s.select("doc_id", pdf.pages_file(F.array("stream")).alias("content")), "doc_id").where("obj_id > 0")
    return o.groupBy("doc_id").agg(F.max(F.md5(F.when(F.col("kind") == "stream", F.col("data")))).alias("digest"), F.count("*").alias("objects"))


@query("s3_object_streams", "SELECT conv_id, md5(string_agg(md5(text), '' ORDER BY turn)) AS digest, count(*) AS pages FROM conversations GROUP BY 1")
def s3_object_streams(spark: SparkSession, d: str) -> DataFrame:
    """Files whose page objects lie in object streams and whose cross-references are a stream."""
    o = pdf.objects(_files(spark, d, True), "conv_id")
    body = F.when((F.col("kind") == "stream") & F.col("type").isNull(), F.struct("obj_id", F.md5("data").alias("h")))
    x = o.groupBy("conv_id").agg(F.array_sort(F.collect_list(body)).alias("b"), F.count(F.when(F.col("type") == "Page", 1)).alias("pages"))
    return x.select("conv_id", F.md5(F.array_join(F.transform("b", lambda s: s["h"]), "")).alias("digest"), "pages")


@query("s2_file_graph", "SELECT conv_id, 3 + 2 * count(*) AS reached FROM conversations GROUP BY 1")
def s2_file_graph(spark: SparkSession, d: str) -> DataFrame:
    """Objects that a file's root reaches: catalog, tree, font, pages and contents."""
    o = pdf.objects(_files(spark, d, False), "conv_id")
    roots = o.where("kind = 'trailer'").select(F.col("conv_id").alias("doc"), F.explode("refs").alias("r")).where("r.key = 'Root'").select("doc", F.col("r.dst").alias("node"))
    return graph.reach(pdf.edges(o, "conv_id"), roots).groupBy(F.col("doc").alias("conv_id")).agg(F.count("*").alias("reached"))
