"""Pages of documents: customers are documents, their orders pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import pages as O
from leafmill.queries import query, table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return O.renumber(o, "o_custkey", "o_orderkey")


PAGES = "p AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders)"


@query("s5_page_remove", f"WITH {PAGES} SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY page) AS page FROM p WHERE NOT page IN (2, 5)")
def s5_page_remove(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    return O.remove(p, p.where("page in (2, 5)"), "o_custkey", "page").select("o_custkey", "o_orderkey", F.col("page").cast("long").alias("page"))


@query(
    "s6_page_insert",
    f"WITH {PAGES}, n AS (SELECT c_custkey AS o_custkey, -c_custkey AS o_orderkey, CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 1000 END AS page, 0 AS new FROM customer), b AS (SELECT o_custkey, o_orderkey, page, 1 AS new FROM p UNION ALL SELECT * FROM n) SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY b.page, new) AS page FROM b",
)
def s6_page_insert(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    new = table(spark, d, "customer").select(k.alias("o_custkey"), (-k).alias("o_orderkey"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 3).otherwise(1000).alias("page"))
    return O.insert(_pages(spark, d).select("o_custkey", "o_orderkey", "page"), new, "o_custkey", "page").select("o_custkey", "o_orderkey", F.col("page").cast("long").alias("page"))


@query("s7_page_copy", f"WITH {PAGES} SELECT o_custkey, page, CASE WHEN page = 1 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM p")
def s7_page_copy(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d)
    content = p.where("page = 1").select("o_custkey", "page", F.lit(0.0).alias("o_totalprice"))
    return O.replace(p, content, ["o_custkey", "page"], "o_totalprice").select("o_custkey", F.col("page").cast("long").alias("page"), "o_totalprice")


@query("o3_first_match", "SELECT p_brand, arg_min(p_partkey, p_name || '|' || lpad(CAST(p_partkey AS VARCHAR), 12, '0')) AS p_partkey FROM part WHERE p_size > 25 GROUP BY 1")
def o3_first_match(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")
    p = table(spark, d, "part").where("p_size > 25").select("p_brand", "p_name", "p_partkey")
    return p.withColumn("n", F.row_number().over(w)).where("n = 1").select("p_brand", "p_partkey")


@query("s13_font_search", "SELECT s_nationkey, arg_min(s_suppkey, s_suppkey) AS s_suppkey FROM supplier WHERE s_name LIKE '%7%' GROUP BY 1")
def s13_font_search(spark: SparkSession, d: str) -> DataFrame:
    """The first file of the searched folders whose name matches."""
    s = table(spark, d, "supplier").where(F.col("s_name").contains("7"))
    return s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"))


@query("o4_page_selection", f"WITH {PAGES} SELECT o_custkey, page FROM p WHERE page IN (1, 3, 4, 5, 9)")
def o4_page_selection(spark: SparkSession, d: str) -> DataFrame:
    return O.select(_pages(spark, d), F.lit("1,3-5,9"), "page").select("o_custkey", F.col("page").cast("long").alias("page"))


@query("j16_inherited", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, n_name) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j16_inherited(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    own, mid = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    return x.select("o_orderkey", O.inherited(own, mid, F.col("n_name")).alias("value"))


@query("j17_dictionary_keys", "SELECT event_id, event_type AS got, CAST(user_id AS VARCHAR) AS any_, NULL::VARCHAR AS missing FROM events")
def j17_dictionary_keys(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("Type"), "event_type", F.lit("ID"), F.col("user_id").cast("string"))
    get = lambda k: F.try_element_at(m, F.lit(k))
    return table(spark, d, "events").select("event_id", get("Type").alias("got"), F.coalesce(get("I"), get("ID")).alias("any_"), get("None").alias("missing"))
