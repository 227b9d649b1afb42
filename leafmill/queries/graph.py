"""Object graphs: regions hold nations, nations customers, customers orders; parts share brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.operators import graph as O
from leafmill.queries import query, table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Tree of region, nation, customer, order, with an edge from each order back to its region's nation."""
    e = lambda df, kind, key: df.select(F.lit(1).alias("doc"), F.col("s").cast("string").alias("src"), F.lit(key).alias("key"), F.lit(None).cast("int").alias("ord"), F.col("t").cast("string").alias("dst"))
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("s"), F.concat(F.lit("n"), "n_nationkey").alias("t"))
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("s"), F.concat(F.lit("c"), "c_custkey").alias("t"))
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("s"), F.concat(F.lit("o"), "o_orderkey").alias("t"))
    back = o.select(F.col("t").alias("s"), F.col("s").alias("t"))
    return e(n, "n", "Kids").union(e(c, "c", "Kids")).union(e(o, "o", "Kids")).union(e(back, "b", "Parent"))


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.lit(1).alias("doc"), F.concat(F.lit("r"), "r_regionkey").alias("node"))


TREE = """WITH t AS (SELECT 'r' || r_regionkey AS node, 0 AS level, '' AS path FROM region
    UNION ALL SELECT 'n' || n_nationkey, 1, '/Kids' FROM nation
    UNION ALL SELECT 'c' || c_custkey, 2, '/Kids/Kids' FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'o' || o_orderkey, 3, '/Kids/Kids/Kids' FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query("g1_reach", f"{TREE} SELECT DISTINCT node, level FROM t")
def g1_reach(spark: SparkSession, d: str) -> DataFrame:
    """Every object once, across cycles: here orders point back to their customers."""
    return O.reach(_edges(spark, d), _roots(spark, d)).select("node", "level")


@query("g2_paths", f"{TREE} SELECT DISTINCT node, path FROM t")
def g2_paths(spark: SparkSession, d: str) -> DataFrame:
    return O.reach(_edges(spark, d), _roots(spark, d), skip=["Parent"]).select("node", "path")


@query(
    "g3_levels",
    """SELECT 'r' || r_regionkey AS node, CASE WHEN r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey) THEN 3 WHEN r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey) THEN 2 ELSE 1 END AS level FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""",
)
def g3_levels(spark: SparkSession, d: str) -> DataFrame:
    """Forms are worked from the innermost out: how far each root is from its leaves."""
    e = _edges(spark, d).where("key = 'Kids'")
    return O.depths(e).where("node like 'r%'").select("node", "level")


@query("g4_propagation", "SELECT c_custkey, CAST(count(*) AS BIGINT) AS chunks, round(sum(o_orderkey * 2.0 + c_nationkey) / 1000, 3) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def g4_propagation(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a form on its page: the page's matrix times the chunk's."""
    forms = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), G.mat(1, 0, 0, 1, F.col("o_orderkey"), 0).alias("m"))
    pages = table(spark, d, "customer").select("c_custkey", G.mat(2, 0, 0, 2, F.col("c_nationkey"), 0).alias("ctm"))
    x = forms.join(pages, "c_custkey").withColumn("m", G.mat_mul(F.col("ctm"), F.col("m")))
    return x.groupBy("c_custkey").agg(F.count("*").alias("chunks"), F.round(F.sum(F.col("m")[4]) / 1000, 3).alias("x"))


@query("g5_count_propagation", "SELECT 'r' || n_regionkey AS node, CAST(count(*) AS BIGINT) AS count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def g5_count_propagation(spark: SparkSession, d: str) -> DataFrame:
    parents = _edges(spark, d).where("key = 'Kids'").select(F.col("dst").alias("node"), F.col("src").alias("parent"))
    leaves = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.lit(1).alias("count"))
    return O.up(parents, leaves).where("node like 'r%'")


@query("a2_object_sizes", "SELECT p_size, CAST(sum(n) + 10 * count(*) AS BIGINT) AS size FROM (SELECT DISTINCT p_size, p_brand, length(p_brand) AS n FROM part) GROUP BY 1")
def a2_object_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Brands that several parts of a size share count once."""
    p = table(spark, d, "part").select(F.lit(1).alias("doc"), "p_size", F.col("p_brand").alias("node"))
    objects = p.select("doc", "node", F.length("node").cast("long").alias("size")).distinct()
    return O.sizes(p, objects, "doc", "p_size", 10).select("p_size", "size")


@query("a10_fonts_used", "SELECT DISTINCT n_regionkey, c_mktsegment AS font FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE regexp_matches(c_mktsegment, '^(A|B|M)')")
def a10_fonts_used(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where(F.col("c_mktsegment").rlike("^(A|B|M)")).select("c_nationkey", F.col("c_mktsegment").alias("font"))
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "font").distinct()


@query("o7_dropped_references", "SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN 'c' || o_custkey END AS dst FROM orders JOIN customer ON o_custkey = c_custkey")
def o7_dropped_references(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select(F.lit(1).alias("doc"), "o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("dst"))
    v = table(spark, d, "customer").where("c_acctbal > 0").select(F.lit(1).alias("doc"), F.concat(F.lit("c"), "c_custkey").alias("node"))
    return O.drop_references(e, v).select("o_orderkey", "dst")
