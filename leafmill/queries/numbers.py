"""Formats of sizes, numbers and ranges; page ranges and properties as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import numbers as N
from leafmill.functions import strings as S
from leafmill.queries import query, table

_TRIM = lambda x, k: f"regexp_replace(regexp_replace(printf('%.{k}f', {x}), '0+$', ''), '\\.$', '')"
_SHORT = lambda x: f"CASE WHEN {x} < 10 THEN {_TRIM(f'round_even({x} * 10, 0) / 10', 2)} ELSE {_TRIM(f'round_even({x}, 0)', 2)} END"


@query(
    "r1_size_format",
    f"""WITH x AS (SELECT p_partkey, CAST(p_partkey * p_size * 977 AS DOUBLE) AS n FROM part)
    SELECT p_partkey, CASE WHEN n < 1024 THEN {_SHORT('n')} || 'K' WHEN n / 1024 < 1024 THEN {_SHORT('(n / 1024)')} || 'M' WHEN n / 1048576 < 1024 THEN {_SHORT('(n / 1048576)')} || 'G' ELSE {_SHORT('(n / 1073741824)')} || 'T' END AS size FROM x""",
)
def r1_size_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", N.size_text(F.col("p_partkey") * F.col("p_size") * 977, "K").alias("size"))


@query("r2_thousands", "SELECT o_orderkey, regexp_replace(format('{:,}', CAST(o_totalprice * 1000 AS BIGINT)), '^$', '0') AS n FROM orders")
def r2_thousands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", N.with_commas(F.round(F.col("o_totalprice") * 1000).cast("long")).alias("n"))


@query("r3_number_print", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_TRIM('l_quantity * l_discount', 6)} AS printed FROM lineitem")
def r3_number_print(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.trimmed(F.col("l_quantity") * F.col("l_discount"), 6).alias("printed"))


@query("r4_scalar_list", "SELECT n_nationkey, n_name AS back, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END AS n FROM nation")
def r4_scalar_list(spark: SparkSession, d: str) -> DataFrame:
    """A scalar as a list, and a list of one as a scalar again."""
    one = S.as_list(F.col("n_name"))
    wrapped = F.when(F.col("n_nationkey") % 2 == 0, one).otherwise(F.array("n_name", "n_name"))
    return table(spark, d, "nation").select("n_nationkey", F.coalesce(S.as_scalar(one), F.lit("")).alias("back"), F.size(wrapped).alias("n"))


@query("r5_soft_hyphen", "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text || chr(173) ELSE text || '.' END) AS digest, doc_id % 2 = 0 AS hyphen FROM documents")
def r5_soft_hyphen(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, every other one with a hyphen after it."""
    text = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "-").otherwise("."))
    return table(spark, d, "documents").select("doc_id", F.md5(S.soft_hyphen(text)).alias("digest"), text.endswith("-").alias("hyphen"))


@query("r6_properties", "SELECT event_id, CAST(value AS INT) AS x0, event_type AS image, CAST(user_id AS INT) % 7 AS ppageno FROM events")
def r6_properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties in the title of a recognised element, as a map."""
    v = F.format_string("%d", F.rint("value").cast("int"))
    title = F.concat(F.lit('image "'), "event_type", F.lit('"; bbox '), v, F.lit(" 0 9 9; ppageno "), (F.col("user_id") % 7).cast("string"))
    p = S.title_properties(title)
    box = F.transform(F.split(p["bbox"], " +"), lambda x: x.try_cast("int"))
    return table(spark, d, "events").select("event_id", box[0].alias("x0"), p["image"].alias("image"), p["ppageno"].cast("int").alias("ppageno"))


@query(
    "a6_ranges_text",
    """WITH x AS (SELECT DISTINCT o_custkey, o_orderkey % 200 AS n FROM orders),
    g AS (SELECT o_custkey, n, n - row_number() OVER (PARTITION BY o_custkey ORDER BY n) AS g FROM x),
    r AS (SELECT o_custkey, min(n) AS a, max(n) AS b FROM g GROUP BY o_custkey, g)
    SELECT o_custkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM r GROUP BY 1""",
)
def a6_ranges_text(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set((F.col("o_orderkey") % 200).cast("int")).alias("ns"))
    return x.select("o_custkey", N.ranges_of(F.col("ns")).alias("ranges"))


@query(
    "a7_ranges_parse",
    """WITH x AS (SELECT p_partkey, p_size, unnest(list_distinct(generate_series(p_size, p_size + 4) || generate_series(p_size + 2, p_size + 6) || [1])) AS n FROM part)
    SELECT p_partkey, count(*) AS n, sum(n)::BIGINT AS total, false AS bad FROM x GROUP BY 1""",
)
def a7_ranges_parse(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    text = F.concat(s.cast("string"), F.lit("-"), (s + 4).cast("string"), F.lit(", "), (s + 2).cast("string"), F.lit(" - "), (s + 6).cast("string"), F.lit(",1"))
    x = table(spark, d, "part").select("p_partkey", N.numbers_of(text).alias("ns"), N.numbers_of(F.concat(text, F.lit(",x"))).isNotNull().alias("bad"))
    return x.select("p_partkey", F.size("ns").cast("long").alias("n"), F.aggregate("ns", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), "bad")
