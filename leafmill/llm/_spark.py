"""Spark helpers of the operators: tables in the shared folder, size-checked joins, components, ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A list of keys is broadcast up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows of one block of a distributed rank or prefix sum.
BLOCK_ROWS = 50_000

_own_dir: list[str] = []


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that Python workers hold; long texts come in large rows.

    The setting is the session's, so a lazy result is read with the batches of the operator that was called last.
    Results don't depend on it, and memory is bounded by bytes: the rows only bound batches of narrow rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a folder of our own, in local mode alone: on a cluster
    each executor would write to its own disk."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="leafmill-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table of written(); df must not be used again."""
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(keys: DataFrame, n: int | None = None) -> DataFrame:
    """keys with a broadcast hint if they are at most BROADCAST_ROWS, else as they are."""
    n = keys.count() if n is None else n
    return F.broadcast(keys) if n <= BROADCAST_ROWS else keys


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (node, root), root the least node of the component.

    Alternating large and small stars (Kiveris et al. 2014): every round is two shuffles of the
    edges, and the number of rounds is logarithmic. Each round is written to the shared folder.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least("u", F.min("v").over(Window.partitionBy("u")))
        big = both.withColumn("m", low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        w = F.min("v").over(Window.partitionBy("u"))
        star = big.withColumn("m", w).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")
        )
        nxt = written(star.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        now = nxt.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        drop_table(e)
        e = nxt
        if before == now:
            break
        before = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def blocks(n_rows: int, rows: int = BLOCK_ROWS) -> int:
    """Into how many blocks of about so many rows a rank over n_rows splits."""
    return max(1, -(-n_rows // rows))


def running(df: DataFrame, group: list[str], value: Column, order: list[Column], block: Column, out: str) -> DataFrame:
    """out = the sum of value over the rows of the group up to this one, in (block, order) order.

    Two levels: totals of each (group, block) are accumulated in a small table, then rows within
    their block. So no task holds a whole group, however hot. block must be monotone in the order.
    """
    x = df.withColumn("_b", block).withColumn("_v", value)
    each = x.groupBy(*group, "_b").agg(F.sum("_v").alias("_s"))
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_c"), F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_in", F.sum("_v").over(inner))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_b") == F.col("_c")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    each = written(each, "sums")
    return x.join(small(each), on).withColumn(out, F.col("_in") + F.col("_before")).drop("_b", "_v", "_in", "_before", "_c", *[f"_g{i}" for i in range(len(group))])
