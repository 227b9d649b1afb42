"""Walks over object graphs: edges (doc, src, key, ord, dst).

A walk goes level by level: each level joins the frontier with the edges and drops what was reached before,
so cycles end and every edge is followed once. Levels are written down, which keeps plans short and lets
a lost executor cost one level. The number of levels is the graph's depth, not its size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder of spark.checkpoint.dir; where that is unset, in local mode, in one of our own."""
    spark: SparkSession = df.sparkSession
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not there:
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="leafmill-"))
        there = _own[0]
    path = f"{there.rstrip('/')}/leafmill-walk/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reach(edges: DataFrame, roots: DataFrame, doc: str = "doc", skip: list[str] | None = None) -> DataFrame:
    """(doc, node, level, path): every node that roots (doc, node) reach, once, at its least level, with the
    least path of keys that leads there. Edges of the keys in skip aren't followed."""
    e = edges.where(~F.col("key").isin(skip)) if skip else edges
    step = F.concat(F.lit("/"), F.col("key"), F.when(F.col("ord").isNotNull(), F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("]"))).otherwise(""))
    e = e.select(F.col(doc).alias("_d"), F.col("src").alias("_s"), F.col("dst").alias("_t"), step.alias("_k"))
    seen = kept(roots.select(doc, "node").distinct().select(doc, "node", F.lit(0).alias("level"), F.lit("").alias("path")))
    front, level = seen, 0
    while True:
        level += 1
        nxt = front.join(e, (F.col(doc) == F.col("_d")) & (F.col("node") == F.col("_s"))).select(doc, F.col("_t").alias("node"), F.concat("path", "_k").alias("path"))
        nxt = nxt.groupBy(doc, "node").agg(F.min("path").alias("path"))
        front = kept(nxt.join(seen.select(doc, "node"), [doc, "node"], "left_anti").select(doc, "node", F.lit(level).alias("level"), "path"))
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def depths(edges: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, node, level): the longest way from a node down to a leaf, level by level from the leaves. Nodes
    on a cycle, and those above one, have no row: nothing can be computed for them bottom-up."""
    e = kept(edges.select(doc, "src", "dst").distinct())
    nodes = e.select(doc, F.col("src").alias("node")).union(e.select(doc, F.col("dst").alias("node"))).distinct()
    done = kept(nodes.join(e.select(doc, F.col("src").alias("node")), [doc, "node"], "left_anti").withColumn("level", F.lit(0)))
    while True:
        kids = e.join(done.withColumnRenamed("node", "dst"), [doc, "dst"], "left")
        ready = kids.groupBy(doc, F.col("src").alias("node")).agg((F.max("level") + 1).alias("level"), F.count("*").alias("n"), F.count("level").alias("k")).where("n = k").select(doc, "node", "level")
        new = kept(ready.join(done.select(doc, "node"), [doc, "node"], "left_anti"))
        if new.isEmpty():
            return done
        done = done.union(new)


def sizes(reached: DataFrame, objects: DataFrame, doc: str, root: str, overhead: int = 0) -> DataFrame:
    """(doc, root, size): the sizes (doc, node, size) of all that each root reaches, shared objects once."""
    x = reached.select(doc, root, "node").distinct().join(objects, [doc, "node"])
    return x.groupBy(doc, root).agg(F.sum(F.col("size") + overhead).alias("size"))


def up(parents: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, count): each node's own count and those of all below it, each once; parents (node, parent). On a cycle
    every node is below every other, and the walk ends when it finds no new pair."""
    p = parents.select(F.col("node").alias("at"), "parent").distinct()
    seen = front = kept(counts.groupBy("node").agg(F.sum("count").alias("count")).select(F.col("node").alias("origin"), "node", "count"))
    while True:
        above = front.join(p, F.col("node") == F.col("at")).select("origin", F.col("parent").alias("node"), "count").distinct()
        front = kept(above.join(seen.select("origin", "node"), ["origin", "node"], "left_anti"))
        if front.isEmpty():
            return seen.groupBy("node").agg(F.sum("count").alias("count"))
        seen = seen.union(front)


def drop_references(edges: DataFrame, valid: DataFrame, doc: str = "doc") -> DataFrame:
    """edges whose target is no valid (doc, node) with dst null."""
    v = valid.select(F.col(doc).alias("_d"), F.col("node").alias("_n"), F.lit(True).alias("_ok"))
    x = edges.join(v, (F.col(doc) == F.col("_d")) & (F.col("dst") == F.col("_n")), "left")
    return x.withColumn("dst", F.when(F.col("_ok"), F.col("dst"))).drop("_d", "_n", "_ok")
