"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies: the source's share of the budget over
what the source holds. The expected copies are summed over the source's documents in a hashed order, a
random offset is added, and a document is emitted once for each integer that its step crosses. So each
source that max_epochs doesn't clip draws its expected number of documents to less than one, whatever the order.

Expected copies are whole millionths, so sums are exact and don't depend on the order of addition. The
prefix sum is distributed over blocks of the hashed order; a hot source is many blocks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm._spark import blocks, running, small, written

SCALE = 1_000_000
#: sample() repeats no source more often than this unless told otherwise; what it can't fill stays unfilled.
#: The registered queries pass math.inf: all sources meet their targets.
MAX_EPOCHS = 4.0
#: Copies of a row that are numbered at a time; a short text of a small source is drawn any number of times.
COPIES = 1_000
#: Rows of a block of the prefix sum; they carry their texts.
BLOCK_TEXTS = 2_000


def _hex(x: Column) -> Column:
    """The first 32 bits of an MD5 sum as a number."""
    return F.conv(F.substring(x, 1, 8), 16, 10).cast("long")


def plan(docs: DataFrame, weights: Mapping[str, float] | None, budget: float | None, max_epochs: float, seed: int, text: str = "text") -> DataFrame:
    """(src, e, u): each source's expected copies of a document and its offset, in millionths."""
    t = docs.groupBy(F.coalesce("source", F.lit("")).alias("src")).agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("double").alias("total"), F.count("*").alias("n"))
    if weights is None:
        t = t.withColumn("w", F.lit(1.0))
    elif weights:
        t = t.withColumn("w", F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("src")], F.lit(0.0)))
    else:
        t = t.withColumn("w", F.lit(0.0))
    t = written(t, "sources")
    s = t.agg(F.coalesce(F.sum(F.when(F.col("total") > 0, F.col("w"))), F.lit(0.0)).alias("w"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.sum("n").alias("n")).first()
    whole = s["total"] if budget is None else float(budget)
    share = F.lit(whole) * F.col("w") / F.lit(s["w"]) / F.col("total") if s["w"] > 0 else F.lit(0.0)
    e = F.when(F.col("total") > 0, F.floor(F.least(F.lit(float(max_epochs)), share) * SCALE)).otherwise(0).cast("long")
    u = _hex(F.md5(F.concat(F.lit(f"{seed}:"), F.col("src")))) % SCALE
    return t.select("src", e.alias("e"), u.alias("u"), F.lit(int(s["n"] or 0)).alias("n_all"))


def sample(
    spark: SparkSession,
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    budget: float | None = None,
    max_epochs: float = MAX_EPOCHS,
    seed: int = 1,
    text: str = "text",
    copy_column: str | None = "copy_no",
) -> DataFrame:
    """docs, each row as often as it is drawn (not at all, once or more), numbered from 1 in copy_column.

    weights: source -> weight (None: all sources alike; a source that isn't listed gets 0). budget: characters
    to emit in all (None: as many as there are). A source's target is budget * weight / sum of weights.
    max_epochs: the most expected copies of a document (math.inf: no bound, every target is met); what a clipped
    source leaves of the budget goes to no other source.
    A null source counts as the empty name. Null and empty texts hold no characters but are drawn like
    the others of their source; a source without any character yields nothing. Null doc_ids come first in
    the hashed order; repeated rows are drawn each by itself. No rows: no rows. Other columns stay as they
    are, whatever their names; copy_column=None adds none, a clashing name replaces the column.
    """
    p = written(plan(docs, weights, budget, max_epochs, seed, text), "plan")
    n = (p.agg(F.max("n_all")).first()[0]) or 0
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    x = docs.select(F.struct("*").alias("row"), F.coalesce("source", F.lit("")).alias("src"), key.alias("key"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"))
    x = x.join(small(p.select("src", "e", "u")), "src").where("e > 0")
    k = blocks(n, BLOCK_TEXTS)
    x = running(x, ["src"], F.col("e"), [F.col("key"), F.col("id"), F.col("h")], F.expr(f"({_hex_sql('key')} * {k}) div 4294967296"), "cum")
    copies = F.expr(f"(cum + u) div {SCALE} - (cum - e + u) div {SCALE}")
    # No struct passes the two explosions (Spark prunes its fields wrongly there), and no given name clashes.
    own = [F.col("row").getField(c).alias(f"__{i}") for i, c in enumerate(docs.columns)]
    x = x.select(*own, copies.alias("copies")).where("copies > 0")
    x = x.withColumn("first", F.explode(F.expr(f"sequence(1L, copies, {COPIES}L)")))
    x = x.withColumn("copy", F.explode(F.expr(f"cast(sequence(first, least(first + {COPIES - 1}, copies)) as array<int>)")))
    out = [F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() != (copy_column or "").lower()]
    return x.select(*out, *([F.col("copy").alias(copy_column)] if copy_column else []))


def _hex_sql(x: str) -> str:
    return f"cast(conv(substring({x}, 1, 8), 16, 10) as bigint)"
