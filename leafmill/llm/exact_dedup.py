"""Exact dedup with composable polynomial fingerprints.

A text's bytes are hashed in chunks that don't depend on each other; the hashes of neighbouring chunks
compose by length-shifted arithmetic, H(ab) = H(a) + B**len(a) * H(b) modulo a prime, so chunks may be
hashed in any order, in parallel and in pieces. Texts with equal length and equal fingerprints under two
bases are then compared chunk by chunk with their group's first text, so the result is exact.

Fingerprints of all texts are computed once, into a narrow table. Only texts that share one are shuffled. Hot groups are safe: groups are counted and their
first row chosen with partial aggregation, and the compared rows join one row a group, which adaptive
execution splits when it is skewed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import _kernels as K
from leafmill.llm._spark import arrow_batches, small, written

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 69_069_069)
#: Bytes of a row of the chunkwise comparison.
COMPARE_BYTES = 1 << 20
_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(base: int) -> np.ndarray:
    """base**0 .. base**(SEGMENT-1) modulo PRIME, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < K.SEGMENT:
        out = np.concatenate([out, out * pow(base, len(out), PRIME) % PRIME])
    return out[: K.SEGMENT]


def compose(a: tuple[int, int], b: tuple[int, int], base: int) -> tuple[int, int]:
    """(hash, length) of the concatenation, from those of its two parts."""
    return (a[0] + pow(base, a[1], PRIME) * b[0]) % PRIME, a[1] + b[1]


def fingerprints(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One int64 a row: the two 31-bit polynomial hashes side by side. An empty row has 0.

    The chunks are the parts of rows that fall into one segment of the batch; sums of a segment stay
    below 2**8 * 2**31 * 2**20 and so within 64 bits.
    """
    if not _TABLES:
        _TABLES.extend((_powers(b), _powers(pow(b, -1, PRIME))) for b in BASES)
    n = len(offs) - 1
    total = np.zeros((2, n), np.int64)
    for lo in range(0, len(data), K.SEGMENT):
        hi = min(lo + K.SEGMENT, len(data))
        r0, r1 = int(np.searchsorted(offs, lo, "right")) - 1, int(np.searchsorted(offs, hi, "left"))
        s, e = np.maximum(offs[r0:r1], lo) - lo, np.minimum(offs[r0 + 1 : r1 + 1], hi) - lo
        x = data[lo:hi].astype(np.int64)
        c = np.zeros(hi - lo + 1, np.int64)
        for k, (base, (up, down)) in enumerate(zip(BASES, _TABLES)):
            np.cumsum(x * up[: hi - lo], out=c[1:])
            h = (c[e] - c[s]) % PRIME * down[np.minimum(s, K.SEGMENT - 1)] % PRIME
            if offs[r0] < lo:  # the rest of a row that an earlier segment began
                h[0] = h[0] * pow(base, lo - int(offs[r0]), PRIME) % PRIME
            total[k, r0:r1] = (total[k, r0:r1] + h) % PRIME
    return total[0] << 31 | total[1]


def _fingerprint(col: pa.Array) -> pa.Array:
    return pa.array(fingerprints(*K.text_bytes(col)), pa.int64())


def fingerprint(*cols: Column | str) -> Column:
    """Fingerprint of each row, as an Arrow function."""
    return F.arrow_udf(_fingerprint, "long")(*cols)


def same_text(a: Column, b: Column) -> Column:
    """Whether two texts of equal length are equal, a chunk at a time and no further than the first difference."""
    a, b = a.cast("binary"), b.cast("binary")
    n = F.greatest(F.ceil(F.octet_length(a) / COMPARE_BYTES), F.lit(1)).cast("int")
    part = lambda x, i: F.substring(x, i * COMPARE_BYTES + 1, F.lit(COMPARE_BYTES))
    return F.forall(F.sequence(F.lit(0), n - 1), lambda i: part(a, i) == part(b, i))


KEY = ["len", "fp"]


def _key(t: Column) -> list[Column]:
    return [F.octet_length(t).alias("len"), fingerprint(t).alias("fp")]


def _groups(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(marks, groups, ids, shared, mixed).

    marks: (id, len, fp) of every row, a narrow table for which all texts are hashed once. groups: keys of several
    rows, with n and the least id. ids: the doc_ids of their rows. shared: those rows, as (row, id, text, len, fp), of
    which the texts are hashed again. mixed: keys of groups that hold different texts, which take an exact grouping.
    """
    arrow_batches(docs.sparkSession)
    t = F.col(text).cast("string")
    marks = written(docs.select(F.col("doc_id").alias("id"), *_key(t)), "marks")
    groups = written(marks.where("len is not null").groupBy(*KEY).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1"), "groups")
    keys = small(groups.select(*KEY))
    ids = written(marks.join(keys, KEY, "left_semi").select(F.col("id").alias("some_id")).distinct(), "ids")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), t.alias("text"))
    rows = rows.join(small(ids), F.col("id").eqNullSafe(F.col("some_id")), "left_semi")
    shared = rows.select("row", "id", "text", *_key(F.col("text"))).join(keys, KEY, "left_semi")
    first = shared.groupBy(*KEY).agg(F.min_by("text", F.struct(F.col("id").isNull(), "id")).alias("first_text"))
    unequal = shared.select(*KEY, "text").join(first, KEY).where(~same_text(F.col("text"), F.col("first_text"))).select(*KEY).distinct()
    return marks, groups, ids, shared, written(unequal, "collisions")


def assign(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, keep_id, copies) for every row: the least doc_id among the rows with this very text, and
    how many rows have it.

    A null text equals no other: keep_id is its own doc_id and copies is 1. Empty texts equal each other.
    A null doc_id is only a keep_id where all ids of the group are null. Rows that repeat count each. No
    rows: no rows. Other columns aren't read.
    """
    marks, groups, _, shared, mixed = _groups(docs.select("doc_id", text), text)
    plain = marks.join(small(mixed), KEY, "left_anti")
    out = plain.join(small(groups), KEY, "left").select(F.col("id").alias("doc_id"), F.coalesce("first_id", "id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("copies"))
    if mixed.isEmpty():
        return out
    odd = shared.join(small(mixed), KEY, "left_semi").select("id", "text")
    each = odd.groupBy("text").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    return out.union(odd.join(each, "text").select("id", F.coalesce("first_id", "id"), "n"))


def dedup(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without further copies: of the rows with one text that of the least doc_id stays (null ids
    last; among equal ids any one). Null texts all stay. All columns are kept, whatever their names.

    A text whose doc_id has no copy of any text is never shuffled unless over BROADCAST_ROWS doc_ids have copies.
    """
    _, groups, ids, shared, mixed = _groups(docs, text)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col(text).cast("string").alias("text"))
    named = F.col("id").eqNullSafe(F.col("some_id"))
    once = rows.join(small(ids), named, "left_anti").select("row.*")
    # rows that share a doc_id, or have none, with one of the copies, but not its text
    other = rows.join(small(ids), named, "left_semi").select("row", *_key(F.col("text"))).join(small(groups.select(*KEY)), KEY, "left_anti").select("row.*")
    best = F.min_by("row", F.struct(F.col("id").isNull(), "id")).alias("row")
    out = once.union(other).union(shared.join(small(mixed), KEY, "left_anti").groupBy(*KEY).agg(best).select("row.*"))
    if mixed.isEmpty():
        return out
    return out.union(shared.join(small(mixed), KEY, "left_semi").groupBy("text").agg(best).select("row.*"))
