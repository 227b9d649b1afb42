"""Best-fit packing by patterns and non-negative least squares.

Lengths are rounded up to units, and the histogram over units is all that the solver sees, so its cost
doesn't depend on the data. Patterns are all multisets of up to DEPTH lengths that fill a bin exactly;
non-negative least squares (Lawson and Hanson) fits how often each is used to the histogram; the counts
are rounded without using more pieces than there are; the residual histogram is packed best fit
decreasing, by counts. Each piece then finds its place by arithmetic from its rank among the pieces of
its length. Ranks are distributed over blocks, so no task holds all pieces of a common length.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm._spark import arrow_batches, blocks, running

#: Characters of a bin, and into how many units a bin is divided.
CAPACITY, UNITS = 8192, 128
DEPTH = 3


def patterns(units: int, depth: int) -> list[tuple[int, ...]]:
    """All multisets of at most depth lengths, greatest first, with this sum."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, have: tuple[int, ...]) -> None:
        if not left:
            out.append(have)
        elif len(have) < depth:
            for x in range(min(left, most), 0, -1):
                if x * (depth - len(have)) < left:
                    break
                grow(left - x, x, (*have, x))

    grow(units, units, ())
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """argmin |a x - b| over x >= 0, by active sets."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    tol = 1e-10 * max(1.0, np.abs(w).max(initial=0))
    for _ in range(rounds):
        free = np.where(passive, -np.inf, w)
        j = int(np.argmax(free))
        if free[j] <= tol:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                break
            bad = z <= 0
            step = (x[at][bad] / np.maximum(x[at][bad] - z[bad], 1e-300)).min()
            x[at] += step * (z - x[at])
            x[at[x[at] <= 1e-14]] = 0
            off = at[x[at] <= 1e-14]
            if not len(off):
                off = at[bad][:1]
            passive[off] = False
            if j in off:
                break
        x[:] = np.where(passive, x, 0)
        at = np.flatnonzero(passive)
        if len(at):
            x[at] = np.maximum(np.linalg.lstsq(a[:, at], b, rcond=None)[0], 0)
        w = a.T @ (b - a @ x)
    return x


def best_fit(hist: np.ndarray, units: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over counts: [(lengths of a bin, number of such bins)]."""
    bins: dict[int, list[list]] = {}  # room left -> [pattern, count]
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append([pattern, count])

    for size in range(units, 0, -1):
        n = int(hist[size])
        while n:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                per = units // size
                if n // per:
                    put(units - per * size, (size,) * per, n // per)
                if n % per:
                    put(units - n % per * size, (size,) * (n % per), 1)
                break
            room = rooms[i]
            pattern, count = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(i)
            per = min(room // size, n)
            take = min(count, n // per)
            if take < count:
                put(room, pattern, count - take)
            put(room - per * size, pattern + (size,) * per, take)
            n -= per * take
    return [(tuple(p), c) for xs in bins.values() for p, c in xs]


def solve(hist: np.ndarray, units: int = UNITS, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a bin, number of such bins)] that uses every piece of the histogram exactly once."""
    left = hist.astype(np.int64).copy()
    total = left.sum()
    if not total:
        return []
    ps = [p for p in patterns(units, depth) if all(left[s] for s in p)]
    out: list[tuple[tuple[int, ...], int]] = []
    if ps:
        a = np.zeros((units + 1, len(ps)))
        for k, p in enumerate(ps):
            for s in p:
                a[s, k] += 1
        x = nnls(a, left / total) * total
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.5:
                break
            need = a[:, k].astype(np.int64)
            count = min(int(round(x[k])), int((left[need > 0] // need[need > 0]).min()))
            if count > 0:
                out.append((ps[k], count))
                left -= count * need
    return out + best_fit(left, units)


def slots(bins: list[tuple[tuple[int, ...], int]], units: int) -> tuple[np.ndarray, ...]:
    """Arrays over (length, first rank) in order: key, pieces a bin, first bin, first offset."""
    rows, used, first_bin = [], np.zeros(units + 1, np.int64), 0
    for p, count in bins:
        offset = 0
        for s in sorted(set(p), reverse=True):
            m = p.count(s)
            rows.append((s << 48 | int(used[s]), int(used[s]), m, first_bin, offset))
            used[s] += m * count
            offset += m * s
        first_bin += count
    rows.sort()
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(5))


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, units: int = UNITS, depth: int = DEPTH, length: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_offset) for every piece of every row of docs.

    A row longer than capacity is cut into pieces of capacity characters and a rest; start is a piece's
    offset in its row, bin_offset in its bin, where pieces begin at multiples of capacity / units. No bin
    is overfull and no piece is left out. A null or empty text has one row of length 0 with null bin_id
    and bin_offset. Null doc_ids and repeated rows are packed each by itself; which of equally long
    pieces goes where depends on a hash of doc_id. No rows: no rows. Other columns aren't read.
    length: characters of a row in place of length(text).
    """
    if capacity % units:
        raise ValueError("capacity must be a multiple of units")
    arrow_batches(spark, 20_000)
    unit = capacity // units
    n = F.coalesce(F.length("text") if length is None else length, F.lit(0)).cast("long")
    x = docs.select("doc_id", n.alias("n"))
    pieces = x.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece").cast("long") * capacity).alias("length"))
    pieces = pieces.withColumn("size", F.expr(f"cast((length + {unit - 1}) div {unit} as int)")).withColumn("h", F.xxhash64("doc_id", "piece"))
    hist = np.zeros(units + 1, np.int64)
    for r in pieces.groupBy("size").count().collect():
        hist[r["size"]] = r["count"]
    plan = spark.sparkContext.broadcast(slots(solve(hist, units, depth), units))
    k = blocks(int(hist.sum()))
    order = [F.col("h"), F.col("doc_id"), F.col("piece"), F.col("length")]
    ranked = running(pieces, ["size"], F.lit(1), order, F.expr(f"((shiftright(h, 32) + 2147483648L) * {k}L) div 4294967296L"), "rank")

    def place(size: pa.Array, rank: pa.Array) -> pa.Array:
        key, used, per, first, offset = plan.value
        s, r = size.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64) - 1
        at = np.searchsorted(key, s << 48 | r, "right") - 1
        i = r - used[at]
        return pa.StructArray.from_arrays([pa.array(first[at] + i // per[at]), pa.array((offset[at] + i % per[at] * s) * unit)], ["bin_id", "bin_offset"])

    placed = ranked.withColumn("at", F.arrow_udf(place, "struct<bin_id:long,bin_offset:long>")("size", "rank"))
    placed = placed.select("doc_id", "piece", "start", "length", "at.bin_id", "at.bin_offset")
    nothing = F.lit(None).cast("long")
    return placed.union(x.where("n = 0").select("doc_id", F.lit(0), F.lit(0).cast("long"), "n", nothing, nothing))
