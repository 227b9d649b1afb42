"""Approximate nearest neighbours by learned partitions.

The exact neighbour graph of a sample is partitioned into balanced parts with few cut edges; a small
classifier learns, for a vector, the distribution of its neighbours over the parts (Dong, Indyk,
Razenshteyn and Wagner, ICLR 2020). Every vector is stored in its most probable part; a query looks into
its several most probable parts, where all candidates are reranked by exact similarity. How many parts are
probed is calibrated for a target recall: exact neighbours of some rows are searched in the whole table, in
one pass without a shuffle, and it is counted how far down the router's ranking their parts lie.

There are about as many parts as a part has vectors (the square root of their number, at every size), and
the sample grows with the parts, SAMPLE_PER_PART vectors each. Parts are compared in groups: a task holds at
most BLOCK members and BLOCK queries of a group, so a crowded part neither overflows a task nor loses a
candidate, and a query travels once a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm._spark import arrow_batches, small, written

#: Sampled vectors of a part, and the bound of the sample that graph and classifier are made from.
SAMPLE_PER_PART, SAMPLE = 64, 1 << 20
#: Vectors of a group of parts that their number aims at, and the most of one task.
GROUP, BLOCK = 4096, 16_384
NEIGHBOURS = 10
TARGET_RECALL = 0.92
#: Rows whose exact neighbours calibrate the number of probes.
HELD = 400
HIDDEN = 256
#: The classifier's passes over its sample: as many as make FIT_ROWS rows, within EPOCHS.
EPOCHS, FIT_ROWS = (12, 300), 250_000


def normed(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-30))


def exact_neighbours(q: np.ndarray, x: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Indices of the k most similar rows of x for each row of q; skip[i] is left out for query i."""
    k = min(k, max(len(x) - (skip is not None), 0))
    out = np.zeros((len(q), k), np.int64)
    for i in range(0, len(q), 256):
        s = q[i : i + 256] @ x.T
        if skip is not None:
            s[np.arange(len(s)), skip[i : i + 256]] = -np.inf
        if k:
            out[i : i + 256] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 6, slack: float = 0.05) -> np.ndarray:
    """Part of each row: halved along principal directions, then moved to where most neighbours are
    while no part exceeds its size by more than slack."""
    n = len(x)
    part = np.zeros(n, np.int64)
    level = 1
    while level < parts:
        for p in range(level):
            at = np.flatnonzero(part == p)
            y = x[at] - x[at].mean(axis=0) if len(at) else x[at]
            d = np.linalg.eigh(y.T @ y)[1][:, -1] if len(at) > 1 else np.zeros(x.shape[1])
            o = np.argsort(y @ d, kind="stable")
            part[at[o[len(o) // 2 :]]] = p + level
        level *= 2
    room = int(np.ceil(n / parts * (1 + slack)))
    least = int(n / parts * (1 - slack))
    size = np.bincount(part, minlength=parts)
    back = np.argsort(graph.ravel(), kind="stable")  # who has me as a neighbour
    bounds = np.searchsorted(graph.ravel()[back], np.arange(n + 1))
    for _ in range(rounds):
        moved = 0
        for i in np.random.default_rng(5).permutation(n):
            near = np.concatenate([part[graph[i]], part[back[bounds[i] : bounds[i + 1]] // max(graph.shape[1], 1)]])
            votes = np.bincount(near, minlength=parts)
            best, here = int(votes.argmax()), part[i]
            if best != here and votes[best] > votes[here] and size[best] < room and size[here] > least:
                part[i] = best
                size[best] += 1
                size[here] -= 1
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """A linear layer and a network of one hidden layer beside it: vector -> scores of the parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    w0: np.ndarray
    probes: int = 1
    recall: float = 0.0

    @property
    def parts(self) -> int:
        return len(self.b2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2 + x @ self.w0

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, the most probable first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")


def fit_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, rate: float = 4e-3, seed: int = 3) -> Router:
    """Minimise cross entropy to the distribution of each row and its neighbours over the parts, with Adam. The
    linear layer starts from the parts' mean directions."""
    rng = np.random.default_rng(seed)
    (n, d), k = x.shape, graph.shape[1]
    mean = np.zeros((parts, d), np.float32)
    np.add.at(mean, part, x)
    ps = [rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1 * (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts), normed(mean).T * 8]
    ps = [p.astype(np.float32) for p in ps]
    m, v, t = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
    batch = min(512, max(128, n // 8))
    per_epoch = -(-n // batch)
    epochs = min(max(EPOCHS[0], FIT_ROWS // n), EPOCHS[1])
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            b = order[i : i + batch]
            where = np.concatenate([part[graph[b]], part[b][:, None]], axis=1) + np.arange(len(b))[:, None] * parts
            target = np.bincount(where.ravel(), minlength=len(b) * parts).reshape(len(b), parts) / np.float32(k + 1)
            a = x[b] @ ps[0] + ps[1]
            h = np.maximum(a, 0)
            z = h @ ps[2] + ps[3] + x[b] @ ps[4]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = ((z / z.sum(axis=1, keepdims=True) - target) / len(b)).astype(np.float32)
            gh = (g @ ps[2].T) * (a > 0)
            t += 1
            step = rate * (1 - t / (epochs * per_epoch + 1))
            for j, grad in enumerate((x[b].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0), x[b].T @ g)):
                m[j] = 0.9 * m[j] + 0.1 * grad
                v[j] = 0.999 * v[j] + 0.001 * grad * grad
                ps[j] -= step * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return Router(*ps)


def _matrix(col: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, d)


def _graph(spark: SparkSession, x: np.ndarray, k: int) -> np.ndarray:
    """exact_neighbours of the sample among itself, computed by tasks of some rows each."""
    n, rows = len(x), 2048
    shared = spark.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in b.column(0).to_pylist():
                at = np.arange(lo, min(lo + rows, n))
                near = exact_neighbours(shared.value[at], shared.value, k, at)
                ends = pa.array(np.arange(len(at) + 1) * near.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.ListArray.from_arrays(ends, pa.array(near.ravel().astype(np.int32)))], ["i", "near"])

    got = spark.range(0, n, rows, numPartitions=-(-n // rows)).mapInArrow(run, "i long, near array<int>").toArrow()
    near = got.column("near").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
    out = np.empty_like(near)
    out[got.column("i").to_numpy()] = near
    shared.destroy()
    return out


def parts_for(n: int) -> int:
    """The least power of two that is no less than the square root of n."""
    return 1 << math.ceil(math.log2(max(n, 1)) / 2)


def _held_search(x: np.ndarray, h: np.ndarray, k: int, d: int):
    """The k vectors of a task's rows most similar to each row of x: (q, sim, part); h: hashes of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sims, parts = np.full((len(x), k), -np.inf, np.float32), np.full((len(x), k), -1, np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            s = x @ normed(_matrix(b.column(1), d)).T
            s[h[:, None] == b.column(0).to_numpy()[None, :]] = -np.inf
            p = np.broadcast_to(b.column(2).to_numpy(), s.shape)
            s, p = np.concatenate([sims, s], axis=1), np.concatenate([parts, p], axis=1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            sims, parts = np.take_along_axis(s, top, axis=1), np.take_along_axis(p, top, axis=1)
        q, r = np.nonzero(sims > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(sims[q, r]), pa.array(parts[q, r])], ["q", "sim", "part"])

    return run


def calibrate(router: Router, routed: DataFrame, n: int, d: int, k: int, target_recall: float) -> None:
    """Set router.probes to the least that reaches target_recall of the exact neighbours, over all of routed
    (id, x, part), of about HELD of its rows; recall is what they reach."""
    share = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < F.lit(min(1.0, HELD / n) * (1 << 30))
    got = routed.where(share).select(F.xxhash64("id").alias("h"), "x").toArrow()
    x = normed(_matrix(got.column("x"), d))
    if len(x) < 1 or n < 2:
        router.probes, router.recall = router.parts, 1.0
        return
    found = routed.select(F.xxhash64("id").alias("h"), "x", "part").mapInArrow(_held_search(x, got.column("h").to_numpy(), k, d), "q long, sim float, part int")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "part"))).where(F.col("r") <= k).select("q", "part").toArrow()
    order = router.order(x)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(router.parts)[None, :].repeat(len(x), 0), axis=1)
    need = rank[best.column("q").to_numpy(), best.column("part").to_numpy()]
    reached = np.cumsum(np.bincount(need, minlength=router.parts)) / max(len(need), 1)
    router.probes = min(int((reached < target_recall).sum()) + 1, router.parts)
    router.recall = float(reached[router.probes - 1])


def index(spark: SparkSession, x: DataFrame, n: int, d: int, k: int = NEIGHBOURS, target_recall: float = TARGET_RECALL, sample: int = SAMPLE) -> tuple[Router, DataFrame]:
    """(calibrated router, routed) of the n vectors x (id, x, ...) of dimension d; routed has part, the most probable."""
    parts = parts_for(n)
    want = min(SAMPLE_PER_PART * parts, sample)
    picked = x if n <= want else x.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(want / n * (1 << 30)))
    got = picked.select(F.xxhash64("id").alias("h"), "x").toArrow().sort_by("h")  # a fixed order
    y = normed(_matrix(got.column("x"), d))
    graph = _graph(spark, y, k) if len(y) else np.zeros((0, 0), np.int64)
    router = fit_router(y, graph, balanced_parts(y, graph, parts), parts)
    shared = spark.sparkContext.broadcast(router)

    def home(col: pa.Array) -> pa.Array:
        s = normed(_matrix(col, d))
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(shared.value.scores(s[i : i + 512]).argmax(axis=1) for i in range(0, len(s), 512))]), pa.int32())

    routed = written(x.withColumn("part", F.arrow_udf(home, "int")("x")), "routed")
    calibrate(router, routed, n, d, k, target_recall)
    return router, routed


def _probe(router, d: int, per: int):
    """The parts that a query probes, by groups of per parts."""

    def probe(col: pa.Array) -> pa.Array:
        x, r = normed(_matrix(col, d)), router.value
        top = np.concatenate([np.zeros((0, r.probes), np.int64), *(r.order(x[i : i + 512])[:, : r.probes] for i in range(0, len(x), 512))])
        flat, row = np.sort(top, axis=1).ravel(), np.repeat(np.arange(len(x)), r.probes)
        group = flat // per
        new = np.ones(len(flat), bool)
        new[1:] = (row[1:] != row[:-1]) | (group[1:] != group[:-1])
        starts = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), pa.array(flat, pa.int32()))
        each = pa.StructArray.from_arrays([pa.array(group[starts], pa.int32()), lists], ["grp", "parts"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[starts], np.arange(len(x) + 1)), pa.int32()), each)

    return probe


def _search(d: int, k: int, id_type: pa.DataType):
    """Of one block of members and one of queries of a group: each query's k most similar members in its parts."""
    names = ["vec_id", "neighbour_id", "similarity"]

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not queries.num_rows or not members.num_rows:
            return pa.table([pa.array([], id_type), pa.array([], id_type), pa.array([], pa.float64())], names)
        members = members.sort_by("part")
        m_id, q_id = members.column("id").combine_chunks(), queries.column("id").combine_chunks()
        number = pc.rank(pa.concat_arrays([m_id, q_id]), tiebreaker="dense").to_numpy().astype(np.int64)
        m_no, q_no = number[: len(m_id)], number[len(m_id) :]
        m, q = normed(_matrix(members.column("x"), d)), normed(_matrix(queries.column("x"), d))
        part = members.column("part").to_numpy()
        lists = queries.column("parts").combine_chunks()
        ask, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), pc.list_value_length(lists).to_numpy())
        o = np.argsort(ask, kind="stable")
        ask, who = ask[o], who[o]
        rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p in np.unique(part):
            lo, hi = np.searchsorted(part, [p, p + 1])
            mine = who[slice(*np.searchsorted(ask, [p, p + 1]))]
            kk = min(k + 1, hi - lo)
            for i in range(0, len(mine), 256):
                s = q[mine[i : i + 256]] @ m[lo:hi].T
                cut = np.partition(s, hi - lo - kk, axis=1)[:, hi - lo - kk]
                r, c = np.nonzero(s >= cut[:, None] - np.float32(1e-6))
                rows.append(mine[i + r])
                cols.append(lo + c)
        r, c = np.concatenate(rows), np.concatenate(cols)
        other = m_no[c] != q_no[r]
        r, c = r[other], c[other]
        exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[r[i : i + 65536]].astype(np.float64), m[c[i : i + 65536]].astype(np.float64)) for i in range(0, len(r), 65536))]).round(7)
        o = np.lexsort((m_no[c], -exact, r))
        r, c, exact = r[o], c[o], exact[o]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        return pa.table([q_id.take(pa.array(r[keep])), m_id.take(pa.array(c[keep])), pa.array(exact[keep])], names)

    return run


def clean(vectors: DataFrame, queries: Column | None = None) -> tuple[DataFrame, int, int]:
    """(id, x, ask) of the usable vectors, one row an id, with their number and dimension; ask: whether it is a query."""
    x = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("x"), F.coalesce(F.lit(True) if queries is None else queries, F.lit(False)).alias("ask"))
    x = x.where("id is not null and x is not null")
    x = x.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size("x") > 0))
    sizes = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return x, 0, 0
    x = x.where(F.size("x") == sizes["d"])
    twice = written(x.groupBy("id").count().where("count > 1"), "twice")
    extra = twice.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
    keys = small(twice.select("id"))
    again = x.join(keys, "id", "left_semi").groupBy("id").agg(F.min_by("x", F.xxhash64("x")).alias("x"), F.max("ask").alias("ask"))
    return x.join(keys, "id", "left_anti").union(again), sizes["count"] - extra, sizes["d"]


def neighbours(spark: SparkSession, vectors: DataFrame, k: int = NEIGHBOURS, queries: Column | None = None, target_recall: float = TARGET_RECALL, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, rank, neighbour_id, similarity): for every query its k nearest other vectors by cosine.

    queries: the condition on a row of vectors that makes it a query (None: all rows); all rows are searched.
    sample: bound of the vectors that graph and classifier are made from, and which are sent to all tasks;
    every vector is indexed, and the number of probes is calibrated on the whole table.

    Ties in similarity (to 7 decimals) go to the lesser vec_id. Fewer than k others: as many as there are. A
    zero vector has similarity 0 to all. Left out, both as query and neighbour: null ids, null vectors,
    vectors with a null, NaN or infinite element or of another dimension than the most common. Rows
    that share a vec_id are one vector, the one least by hash, and a query if one of them is. vec_id may have
    any type that orders. No rows: no rows. Other columns are read by queries alone.
    """
    arrow_batches(spark, 5000)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    x, n, d = clean(vectors, queries)
    if not n:
        return spark.createDataFrame([], f"vec_id {kind}, rank int, neighbour_id {kind}, similarity double")
    router, routed = index(spark, x, n, d, k, target_recall, sample)
    per = max(1, GROUP * router.parts // n)
    shared = spark.sparkContext.broadcast(router)
    members = routed.select("id", "x", "part", F.expr(f"part div {per}").cast("int").alias("grp"))
    asked = routed.where("ask").withColumn("p", F.arrow_udf(_probe(shared, d, per), "array<struct<grp:int,parts:array<int>>>")("x"))
    asked = asked.select("id", "x", F.explode("p").alias("p")).select("id", "x", "p.grp", "p.parts")
    pieces = lambda t, name: t.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    grid = written(pieces(members, "nm").join(pieces(asked.select("grp"), "nq"), "grp"), "grid")
    spread = F.xxhash64("id", F.lit(1))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731 - new columns: both sides come from one table
    members = members.join(small(grid), "grp").select(*own("grp"), F.pmod(spread, F.col("nm")).cast("int").alias("mb"), each("nq").alias("qb"), *own("id", "x", "part"))
    asked = asked.join(small(grid), "grp").select(*own("grp"), each("nm").alias("mb"), F.pmod(spread, F.col("nq")).cast("int").alias("qb"), *own("id", "x", "parts"))
    keys = ["grp", "mb", "qb"]
    id_type = pa.schema([routed.select("id").limit(0).toArrow().schema.field("id")]).field("id").type
    found = members.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(d, k, id_type), f"vec_id {kind}, neighbour_id {kind}, similarity double")
    best = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return found.select("vec_id", best.cast("int").alias("rank"), "neighbour_id", "similarity").where(F.col("rank") <= k)
