import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import ann as A
from leafmill.llm.queries import QUERIES


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], "q", 0) for i, v in rows], "vec_id long, embedding array<float>, part string, label int")


def brute(ids, x, k):
    x = A.normed(x).astype(np.float64)
    s = np.round(x @ x.T, 7)
    out = {}
    for i in range(len(ids)):
        o = sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[ids[i]] = [ids[j] for j in o]
    return out


def recall(got, want):
    return np.mean([len(set(got.get(i, [])) & set(w)) / len(w) for i, w in want.items()])


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["vec_id"], r["rank"])):
        out.setdefault(r["vec_id"], []).append(r["neighbour_id"])
    return out


def index_of(spark, df):
    x, n, d = A.clean(df)
    return A.index(spark, x, n, d)[0]


def test_all_of_the_recall_is_exact(spark):
    """The probes are calibrated on all of a table as small as this."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16))
    got = answers(A.neighbours(spark, frame(spark, list(enumerate(x))), k=5, target_recall=1.0))
    assert got == brute(list(range(300)), x, 5)


@pytest.mark.parametrize("n", [2, 3, 17, 100, 300])
def test_small_tables_are_partitioned_too(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 12))
    df = frame(spark, list(enumerate(x)))
    assert index_of(spark, df).parts == A.parts_for(n) and A.parts_for(n) ** 2 >= n
    got = answers(A.neighbours(spark, df, k=5))
    assert recall(got, brute(list(range(n)), x, 5)) >= 0.9


def test_clusters_in_a_sample_a_hot_one_and_rare_ones(spark, monkeypatch):
    """A third of the rows in one cluster, clusters of a few rows, a sample of a fifth, tasks of a few rows."""
    monkeypatch.setattr(A, "BLOCK", 100)
    monkeypatch.setattr(A, "GROUP", 200)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16)) * 2
    which = np.concatenate([np.zeros(1000, int), rng.integers(1, 20, 1900), np.repeat(np.arange(20, 30), 10)])
    x = centres[which] + rng.normal(size=(3000, 16)) * 0.4
    df = frame(spark, list(enumerate(x)))
    got = answers(A.neighbours(spark, df, k=10, sample=600))
    want = brute(list(range(3000)), x, 10)
    assert recall(got, want) >= 0.9
    assert recall(got, {i: want[i] for i in range(2900, 3000)}) >= 0.9
    assert all(len(v) == 10 and i not in v for i, v in got.items())
    router = index_of(spark, df)
    assert router.parts == 64 and router.probes <= 16  # structure is exploited


def test_supplied_vectors(spark, sf):
    """Recall against brute force, and no more than a quarter of the parts probed."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = answers(QUERIES["op4_nearest_neighbours"](spark, "/root/testdata/sf0.01"))
    rows = df.select("vec_id", "embedding").collect()
    want = brute([r[0] for r in rows], np.array([r[1] for r in rows]), 10)
    assert set(got) == {r[0] for r in rows if r[0] % 50 == 0}
    assert recall(got, {i: want[i] for i in got}) >= 0.9
    router = index_of(spark, df)
    assert router.parts > 1 and router.probes <= router.parts / 4


def test_queries_are_chosen_by_a_condition(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 24))
    got = answers(A.neighbours(spark, frame(spark, list(enumerate(x))), queries=F.col("vec_id") % 50 == 0, target_recall=1.0))
    want = brute(list(range(200)), x, 10)
    assert got == {i: want[i] for i in (0, 50, 100, 150)}


@pytest.mark.parametrize("kind", ["smallint", "decimal(6,1)", "string", "date"])
def test_types_of_ids(spark, kind):
    df = frame(spark, [(i, [math.cos(i / 9), math.sin(i / 9)]) for i in range(9)])
    make = f"date_add(date'2020-01-01', cast(vec_id as int))" if kind == "date" else f"cast(vec_id as {kind})"
    got = A.neighbours(spark, df.selectExpr(f"{make} as vec_id", "embedding"), k=2, target_recall=1.0)
    assert [f.dataType.simpleString() for f in got.schema.fields if f.name != "rank" and f.name != "similarity"] == [kind] * 2
    order = df.selectExpr("vec_id", f"{make} as name").collect()
    name = {r[0]: r[1] for r in order}
    assert {name[0]: [name[1], name[2]], name[4]: [name[3], name[5]]}.items() <= answers(got).items()


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(3)
    x = A.normed(rng.normal(size=(800, 8)))
    g = A.exact_neighbours(x, x, 8, np.arange(800))
    p = A.balanced_parts(x, g, 8)
    assert np.bincount(p, minlength=8).max() <= math.ceil(100 * 1.05)
    assert (p[g] == p[:, None]).mean() > 2 * (rng.permutation(p)[g] == p[:, None]).mean()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0]), (2, [1, 0]), (3, [2, 0]), (4, [0, 0]), (5, None), (6, [nan, 1]), (7, [1, None]), (8, [1, 2, 3]), (None, [1, 1]), (9, [inf, 0]), (10, [0, 1]), (2, [1, 0]), (11, [])]
    got = answers(A.neighbours(spark, frame(spark, rows), k=3, target_recall=1.0))
    assert got == {1: [2, 3, 4], 2: [1, 3, 4], 3: [1, 2, 4], 4: [1, 2, 3], 10: [1, 2, 3]}
    assert A.neighbours(spark, frame(spark, [(1, [1, 0])])).count() == 0
    assert A.neighbours(spark, frame(spark, [])).count() == 0
