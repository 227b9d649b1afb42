import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from conftest_llm import prose, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import _kernels as K
from leafmill.llm import exact_dedup as E


def naive(data: bytes, base: int) -> int:
    return sum(x * pow(base, i, E.PRIME) for i, x in enumerate(data)) % E.PRIME


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_fingerprints_are_the_polynomials(texts):
    got = E.fingerprints(*K.text_bytes(pa.array(texts, pa.string())))
    assert list(got) == [naive(t.encode(), E.BASES[0]) << 31 | naive(t.encode(), E.BASES[1]) for t in texts]


def test_long_rows_compose_over_segments(monkeypatch):
    texts = ["ab" * 700, "", "x", "y" * 999, "é" * 513]
    want = E.fingerprints(*K.text_bytes(pa.array(texts)))
    monkeypatch.setattr(K, "SEGMENT", 64)
    E._TABLES.clear()
    assert list(E.fingerprints(*K.text_bytes(pa.array(texts)))) == list(want)
    E._TABLES.clear()
    a, b = b"some bytes", b"and more of them"
    assert E.compose((naive(a, 7), len(a)), (naive(b, 7), len(b)), 7) == (naive(a + b, 7), len(a + b))


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t] if x is not None]
        out.append((i, i, 1) if t is None else (i, min(ids) if ids else None, len(groups[t])))
    return sorted(out, key=str)


ROWS = [(1, "a b"), (2, "a b"), (3, None), (4, None), (5, ""), (6, ""), (7, "a B"), (7, "a B"), (None, "a b"), (None, "lone"), (None, "pair"), (None, "pair"), (8, "z" * 300_000), (9, "z" * 299_999 + "y"), (10, "z" * 300_000)]


def test_assign_and_dedup_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(E, "COMPARE_BYTES", 1000)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in ROWS], "doc_id long, text string, len int, fp string")
    got = sorted((tuple(r) for r in E.assign(spark, df).collect()), key=str)
    assert got == brute(ROWS)
    kept = E.dedup(spark, df)
    assert kept.columns == df.columns
    texts = sorted(str(r["text"]) for r in kept.collect())
    assert texts == sorted([str(t) for t in {t for _, t in ROWS if t is not None}] + ["None", "None"])
    assert {r["doc_id"] for r in kept.where("text = 'a b'").collect()} == {1}


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(E, "fingerprint", lambda c: __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1).cast("long"))
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "bb", "dd", None, "", ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in E.assign(spark, df).collect()), key=str) == brute(rows)
    assert sorted(r["doc_id"] for r in E.dedup(spark, df).collect()) == [0, 1, 3, 5, 6, 7]


def test_empty_table(spark, schema):
    df = spark.createDataFrame([], schema)
    assert E.assign(spark, df).count() == 0 and E.dedup(spark, df).count() == 0


def test_random_documents(spark, schema):
    rng = random.Random(4)
    pool = [prose(rng, rng.randint(1, 50)) for _ in range(40)]
    rows = rows_of([rng.choice(pool) for _ in range(200)])
    got = sorted((tuple(r) for r in E.assign(spark, spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in rows])
    assert np.unique([g[1] for g in got]).size == E.dedup(spark, spark.createDataFrame(rows, schema)).count()
