"""Rows that share a doc_id but not their text."""

import random

from conftest_llm import prose
from test_near_dedup import edited

from leafmill.llm import near_dedup as N


def test_only_near_duplicates_go(spark):
    rng = random.Random(12)
    a, b, c, d = (prose(rng, 150) for _ in range(4))
    a2, c2, d2 = (edited(rng, t, 0.02) for t in (a, c, d))
    rows = [(1, a), (5, a2), (5, b), (5, None), (5, ""), (6, c), (6, d), (7, c2), (8, d2), (9, prose(rng, 100))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for r in N.dedup(spark, df).collect()}
    assert kept == set(rows) - {(5, a2), (7, c2), (8, d2)}
    got = sorted((tuple(r) for r in N.assign(spark, df).select("doc_id", "group_id", "keep").collect()))
    assert got == sorted([(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (5, 5, True), (6, 6, True), (6, 6, True), (7, 6, False), (8, 6, False), (9, 9, True)])


def test_a_shared_id_joins_no_groups(spark):
    rng = random.Random(13)
    a, b = prose(rng, 150), prose(rng, 150)
    rows = [(3, edited(rng, a, 0.02)), (5, a), (5, b), (8, edited(rng, b, 0.02))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in N.dedup(spark, df).collect()} == {rows[0], rows[2]}
