import random
from collections import defaultdict

import numpy as np
from conftest_llm import prose, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import packing as P


def first_fit_decreasing(lengths, room):
    bins = []
    for x in sorted(lengths, reverse=True):
        for b in bins:
            if sum(b) + x <= room:
                b.append(x)
                break
        else:
            bins.append([x])
    return len(bins)


def test_patterns_are_all_multisets():
    got = P.patterns(7, 3)
    want = {tuple(sorted((a, b, c), reverse=True)) for a in range(8) for b in range(8) for c in range(8) if a + b + c == 7}
    assert {p + (0,) * (3 - len(p)) for p in got} == want and len(got) == len(set(got))


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12)
        x = P.nnls(a, b)
        g = a.T @ (b - a @ x)
        assert (x >= 0).all() and (g <= 1e-7).all() and abs(x @ g) < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=120))
def test_solve_uses_each_piece_once_and_packs_well(lengths):
    hist = np.bincount(lengths, minlength=17) if lengths else np.zeros(17, int)
    bins = P.solve(hist, 16, 3)
    used = np.zeros(17, int)
    for p, count in bins:
        assert count > 0 and sum(p) <= 16
        for s in p:
            used[s] += count
    assert (used == hist).all()
    n = sum(c for _, c in bins)
    assert n <= first_fit_decreasing(lengths, 16) * 1.25 + 1
    assert n >= -(-sum(lengths) // 16)


def check(rows, out, capacity, units):
    """Whole, disjoint, within bounds: by brute force."""
    unit = capacity // units
    bins, cover = defaultdict(list), defaultdict(list)
    for doc, piece, start, length, bin_id, offset in out:
        if length == 0:
            assert bin_id is None and offset is None
            cover[doc].append((0, 0))
            continue
        assert offset % unit == 0 and offset + length <= capacity and start == piece * capacity
        bins[bin_id].append((offset, offset + length))
        cover[doc].append((start, start + length))
    for spans in bins.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    want = defaultdict(list)
    for doc, n in rows:
        want[doc] += [(s, min(s + capacity, n)) for s in range(0, n, capacity)] or [(0, 0)]
    assert {k: sorted(v) for k, v in cover.items()} == {k: sorted(v) for k, v in want.items()}
    assert sorted(bins) == list(range(len(bins)))
    return bins


def test_pack_on_odd_rows(spark, schema):
    rng = random.Random(2)
    texts = [None, "", "x", "y" * 8192, "z" * 8193, "w" * 100_000] + [prose(rng, rng.randint(1, 2000)) for _ in range(300)]
    rows = rows_of(texts)
    rows += [rows[10], rows[10], (None, "a null id", "en", "s", 9), (None, "b" * 9000, "en", "s", 9)]
    df = spark.createDataFrame(rows, schema).withColumnRenamed("source", "bin_id")
    out = [tuple(r) for r in P.pack(spark, df).collect()]
    lengths = [(r[0], len(r[1] or "")) for r in rows]
    bins = check(lengths, out, P.CAPACITY, P.UNITS)
    assert sum(n for _, n in lengths) / (len(bins) * P.CAPACITY) > 0.95


def test_ranks_over_many_blocks(spark, schema, monkeypatch):
    from leafmill.llm import _spark as S

    monkeypatch.setattr(S, "BLOCK_ROWS", 7)
    rows = rows_of(["q" * (i % 5 * 64) for i in range(200)])
    out = [tuple(r) for r in P.pack(spark, spark.createDataFrame(rows, schema), capacity=256, units=4).collect()]
    check([(r[0], len(r[1])) for r in rows], out, 256, 4)


def test_empty_table(spark, schema):
    assert P.pack(spark, spark.createDataFrame([], schema)).count() == 0
