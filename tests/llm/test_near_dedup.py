import random

import numpy as np
import pyarrow as pa
from conftest_llm import WORDS, prose, rows_of

from leafmill.llm import _kernels as K
from leafmill.llm import near_dedup as N


def folded(t: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in t).split()


def shingle_set(t: str) -> set:
    w = folded(t)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def similarity(a: str, b: str) -> float:
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def brute_groups(texts: list[str], threshold: float) -> list[int]:
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def edited(rng, t, share):
    w = t.split()
    return " ".join(rng.choice(WORDS) if rng.random() < share else x for x in w)


def test_every_coordinate_is_filled_and_estimates_similarity():
    rng = random.Random(1)
    a = prose(rng, 400)
    texts = [a, edited(rng, a, 0.05), prose(rng, 400), "one", "two words", "", "!!!", None]
    h, at, _ = N.shingles(*K.text_bytes(pa.array(texts)))
    s = N.sketches(h, at)
    assert (s[:5] != K.MAX64).all() and (s[5:] == K.MAX64).all()
    for i in (1, 2):
        assert abs((s[0] == s[i]).mean() - similarity(texts[0], texts[i])) < 0.15


def test_estimate_is_unbiased_over_many_pairs():
    rng = random.Random(2)
    err = []
    for _ in range(60):
        a = prose(rng, rng.choice([6, 30, 200]))
        b = edited(rng, a, 0.1)
        h, at, _ = N.shingles(*K.text_bytes(pa.array([a, b])))
        s = N.sketches(h, at)
        err.append((s[0] == s[1]).mean() - similarity(a, b))
    assert abs(np.mean(err)) < 0.02 and np.std(err) < 0.07


def test_exact_similarity():
    rng = random.Random(3)
    a = [prose(rng, 50), "x y z", "only", "", "A b. C d", prose(rng, 50_000)]
    b = [edited(rng, a[0], 0.1), "x y w", "only", "", "a B c D!", prose(rng, 10)]
    assert np.allclose(N.jaccard_rows(pa.array(a), pa.array(b)), [similarity(x, y) for x, y in zip(a, b)])


def test_groups_equal_brute_force(spark, schema):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        t = prose(rng, rng.randint(40, 200))
        texts.append(t)
        texts += [edited(rng, t, 0.03) for _ in range(rng.randint(0, 5))]
    t = prose(rng, 120)
    texts += [edited(rng, t, 0.04) for _ in range(60)]  # one large group
    texts += [prose(rng, 100) for _ in range(40)]
    passage = prose(rng, 60)
    texts += [prose(rng, 60) + " " + passage for _ in range(20)]  # share a passage, but aren't near
    rng.shuffle(texts)
    want = brute_groups(texts, N.THRESHOLD)
    got = {r["doc_id"]: r for r in N.assign(spark, spark.createDataFrame(rows_of(texts), schema)).collect()}
    pairs = {(i, j) for i in range(len(texts)) for j in range(i) if want[i] == want[j]}
    found = {(i, j) for i in range(len(texts)) for j in range(i) if got[i]["group_id"] == got[j]["group_id"]}
    assert found <= pairs
    assert len(found) >= 0.97 * len(pairs)
    assert all(got[i]["keep"] == (got[i]["group_id"] == i) for i in got)
    kept = N.dedup(spark, spark.createDataFrame(rows_of(texts), schema))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in got if got[i]["keep"])


def test_odd_rows(spark):
    rng = random.Random(6)
    t = prose(rng, 60)
    rows = [(1, t), (2, t.upper() + "!"), (3, None), (4, None), (5, ""), (6, ""), (None, t), (7, t), (7, t), (8, "one"), (9, "One."), (10, "..."), (1, t), (11, " ".join([t] * 3000))]
    df = spark.createDataFrame([(i, x, 1, "q", 2) for i, x in rows], "doc_id long, text string, id int, root string, n int")
    got = sorted((tuple(r) for r in N.assign(spark, df).collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == len(rows)
    assert by[2][1] == 1 and by[7][1] == 1 and by[1] == (1, 1, 6, True)  # with 11, which has hardly other shingles
    assert by[9][1] == 8
    assert by[None] == (None, None, 1, True) and by[3] == (3, 3, 1, True) and by[6] == (6, 6, 1, True) and by[10] == (10, 10, 1, True)
    kept = N.dedup(spark, df)
    assert kept.columns == df.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(map(str, [1, 3, 4, 5, 6, None, 8, 10] + ([11] if by[11][1] == 11 else [])))


def test_empty_table(spark, schema):
    df = spark.createDataFrame([], schema)
    assert N.assign(spark, df).count() == 0 and N.dedup(spark, df).count() == 0


def test_clashing_columns_and_folded_copies(spark):
    """Columns by the names of the operator's own; rows of one id that differ in case and punctuation alone are copies."""
    names = ["gone", "twice", "_gone", "_twice", "_same", "row", "name", "id", "s", "n", "f1", "w", "root", "lead", "group_id", "key", "h", "m", "u", "v"]
    rng = random.Random(8)
    t, other = prose(rng, 60), prose(rng, 60)
    rows = [(1, t), (2, edited(rng, t, 0.01)), (3, "One."), (3, "one"), (3, " ONE!"), (3, other), (4, "..."), (4, "... "), (4, None), (5, t.upper())]
    df = spark.createDataFrame([(i, x, *range(len(names))) for i, x in rows], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names))
    kept = N.dedup(spark, df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert all(tuple(r)[2:] == tuple(range(len(names))) for r in got)
    assert sorted((r["doc_id"], N_words(r["text"])) for r in got) == sorted([(1, N_words(t)), (3, ["one"]), (3, folded(other)), (4, []), (4, []), (4, [])])
    assert N.assign(spark, df).count() == len(rows)


def N_words(t):
    return folded(t or "")


def test_rare_pairs_lose_no_similar_pair(spark, schema):
    """Documents that share a passage of a third of their text meet, but only pairs that may be similar are joined."""
    rng = random.Random(9)
    passage = prose(rng, 50)
    texts = [prose(rng, 100) + " " + passage for _ in range(60)]
    texts += [edited(rng, texts[i], 0.03) for i in range(20)] + [edited(rng, texts[i], 0.06) for i in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3])], "id long, text string")
    placed = spark.createDataFrame([(i, i) for i in range(len(texts))], "id long, root long")
    for threshold in (0.5, 0.7):
        got = {(r["u"], r["v"]) for r in N._rare_pairs(placed, docs, threshold).collect()}
        want = {(i, j) for j in range(len(texts)) for i in range(j) if similarity(texts[i], texts[j]) >= threshold}
        assert want <= got and len(want) > 5
        assert len(got) < 200  # of 3,570 pairs
