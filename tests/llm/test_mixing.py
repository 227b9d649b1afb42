import hashlib
from collections import Counter, defaultdict

from conftest_llm import rows_of

from leafmill.llm import _spark as S
from leafmill.llm import mixing as M


def brute(rows, weights, budget, max_epochs, seed):
    by = defaultdict(list)
    for r in rows:
        by[r[3] or ""].append(r)
    total = {s: float(sum(len(r[1] or "") for r in rs)) for s, rs in by.items()}
    w = {s: 1.0 if weights is None else float(weights.get(s, 0)) for s in by}
    whole = sum(total.values()) if budget is None else budget
    sum_w = sum(w[s] for s in by if total[s] > 0)
    out = Counter()
    for s, rs in by.items():
        e = int(min(max_epochs, whole * w[s] / sum_w / total[s]) * 1_000_000) if total[s] and sum_w else 0
        u = int(hashlib.md5(f"{seed}:{s}".encode()).hexdigest()[:8], 16) % 1_000_000
        cum = u
        for r in sorted(rs, key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] is not None, r[0] or 0)):
            n = (cum + e) // 1_000_000 - cum // 1_000_000
            cum += e
            if n:
                out[r] += n
    return out


def drawn(spark, schema, rows, **kw):
    args = {"weights": None, "budget": None, "max_epochs": M.MAX_EPOCHS, "seed": 1} | kw
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in M.sample(spark, df, **kw).collect()]
    assert Counter(r[:-1] for r in got) == brute(rows, **args)
    assert all(max(r[-1] for r in got if r[:-1] == x) <= n for x, n in Counter(r[:-1] for r in got).items())
    return Counter(r[3] for r in got)


def make(n, source, size):
    return [(i, "x" * size, "en", source, size) for i in n]


def test_equals_brute_force_and_meets_targets(spark, schema, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", 16)
    rows = make(range(300), "hot", 10) + make(range(300, 340), "small", 20) + make(range(340, 345), "tiny", 2)
    got = drawn(spark, schema, rows)
    whole = 300 * 10 + 40 * 20 + 5 * 2
    assert abs(got["hot"] - whole / 3 / 10) <= 1 and abs(got["small"] - whole / 3 / 20) <= 1 and got["tiny"] == 20
    got = drawn(spark, schema, rows, weights={"hot": 1, "small": 3}, budget=800.0, seed=9)
    assert abs(got["hot"] - 20) <= 1 and abs(got["small"] - 30) <= 1 and "tiny" not in got


def test_odd_rows(spark, schema):
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "text", None, None, 4), (None, "more", "en", "", 4), (4, "", "en", "void", 0)]
    rows += [(5, "same", "en", "a", 4)] * 3
    drawn(spark, schema, rows, seed=3)
    drawn(spark, schema, rows, weights={}, seed=3)
    assert M.sample(spark, spark.createDataFrame([], schema)).count() == 0


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(i, "t", "s", 1, 2, 3, 4) for i in range(4)], "doc_id long, text string, source string, src int, e int, u int, copy_no int")
    out = M.sample(spark, df, copy_column=None)
    assert out.columns == df.columns and out.count() == 4
    assert sorted(M.sample(spark, df).columns) == sorted(df.columns)


def test_rows_of_a_pipeline_keep_their_columns(spark, schema):
    df = spark.createDataFrame(rows_of(["a", "b"]), schema)
    assert M.sample(spark, df, copy_column=None).schema == df.schema


def test_own_names_of_the_operator_clash_with_none(spark):
    names = ["__copy", "copy", "copies", "first", "__0", "__1", "row", "key", "id", "h", "cum", "_b", "_v", "_in", "src", "_g0", "_c", "_before", "n_all"]
    df = spark.createDataFrame([(i, "t", "s", *range(len(names))) for i in range(4)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names))
    out = M.sample(spark, df)
    assert out.columns == [*df.columns, "copy_no"]
    assert sorted(tuple(r) for r in out.collect()) == sorted((*r, 1) for r in df.collect())
    assert sorted(tuple(r) for r in M.sample(spark, df, copy_column="__copy").select(*[f"`{c}`" for c in df.columns if c != "__copy"]).collect()) == sorted(tuple(r) for r in df.drop("__copy").collect())
