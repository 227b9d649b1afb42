import random
from collections import Counter

from conftest_llm import prose
from test_language_id import text
from test_near_dedup import brute_groups, edited

import corpus_pipeline as C
from leafmill.llm.near_dedup import THRESHOLD

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(rng):
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de", "fr", "es"])
        rows.append((i, text(rng, lang, 80), lang, rng.choice(["a", "a", "b"]), 0))
    rows += [(100 + i, rows[i][1], *rows[i][2:]) for i in range(10)]
    rows += [(200 + i, edited(rng, rows[i][1], 0.02), *rows[i][2:]) for i in range(10, 20)]
    return rows + [(300, None, "en", "a", 0), (301, "", "en", "a", 0), (302, "12 34", "en", None, 0), (303, "你好 世界", "en", "b", 0)]


def test_stages_one_by_one(spark, tmp_path):
    rng = random.Random(8)
    rows = documents(rng)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    stage = dict(C.STAGES)

    kept = stage["language_id"](spark, docs, "")
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows if r[0] < 300}

    once = stage["exact_dedup"](spark, kept, "")
    first: dict[str, int] = {}
    for r in rows:
        if r[0] < 300:  # an edited copy may equal its original
            first.setdefault(r[1], r[0])
    assert {r["doc_id"] for r in once.collect()} == set(first.values())

    left = [tuple(r) for r in once.collect()]
    apart = stage["near_dedup"](spark, once, "")
    root = brute_groups([r[1] for r in left], THRESHOLD)
    want = {min(left[j][0] for j in range(len(left)) if root[j] == root[i]) for i in range(len(left))}
    assert {r["doc_id"] for r in apart.collect()} == want and apart.columns == docs.columns

    mixed = stage["mixing"](spark, apart, "")
    assert mixed.columns == docs.columns
    drawn = Counter(r["doc_id"] for r in mixed.collect())
    assert set(drawn) <= want and sum(drawn.values()) > 10

    bins = stage["packing"](spark, mixed, "").collect()
    assert Counter(r["doc_id"] for r in bins if r["piece"] == 0) == drawn


def test_run(spark, tmp_path):
    docs = spark.createDataFrame(documents(random.Random(9)), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = C.run(spark, str(tmp_path))
    assert got.count() > 20 and "bin_id" in got.columns


def test_prose_helper_is_deterministic():
    assert prose(random.Random(1), 5) == prose(random.Random(1), 5)


NAMES = ["gone", "twice", "row", "name", "id", "s", "n", "root", "lead", "langid", "src", "key", "h", "copy", "copies", "copy_no", "first", "fp", "len", "e", "u", "part", "piece", "length", "bin_id", "_gone", "_twice", "_same", "__copy", "__0"]


def test_clashing_columns_pass_every_stage(spark):
    rows = [(*r, *range(len(NAMES))) for r in documents(random.Random(10))]
    docs = spark.createDataFrame(rows + rows[:3] + [(None, *rows[4][1:])], SCHEMA + "".join(f", `{c}` int" for c in NAMES))
    for name, stage in C.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.schema == docs.schema, name
            got = out.collect()
            assert got and all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in got), name
            docs = spark.createDataFrame(got, docs.schema)
    assert out.count() > 20


def test_empty_table_passes_every_stage(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in C.STAGES:
        assert stage(spark, docs, "").count() == 0, name
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0
