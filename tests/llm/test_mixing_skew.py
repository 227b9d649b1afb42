"""The registered mixes meet the targets of sources of any size."""

from collections import Counter

import corpus_pipeline as C
from leafmill.llm import mixing as M
from leafmill.llm.queries import QUERIES

SIZE = 10


def skewed(spark, schema):
    """One source of 90 % of the characters and 19 that share the rest."""
    rows = [(i, "x" * SIZE, "en", "hot", SIZE) for i in range(3420)]
    rows += [(10_000 + i, "x" * SIZE, "en", f"s{i % 19}", SIZE) for i in range(380)]
    return spark.createDataFrame(rows, schema)


def test_all_sources_meet_their_targets(spark, schema, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "COPIES", 3)
    docs = skewed(spark, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for got in (QUERIES["op5_source_mixing"](spark, str(tmp_path)), C.mixed(spark, docs, "")):
        rows = got.collect()
        drawn = Counter(r["source"] for r in rows)
        assert len(drawn) == 20 and all(abs(n - 3800 / 20) <= 1 for n in drawn.values())
    copies = Counter(r["doc_id"] for r in QUERIES["op5_source_mixing"](spark, str(tmp_path)).collect())
    assert max(copies.values()) >= 9


def test_copies_are_numbered_without_gaps(spark, schema, tmp_path):
    rows = [(i, "x" * 100, "en", "hot", 100) for i in range(100)] + [(1000, "y", "en", "tiny", 1)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(r["copy_no"] for r in QUERIES["op5_source_mixing"](spark, str(tmp_path)).where("source = 'tiny'").collect())
    assert abs(len(got) - 10_001 / 2) <= 1 and got == list(range(1, len(got) + 1))
