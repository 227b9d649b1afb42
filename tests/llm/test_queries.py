"""The registered queries run over the supplied tables, and agree with their SQL where they have it."""

import pytest
from parity import compare

from leafmill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), ORACLE_SQL[name], sf) is None


def test_every_document_has_its_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name in ("op2_minhash_near_dedup", "op8_language_id", "op10_token_blocks"):
        got = QUERIES[name](spark, sf)
        assert got.count() == n and got.select("doc_id").distinct().count() == n
    packed = QUERIES["op1_best_fit_packing"](spark, sf)
    assert packed.agg({"length": "sum"}).first()[0] == docs.selectExpr("sum(length(text))").first()[0]
    assert QUERIES["op9_html_extraction"](spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def test_spans_lie_within_their_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "length(text) as n")
    spans = QUERIES["op6_substring_dedup"](spark, sf).join(docs, "doc_id")
    assert spans.where("start < 0 or end > n or start >= end").isEmpty()
