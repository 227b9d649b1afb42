"""Named queries over the supplied tables, each with SQL to hold it against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.functions.batches import bounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, in a session whose Arrow batches are bounded: columns don't know their session."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    from leafmill.queries import codecs, color, content, files, fonts, geometry, graph, images, layers, numbers, programs, state, structure  # noqa: F401

    return QUERIES, ORACLE_SQL
