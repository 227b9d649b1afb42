"""Bounds of what Python workers hold: small Arrow batches in, and tables of few bytes dealt over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROWS, BYTES = 1000, 2 << 20


def bounded(spark: SparkSession | None = None) -> None:
    """Bound the session's Arrow batches by rows and bytes, so that a worker's memory doesn't grow with the table. Results
    don't depend on it; one row is never cut. Without a session it's the thread's active one, else the default: a thread
    of its own has no active session, and a session beside the default one must be given."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over all cores. For narrow rows that take much work each: a table's tasks go by its bytes, so a
    million short rows else lie in one or two tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
