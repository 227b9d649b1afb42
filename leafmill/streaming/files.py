"""Files as they arrive in a folder: each is parsed once, and its objects appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from leafmill.sources import pdf

BINARY_FILE = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])


def arriving(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """(path, content) of the files of a folder, as a stream of at most per_trigger files a batch."""
    s = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", per_trigger)
    return s.load(folder).select("path", "content")


def append_objects(spark: SparkSession, folder: str, table: str, checkpoint: str, per_trigger: int = 1000) -> StreamingQuery:
    """Parse all files that are new since the last run into a Parquet table, then stop. The work has no
    state but the list of files seen, so a batch that is lost is simply done again."""
    objects = pdf.objects(arriving(spark, folder, per_trigger))
    return objects.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
