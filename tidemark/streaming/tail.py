"""The log as a stream: newest row of each key, kept up to date batch by batch (an addition to the store)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.changelog import latest

OPLOG = "key string, seq long, op string, value binary"


def read_tail(spark: SparkSession, directory: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of the log's batches, one folder a batch."""
    return spark.readStream.schema(OPLOG).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def latest_stream(tail: DataFrame) -> DataFrame:
    """Stateful newest row of each key, for output mode ``update`` or ``complete``; state is one row a key."""
    return latest(tail)
