"""Change logs: latest-wins state, tombstones, lookups and memtable accounting.

An oplog row is (seq, key, op, value) with op 'PUT' or 'DEL'; the newest row of a key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT, DEL = "PUT", "DEL"


def latest(oplog: DataFrame) -> DataFrame:
    """Newest row of each key, tombstones included.

    max_by combines map-side, so a key with a third of all rows costs one row a task; a filter on
    ``key`` passes below the grouping to the scan.
    """
    newest = oplog.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("x"))
    return newest.select("key", "seq", F.col("x.op").alias("op"), F.col("x.value").alias("value"))


def live(oplog: DataFrame) -> DataFrame:
    """State: keys whose newest row is a PUT."""
    return latest(oplog).where(F.col("op") == PUT).select("key", "value", "seq")


def get(oplog: DataFrame, key: str) -> DataFrame:
    """Zero or one row of the state."""
    return live(oplog.where(F.col("key") == key))


def multi_get(keys: DataFrame, state: DataFrame) -> DataFrame:
    """(key, value, found) for each row of ``keys``; Spark picks broadcast or sort-merge by measured size."""
    known = state.select("key", "value", F.lit(True).alias("_hit"))
    return keys.join(known, "key", "left").select("key", "value", F.coalesce("_hit", F.lit(False)).alias("found"))


def put(oplog: DataFrame, rows: DataFrame) -> DataFrame:
    """Oplog with (key, value) upserted after all present rows: ``rows`` brings its own seq."""
    return oplog.unionByName(rows.select("seq", "key", F.lit(PUT).alias("op"), "value"))


def delete(oplog: DataFrame, rows: DataFrame) -> DataFrame:
    """Oplog with tombstones for (seq, key); deleting an absent key is allowed."""
    return oplog.unionByName(rows.select("seq", "key", F.lit(DEL).alias("op"), F.lit(None).cast("binary").alias("value")))


def utf16_units(key: Column) -> Column:
    return (F.octet_length(F.encode(key, "UTF-16BE")) / 2).cast("long")


def memtable_accounting(oplog: DataFrame) -> DataFrame:
    """One row (size, ops, entries): bytes that a mutable table holds after all rows.

    A key's units count once it was ever put first, a value's bytes while the newest row is a PUT.
    """
    per_key = oplog.groupBy("key").agg(
        F.min_by("op", "seq").alias("first"), F.max_by("op", "seq").alias("last"), F.max_by(F.octet_length("value"), "seq").alias("bytes"), F.count("*").alias("ops")
    )
    size = F.when(F.col("first") == PUT, utf16_units(F.col("key"))).otherwise(0) + F.when(F.col("last") == PUT, F.col("bytes")).otherwise(0)
    return per_key.agg(
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("size"), F.coalesce(F.sum("ops"), F.lit(0)).cast("long").alias("ops"), F.count("*").alias("entries")
    )
