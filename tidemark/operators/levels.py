"""Levels: limits, triggers, candidates, merges and tombstone collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import StoreConfig
from .changelog import DEL


def limits(spark: SparkSession, config: StoreConfig) -> DataFrame:
    """(level, max_bytes) of all levels."""
    return spark.createDataFrame([(n, config.level_limit(n)) for n in range(config.max_level)], "level int, max_bytes long")


def level_stats(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("level").agg(F.count("*").alias("runs"), F.sum("bytes").alias("bytes"))


def needs_compaction(catalog: DataFrame, config: StoreConfig) -> DataFrame:
    """(level, runs, bytes, needed): level 0 by number of runs, the others by bytes above their limit; empty levels never.

    The last level has nowhere to go and is never a source.
    """
    found = limits(catalog.sparkSession, config).join(level_stats(catalog), "level", "left").na.fill(0, ["runs", "bytes"])
    full = F.when(F.col("level") == 0, F.col("runs") >= config.level0_runs).otherwise(F.col("bytes") > F.col("max_bytes"))
    return found.select("level", "runs", "bytes", (full & (F.col("runs") > 0) & (F.col("level") < config.max_level - 1)).alias("needed"))


def candidates(catalog: DataFrame) -> DataFrame:
    """(level, run_id): all runs of level 0; of another level the largest one, the earlier of equals."""
    order = Window.partitionBy("level").orderBy(F.desc("bytes"), "run_id")
    ranked = catalog.withColumn("_n", F.row_number().over(order))
    return ranked.where((F.col("level") == 0) | (F.col("_n") == 1)).select("level", "run_id")


def overlapping(catalog: DataFrame, source: DataFrame, target: int) -> DataFrame:
    """Runs of the target level whose key range meets the sources'; catalog-sized."""
    span = source.agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"))  # one row
    return catalog.where(F.col("level") == target).join(F.broadcast(span), (F.col("min_key") <= F.col("hi")) & (F.col("max_key") >= F.col("lo"))).select(catalog["*"])


def merge(rows: DataFrame, bottommost: bool, older: DataFrame | None = None) -> DataFrame:
    """Newest row of each key over the sources; tombstones go only where no older run can hold the key.

    ``older`` has the key ranges (min_key, max_key) of deeper runs: a tombstone within one stays. It is as long as
    a manifest's list of runs, so it is the side that is broadcast.
    """
    newest = rows.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("x"))
    out = newest.select("key", "seq", F.col("x.op").alias("op"), F.col("x.value").alias("value"))
    if not bottommost:
        return out
    kept = out.where(F.col("op") != DEL)
    if older is None:
        return kept
    hides = out.where(F.col("op") == DEL).join(F.broadcast(older), F.col("key").between(F.col("min_key"), F.col("max_key")), "left_semi")
    return kept.unionByName(hides)


def concat(rows: DataFrame) -> DataFrame:
    """Runs that do not overlap: rows in key order, nothing to resolve."""
    return rows.repartitionByRange("key").sortWithinPartitions("key")
