"""Transactions over a pinned state: overlay, commit, rollback, read-set validation, isolation levels."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .changelog import DEL, PUT


class Isolation(IntEnum):
    READ_UNCOMMITTED = 0
    READ_COMMITTED = 1
    REPEATABLE_READ = 2
    SNAPSHOT_ISOLATION = 3
    SERIALIZABLE = 4

    @property
    def label(self) -> str:
        return self.name.replace("_", " ").title()

    @property
    def description(self) -> str:
        return _SAYS[self]

    def __str__(self) -> str:
        return f"{self.label} (Level {int(self)}): {self.description}"

    @property
    def dirty_reads(self) -> bool:
        return self == 0

    @property
    def non_repeatable_reads(self) -> bool:
        return self <= 1

    @property
    def phantom_reads(self) -> bool:
        return self < 3

    @property
    def snapshot(self) -> bool:
        return self >= 3

    def stricter_than(self, other: Isolation) -> bool:
        return self > other


_SAYS = {
    Isolation.READ_UNCOMMITTED: "may see writes that are never committed",
    Isolation.READ_COMMITTED: "sees committed writes alone, perhaps others at the second look",
    Isolation.REPEATABLE_READ: "sees the same value of a key at every look, perhaps new keys",
    Isolation.SNAPSHOT_ISOLATION: "sees one version of the store throughout",
    Isolation.SERIALIZABLE: "acts as if transactions came one after another",
}

RECOMMENDED = Isolation.SNAPSHOT_ISOLATION


def isolation_levels(spark: SparkSession) -> DataFrame:
    rows = [(int(x), x.label, str(x), x.dirty_reads, x.non_repeatable_reads, x.phantom_reads, x.snapshot, x == RECOMMENDED) for x in Isolation]
    return spark.createDataFrame(
        rows, "level int, name string, text string, dirty_reads boolean, non_repeatable_reads boolean, phantom_reads boolean, snapshot boolean, recommended boolean"
    )


def overlay(state: DataFrame, staged: DataFrame) -> DataFrame:
    """What a transaction reads: its own staged (key, op, value) before the snapshot's (key, value)."""
    own = staged.select("key", "op", F.col("value").alias("_own"))
    both = state.select("key", "value").join(own, "key", "full")
    kept = both.where(F.col("op").isNull() | (F.col("op") == PUT))
    return kept.select("key", F.when(F.col("op") == PUT, F.col("_own")).otherwise(F.col("value")).alias("value"))


def commit_rows(staged: DataFrame, seq: int) -> DataFrame:
    """Oplog rows of a commit: one batch, all with the commit's sequence number, at most one row a key."""
    return staged.select(F.lit(seq).cast("long").alias("seq"), "key", "op", F.when(F.col("op") == DEL, None).otherwise(F.col("value")).alias("value"))


def conflicts(reads: DataFrame, state: DataFrame) -> DataFrame:
    """(key, expected, actual) of reads that no longer hold; absent equals absent."""
    now = state.select("key", F.col("value").alias("actual"))
    return reads.join(now, "key", "left").where(~F.col("expected").eqNullSafe(F.col("actual"))).select("key", "expected", "actual")
