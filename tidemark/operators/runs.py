"""Immutable sorted runs: writing, cataloguing, pruning, newest-first lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import encode_block, find_block
from ..functions.codec import block_entry_size, encode_entry
from .changelog import DEL, PUT, latest

#: Blocks of an index page: an index of the largest allowed size has under 400 pages.
PAGE = 256


def sorted_run(tail: DataFrame) -> DataFrame:
    """Rows of a flush: the newest row of each key, tombstones kept, in key order over range partitions."""
    return latest(tail).repartitionByRange("key").sortWithinPartitions("key")


def run_catalog(rows: DataFrame, *by: str) -> DataFrame:
    """Entries, tombstones, bytes and key and seq ranges of each run."""
    is_put = F.col("op") == PUT
    return rows.groupBy(*by).agg(
        F.count("*").alias("entries"),
        F.sum((F.col("op") == DEL).cast("long")).alias("tombstones"),
        F.coalesce(F.sum(F.when(is_put, block_entry_size(F.col("key"), F.col("value")))), F.lit(0)).cast("long").alias("bytes"),
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
    )


def prune(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """(key, run_id) of runs whose key range covers the key.

    The catalog has one row a run (a manifest's list), so it is the side that is broadcast.
    """
    return keys.join(F.broadcast(catalog), F.col("key").between(F.col("min_key"), F.col("max_key"))).select("key", "run_id")


def lookup(rows: DataFrame) -> DataFrame:
    """State over runs of several levels: lower level first, newer run first; a tombstone hides what is older."""
    order = Window.partitionBy("key").orderBy("level", F.desc("run_id"))
    newest = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return newest.where(F.col("op") == PUT).select("key", "value", "level", "run_id")


def blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(run_id, key, block_id): greedy blocks of each run in key order.

    A block is closed when the next entry would pass ``block_bytes``; an entry larger than that has a block of
    its own. The fold is sequential within a run by its nature, so a run is one group; its memory is the sizes.
    """
    import pandas as pd

    sized = rows.where(F.col("op") == PUT).select("run_id", "key", block_entry_size(F.col("key"), F.col("value")).alias("size"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", key=lambda s: s.map(lambda k: k.encode("utf-8")))
        block, filled, out = 0, 0, []
        for size in pdf["size"]:
            if filled and filled + size > block_bytes:
                block, filled = block + 1, 0
            filled += size
            out.append(block)
        return pd.DataFrame({"run_id": pdf["run_id"], "key": pdf["key"], "block_id": out, "size": pdf["size"]})

    return sized.groupBy("run_id").applyInPandas(fold, "run_id long, key string, block_id long, size long")


def builder_stats(split: DataFrame) -> DataFrame:
    """(run_id, blocks, entries, bytes, average): what a run's blocks hold, the average size rounded down."""
    per = split.groupBy("run_id").agg((F.max("block_id") + 1).alias("blocks"), F.count("*").alias("entries"), F.sum("size").alias("bytes"))
    return per.withColumn("average", F.expr("bytes div blocks"))


def block_bytes(rows: DataFrame, split: DataFrame) -> DataFrame:
    """(run_id, block_id, raw) of each block: its entries in their envelopes, in key order. A block is a few kilobytes."""
    entry = F.struct("key", encode_entry(F.col("key"), F.col("value"), F.lit(False)).alias("value"))
    held = rows.where(F.col("op") == PUT).join(split.select("run_id", "key", "block_id"), ["run_id", "key"])
    grouped = held.groupBy("run_id", "block_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return grouped.select("run_id", "block_id", encode_block(F.col("entries")).alias("raw"))


def block_index(split: DataFrame) -> DataFrame:
    """(run_id, block_id, first_key, last_key, entries, bytes, offset) of each block."""
    per = split.groupBy("run_id", "block_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("entries"), F.sum("size").alias("bytes"))
    before = Window.partitionBy("run_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)))


def place(keys: DataFrame, index: DataFrame, page: int = PAGE) -> DataFrame:
    """(run_id, key, block_id): the one block of each run that can hold the key, -1 before the first.

    A run's index is a tree of two levels: a binary search over the first keys of its pages picks the page, one inside the
    page the block. Only the pages' first keys, one in ``page`` of the index, are broadcast; a lookup meets one page, not the whole index.
    """
    paged = index.withColumn("page", F.expr(f"block_id div {page}"))
    pages = paged.groupBy("run_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "first_key"))), lambda x: x["first_key"]).alias("firsts"))
    fences = paged.where(F.col("block_id") % page == 0).groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "first_key"))), lambda x: x["first_key"]).alias("fences"))
    asked = keys.select("key").crossJoin(F.broadcast(fences))  # one row a run
    asked = asked.select("run_id", "key", find_block(F.col("fences"), F.col("key")).cast("long").alias("page"))
    found = asked.join(pages.hint("merge"), ["run_id", "page"], "left")
    inside = F.col("page") * page + find_block(F.col("firsts"), F.col("key"))
    return found.select("run_id", "key", F.when(F.col("page") < 0, F.lit(-1)).otherwise(inside).cast("long").alias("block_id"))
