"""Sharding [native]: contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import running_totals

ROW_OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` contiguous ranges of the order (md5 of text, id).

    The order keeps equal texts side by side and mixes sources. A row's shard is the place of its
    first byte among all bytes: ``start * shards // total``, so each shard's size differs from
    the mean by less than one row. Sizes come from per-partition totals (``running_totals``);
    nothing is gathered but one row a partition.

    Null text: no bytes, size 16, crc 0. Null or repeated ids and repeated rows: each row is
    placed once; equal rows are interchangeable. Empty table: empty result. Extra columns are
    ignored. Fewer rows than shards: some shards stay empty.

    Returns id, size, text_crc32, law, shard, slot, grown_shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("_key"),
        F.lit(1).cast("long").alias("_one"),
    )
    placed = running_totals(rows, ["_key", "doc_id"], {"_start": "size", "_rank": "_one"})
    # start * shards stays below 2^63 up to 200 PB in 40 shards
    cut = placed.withColumn("shard", F.expr(f"int(_start * {int(shards)} div _start_all)"))
    first = F.broadcast(cut.groupBy("shard").agg(F.min("_rank").alias("_first")))  # one row a shard
    return cut.join(first, "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_rank") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
