"""Hashes and Bloom filters as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesfn import byte_list, signed32

#: Multiplier of the per-byte mixer (fixed value: filters written earlier depend on it).
MIX_FACTOR = 0x5BD1E995
_LOW32 = 0xFFFFFFFF


def mix(b: Column, seed: Column) -> Column:
    """Unsigned 32-bit mixer: per signed byte xor, multiply, fold the top 17 bits."""

    def step(h: Column, x: Column) -> Column:
        wide = F.when(x >= 128, x + 0xFFFFFF00).otherwise(x)
        h = (h.bitwiseXOR(wide) * MIX_FACTOR).bitwiseAND(F.lit(_LOW32))
        return h.bitwiseXOR(F.shiftright(h, 15))

    return F.aggregate(byte_list(b), seed.cast("bigint"), step)


def bloom_bits(n: int, fpp: float) -> int:
    """Bits for n keys; at least one."""
    return max(1, int(-n * math.log(fpp) / math.log(2) ** 2))


def bloom_hashes(n: int, fpp: float) -> int:
    """Hash functions for n keys; at least one."""
    return max(1, math.floor(bloom_bits(n, fpp) / n * math.log(2) + 0.5)) if n else 1


def bloom_positions(key: Column, bits: int, hashes: int) -> Column:
    """Bit of each hash function: |(h1 + i * h2) % bits| with 32-bit wrap."""
    raw = F.encode(key, "UTF-8")
    first = mix(raw, F.lit(0))
    pair = F.struct(first.alias("a"), mix(raw, first).alias("b"))
    at = lambda i: F.abs(signed32((pair["a"] + i * pair["b"]).bitwiseAND(F.lit(_LOW32))).cast("bigint") % bits)
    return F.array(*[at(i) for i in range(hashes)])


def bloom_build(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """(bit): the distinct bits that are set; partial distinct happens before the shuffle."""
    return keys.select(F.explode(bloom_positions(F.col(key), bits, hashes)).alias("bit")).distinct()


def bloom_probe(keys: DataFrame, key: str, filter_bits: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(key, might_contain): all of the key's bits are set. Never false for a key that was added.

    Meets the filter by pieces of 4,096 bytes rather than bit by bit; Spark broadcasts them if they are few.
    """
    from .blocks import PIECE_BITS, filter_pieces

    wanted = keys.select(F.col(key), F.explode(F.array_distinct(bloom_positions(F.col(key), bits, hashes))).alias("bit"))
    placed = wanted.withColumn("piece", F.expr(f"bit div {PIECE_BITS}"))
    hit = placed.join(filter_pieces(filter_bits), "piece", "left")
    byte = F.substring("bytes", (F.floor(F.col("bit") % PIECE_BITS / 8) + 1).cast("int"), F.lit(1))
    is_set = F.coalesce(F.expr("getbit(conv(hex(_byte), 16, 10)::int, (bit % 8)::int)") == 1, F.lit(False))
    return hit.withColumn("_byte", byte).groupBy(key).agg(F.bool_and(is_set).alias("might_contain"))


def string_hash(s: Column) -> Column:
    """31-based polynomial over UTF-16 code units, 32-bit wrap, signed."""
    raw = F.encode(s, "UTF-16BE")
    units = F.when(F.octet_length(raw) > 0, F.sequence(F.lit(1), F.octet_length(raw) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return signed32(
        F.aggregate(
            units,
            F.lit(0).cast("bigint"),
            lambda h, i: (h * 31 + F.conv(F.hex(F.substring(raw, i, F.lit(2))), 16, 10).cast("bigint")).bitwiseAND(F.lit(_LOW32)),
        )
    )


def shard(key: Column, shards: int) -> Column:
    return string_hash(key).bitwiseAND(F.lit(shards - 1))
