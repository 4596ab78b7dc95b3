"""Binary forms of blocks, block indexes and Bloom filters, written and read by column expressions.

Block: number of entries (4 bytes), CRC-32 of all keys and values (8), then key length, key, value length, value of
each entry in key order. Index: version, number of blocks, then key length, key, offset (8), size (4) of each. Filter:
version, bits, hash functions, length, bytes with the lowest bit first. All numbers are big-endian.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesfn import int_to_bytes, long_to_bytes
from .codec import VERSION, number

#: Entries that a block index may have.
MAX_INDEX_ENTRIES = 100_000
#: Bits that are aggregated to one piece of a filter.
PIECE_BITS = 32_768


def _joined(parts: Column) -> Column:
    """Bytes of an array of binaries in a row."""
    return F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x)), ""))


def _raw(key: Column) -> Column:
    return F.encode(key, "UTF-8")


def _sized(raw: Column) -> Column:
    return F.concat(int_to_bytes(F.octet_length(raw)), raw)


def block_checksum(entries: Column) -> Column:
    """CRC-32 over keys and values of an array of (key, value) in key order."""
    return F.crc32(_joined(F.transform(entries, lambda e: F.concat(_raw(e["key"]), e["value"]))))


def encode_block(entries: Column) -> Column:
    body = _joined(F.transform(entries, lambda e: F.concat(_sized(_raw(e["key"])), _sized(e["value"]))))
    return F.concat(int_to_bytes(F.size(entries)), long_to_bytes(block_checksum(entries)), body)


def _cut(b: Column, at: Column, size: Column) -> Column:
    return F.substring(b, at.cast("int"), size.cast("int"))


def decode_block(b: Column) -> Column:
    """struct<status, entries>: status OK, SHORT or CRC; entries an array of (key, value), null unless OK."""
    none = F.array().cast("array<struct<key:string,value:binary>>")
    start = F.struct(F.lit(13).cast("long").alias("at"), none.alias("entries"))

    def step(s: Column, _: Column) -> Column:
        key_size = F.coalesce(number(b, s["at"].cast("int"), 4), F.lit(0))
        value_at = s["at"] + 4 + key_size
        value_size = F.coalesce(number(b, value_at.cast("int"), 4), F.lit(0))
        entry = F.struct(_cut(b, s["at"] + 4, key_size).cast("string").alias("key"), _cut(b, value_at + 4, value_size).alias("value"))
        return F.struct((value_at + 4 + value_size).alias("at"), F.concat(s["entries"], F.array(entry)).alias("entries"))

    size = F.octet_length(b)
    count = F.when(size >= 12, number(b, 1, 4))
    # an entry takes 8 bytes at least: a damaged count cannot ask for more steps than the bytes allow
    sane = F.coalesce((count >= 0) & (count * 8 <= size - 12), F.lit(False))
    steps = F.when(sane & (count > 0), F.sequence(F.lit(1).cast("bigint"), count)).otherwise(F.array().cast("array<bigint>"))
    read = F.aggregate(steps, start, step)
    whole = sane & (read["at"] == size + 1)
    sound = block_checksum(read["entries"]) == number(b, 5, 8)
    status = F.when(~F.coalesce(whole, F.lit(False)), "SHORT").when(~sound, "CRC").otherwise("OK")
    return F.struct(status.alias("status"), F.when(whole & sound, read["entries"]).alias("entries"))


def block_get(entries: Column, key: Column) -> Column:
    """Value of ``key`` in a block's entries, null if it has none."""
    return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["value"]


def block_contains(entries: Column, key: Column) -> Column:
    """First by the range of keys, then by the keys."""
    low, high = F.get(entries, F.lit(0))["key"], F.element_at(entries, -1)["key"]
    return F.when(F.size(entries) == 0, False).otherwise((key >= low) & (key <= high) & F.exists(entries, lambda e: e["key"] == key))


def find_block(first_keys: Column, key: Column) -> Column:
    """Place in the ascending ``first_keys`` of the one block that can hold ``key``; -1 before the first.

    A binary search: log2 of the number of blocks steps.
    """
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(first_keys) + 1.0)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(first_keys).alias("high"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = F.get(first_keys, mid) <= key
        open_ = s["low"] < s["high"]
        return F.struct(F.when(open_ & right, mid + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~right, mid).otherwise(s["high"]).alias("high"))

    return F.aggregate(steps, start, step, lambda s: s["low"] - 1)


def encode_index(blocks: Column) -> Column:
    """Bytes of an array of (first_key, offset, bytes) in block order."""
    each = F.transform(blocks, lambda x: F.concat(_sized(_raw(x["first_key"])), long_to_bytes(x["offset"]), int_to_bytes(x["bytes"])))
    return F.concat(F.unhex(F.lit(VERSION)), int_to_bytes(F.size(blocks)), _joined(each))


def decode_index(b: Column) -> Column:
    """struct<status, blocks>: status OK, VERSION, COUNT or SHORT; blocks an array of (first_key, offset, bytes)."""
    none = F.array().cast("array<struct<first_key:string,offset:bigint,bytes:bigint>>")
    start = F.struct(F.lit(6).cast("long").alias("at"), none.alias("blocks"))

    def step(s: Column, _: Column) -> Column:
        key_size = F.coalesce(number(b, s["at"].cast("int"), 4), F.lit(0))
        behind = s["at"] + 4 + key_size
        entry = F.struct(
            _cut(b, s["at"] + 4, key_size).cast("string").alias("first_key"), number(b, behind.cast("int"), 8).alias("offset"), number(b, (behind + 8).cast("int"), 4).alias("bytes")
        )
        return F.struct((behind + 12).alias("at"), F.concat(s["blocks"], F.array(entry)).alias("blocks"))

    size = F.octet_length(b)
    count = F.when(size >= 5, number(b, 2, 4))
    sane = F.coalesce((count >= 0) & (count <= MAX_INDEX_ENTRIES) & (count * 16 <= size - 5), F.lit(False))
    steps = F.when(sane & (count > 0), F.sequence(F.lit(1).cast("bigint"), count)).otherwise(F.array().cast("array<bigint>"))
    read = F.aggregate(steps, start, step)
    version = F.hex(F.substring(b, 1, 1)) == VERSION
    whole = read["at"] == size + 1
    status = F.when(~F.coalesce(version, F.lit(False)), "VERSION").when(~sane, "COUNT").when(~F.coalesce(whole, F.lit(False)), "SHORT").otherwise("OK")
    return F.struct(status.alias("status"), F.when(version & sane & whole, read["blocks"]).alias("blocks"))


def filter_pieces(bits: DataFrame) -> DataFrame:
    """(piece, bytes) of a filter's ``bits(bit)``: 4,096 bytes for each PIECE_BITS, aggregated map-side."""
    return bits.groupBy(F.expr(f"bit div {PIECE_BITS}").alias("piece")).agg(F.expr(f"bitmap_construct_agg(bit % {PIECE_BITS})").alias("bytes"))


def filter_bytes(bits: DataFrame) -> DataFrame:
    """One row ``bytes``: lowest bit first, without the zero bytes at the end. As large as one run's filter."""
    pieces = filter_pieces(bits).agg(F.map_from_entries(F.collect_list(F.struct("piece", F.hex("bytes")))).alias("m"), F.max("piece").alias("top"))
    zeros = "00" * (PIECE_BITS // 8)
    whole = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("top")), lambda i: F.coalesce(F.element_at("m", i), F.lit(zeros))), "")
    return pieces.select(F.coalesce(F.unhex(F.regexp_replace(whole, "^((?:..)*?)(?:00)*$", "$1")), F.unhex(F.lit(""))).alias("bytes"))


def encode_filter(raw: Column, bits: Column, hashes: Column) -> Column:
    return F.concat(F.unhex(F.lit(VERSION)), int_to_bytes(bits), int_to_bytes(hashes), _sized(raw))


def decode_filter(b: Column) -> Column:
    """struct<status, bits, hashes, bytes>: status OK, VERSION or SHORT."""
    version = F.coalesce(F.hex(F.substring(b, 1, 1)) == VERSION, F.lit(False))
    size = F.octet_length(b)
    whole = F.coalesce((size >= 13) & (size == 13 + number(b, 10, 4)), F.lit(False))
    ok = version & whole
    status = F.when(~version, "VERSION").when(~whole, "SHORT").otherwise("OK")
    return F.struct(
        status.alias("status"),
        F.when(ok, number(b, 2, 4)).alias("bits"),
        F.when(ok, number(b, 6, 4)).alias("hashes"),
        F.when(ok, F.substring(b, F.lit(14), size - 13)).alias("bytes"),
    )
