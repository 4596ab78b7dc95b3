"""Byte-array functions as column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


FNV_START, FNV_PRIME = 2166136261, 16777619


def _empty() -> Column:
    return F.unhex(F.lit(""))


def byte_list(b: Column) -> Column:
    """Unsigned bytes of a binary as array<bigint>; empty and null give none."""
    at = F.when(F.octet_length(b) > 0, F.sequence(F.lit(1), F.octet_length(b))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.transform(at, lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("bigint")), F.array().cast("array<bigint>"))


def signed32(v: Column) -> Column:
    """Two's complement reading of an unsigned 32-bit number."""
    return F.when(v >= (1 << 31), v - (1 << 32)).otherwise(v).cast("int")


def int_to_bytes(v: Column) -> Column:
    """Four bytes, big-endian."""
    return F.unhex(F.right(F.lpad(F.hex(v.cast("bigint")), 16, "0"), F.lit(8)))


def long_to_bytes(v: Column) -> Column:
    """Eight bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(v.cast("bigint")), 16, "0"))


def bytes_to_int(b: Column) -> Column:
    """Signed big-endian reading of four bytes; other lengths raise."""
    number = signed32(F.conv(F.hex(b), 16, 10).cast("bigint"))
    return F.when(b.isNull(), None).when(F.octet_length(b) == 4, number).otherwise(F.raise_error(F.lit("int needs 4 bytes")).cast("int"))


def bytes_to_long(b: Column) -> Column:
    """Signed big-endian reading of eight bytes; other lengths raise."""
    half = lambda at: F.conv(F.hex(F.substring(b, at, 4)), 16, 10).cast("bigint")
    number = F.shiftleft(half(1), 32).bitwiseOR(half(5))
    return F.when(b.isNull(), None).when(F.octet_length(b) == 8, number).otherwise(F.raise_error(F.lit("long needs 8 bytes")).cast("bigint"))


def string_to_bytes(s: Column) -> Column:
    """UTF-8; null gives no bytes."""
    return F.coalesce(F.encode(s, "UTF-8"), _empty())


def bytes_to_string(b: Column) -> Column:
    """UTF-8 with U+FFFD for what is malformed; null gives the empty string."""
    return F.coalesce(F.make_valid_utf8(b.cast("string")), F.lit(""))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: unsigned, byte by byte, then by length; null before all."""
    return (
        F.when(a.eqNullSafe(b), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)
    )


def equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def concat(*parts: Column) -> Column:
    """Nulls add nothing."""
    return F.concat(_empty(), *[F.coalesce(p, _empty()) for p in parts])


def slice_bytes(b: Column, start: Column, length: Column) -> Column:
    """``length`` bytes from 0-based ``start``; a range outside the array raises."""
    fits = (start >= 0) & (length >= 0) & (start + length <= F.octet_length(b))
    return F.when(b.isNull(), None).when(fits, F.substring(b, start + 1, length)).otherwise(F.unhex(F.raise_error(F.lit("range outside the bytes")).cast("string")))


def fnv1a(b: Column) -> Column:
    """FNV-1a, 32 bits, as a signed int; null and empty give 0."""
    mixed = F.aggregate(byte_list(b), F.lit(FNV_START).cast("bigint"), lambda h, x: (h.bitwiseXOR(x) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(F.coalesce(F.octet_length(b), F.lit(0)) == 0, 0).otherwise(signed32(mixed)).cast("int")


def to_hex(b: Column) -> Column:
    return F.coalesce(F.lower(F.hex(b)), F.lit(""))


def from_hex(s: Column) -> Column:
    """Null and empty give no bytes; an odd number of digits or another sign raises."""
    good = s.rlike("^([0-9A-Fa-f]{2})*$")
    return F.when(s.isNull(), _empty()).when(good, F.unhex(s)).otherwise(F.unhex(F.raise_error(F.lit("not a hexadecimal string")).cast("string")))


def is_empty(b: Column) -> Column:
    return F.coalesce(F.octet_length(b), F.lit(0)) == 0


def length(b: Column) -> Column:
    return F.coalesce(F.octet_length(b), F.lit(0))


def order_key(key: Column) -> Column:
    """Bytes that sort as UTF-16 code units do, for readers that need that order."""
    return F.encode(key, "UTF-16BE")
