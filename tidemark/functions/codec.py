"""Binary envelopes of entries, written and read by column expressions.

Entry: version, marker, key length, key, value length, value, CRC-32 of all before; 14 + key + value bytes.
Log entry: timestamp and sequence number (8 bytes each) after the marker; 30 + key + value bytes.
Frame: CRC-32 and length before a log entry; 8 more. All numbers are big-endian.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MAX_KEY_BYTES, MAX_VALUE_BYTES
from .bytesfn import bytes_to_long, int_to_bytes, long_to_bytes

VERSION = "01"
DATA, DELETED = "01", "02"


def _sealed(body: Column) -> Column:
    return F.concat(body, int_to_bytes(F.crc32(body)))


def _head(deleted: Column) -> Column:
    return F.when(deleted, F.unhex(F.lit(VERSION + DELETED))).otherwise(F.unhex(F.lit(VERSION + DATA)))


def _pair(key: Column, value: Column, deleted: Column) -> list[Column]:
    raw, empty = F.encode(key, "UTF-8"), F.unhex(F.lit(""))
    data = F.when(deleted, empty).otherwise(F.coalesce(value, empty))
    return [int_to_bytes(F.octet_length(raw)), raw, int_to_bytes(F.octet_length(data)), data]


def encode_entry(key: Column, value: Column, deleted: Column) -> Column:
    return _sealed(F.concat(_head(deleted), *_pair(key, value, deleted)))


def encode_log_entry(key: Column, value: Column, deleted: Column, ts: Column, seq: Column) -> Column:
    return _sealed(F.concat(_head(deleted), long_to_bytes(ts), long_to_bytes(seq), *_pair(key, value, deleted)))


def frame(entry: Column) -> Column:
    return F.concat(int_to_bytes(F.crc32(entry)), int_to_bytes(F.octet_length(entry)), entry)


def number(b: Column, at: Column | int, size: int) -> Column:
    """Unsigned big-endian number of ``size`` bytes at the place ``at``, counted from 1."""
    return F.conv(F.hex(F.substring(b, at if isinstance(at, Column) else F.lit(at), F.lit(size))), 16, 10).cast("bigint")


def decode_entry(b: Column, log: bool = False) -> Column:
    """struct<status, key, value, deleted[, ts, seq]>; status OK, SHORT, VERSION, MARKER, KEY, VALUE or CRC.

    Anything but OK leaves the other fields null. A deleted entry has a null value; an empty value is a value.
    """
    begin = 19 if log else 3
    size = F.octet_length(b)
    key_bytes = number(b, begin, 4)
    value_at = F.lit(begin + 4) + key_bytes.cast("int")
    safe = (size >= begin + 11) & (key_bytes <= MAX_KEY_BYTES) & (size >= begin + 11 + key_bytes)
    value_bytes = F.when(safe, number(b, value_at, 4))
    marker = F.hex(F.substring(b, 2, 1))
    status = (
        F.when(b.isNull() | (size < begin + 11), "SHORT")
        .when(F.hex(F.substring(b, 1, 1)) != VERSION, "VERSION")
        .when(~marker.isin(DATA, DELETED), "MARKER")
        .when((key_bytes > MAX_KEY_BYTES) | (size < begin + 11 + key_bytes), "KEY")
        .when((value_bytes > MAX_VALUE_BYTES) | (size != begin + 11 + key_bytes + value_bytes), "VALUE")
        .when(F.crc32(F.substring(b, F.lit(1), size - 4)) != number(b, size - 3, 4), "CRC")
        .otherwise("OK")
    )
    ok, deleted = status == "OK", marker == DELETED
    fields = [
        status.alias("status"),
        F.when(ok, F.substring(b, F.lit(begin + 4), key_bytes.cast("int")).cast("string")).alias("key"),
        F.when(ok & ~deleted, F.substring(b, value_at + 4, value_bytes.cast("int"))).alias("value"),
        F.when(ok, deleted).alias("deleted"),
    ]
    if log:
        fields += [F.when(ok, bytes_to_long(F.substring(b, 3, 8))).alias("ts"), F.when(ok, bytes_to_long(F.substring(b, 11, 8))).alias("seq")]
    return F.struct(*fields)


def entry_length(key: Column, value: Column) -> Column:
    return (F.lit(14) + F.octet_length(F.encode(key, "UTF-8")) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def block_entry_size(key: Column, value: Column) -> Column:
    """Bytes of an entry in a block: two lengths, the key and the value's envelope."""
    return (F.lit(22) + 2 * F.octet_length(F.encode(key, "UTF-8")) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")
