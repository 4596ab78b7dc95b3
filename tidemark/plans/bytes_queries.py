"""Queries over byte functions, hashes, Bloom filters, the codec and framed logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytesfn as b
from ..functions import codec, hashing
from ..sources import files
from . import fixtures as fx
from .fixtures import SQL_OPS


def _parts(spark, sf):
    return fx.table(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.encode("p_name", "UTF-8").alias("raw"))


def _wide(c="p_partkey"):
    return F.col(c) * 1_000_003 - 500_000_000


def int_to_bytes(spark, sf):
    return _parts(spark, sf).select("p_partkey", b.to_hex(b.int_to_bytes(_wide())).alias("out"))


def bytes_to_int(spark, sf):
    return _parts(spark, sf).select("p_partkey", b.bytes_to_int(F.substring("raw", 1, 4)).alias("out"))


def long_to_bytes(spark, sf):
    return _parts(spark, sf).select("p_partkey", b.to_hex(b.long_to_bytes(_wide())).alias("out"))


def bytes_to_long(spark, sf):
    return _parts(spark, sf).select("p_partkey", b.bytes_to_long(b.long_to_bytes(_wide())).alias("out"))


def string_to_bytes(spark, sf):
    return _parts(spark, sf).select("p_partkey", b.to_hex(b.string_to_bytes(F.when(F.col("p_size") > 5, F.col("p_name")))).alias("out"))


def bytes_to_string(spark, sf):
    return _parts(spark, sf).select("p_partkey", b.bytes_to_string(F.when(F.col("p_size") > 5, F.col("raw"))).alias("out"))


def bytes_compare(spark, sf):
    left, right = F.substring("raw", 1, 3), F.encode(F.lit("gre"), "UTF-8")
    return _parts(spark, sf).select("p_partkey", b.compare(F.when(F.col("p_size") > 5, left), right).alias("out"))


def bytes_equal(spark, sf):
    left = F.when(F.col("p_size") > 5, F.substring("raw", 1, 2))
    right = F.when(F.col("p_size") > 10, F.substring("raw", 1, 2))
    return _parts(spark, sf).select("p_partkey", b.equal(left, right).alias("out"))


def bytes_concat(spark, sf):
    return _parts(spark, sf).select("p_partkey", b.to_hex(b.concat(F.col("raw"), F.when(F.col("p_size") > 5, F.encode(F.lit("-x"), "UTF-8")), F.col("raw"))).alias("out"))


def bytes_slice(spark, sf):
    return _parts(spark, sf).select("p_partkey", b.to_hex(b.slice_bytes(F.col("raw"), F.lit(1), F.lit(2))).alias("out"))


def fnv1a(spark, sf):
    return _parts(spark, sf).select("p_partkey", b.fnv1a(F.when(F.col("p_size") > 2, F.col("raw"))).alias("out"))


def to_hex(spark, sf):
    return _parts(spark, sf).select("p_partkey", b.to_hex(F.when(F.col("p_size") > 2, F.col("raw"))).alias("out"))


def from_hex(spark, sf):
    return _parts(spark, sf).select("p_partkey", b.bytes_to_string(b.from_hex(F.hex("raw"))).alias("out"))


def bytes_is_empty(spark, sf):
    return _parts(spark, sf).select("p_partkey", b.is_empty(F.when(F.col("p_size") > 9, F.col("raw")).when(F.col("p_size") > 4, b.from_hex(F.lit("")))).alias("out"))


def bytes_length(spark, sf):
    return _parts(spark, sf).select("p_partkey", b.length(F.when(F.col("p_size") > 4, F.col("raw"))).cast("long").alias("out"))


def hash_mix(spark, sf):
    first = hashing.mix(F.col("raw"), F.lit(0))
    return _parts(spark, sf).select("p_partkey", first.alias("h1"), hashing.mix(F.col("raw"), first).alias("h2"))


def bloom_sizing(spark, sf):
    rows = [(n, p, hashing.bloom_bits(n, p), hashing.bloom_hashes(n, p)) for n in (0, 1, 10, 100, 1000, 10_000, 100_000) for p in (0.1, 0.01, 0.001)]
    return spark.createDataFrame(rows, "n long, fpp double, bits long, hashes long")


def filter_of_ops(spark, sf):
    """(bits set, number of bits, hash functions) of the filter of all keys."""
    known = fx.ops(spark, sf).select("key").distinct()
    n = known.count()
    bits, hashes = hashing.bloom_bits(n, 0.01), hashing.bloom_hashes(n, 0.01)
    return hashing.bloom_build(known, "key", bits, hashes), bits, hashes


def cache_shard(spark, sf):
    return fx.ops(spark, sf).select("key").distinct().select("key", hashing.string_hash(F.col("key")).alias("hash"), hashing.shard(F.col("key"), 16).alias("shard"))


def entry_size(spark, sf):
    return fx.ops(spark, sf).where("op = 'PUT'").select("seq", codec.block_entry_size(F.col("key"), F.col("value")).alias("bytes"))


def _encoded(spark, sf):
    deleted = F.col("op") == "DEL"
    return fx.ops(spark, sf).select("seq", "key", "op", "value", codec.encode_entry(F.col("key"), F.col("value"), deleted).alias("raw"))


def codec_encode(spark, sf):
    return _encoded(spark, sf).select("seq", b.to_hex(F.col("raw")).alias("raw_hex"))


def codec_length(spark, sf):
    return _encoded(spark, sf).select("seq", F.octet_length("raw").cast("long").alias("bytes"))


def codec_roundtrip(spark, sf):
    back = _encoded(spark, sf).withColumn("d", codec.decode_entry(F.col("raw")))
    return back.select("seq", F.col("d.status").alias("status"), F.col("d.key").alias("key"), F.lower(F.hex("d.value")).alias("value_hex"), F.col("d.deleted").alias("deleted"))


def list_files(spark, sf):
    return files.list_files(spark, sf, "*.parquet")


def directory_size(spark, sf):
    return files.directory_size(spark, sf)


QUERIES = {
    f.__name__: f
    for f in (
        int_to_bytes, bytes_to_int, long_to_bytes, bytes_to_long, string_to_bytes, bytes_to_string, bytes_compare, bytes_equal, bytes_concat, bytes_slice, fnv1a, to_hex, from_hex,
        bytes_is_empty, bytes_length, hash_mix, bloom_sizing, cache_shard, entry_size, codec_encode, codec_length, codec_roundtrip,
        list_files, directory_size,
    )
}

_BYTES = "list_transform(range(1, strlen({s}) + 1), lambda i: CAST(ascii(substr({s}, i, 1)) AS BIGINT))"
_MIX = "list_reduce(list_prepend(CAST({seed} AS BIGINT), " + _BYTES.format(s="p_name") + "), lambda h, x: xor((xor(h, x) * 1540483477) & 4294967295, ((xor(h, x) * 1540483477) & 4294967295) >> 15))"
_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), " + _BYTES.format(s="p_name") + "), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"
_HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), " + _BYTES.format(s="key") + "), lambda h, x: (h * 31 + x) & 4294967295)"
_SIGNED = "CAST(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END AS INTEGER)"
_WIDE = "(p_partkey * 1000003 - 500000000)"
_SELECT = "SELECT p_partkey, {x} AS out FROM part"

ORACLE_SQL = {
    "int_to_bytes": _SELECT.format(x=f"lower(right(printf('%016x', {_WIDE}), 8))"),
    "bytes_to_int": _SELECT.format(x=_SIGNED.format(h="CAST('0x' || hex(substr(p_name, 1, 4)) AS BIGINT)")),
    "long_to_bytes": _SELECT.format(x=f"lower(printf('%016x', {_WIDE}))"),
    "bytes_to_long": _SELECT.format(x=_WIDE),
    "string_to_bytes": _SELECT.format(x="CASE WHEN p_size > 5 THEN lower(hex(p_name)) ELSE '' END"),
    "bytes_to_string": _SELECT.format(x="CASE WHEN p_size > 5 THEN p_name ELSE '' END"),
    "bytes_compare": _SELECT.format(x="CAST(CASE WHEN NOT (p_size > 5) THEN -1 WHEN encode(substr(p_name, 1, 3)) < encode('gre') THEN -1 WHEN substr(p_name, 1, 3) = 'gre' THEN 0 ELSE 1 END AS INTEGER)"),
    "bytes_equal": _SELECT.format(x="NOT (p_size > 5 AND p_size <= 10)"),
    "bytes_concat": _SELECT.format(x="lower(hex(p_name || CASE WHEN p_size > 5 THEN '-x' ELSE '' END || p_name))"),
    "bytes_slice": _SELECT.format(x="lower(hex(substr(p_name, 2, 2)))"),
    "fnv1a": _SELECT.format(x=f"CASE WHEN p_size > 2 THEN {_SIGNED.format(h=_FNV)} ELSE 0 END"),
    "to_hex": _SELECT.format(x="CASE WHEN p_size > 2 THEN lower(hex(p_name)) ELSE '' END"),
    "from_hex": _SELECT.format(x="p_name"),
    "bytes_is_empty": _SELECT.format(x="NOT (p_size > 9)"),
    "bytes_length": _SELECT.format(x="CASE WHEN p_size > 4 THEN strlen(p_name) ELSE 0 END"),
    "hash_mix": f"SELECT p_partkey, h1, {_MIX.format(seed='h1')} AS h2 FROM (SELECT *, {_MIX.format(seed='0')} AS h1 FROM part) m",
    "bloom_sizing": """SELECT n, fpp, bits, CASE WHEN n = 0 THEN 1 ELSE greatest(1, CAST(floor(bits / n * ln(2) + 0.5) AS BIGINT)) END AS hashes FROM
      (SELECT CAST(n AS BIGINT) AS n, fpp, greatest(1, CAST(floor(-n * ln(fpp) / (ln(2) * ln(2))) AS BIGINT)) AS bits
       FROM (VALUES (0), (1), (10), (100), (1000), (10000), (100000)) a(n), (VALUES (CAST(0.1 AS DOUBLE)), (0.01), (0.001)) f(fpp)) s""",
    "cache_shard": f"WITH {SQL_OPS} SELECT key, {_SIGNED.format(h=_HASH)} AS hash, CAST({_HASH} & 15 AS INTEGER) AS shard FROM (SELECT DISTINCT key FROM ops) k",
    "entry_size": f"WITH {SQL_OPS} SELECT seq, 22 + 2 * strlen(key) + strlen(value) AS bytes FROM ops WHERE op = 'PUT'",
    "codec_length": f"WITH {SQL_OPS} SELECT seq, 14 + strlen(key) + coalesce(strlen(value), 0) AS bytes FROM ops",
    "codec_roundtrip": f"WITH {SQL_OPS} SELECT seq, 'OK' AS status, key, lower(hex(value)) AS value_hex, op = 'DEL' AS deleted FROM ops",
}
