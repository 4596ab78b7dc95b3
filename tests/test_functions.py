import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bytesfn as b
from tidemark.functions import codec, hashing

VALUES = [None, b"", b"\x00", b"\x7f", b"\x80", b"\xff", b"\x01", b"\x01\x00", b"\x01\x01", b"abc", "张三".encode(), "�".encode(), "\U0001f600".encode()]


def column(spark, values, kind):
    return spark.createDataFrame([(i, None if v is None else v) for i, v in enumerate(values)], f"i int, x {kind}").coalesce(1)


def run(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_integers(spark):
    ints = [0, 1, -1, 2**31 - 1, -(2**31)]
    df = column(spark, ints, "int")
    assert run(df, b.bytes_to_int(b.int_to_bytes(F.col("x")))) == ints
    assert [bytes(x) for x in run(df, b.int_to_bytes(F.col("x")))] == [v.to_bytes(4, "big", signed=True) for v in ints]
    longs = [0, -1, 2**63 - 1, -(2**63), 1 << 40]
    df = column(spark, longs, "long")
    assert run(df, b.bytes_to_long(b.long_to_bytes(F.col("x")))) == longs
    with pytest.raises(Exception, match="4 bytes"):
        run(column(spark, [b"abc"], "binary"), b.bytes_to_int(F.col("x")))


def test_hex_length_text(spark):
    df = column(spark, [None if v is None else bytearray(v) for v in VALUES], "binary")
    assert run(df, b.to_hex(F.col("x"))) == [(v or b"").hex() for v in VALUES]
    assert run(df, b.length(F.col("x"))) == [len(v or b"") for v in VALUES]
    assert run(df, b.is_empty(F.col("x"))) == [not v for v in VALUES]
    assert run(df, b.bytes_to_string(F.col("x"))) == [(v or b"").decode("utf-8", "replace") for v in VALUES]
    assert [bytes(x) for x in run(df, b.from_hex(b.to_hex(F.col("x"))))] == [v or b"" for v in VALUES]
    for bad in ("abc", "zz"):
        with pytest.raises(Exception, match="hexadecimal"):
            run(column(spark, [bad], "string"), b.from_hex(F.col("x")))


def test_fnv_and_compare(spark):
    def fnv(v):
        if not v:
            return 0
        h = 2166136261
        for x in v:
            h = (h ^ x) * 16777619 & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    df = column(spark, [None if v is None else bytearray(v) for v in VALUES], "binary")
    assert run(df, b.fnv1a(F.col("x"))) == [fnv(v) for v in VALUES]
    pairs = [(p, q) for p in VALUES for q in VALUES]
    two = spark.createDataFrame([(i, p and bytearray(p), q and bytearray(q)) if p != b"" and q != b"" else (i, None if p is None else bytearray(p), None if q is None else bytearray(q)) for i, (p, q) in enumerate(pairs)], "i int, x binary, y binary")
    rank = lambda v: (v is not None, v or b"")
    assert run(two, b.compare(F.col("x"), F.col("y"))) == [(rank(p) > rank(q)) - (rank(p) < rank(q)) for p, q in pairs]


def test_slice_and_concat(spark):
    df = column(spark, [bytearray(b"abcdef")], "binary")
    assert bytes(run(df, b.slice_bytes(F.col("x"), F.lit(2), F.lit(3)))[0]) == b"cde"
    with pytest.raises(Exception, match="range"):
        run(df, b.slice_bytes(F.col("x"), F.lit(4), F.lit(3)))
    assert bytes(run(df, b.concat(F.col("x"), F.lit(None).cast("binary"), F.col("x")))[0]) == b"abcdefabcdef"


def test_codec(spark):
    rows = [("k", b"v", False), ("键", b"", False), ("gone", None, True), ("", b"x" * 300, False)]
    df = spark.createDataFrame([(i, k, None if v is None else bytearray(v), d) for i, (k, v, d) in enumerate(rows)], "i int, key string, value binary, deleted boolean")
    raw = df.withColumn("x", codec.encode_entry(F.col("key"), F.col("value"), F.col("deleted")))
    for (k, v, d), x in zip(rows, run(raw, F.col("x")), strict=True):
        body = bytes([1, 2 if d else 1]) + len(k.encode()).to_bytes(4, "big") + k.encode() + len(v or b"").to_bytes(4, "big") + (v or b"")
        assert bytes(x) == body + zlib.crc32(body).to_bytes(4, "big")
    back = [r[0] for r in raw.orderBy("i").select(codec.decode_entry(F.col("x"))).collect()]
    assert [(r.status, r.key, None if r.value is None else bytes(r.value), r.deleted) for r in back] == [("OK", *r) for r in rows]
    # any flipped byte is noticed
    whole = bytes(run(raw, F.col("x"))[0])
    broken = column(spark, [bytearray(whole[:i] + bytes([whole[i] ^ 0x55]) + whole[i + 1 :]) for i in range(len(whole))] + [bytearray(whole[:5]), None], "binary")
    assert "OK" not in [r.status for r in run(broken, codec.decode_entry(F.col("x")))]


def test_bloom(spark):
    keys = spark.range(2000).selectExpr("concat('key-', id) key")
    bits, hashes = hashing.bloom_bits(2000, 0.01), hashing.bloom_hashes(2000, 0.01)
    built = hashing.bloom_build(keys, "key", bits, hashes).cache()
    assert hashing.bloom_probe(keys, "key", built, bits, hashes).where("not might_contain").count() == 0
    others = spark.range(2000).selectExpr("concat('other-', id) key")
    assert hashing.bloom_probe(others, "key", built, bits, hashes).where("might_contain").count() < 400
    assert (hashing.bloom_bits(0, 0.01), hashing.bloom_hashes(0, 0.01)) == (1, 1)


def test_string_hash(spark):
    def java(s):
        h = 0
        raw = s.encode("utf-16-be")
        for i in range(0, len(raw), 2):
            h = (31 * h + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    texts = ["", "a", "user:1001", "张三", "\U0001f600x"]
    df = column(spark, texts, "string")
    assert run(df, hashing.string_hash(F.col("x"))) == [java(s) for s in texts]
    order = ["�", "\U0001f600"]
    assert [r[0] for r in column(spark, order, "string").orderBy(b.order_key(F.col("x"))).select("x").collect()] == order[::-1]
