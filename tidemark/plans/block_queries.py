"""Queries over blocks, block indexes, filters and framed logs in their binary forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blocks as bl
from ..functions import codec, hashing
from ..functions.bytesfn import int_to_bytes, to_hex
from ..operators import changelog
from ..operators import runs as run_ops
from ..sources import log_frames
from . import fixtures as fx
from .bytes_queries import _MIX, _SIGNED, filter_of_ops
from .fixtures import SQL_KEYS, SQL_OPS, SQL_RUNS

BLOCK = 512
#: Records of a log file.
PER_FILE = 1000


def _split(spark, sf):
    return run_ops.blocks(fx.runs(spark, sf), BLOCK)


def block_split(spark, sf):
    return _split(spark, sf).select("run_id", "key", "block_id")


def block_meta(spark, sf):
    return run_ops.block_index(_split(spark, sf)).select("run_id", "block_id", "first_key", "last_key", "entries")


def block_index(spark, sf):
    return run_ops.block_index(_split(spark, sf)).select("run_id", "block_id", "first_key", "offset", "bytes")


def block_builder_stats(spark, sf):
    return run_ops.builder_stats(_split(spark, sf))


def _raw_blocks(spark, sf):
    return run_ops.block_bytes(fx.runs(spark, sf), _split(spark, sf))


def block_encode(spark, sf):
    """Blocks in their binary form; bytes without the 12 of the header are what the builder counted."""
    return _raw_blocks(spark, sf).select("run_id", "block_id", to_hex(F.col("raw")).alias("raw_hex"), (F.octet_length("raw") - 12).cast("long").alias("bytes"))


def block_checksum(spark, sf):
    return _raw_blocks(spark, sf).select("run_id", "block_id", codec.number(F.col("raw"), 5, 8).alias("crc"))


def block_decode(spark, sf):
    """Blocks read back; every seventh with a flipped bit in its last byte, every eleventh cut short."""
    n = F.col("run_id") * 1000 + F.col("block_id")
    last = F.octet_length("raw")
    flipped = F.concat(F.substring("raw", F.lit(1), last - 1), F.unhex(F.lpad(F.hex(codec.number(F.col("raw"), last, 1).bitwiseXOR(F.lit(1))), 2, "0")))
    damaged = F.when(n % 7 == 0, flipped).when(n % 11 == 0, F.substring("raw", F.lit(1), last - 3)).otherwise(F.col("raw"))
    back = _raw_blocks(spark, sf).select("run_id", "block_id", bl.decode_block(damaged).alias("d"))
    return back.select("run_id", "block_id", F.col("d.status").alias("status"), F.explode_outer("d.entries").alias("e")).select(
        "run_id", "block_id", "status", F.col("e.key").alias("key"), F.lower(F.hex(codec.decode_entry(F.col("e.value"))["value"])).alias("value_hex")
    )


def block_get(spark, sf):
    """Every key of ``keys`` asked of the one block of each run that can hold it, found by binary search in the index."""
    split = _split(spark, sf)
    placed = run_ops.place(fx.keys(spark, sf), run_ops.block_index(split))
    held = run_ops.block_bytes(fx.runs(spark, sf), split).select("run_id", "block_id", bl.decode_block(F.col("raw"))["entries"].alias("entries"))
    found = placed.join(held, ["run_id", "block_id"], "left")
    value = codec.decode_entry(bl.block_get(F.col("entries"), F.col("key")))["value"]
    return found.select("run_id", "key", "block_id", F.coalesce(bl.block_contains(F.col("entries"), F.col("key")), F.lit(False)).alias("found"), F.lower(F.hex(value)).alias("value_hex"))


def _index_rows(spark, sf):
    per = run_ops.block_index(_split(spark, sf))
    entry = F.struct("block_id", "first_key", "offset", "bytes")
    return per.groupBy("run_id").agg(F.array_sort(F.collect_list(entry)).alias("blocks")).select("run_id", bl.encode_index(F.col("blocks")).alias("raw"))


def index_encode(spark, sf):
    return _index_rows(spark, sf).select("run_id", to_hex(F.col("raw")).alias("raw_hex"))


def index_decode(spark, sf):
    back = _index_rows(spark, sf).select("run_id", bl.decode_index(F.col("raw")).alias("d"))
    return back.select("run_id", F.col("d.status").alias("status"), F.posexplode("d.blocks").alias("n", "b")).select(
        "run_id", "status", F.col("n").cast("long").alias("block_id"), F.col("b.first_key").alias("first_key"), F.col("b.offset").alias("offset"), F.col("b.bytes").alias("bytes")
    )


def _filter_bytes(spark, sf):
    found, bits, hashes = filter_of_ops(spark, sf)
    return bl.filter_bytes(found).select(bl.encode_filter(F.col("bytes"), F.lit(bits), F.lit(hashes)).alias("raw"))


def bloom_encode(spark, sf):
    return _filter_bytes(spark, sf).select(to_hex(F.col("raw")).alias("raw_hex"))


def bloom_decode(spark, sf):
    back = _filter_bytes(spark, sf).select(bl.decode_filter(F.col("raw")).alias("d"))
    return back.select("d.status", "d.bits", "d.hashes", F.octet_length("d.bytes").cast("long").alias("bytes"), F.bit_count(F.conv(F.hex(F.substring("d.bytes", 1, 4)), 16, 10).cast("bigint")).cast("long").alias("first_set"))


def bloom_build(spark, sf):
    return filter_of_ops(spark, sf)[0]


def bloom_probe(spark, sf):
    bits_set, bits, hashes = filter_of_ops(spark, sf)
    return hashing.bloom_probe(fx.keys(spark, sf), "key", bits_set, bits, hashes)


def _files(spark, sf, raw):
    """Log files of PER_FILE records in a row; a fixture, so a file's records are gathered."""
    records = raw.groupBy(F.expr(f"seq div {PER_FILE}").alias("file")).agg(F.array_sort(F.collect_list(F.struct("seq", F.hex("raw").alias("raw")))).alias("x"))
    return records.select(F.format_string("log-%012d", "file").alias("path"), F.unhex(F.array_join(F.transform("x", lambda r: r["raw"]), "")).alias("content"))


def _log_entry():
    return codec.encode_log_entry(F.col("key"), F.col("value"), F.col("op") == "DEL", F.col("seq") + 1_700_000_000_000, F.col("seq"))


def wal_frame(spark, sf):
    """Frames of the log in files, and the same read back by the framing parser."""
    framed = fx.ops(spark, sf).select("seq", codec.frame(_log_entry()).alias("raw"))
    return log_frames.decoded(log_frames.read_frames(_files(spark, sf, framed))).select(
        F.col("entry.seq").alias("seq"), (F.col("length") + 8).alias("bytes"), "status", F.col("entry.key").alias("key"), F.lower(F.hex("entry.value")).alias("value_hex")
    )


def _faulty_files(spark, sf):
    """Log files with planted faults: a wrong checksum, a wrong version, a length of 0 that ends a file."""
    entry, log = F.col("entry"), fx.ops(spark, sf).select("seq", _log_entry().alias("entry"))
    old = F.concat(F.unhex(F.lit("09")), F.substring(entry, F.lit(2), F.octet_length(entry) - 1))
    crc = F.concat(int_to_bytes(F.crc32(entry).bitwiseXOR(F.lit(1).cast("bigint"))), int_to_bytes(F.octet_length(entry)), entry)
    seq = F.col("seq")
    raw = F.when(seq % PER_FILE == 901, F.unhex(F.lit("00" * 8))).when(seq % 97 == 5, crc).when(seq % 89 == 7, codec.frame(old)).otherwise(codec.frame(entry))
    return _files(spark, sf, log.select("seq", raw.alias("raw")))


def wal_recover(spark, sf):
    """Recovery over several files: faulty records are skipped, what follows a zero length in its file is lost, later files win."""
    found = log_frames.recover(log_frames.read_frames(_faulty_files(spark, sf)))
    return changelog.live(found).select("key", to_hex(F.col("value")).alias("value_hex"))


def wal_repair(spark, sf):
    """Records by what becomes of them."""
    good, aside = log_frames.repair(log_frames.read_frames(_faulty_files(spark, sf)))
    return good.unionByName(aside).groupBy("status").agg(F.count("*").alias("records"))


QUERIES = {
    f.__name__: f
    for f in (
        block_split, block_meta, block_index, block_builder_stats, block_encode, block_checksum, block_decode, block_get, index_encode, index_decode, bloom_encode, bloom_decode,
        bloom_build, bloom_probe, wal_frame, wal_recover, wal_repair,
    )
}

# CRC-32 by table over the bytes of a hexadecimal text; the table is made from its polynomial.
SQL_CRC = """crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(i AS BIGINT) AS i FROM range(256) r(i)) s)"""
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all({h}, '..'), lambda x: CAST('0x' || x AS BIGINT))),
  lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"""


def sql_crc(h: str) -> str:
    return _CRC.format(h=h)


_INT = "printf('%08x', CAST({n} AS BIGINT))"
_LONG = "printf('%016x', CAST({n} AS BIGINT))"


def _pair(key: str, value: str) -> str:
    return f"{_INT.format(n=f'strlen({key})')} || lower(hex({key})) || {_INT.format(n=f'coalesce(strlen({value}), 0)')} || coalesce(lower(hex({value})), '')"


#: Entries in their envelopes, hexadecimal; the SQL before it names ``src(key, op, value, ...)``.
SQL_ENVELOPE = f"""bare AS (SELECT *, '01' || CASE WHEN op = 'DEL' THEN '02' ELSE '01' END || {_pair("key", "value")} AS body FROM src),
envelope AS (SELECT * EXCLUDE (body, t), body || {_INT.format(n=sql_crc("body"))} AS raw_hex FROM bare, crc_table)"""

_BLOCKS = f"""{SQL_RUNS}, sized AS (SELECT run_id, key, op, value, 22 + 2 * strlen(key) + strlen(value) AS size, row_number() OVER (PARTITION BY run_id ORDER BY key) AS n FROM runs WHERE op = 'PUT'),
fold AS (SELECT run_id, n, size AS filled, CAST(0 AS BIGINT) AS block_id FROM sized WHERE n = 1 UNION ALL
  SELECT s.run_id, s.n, CASE WHEN f.filled + s.size > {BLOCK} THEN s.size ELSE f.filled + s.size END, f.block_id + CASE WHEN f.filled + s.size > {BLOCK} THEN 1 ELSE 0 END
  FROM fold f JOIN sized s ON s.run_id = f.run_id AND s.n = f.n + 1),
split AS (SELECT s.*, block_id FROM sized s JOIN fold USING (run_id, n)),
per AS (SELECT run_id, block_id, min(key) AS first_key, max(key) AS last_key, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM split GROUP BY run_id, block_id),
idx AS (SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY run_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM per)"""
_RAW = f"""{_BLOCKS}, {SQL_CRC}, src AS (SELECT * FROM split), {SQL_ENVELOPE},
grouped AS (SELECT run_id, block_id, count(*) AS entries, string_agg(lower(hex(key)) || raw_hex, '' ORDER BY key) AS told,
  string_agg({_INT.format(n="strlen(key)")} || lower(hex(key)) || {_INT.format(n="length(raw_hex) // 2")} || raw_hex, '' ORDER BY key) AS body FROM envelope GROUP BY run_id, block_id),
raw AS (SELECT run_id, block_id, entries, {sql_crc("told")} AS crc, body FROM grouped, crc_table)"""

_KEY_MIX = _MIX.replace("p_name", "key")
_POSITIONS = f"""f AS (SELECT CAST(greatest(1, floor(-n * ln(CAST(0.01 AS DOUBLE)) / (ln(2) * ln(2)))) AS BIGINT) AS bits, n FROM (SELECT count(DISTINCT key) AS n FROM ops) c),
g AS (SELECT bits, greatest(1, CAST(floor(bits / n * ln(2) + 0.5) AS BIGINT)) AS hashes FROM f)"""


def _bits_of(source: str) -> str:
    at = _SIGNED.format(h="((h1 + i * h2) & 4294967295)")
    return f"""(SELECT key, abs(CAST({at} AS BIGINT)) % bits AS bit FROM (SELECT key, h1, {_KEY_MIX.format(seed="h1")} AS h2 FROM (SELECT key, {_KEY_MIX.format(seed="0")} AS h1 FROM {source}) a) b, g, range(50) r(i) WHERE i < hashes)"""


_FILTER = f"WITH {SQL_OPS}, {_POSITIONS}, own AS (SELECT DISTINCT bit FROM {_bits_of('(SELECT DISTINCT key FROM ops)')} x)"
_FILTER_BYTES = f"""{_FILTER}, b AS (SELECT i, coalesce(sum(1 << (bit % 8)), 0) AS v FROM (SELECT unnest(range((SELECT max(bit) // 8 + 1 FROM own))) AS i) s LEFT JOIN own ON bit // 8 = i GROUP BY i)"""

_FAULTS = f"""{SQL_OPS}, found AS (SELECT *, CASE WHEN seq % {PER_FILE} = 901 THEN 'LENGTH' WHEN seq % 97 = 5 THEN 'CRC' WHEN seq % 89 = 7 THEN 'VERSION' ELSE 'OK' END AS status
  FROM ops WHERE seq % {PER_FILE} <= 901)"""

ORACLE_SQL = {
    "block_split": f"WITH RECURSIVE {_BLOCKS} SELECT run_id, key, block_id FROM split",
    "block_meta": f"WITH RECURSIVE {_BLOCKS} SELECT run_id, block_id, first_key, last_key, entries FROM idx",
    "block_index": f"""WITH RECURSIVE {_BLOCKS} SELECT run_id, block_id, first_key, "offset", bytes FROM idx""",
    "block_builder_stats": f"WITH RECURSIVE {_BLOCKS} SELECT *, bytes // blocks AS average FROM (SELECT run_id, max(block_id) + 1 AS blocks, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM split GROUP BY run_id) s",
    "block_encode": f"""WITH RECURSIVE {_RAW} SELECT run_id, block_id, {_INT.format(n="entries")} || {_LONG.format(n="crc")} || body AS raw_hex, length(body) // 2 AS bytes FROM raw""",
    "block_checksum": f"WITH RECURSIVE {_RAW} SELECT run_id, block_id, crc FROM raw",
    "block_decode": f"""WITH RECURSIVE {_BLOCKS}, judged AS (SELECT *, run_id * 1000 + block_id AS n7 FROM split)
      SELECT run_id, block_id, 'OK' AS status, key, lower(hex(value)) AS value_hex FROM judged WHERE n7 % 7 <> 0 AND n7 % 11 <> 0
      UNION ALL SELECT DISTINCT run_id, block_id, CASE WHEN n7 % 7 = 0 THEN 'CRC' ELSE 'SHORT' END, NULL, NULL FROM judged WHERE n7 % 7 = 0 OR n7 % 11 = 0""",
    "block_get": f"""WITH RECURSIVE {_BLOCKS}, {SQL_KEYS}, placed AS (SELECT r.run_id, k.key, coalesce((SELECT max(block_id) FROM idx i WHERE i.run_id = r.run_id AND i.first_key <= k.key), -1) AS block_id
        FROM keys k, (SELECT DISTINCT run_id FROM idx) r)
      SELECT p.run_id, p.key, p.block_id, s.key IS NOT NULL AS found, lower(hex(s.value)) AS value_hex FROM placed p LEFT JOIN split s ON s.run_id = p.run_id AND s.block_id = p.block_id AND s.key = p.key""",
    "index_encode": f"""WITH RECURSIVE {_BLOCKS} SELECT run_id, '01' || {_INT.format(n="count(*)")} || string_agg({_INT.format(n="strlen(first_key)")} || lower(hex(first_key))
      || {_LONG.format(n='"offset"')} || {_INT.format(n="bytes")}, '' ORDER BY block_id) AS raw_hex FROM idx GROUP BY run_id""",
    "index_decode": f"""WITH RECURSIVE {_BLOCKS} SELECT run_id, 'OK' AS status, block_id, first_key, "offset", bytes FROM idx""",
    "bloom_encode": f"""{_FILTER_BYTES} SELECT '01' || {_INT.format(n="bits")} || {_INT.format(n="hashes")} || {_INT.format(n="count(*)")} || string_agg(printf('%02x', CAST(v AS BIGINT)), '' ORDER BY i) AS raw_hex FROM b, g GROUP BY bits, hashes""",
    "bloom_decode": f"{_FILTER_BYTES} SELECT 'OK' AS status, bits, hashes, (SELECT count(*) FROM b) AS bytes, (SELECT count(*) FROM own WHERE bit < 32) AS first_set FROM g",
    "bloom_build": f"{_FILTER} SELECT bit FROM own",
    "bloom_probe": f"""{_FILTER}, {SQL_KEYS} SELECT key, bool_and(bit IN (SELECT bit FROM own)) AS might_contain FROM {_bits_of("(SELECT DISTINCT key FROM keys)")} x GROUP BY key""",
    "wal_frame": f"WITH {SQL_OPS} SELECT seq, 38 + strlen(key) + coalesce(strlen(value), 0) AS bytes, 'OK' AS status, key, lower(hex(value)) AS value_hex FROM ops",
    "wal_recover": f"""WITH {_FAULTS}, latest AS (SELECT * FROM found WHERE status = 'OK' QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
      SELECT key, lower(hex(value)) AS value_hex FROM latest WHERE op = 'PUT'""",
    "wal_repair": f"WITH {_FAULTS} SELECT status, count(*) AS records FROM found GROUP BY status",
    "codec_encode": f"WITH {SQL_OPS}, {SQL_CRC}, src AS (SELECT * FROM ops), {SQL_ENVELOPE} SELECT seq, raw_hex FROM envelope",
}
