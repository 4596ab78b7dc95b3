"""Queries over transactions, isolation levels, caches, the demos and the shell."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bytesfn import bytes_to_string, to_hex
from ..operators import changelog, folds, transactions
from . import fixtures as fx
from .bytes_queries import _HASH
from .fixtures import SQL_LATEST, SQL_STAGED


def _state(spark, sf):
    return changelog.live(fx.ops(spark, sf))


def txn_read_your_writes(spark, sf):
    return transactions.overlay(_state(spark, sf), fx.staged(spark, sf)).select("key", to_hex(F.col("value")).alias("value_hex"))


def txn_commit(spark, sf):
    log = fx.ops(spark, sf)
    seq = log.agg(F.max("seq")).first()[0] + 1
    return changelog.live(log.unionByName(transactions.commit_rows(fx.staged(spark, sf), seq))).select("key", to_hex(F.col("value")).alias("value_hex"), "seq")


def txn_conflicts(spark, sf):
    found = transactions.conflicts(fx.reads(spark, sf), _state(spark, sf))
    return found.select("key", F.lower(F.hex("expected")).alias("expected_hex"), F.lower(F.hex("actual")).alias("actual_hex"))


def isolation_levels(spark, sf):
    return transactions.isolation_levels(spark)


def isolation_stricter(spark, sf):
    a = transactions.isolation_levels(spark).select(F.col("level").alias("level"), F.col("name").alias("name"))
    b = transactions.isolation_levels(spark).select(F.col("level").alias("other_level"), F.col("name").alias("other_name"))
    return a.join(b, F.col("level") > F.col("other_level"))  # five rows


def lru_hits(spark, sf):
    trace = fx.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"))
    return folds.cache_hits(trace, 4, 16)


def _log(spark, rows):
    data = [(n, k, op, None if v is None else bytearray(v.encode())) for n, (k, op, v) in enumerate(rows)]
    return spark.createDataFrame(data, "seq long, key string, op string, value binary")


#: The script of the basic demo: what is put, changed, deleted and asked for (fixed values).
DEMO = [
    ("user:1001", "PUT", "张三,25,工程师"),
    ("user:1002", "PUT", "李四,30,设计师"),
    ("user:1003", "PUT", "王五,28,产品经理"),
    ("user:1001", "PUT", "张三,26,高级工程师"),
    ("user:1003", "DEL", None),
]


def demo_basic(spark, sf):
    asked = spark.createDataFrame([("user:1001",), ("user:1002",), ("user:1003",), ("user:9999",)], "key string")
    return changelog.multi_get(asked, changelog.live(_log(spark, DEMO))).select("key", F.when(F.col("found"), bytes_to_string(F.col("value"))).alias("value"))


def perf_keys(spark, sf):
    return spark.range(10_000).select(F.format_string("perf_key_%06d", "id").alias("key"), F.concat(F.lit("performance_test_value_"), "id").alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        txn_read_your_writes, txn_commit, txn_conflicts, isolation_levels, isolation_stricter, lru_hits, demo_basic, perf_keys,
    )
}

_ISO = "(VALUES (0, 'Read Uncommitted'), (1, 'Read Committed'), (2, 'Repeatable Read'), (3, 'Snapshot Isolation'), (4, 'Serializable'))"

ORACLE_SQL = {
    "txn_read_your_writes": f"""WITH {SQL_LATEST}, {SQL_STAGED}, state AS (SELECT key, value FROM latest WHERE op = 'PUT')
      SELECT coalesce(s.key, t.key) AS key, lower(hex(CASE WHEN s.op = 'PUT' THEN s.value ELSE t.value END)) AS value_hex
      FROM state t FULL JOIN staged s ON s.key = t.key WHERE s.op IS NULL OR s.op = 'PUT'""",
    "txn_commit": f"""WITH {SQL_LATEST}, {SQL_STAGED}
      SELECT key, lower(hex(value)) AS value_hex, seq FROM latest WHERE op = 'PUT' AND key NOT IN (SELECT key FROM staged)
      UNION ALL SELECT key, lower(hex(value)), (SELECT max(seq) FROM ops) + 1 FROM staged WHERE op = 'PUT'""",
    "txn_conflicts": f"""WITH {SQL_LATEST}, state AS (SELECT key, value FROM latest WHERE op = 'PUT'),
      reads AS (SELECT key, CASE WHEN n % 5 = 0 THEN 'other' ELSE value END AS expected
        FROM (SELECT *, row_number() OVER (ORDER BY key) AS n FROM state) s WHERE n <= 50
        UNION ALL SELECT * FROM (VALUES ('-1', NULL), ('999999', NULL), ('', NULL)) v(key, expected))
      SELECT r.key, lower(hex(expected)) AS expected_hex, lower(hex(value)) AS actual_hex
      FROM reads r LEFT JOIN state s ON s.key = r.key WHERE expected IS DISTINCT FROM value""",
    "isolation_levels": f"""SELECT CAST(l AS INTEGER) AS level, n AS name, n || ' (Level ' || l || '): ' || CASE l WHEN 0 THEN 'may see writes that are never committed'
        WHEN 1 THEN 'sees committed writes alone, perhaps others at the second look' WHEN 2 THEN 'sees the same value of a key at every look, perhaps new keys'
        WHEN 3 THEN 'sees one version of the store throughout' ELSE 'acts as if transactions came one after another' END AS text, l = 0 AS dirty_reads, l <= 1 AS non_repeatable_reads, l < 3 AS phantom_reads,
      l >= 3 AS snapshot, l = 3 AS recommended FROM {_ISO} v(l, n)""",
    "isolation_stricter": f"""SELECT CAST(a.l AS INTEGER) AS level, a.n AS name, CAST(b.l AS INTEGER) AS other_level, b.n AS other_name
      FROM {_ISO} a(l, n) JOIN {_ISO} b(l, n) ON a.l > b.l""",
    "lru_hits": f"""WITH a AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, CAST({_HASH} & 15 AS INTEGER) AS shard FROM (SELECT event_id, user_id, CAST(user_id AS VARCHAR) AS key FROM events) e),
      p AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev FROM a),
      between_ AS (SELECT p.seq, count(DISTINCT b.key) AS others FROM p JOIN a b ON b.shard = p.shard AND b.seq > p.prev AND b.seq < p.seq GROUP BY p.seq)
      SELECT shard, count(*) AS gets, count(*) FILTER (prev IS NOT NULL AND coalesce(others, 0) < 4) AS hits FROM p LEFT JOIN between_ USING (seq) GROUP BY shard""",
    "demo_basic": "SELECT * FROM (VALUES ('user:1001', '张三,26,高级工程师'), ('user:1002', '李四,30,设计师'), ('user:1003', NULL), ('user:9999', NULL)) v(key, value)",
    "perf_keys": "SELECT printf('perf_key_%06d', i) AS key, 'performance_test_value_' || i AS value FROM range(10000) r(i)",
}
