"""Queries that go through the store itself: batches, flushes, compactions, transactions, the shell."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..config import StoreConfig
from ..functions.bytesfn import bytes_to_string, to_hex
from ..store import KVStore
from . import fixtures as fx
from .fixtures import SQL_LATEST, SQL_OPS, SQL_STAGED


def _store(spark: SparkSession, **more) -> KVStore:
    """An empty store: beside the checkpoints where these have a shared folder, else in a temporary one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        root = f"{named.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"
    else:
        root = tempfile.mkdtemp(prefix="tidemark-store-")
    store = KVStore.open(spark, StoreConfig(data_dir=f"{root}/data", log_dir=f"{root}/log", **more))
    atexit.register(lambda: _forget(store, root))
    return store


def _forget(store: KVStore, root: str) -> None:
    try:
        store.files.delete_tree(root)
    except Exception:  # the session is gone: nothing is left to ask
        pass


def _hex(c: str = "value"):
    return F.lower(F.hex(c)).alias("value_hex")


def _filled(spark: SparkSession, sf: str) -> KVStore:
    """``ops`` in eight batches of consecutive rows, flushed and compacted on the way; level limits so small that merges cascade."""
    store = _store(spark, level0_runs=2, level1_bytes=2_000, level_multiplier=2)
    log = fx.ops(spark, sf)
    n = log.count()
    for k in range(fx.RUNS):
        part = log.where(F.least(F.floor(F.col("seq") / max(1, n // fx.RUNS)), F.lit(fx.RUNS - 1)) == k)
        store.write(part.withColumn("seq", F.col("seq") - k * max(1, n // fx.RUNS)))
        if k < fx.RUNS - 1:
            store.flush()
            while store.compact() is not None:
                pass
    return store


def store_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state after all batches: tombstones hide what lies on any level below."""
    return _filled(spark, sf).state().select("key", to_hex(F.col("value")).alias("value_hex"))


def store_multi_get(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf).multi_get(fx.keys(spark, sf)).select("key", _hex(), "found")


def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What ``stats`` says of one unflushed batch."""
    store = _store(spark, memtable_bytes=1 << 40)
    store.write(fx.ops(spark, sf))
    s = store.stats()
    row = (s["version"], s["log_bytes"], s["log_ops"], s["log_entries"], s["runs"], s["cache_shards"], s["compactions"])
    return spark.createDataFrame([row], "version long, log_bytes long, log_ops long, log_entries long, runs long, cache_shards long, compactions long")


def compaction_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    """A tombstone that a merge takes along from the next level still hides a row of the level below that.

    y and z lie on level 2, level 1 spans a to z and deletes z; then a and b are flushed and compacted.
    """
    store = _store(spark, level0_runs=1, level1_bytes=1, level_multiplier=1_000_000)
    for batch in ([("y", "PUT", b"1"), ("z", "PUT", b"1")], [("a", "PUT", b"1"), ("z", "DEL", None)], [("a", "PUT", b"2"), ("b", "PUT", b"2")]):
        rows = [(k, op, None if v is None else bytearray(v)) for k, op, v in batch]
        store.write(spark.createDataFrame(rows, "key string, op string, value binary"))
        store.flush()
        store.compact()
        if batch[0][0] == "y":
            store.compact()  # on to level 2
    asked = spark.createDataFrame([(k,) for k in "abyz"], "key string")
    return store.multi_get(asked).select("key", F.when(F.col("found"), bytes_to_string(F.col("value"))).alias("value"))


def txn_rollback(spark: SparkSession, sf: str) -> DataFrame:
    """Staged rows of a rolled-back transaction are dropped: the state is the one before."""
    store = _store(spark)
    store.write(fx.ops(spark, sf))
    txn = store.begin()
    for r in fx.staged(spark, sf).where("length(key) < 3 OR key = 'new-key'").collect():  # users under 100
        txn.delete(r["key"]) if r["op"] == "DEL" else txn.put(r["key"], bytes(r["value"]))
    txn.rollback()
    return store.state().select("key", to_hex(F.col("value")).alias("value_hex"))


def store_txn_commit(spark: SparkSession, sf: str) -> DataFrame:
    """The staged writes of users under 100, and of the new key, committed through a transaction."""
    store = _store(spark)
    store.write(fx.ops(spark, sf))
    txn = store.begin()
    for r in fx.staged(spark, sf).where("length(key) < 3 OR key = 'new-key'").collect():
        txn.delete(r["key"]) if r["op"] == "DEL" else txn.put(r["key"], bytes(r["value"]))
    txn.commit()
    return store.state().select("key", to_hex(F.col("value")).alias("value_hex"))


def demo_txn(spark: SparkSession, sf: str) -> DataFrame:
    """Two accounts are committed; a second transaction is rolled back and leaves no trace."""
    store = _store(spark)
    first = store.begin()
    first.put("account:001", b"1000.00")
    first.put("account:002", b"2000.00")
    first.commit()
    second = store.begin()
    second.put("account:001", b"500.00")
    second.put("account:003", b"1500.00")
    second.rollback()
    asked = spark.createDataFrame([("account:001",), ("account:002",), ("account:003",)], "key string")
    return store.multi_get(asked).select("key", F.when(F.col("found"), bytes_to_string(F.col("value"))).alias("value"))


#: Lines for the shell (fixed values).
SHELL = ["put k1 hello  big world", "GET k1", "del k1", "get k1", "put onlykey", "  get   k2 ", "noise a b c", "put k3 v"]


def shell_session(spark: SparkSession, sf: str) -> DataFrame:
    """What the shell answers, line by line."""
    store = _store(spark)
    return spark.createDataFrame([(n, cli.run_line(store, line)) for n, line in enumerate(SHELL)], "n long, answer string")


def shell_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = []
    for n, line in enumerate(SHELL):
        command, args = cli.parse(line)
        rows.append((n, command, *(args + [None, None])[:2]))
    return spark.createDataFrame(rows, "n long, command string, key string, value string")


QUERIES = {
    f.__name__: f
    for f in (store_state, store_multi_get, store_stats, compaction_tombstones, txn_rollback, store_txn_commit, demo_txn, shell_session, shell_parse)
}

_VALUES = ", ".join(f"(CAST({n} AS BIGINT), '{line}')" for n, line in enumerate(SHELL))
_FEW = "(length(key) < 3 OR key = 'new-key')"

ORACLE_SQL = {
    "store_state": f"WITH {SQL_LATEST} SELECT key, lower(hex(value)) AS value_hex FROM latest WHERE op = 'PUT'",
    "store_multi_get": f"""WITH {SQL_LATEST}, keys AS (SELECT DISTINCT key FROM ops UNION ALL SELECT * FROM (VALUES ('-1'), ('999999'), ('')) v(key))
      SELECT keys.key, lower(hex(value)) AS value_hex, l.key IS NOT NULL AS found FROM keys LEFT JOIN (SELECT * FROM latest WHERE op = 'PUT') l ON l.key = keys.key""",
    "store_stats": f"""WITH {SQL_OPS} SELECT CAST(1 AS BIGINT) AS version, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS log_bytes, count(*) AS log_ops,
      count(DISTINCT key) AS log_entries, CAST(0 AS BIGINT) AS runs, CAST(16 AS BIGINT) AS cache_shards, CAST(0 AS BIGINT) AS compactions FROM ops""",
    "compaction_tombstones": "SELECT * FROM (VALUES ('a', '2'), ('b', '2'), ('y', '1'), ('z', NULL)) v(key, value)",
    "txn_rollback": f"WITH {SQL_LATEST} SELECT key, lower(hex(value)) AS value_hex FROM latest WHERE op = 'PUT'",
    "store_txn_commit": f"""WITH {SQL_LATEST}, {SQL_STAGED}
      SELECT key, lower(hex(value)) AS value_hex FROM latest WHERE op = 'PUT' AND key NOT IN (SELECT key FROM staged WHERE {_FEW})
      UNION ALL SELECT key, lower(hex(value)) FROM staged WHERE op = 'PUT' AND {_FEW}""",
    "demo_txn": "SELECT * FROM (VALUES ('account:001', '1000.00'), ('account:002', '2000.00'), ('account:003', NULL)) v(key, value)",
    "shell_session": """SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'OK'), (1, 'hello  big world'), (2, 'OK'), (3, '(null)'), (4, 'usage: put <key> <value>'),
      (5, '(null)'), (6, 'unknown command: noise'), (7, 'OK')) v(n, answer)""",
    "shell_parse": rf"""SELECT n, lower(regexp_extract(line, '^\s*(\S+)', 1)) AS command,
      nullif(regexp_extract(line, '^\s*\S+\s+(\S+)', 1), '') AS key, nullif(regexp_extract(line, '^\s*\S+\s+\S+\s+(.*\S)', 1), '') AS value
      FROM (VALUES {_VALUES}) v(n, line)""",
}
