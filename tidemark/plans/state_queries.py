"""Queries over the change log, the store's API, runs, levels and compaction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import StoreConfig
from ..functions.bytesfn import to_hex
from ..operators import changelog, folds, levels
from ..operators import runs as run_ops
from . import fixtures as fx
from .fixtures import SQL_CATALOG, SQL_DISJOINT, SQL_KEYS, SQL_LATEST, SQL_OPS, SQL_RUNS

#: Thresholds at which the fixtures' levels do and do not need compaction.
SMALL = StoreConfig(level0_runs=4, level1_bytes=20_000)

_hex = lambda c="value": to_hex(F.col(c)).alias("value_hex")
_nhex = lambda c="value": F.lower(F.hex(c)).alias("value_hex")


def kv_state(spark, sf):
    return changelog.live(fx.ops(spark, sf)).select("key", _hex(), "seq")


def kv_put_upsert(spark, sf):
    log = fx.ops(spark, sf)
    top = log.agg(F.max("seq")).first()[0]
    new = log.select("key").distinct().where(F.col("key").cast("long") % 3 == 0)
    rows = new.select(F.lit(top + 1).cast("long").alias("seq"), "key", F.encode(F.concat(F.lit("put-"), "key"), "UTF-8").alias("value"))
    return changelog.live(changelog.put(log, rows)).select("key", _hex(), "seq")


def kv_get(spark, sf):
    return changelog.get(fx.ops(spark, sf), "42").select("key", _hex(), "seq")


def kv_multi_get(spark, sf):
    return changelog.multi_get(fx.keys(spark, sf), changelog.live(fx.ops(spark, sf))).select("key", _nhex(), "found")


def kv_delete(spark, sf):
    log = fx.ops(spark, sf)
    top = log.agg(F.max("seq")).first()[0]
    rows = log.select("key").distinct().where(F.col("key").cast("long") % 5 == 0).select(F.lit(top + 1).cast("long").alias("seq"), "key")
    return changelog.live(changelog.delete(log, rows)).select("key", _hex(), "seq")


def memtable_state(spark, sf):
    return changelog.latest(fx.ops(spark, sf)).select("key", "seq", "op", _nhex())


def memtable_size(spark, sf):
    return changelog.memtable_accounting(fx.ops(spark, sf))


def kv_stats(spark, sf):
    found = changelog.memtable_accounting(fx.ops(spark, sf))
    return found.select(F.col("size").alias("log_bytes"), F.col("ops").alias("log_ops"), F.col("entries").alias("log_entries"), F.lit(StoreConfig().cache_shards).cast("long").alias("cache_shards"))


def kv_flush_run(spark, sf):
    return run_ops.sorted_run(fx.ops(spark, sf)).select("key", "seq", "op", _nhex())


def flush_epochs(spark, sf):
    return folds.flush_epochs(fx.ops(spark, sf).withColumn("store", F.lit("main")), 1024)


def run_catalog(spark, sf):
    return fx.catalog(spark, sf)


def run_prune(spark, sf):
    rows = fx.runs_disjoint(spark, sf)
    wanted = fx.table(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("key"))
    return run_ops.prune(wanted, run_ops.run_catalog(rows, "run_id"))


def level_catalog(spark, sf):
    return fx.catalog(spark, sf).select("level", "run_id", "min_key", "max_key", "bytes")


def level_stats(spark, sf):
    return levels.level_stats(fx.catalog(spark, sf))


def level_limits(spark, sf):
    return levels.limits(spark, StoreConfig())


def level_lookup(spark, sf):
    return run_ops.lookup(fx.runs(spark, sf)).select("key", _hex(), "level", "run_id")


def needs_compaction(spark, sf):
    return levels.needs_compaction(fx.catalog(spark, sf), SMALL)


def compaction_candidates(spark, sf):
    return levels.candidates(fx.catalog(spark, sf))


def compaction_merge(spark, sf):
    return levels.merge(fx.runs(spark, sf).where("level <= 1"), bottommost=False).select("key", "seq", "op", _nhex())


def tombstone_gc(spark, sf):
    return levels.merge(fx.runs(spark, sf), bottommost=True).select("key", "seq", "op", _nhex())


def compaction_concat(spark, sf):
    """Each row with the key that follows it in its output partition: the next one in order, or none where a partition ends."""
    rows = levels.concat(fx.runs_disjoint(spark, sf)).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    follows = F.lead("key").over(Window.partitionBy("part").orderBy("at"))
    return rows.select("run_id", "key", _hex(), follows.alias("next")).select("run_id", "key", "value_hex", (F.col("next").isNull() | (F.col("next") > F.col("key"))).alias("in_order"))


def compaction_stats(spark, sf):
    return fx.catalog(spark, sf).where("level = 0").agg(F.count("*").alias("sources"), F.sum("bytes").alias("bytes_compacted"))


_LIVE = "SELECT key, lower(hex(value)) AS value_hex, seq FROM latest WHERE op = 'PUT'"
_AGAIN = """SELECT * FROM (SELECT * FROM ops UNION ALL {more}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"""

QUERIES = {
    f.__name__: f
    for f in (
        kv_state, kv_put_upsert, kv_get, kv_multi_get, kv_delete, memtable_state, memtable_size, kv_stats, kv_flush_run, flush_epochs, run_catalog, run_prune,
        level_catalog, level_stats, level_limits, level_lookup, needs_compaction, compaction_candidates, compaction_merge,
        tombstone_gc, compaction_concat, compaction_stats,
    )
}

_MEMTABLE = f"""WITH {SQL_OPS}, per AS (SELECT key, arg_min(op, seq) AS first, arg_max(op, seq) AS last, max(seq) AS top, count(*) AS ops FROM ops GROUP BY key)
SELECT CAST(coalesce(sum(CASE WHEN first = 'PUT' THEN length(per.key) ELSE 0 END + CASE WHEN last = 'PUT' THEN strlen(o.value) ELSE 0 END), 0) AS BIGINT) AS {{size}},
  CAST(coalesce(sum(ops), 0) AS BIGINT) AS {{ops}}, count(*) AS {{entries}}{{more}} FROM per JOIN ops o ON o.key = per.key AND o.seq = per.top"""

ORACLE_SQL = {
    "kv_state": f"WITH {SQL_LATEST} {_LIVE}",
    "kv_put_upsert": f"""WITH {SQL_OPS}, latest AS ({_AGAIN.format(more="SELECT (SELECT max(seq) FROM ops) + 1, key, 'PUT', 'put-' || key FROM (SELECT DISTINCT key FROM ops) k WHERE CAST(key AS BIGINT) % 3 = 0")}) {_LIVE}""",
    "kv_get": f"WITH {SQL_LATEST} {_LIVE} AND key = '42'",
    "kv_multi_get": f"""WITH {SQL_LATEST}, {SQL_KEYS} SELECT keys.key, lower(hex(value)) AS value_hex, l.key IS NOT NULL AS found
      FROM keys LEFT JOIN (SELECT * FROM latest WHERE op = 'PUT') l ON l.key = keys.key""",
    "kv_delete": f"""WITH {SQL_OPS}, latest AS ({_AGAIN.format(more="SELECT (SELECT max(seq) FROM ops) + 1, key, 'DEL', NULL FROM (SELECT DISTINCT key FROM ops) k WHERE CAST(key AS BIGINT) % 5 = 0")}) {_LIVE}""",
    "memtable_state": f"WITH {SQL_LATEST} SELECT key, seq, op, lower(hex(value)) AS value_hex FROM latest",
    "memtable_size": _MEMTABLE.format(size="size", ops="ops", entries="entries", more=""),
    "kv_stats": _MEMTABLE.format(size="log_bytes", ops="log_ops", entries="log_entries", more=", CAST(16 AS BIGINT) AS cache_shards"),
    "kv_flush_run": f"WITH {SQL_LATEST} SELECT key, seq, op, lower(hex(value)) AS value_hex FROM latest",
    "flush_epochs": f"""WITH RECURSIVE {SQL_OPS}, sized AS (SELECT seq, key, op = 'PUT' AS put, length(key) AS k, coalesce(strlen(value), 0) AS v FROM ops),
      ep AS (SELECT CAST(-1 AS BIGINT) AS epoch, CAST(-1 AS BIGINT) AS last, CAST(0 AS BIGINT) AS ops, CAST(0 AS BIGINT) AS entries, CAST(0 AS BIGINT) AS size UNION ALL
        SELECT epoch + 1, seq, ops, entries, size FROM (SELECT epoch, seq, row_number() OVER (ORDER BY seq) AS ops, CAST(sum(fresh) OVER w AS BIGINT) AS entries,
            CAST(sum(delta) OVER w AS BIGINT) AS size, max(seq) OVER () AS final FROM
          (SELECT epoch, seq, CASE WHEN before IS NULL THEN 1 ELSE 0 END AS fresh,
             CASE WHEN put AND before IS NULL THEN v + k WHEN put THEN v - before ELSE -coalesce(before, 0) END AS delta FROM
            (SELECT e.epoch, s.*, lag(CASE WHEN put THEN v ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS before FROM ep e JOIN sized s ON s.seq > e.last) a) b
          WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) c
        WHERE size >= 1024 OR seq = final QUALIFY row_number() OVER (ORDER BY seq) = 1)
      SELECT 'main' AS store, epoch, ops, entries, size FROM ep WHERE epoch >= 0""",
    "run_catalog": f"WITH {SQL_CATALOG} SELECT * FROM catalog",
    "run_prune": f"""WITH {SQL_DISJOINT}, catalog AS (SELECT run_id, min(key) AS lo, max(key) AS hi FROM runs_disjoint GROUP BY run_id)
      SELECT k.key, run_id FROM (SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key FROM orders) k JOIN catalog ON k.key BETWEEN lo AND hi""",
    "level_catalog": f"WITH {SQL_CATALOG} SELECT level, run_id, min_key, max_key, bytes FROM catalog",
    "level_stats": f"WITH {SQL_CATALOG} SELECT level, count(*) AS runs, CAST(sum(bytes) AS BIGINT) AS bytes FROM catalog GROUP BY level",
    "level_limits": "SELECT CAST(l AS INTEGER) AS level, CASE WHEN l = 0 THEN 9223372036854775807 ELSE CAST(10485760 * 10 ** (l - 1) AS BIGINT) END AS max_bytes FROM range(7) r(l)",
    "level_lookup": f"""WITH {SQL_RUNS}, newest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY level, run_id DESC) = 1)
      SELECT key, lower(hex(value)) AS value_hex, level, run_id FROM newest WHERE op = 'PUT'""",
    "needs_compaction": f"""WITH {SQL_CATALOG}, per AS (SELECT level, count(*) AS runs, CAST(sum(bytes) AS BIGINT) AS bytes FROM catalog GROUP BY level)
      SELECT CAST(l AS INTEGER) AS level, coalesce(runs, 0) AS runs, coalesce(bytes, 0) AS bytes,
        coalesce(runs, 0) > 0 AND l < 6 AND CASE WHEN l = 0 THEN coalesce(runs, 0) >= 4 ELSE coalesce(bytes, 0) > 20000 * 10 ** (l - 1) END AS needed
      FROM range(7) r(l) LEFT JOIN per ON per.level = l""",
    "compaction_candidates": f"""WITH {SQL_CATALOG} SELECT level, run_id FROM catalog
      QUALIFY level = 0 OR row_number() OVER (PARTITION BY level ORDER BY bytes DESC, run_id) = 1""",
    "compaction_merge": f"""WITH {SQL_RUNS} SELECT key, seq, op, lower(hex(value)) AS value_hex FROM runs WHERE level <= 1
      QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1""",
    "tombstone_gc": f"""WITH {SQL_RUNS}, newest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
      SELECT key, seq, op, lower(hex(value)) AS value_hex FROM newest WHERE op <> 'DEL'""",
    "compaction_concat": f"WITH {SQL_DISJOINT} SELECT run_id, key, lower(hex(value)) AS value_hex, true AS in_order FROM runs_disjoint",
    "compaction_stats": f"WITH {SQL_CATALOG} SELECT count(*) AS sources, CAST(sum(bytes) AS BIGINT) AS bytes_compacted FROM catalog WHERE level = 0",
}
