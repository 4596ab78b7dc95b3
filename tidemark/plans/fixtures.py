"""Change logs, runs and keys derived from the driver's tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changelog import latest
from ..operators.runs import run_catalog

RUNS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log from events: an error deletes its user's key."""
    gone = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("key"),
        F.when(gone, "DEL").otherwise("PUT").alias("op"),
        F.when(~gone, F.encode("props", "UTF-8")).alias("value"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight consecutive epochs of ``ops``, latest-wins inside each; the newest four on level 0, two on 1, two on 2."""
    log = ops(spark, sf_dir)
    n = table(spark, sf_dir, "events").count()
    epoch = F.least(F.floor(F.col("seq") / max(1, n // RUNS)), F.lit(RUNS - 1)).cast("long")
    rows = log.withColumn("run_id", epoch).groupBy("run_id", "key").agg(F.max("seq").alias("seq"), F.max_by(F.struct("op", "value"), "seq").alias("x"))
    level = F.when(F.col("run_id") >= 4, 0).when(F.col("run_id") >= 2, 1).otherwise(2)
    return rows.select("run_id", level.alias("level"), "key", "seq", F.col("x.op").alias("op"), F.col("x.value").alias("value"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_catalog(runs(spark, sf_dir), "run_id", "level")


def runs_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as eight runs whose key ranges do not meet."""
    orders = table(spark, sf_dir, "orders")
    top = orders.agg(F.max("o_orderkey")).first()[0]
    return orders.select(
        F.least(F.floor(F.col("o_orderkey") * RUNS / (top + 1)), F.lit(RUNS - 1)).cast("long").alias("run_id"),
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("key"),
        F.col("o_orderkey").alias("seq"),
        F.lit("PUT").alias("op"),
        F.encode("o_orderpriority", "UTF-8").alias("value"),
    )


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys of ``ops`` and three that no log has."""
    misses = spark.createDataFrame([("-1",), ("999999",), ("",)], "key string")
    return ops(spark, sf_dir).select("key").distinct().unionByName(misses)


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of a transaction: every 7th user put, every 11th deleted (deleting wins), and a new key."""
    user = F.col("key").cast("long")
    own = ops(spark, sf_dir).select("key").distinct().where((user % 7 == 0) | (user % 11 == 0))
    rows = own.select("key", F.when(user % 11 == 0, "DEL").otherwise("PUT").alias("op"), F.when(user % 11 != 0, F.encode(F.concat(F.lit("staged-"), "key"), "UTF-8")).alias("value"))
    return rows.unionByName(spark.createDataFrame([("new-key", "PUT", bytearray(b"new-value"))], "key string, op string, value binary"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read set: the first 50 live keys, every 5th with another value than the true one, and three absent keys."""
    from pyspark.sql import Window

    live = latest(ops(spark, sf_dir)).where("op = 'PUT'").orderBy("key").limit(50)
    numbered = live.withColumn("n", F.row_number().over(Window.orderBy("key")))  # 50 rows
    known = numbered.select("key", F.when(F.col("n") % 5 == 0, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("value")).alias("expected"))
    return known.unionByName(spark.createDataFrame([("-1", None), ("999999", None), ("", None)], "key string, expected binary"))


# The same derivations as SQL, to be put before a query.
SQL_OPS = """ops AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key,
  CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'PUT' END AS op,
  CASE WHEN event_type <> 'error' THEN props END AS value FROM events)"""
SQL_LATEST = SQL_OPS + """, latest AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"""
SQL_RUNS = SQL_OPS + """, epochs AS (SELECT *, least(seq // greatest(1, (SELECT count(*) FROM events) // 8), 7) AS run_id FROM ops),
runs AS (SELECT *, CASE WHEN run_id >= 4 THEN 0 WHEN run_id >= 2 THEN 1 ELSE 2 END AS level FROM epochs
  QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) = 1)"""
SQL_CATALOG = SQL_RUNS + """, catalog AS (SELECT run_id, level, count(*) AS entries, count(*) FILTER (op = 'DEL') AS tombstones,
  CAST(coalesce(sum(CASE WHEN op = 'PUT' THEN 22 + 2 * strlen(key) + strlen(value) END), 0) AS BIGINT) AS bytes,
  min(key) AS min_key, max(key) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq FROM runs GROUP BY run_id, level)"""
SQL_DISJOINT = """runs_disjoint AS (SELECT CAST(least(floor(o_orderkey * 8 / ((SELECT max(o_orderkey) FROM orders) + 1)), 7) AS BIGINT) AS run_id,
  lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderkey AS seq, o_orderpriority AS value FROM orders)"""
SQL_KEYS = """keys AS (SELECT DISTINCT key FROM ops UNION ALL SELECT * FROM (VALUES ('-1'), ('999999'), ('')) v(key))"""
SQL_STAGED = """staged AS (SELECT key, CASE WHEN CAST(key AS BIGINT) % 11 = 0 THEN 'DEL' ELSE 'PUT' END AS op,
  CASE WHEN CAST(key AS BIGINT) % 11 <> 0 THEN 'staged-' || key END AS value
  FROM (SELECT DISTINCT key FROM ops) k WHERE CAST(key AS BIGINT) % 7 = 0 OR CAST(key AS BIGINT) % 11 = 0
  UNION ALL SELECT 'new-key', 'PUT', 'new-value')"""
