"""Shared plumbing of the training-data operators: checkpoint folder, stable prefix sums, components.

Nothing here keeps state on one machine: what has to outlive an executor goes to the folder
that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space bytes that end a word.
WS = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"

#: Used only where no shared folder is named and Spark runs in this one process (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def work_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage; a local one only in local mode without a setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{LOCAL_CHECKPOINTS}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in the shared folder, so a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def reclaim(spark: SparkSession) -> None:
    """Asks for the shuffle files of finished steps to go.

    Spark's cleaner removes them once the driver's collector finds their plan unreachable, which on a quiet
    driver may take half an hour (``spark.cleaner.periodicGC.interval``); operators of many steps ask after
    their few large ones.
    """
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Written tables of one operator below the shared folder: dropped by name once spent, else when the process ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{work_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        atexit.register(self.drop)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """``df`` as a table that is read again; one of the same name stays until drop()."""
        path = f"{self.root}/{tag}-{len(self.paths)}-{uuid.uuid4().hex[:6]}"
        df.write.parquet(path)
        self.paths[path] = tag
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        """Deletes the tables of these names, all without a name."""
        for path in [p for p, t in self.paths.items() if t in tags or not tags]:
            del self.paths[path]
            _remove(self.spark, path)


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Written table in the shared folder for rows that are read more than once; it goes when the process ends."""
    return Scratch(df.sparkSession).write(df, tag)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone: nothing is left to ask
        pass


#: Rows of an Arrow batch at most: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of this session at BATCH_ROWS rows or what is set, if less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Words as maximal runs without the six white-space bytes; null and blank texts have none."""
    bare = F.trim(text, F.lit(WS))
    return F.when(bare.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK))


def running_totals(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Exclusive global prefix sums in ``order``: adds a column ``out`` for each ``{out: column}``,
    and ``out_all`` with the grand total.

    Range partitions keep the order, each partition's total goes through one prefix over as many
    rows as there are partitions, and a window inside each partition does the rest. No task sees
    more than one range partition. ``order`` has to be unique for a defined result; rows that tie
    get neighbouring places.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    totals = placed.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as partitions: a proven bound
    whole = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = F.broadcast(
        totals.select(
            "_pid",
            *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums],
            *[F.sum(f"_t_{o}").over(whole).alias(f"{o}_all") for o in sums],
        )
    )
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumns({f"_i_{o}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for o, c in sums.items()})
        .join(bases, "_pid")
        .withColumns({o: F.col(f"_b_{o}") + F.col(f"_i_{o}") for o in sums})
        .drop("_pid", *[f"_{k}_{o}" for k in "bi" for o in sums])
    )


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Distributed union-find over ``edges(a, b)``: ``(node, root)``, root the smallest node reachable.

    Every node has a parent (FastSV: Zhang, Azad and Hu 2020). A round hangs the parents of a node, as well as the
    node itself, below the smallest grandparent among its neighbours, then lets each node skip its parent; whole trees
    move at once, so rounds grow with the logarithm of the longest path (11 for 1,000 nodes in a row). Minima are
    combined map-side, so a node with very many links costs one row a task. State is written every round and the
    last one dropped; ``rounds`` is far beyond what any number of nodes needs. No links: no rows.
    """
    keep = Scratch(edges.sparkSession)
    one = edges.select("a", "b").where("a <> b")
    both = keep.write(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up"))
    state = keep.write(_grandparents(first), "state-0")
    for r in range(1, rounds):
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("top").alias("lowest"))
        # one row for the node, with what it knew, and one for its parent
        own = F.struct(F.col("node").alias("node"), F.least("up", "top", "lowest").alias("up"), F.col("top").alias("was"))
        above = F.struct(F.col("up").alias("node"), F.col("lowest").alias("up"), F.lit(None).cast("long").alias("was"))
        told = state.join(near, "node").select(F.explode(F.array(own, above)).alias("x"))
        moved = _grandparents(told.groupBy("x.node").agg(F.min("x.up").alias("up"), F.max("x.was").alias("was")))
        seen = Observation()
        new = moved.observe(seen, F.count_if(F.col("top") != F.col("was")).alias("moved")).select("node", "up", "top")
        state = keep.write(new, f"state-{r}")
        keep.drop(f"state-{r - 1}")
        if not seen.get["moved"]:
            keep.drop("both")
            return state.select("node", F.col("top").alias("root"))
    raise RuntimeError("components did not settle")


def _grandparents(parents: DataFrame) -> DataFrame:
    """Adds ``top``, the parent of the parent, to (node, up, ...)."""
    return parents.join(parents.select(F.col("node").alias("up"), F.col("up").alias("top")), "up")


#: Cells of a bitmap over 64-bit ids: 8 MB, whatever the number of ids.
CELL_BITS = 26


def cell_of(column: str) -> str:
    """SQL for the cell of an id: its leading bits."""
    return f"shiftrightunsigned({column}, {64 - CELL_BITS})"


def cells_of(ids: np.ndarray) -> np.ndarray:
    return (ids.view(np.uint64) >> np.uint64(64 - CELL_BITS)).astype(np.int32)


def id_bitmap(cells: DataFrame) -> np.ndarray:
    """Bitmap of the cells ``c``."""
    parts = cells.groupBy(F.expr("bitmap_bucket_number(c)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(c))").alias("bits")).collect()
    bits = np.zeros((1 << CELL_BITS) // 8 + 4096, np.uint8)
    for r in parts:  # buckets of 32,768 bits count from 1; bucket 0 has the number 0 alone
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[r["k"] * 4096 : r["k"] * 4096 + len(own)] = own
    return bits


def in_bitmap(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each id's cell is set: true for every id that was put in, and for some others."""
    c = cells_of(ids).astype(np.int64)
    k = np.where(c > 0, 1 + (c - 1) // 32768, 0)
    bit = np.where(c > 0, (c - 1) % 32768, 0)
    return (bits[k * 4096 + bit // 8] >> (bit % 8).astype(np.uint8) & 1).astype(bool)


LONG, INT, STRING, BINARY, DOUBLE, BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType(), T.DoubleType(), T.BooleanType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
