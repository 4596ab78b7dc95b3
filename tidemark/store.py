"""A versioned key-value store: state is a query over immutable files that a manifest lists.

Writes append a Parquet batch to the log; a flush rewrites the log's rows as a sorted run; a compaction
rewrites runs. Each publishes one new manifest by compare-and-set, which is its only point of effect: files
that no manifest names do not exist for readers, and a failed step leaves the state as it was.
"""

from __future__ import annotations

import json
import logging
import os
import threading
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import MAX_KEY_BYTES, MAX_VALUE_BYTES, StoreConfig
from .operators import changelog, levels, transactions
from .operators.changelog import DEL, PUT
from .operators.runs import run_catalog, sorted_run
from .sources.files import file_system

ROW = "key string, seq long, op string, value binary"
_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Run:
    run_id: str
    level: int
    path: str
    entries: int
    tombstones: int
    bytes: int
    min_key: str | None
    max_key: str | None
    min_seq: int
    max_seq: int


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    runs: tuple[Run, ...] = ()
    log: tuple[str, ...] = ()
    log_bytes: int = 0
    log_ops: int = 0
    next_seq: int = 1
    flushed_seq: int = 0
    compactions: int = 0
    bytes_compacted: int = 0

    def dump(self) -> bytes:
        return json.dumps(asdict(self)).encode()

    @staticmethod
    def load(raw: bytes) -> Manifest:
        found = json.loads(raw)
        found["runs"] = tuple(Run(**r) for r in found["runs"])
        found["log"] = tuple(found["log"])
        return Manifest(**found)


class Conflict(RuntimeError):
    """A transaction's reads no longer hold."""


class KVStore:
    """Open with ``KVStore.open``; use as a context manager so that the log is flushed at the end."""

    def __init__(self, spark: SparkSession, config: StoreConfig):
        self.spark, self.config, self.closed = spark, config.validate(), False
        self.damaged: set[str] = set()
        self.files = file_system(spark, config.data_dir)
        self._manifests = os.path.join(config.data_dir, "manifest")
        for d in (config.data_dir, config.log_dir, self._manifests):
            self.files.ensure_directory(d)
        self.manifest = self._newest()
        self.compactor: Compactor | None = None
        self._skip_damaged()

    @classmethod
    def open(cls, spark: SparkSession, config: StoreConfig | None = None) -> KVStore:
        return cls(spark, config or StoreConfig())

    def _skip_damaged(self) -> None:
        """Leaves out, with a warning, runs whose files have no readable footer; the manifest still names them."""
        for run in self.manifest.runs:
            try:
                found = self.spark.read.parquet(run.path).columns
                if not {"key", "seq", "op", "value"} <= set(found):
                    raise ValueError(f"columns {found}")
            except Exception as why:
                _log.warning("run %s on level %d is left out: %s", run.path, run.level, str(why).splitlines()[0])
                self.damaged.add(run.run_id)

    def __enter__(self) -> KVStore:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    # manifests

    def _path(self, version: int) -> str:
        return os.path.join(self._manifests, f"{version:012d}.json")

    def _newest(self) -> Manifest:
        versions = [f for f in self.files.names(self._manifests) if f.endswith(".json")]
        return Manifest.load(self.files.read(os.path.join(self._manifests, versions[-1]))) if versions else Manifest()

    def _publish(self, new: Manifest) -> bool:
        """Make ``new`` the version after the one it was made from; False if somebody was faster."""
        new = replace(new, version=new.version + 1)
        if not self.files.create_exclusively(self._path(new.version), new.dump()):
            return False
        self.manifest = new
        return True

    def refresh(self) -> Manifest:
        self.manifest = self._newest()
        return self.manifest

    # reading

    def _check_open(self) -> None:
        if self.closed:
            raise RuntimeError("the store is closed")

    @staticmethod
    def _check_key(key: str) -> None:
        if key is None:
            raise ValueError("key must not be null")

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(*paths)

    def oplog(self, manifest: Manifest | None = None, key: str | None = None) -> DataFrame:
        """All rows that the manifest names. With a key only the runs whose range covers it are opened."""
        m = manifest or self.manifest
        runs = [r for r in m.runs if r.run_id not in self.damaged]
        runs = [r for r in runs if key is None or (r.min_key is not None and r.min_key.encode() <= key.encode() <= r.max_key.encode())]
        return self._read([*(r.path for r in runs), *m.log])

    def state(self, manifest: Manifest | None = None) -> DataFrame:
        return changelog.live(self.oplog(manifest))

    def get(self, key: str) -> bytes | None:
        self._check_open()
        self._check_key(key)
        found = changelog.get(self.oplog(key=key), key).select("value").head()
        return None if found is None else bytes(found["value"])

    def multi_get(self, keys: DataFrame) -> DataFrame:
        self._check_open()
        return changelog.multi_get(keys, self.state())

    def scan(self, low: str | None = None, high: str | None = None, prefix: str | None = None) -> DataFrame:
        """State rows of a key range or prefix (an addition: the key order makes it a pushed-down filter)."""
        self._check_open()
        rows = self.oplog()
        if low is not None:
            rows = rows.where(F.col("key") >= low)
        if high is not None:
            rows = rows.where(F.col("key") < high)
        if prefix is not None:
            rows = rows.where(F.col("key").startswith(prefix))
        return changelog.live(rows)

    # writing

    def write(self, rows: DataFrame) -> None:
        """Append (key, op, value[, seq]); ``seq`` orders rows of one batch, without it each key comes once.

        Nulls, unknown ops and sizes above the caps are rejected before anything is written.
        """
        self._check_open()
        self._write(rows, self.manifest, check_retry=True)

    def _write(self, rows: DataFrame, base: Manifest, check_retry: bool) -> None:
        seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
        rows = rows.select("key", seq.cast("long").alias("seq"), "op", F.when(F.col("op") == DEL, None).otherwise(F.col("value")).cast("binary").alias("value"))
        bad = (
            F.col("key").isNull()
            | ~F.col("op").isin(PUT, DEL)
            | F.col("op").isNull()
            | ((F.col("op") == PUT) & F.col("value").isNull())
            | (F.octet_length("key") > MAX_KEY_BYTES)
            | F.coalesce(F.octet_length("value") > MAX_VALUE_BYTES, F.lit(False))
            | (F.col("seq") < 0)
        )
        facts = rows.agg(
            F.count("*").alias("n"),
            F.sum(F.coalesce(bad, F.lit(True)).cast("long")).alias("bad"),
            F.max("seq").alias("top"),
            F.count_distinct("key", "seq").alias("distinct"),
            F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes"),
        ).first()
        if not facts["n"]:
            return
        if facts["bad"]:
            raise ValueError(f"{facts['bad']} rows with a null, an unknown op or too many bytes")
        if facts["distinct"] != facts["n"]:
            raise ValueError("rows of one key need different seq")
        while True:
            path = os.path.join(self.config.log_dir, f"batch-{base.next_seq:018d}-{uuid.uuid4().hex}")
            rows.withColumn("seq", F.col("seq") + base.next_seq).write.parquet(path)
            new = replace(
                base,
                log=(*base.log, path),
                log_bytes=base.log_bytes + facts["bytes"],
                log_ops=base.log_ops + facts["n"],
                next_seq=base.next_seq + facts["top"] + 1,
            )
            if self._publish(new):
                break
            if not check_retry:
                raise Conflict("another commit came first")
            base = self.refresh()
        if self.manifest.log_bytes >= self.config.memtable_bytes:
            self.flush()

    def _one(self, key: str, op: str, value: bytes | None) -> DataFrame:
        return self.spark.createDataFrame([(key, op, value)], "key string, op string, value binary")

    def put(self, key: str, value: bytes) -> None:
        self._check_open()
        self._check_key(key)
        if value is None:
            raise ValueError("value must not be null")
        self.write(self._one(key, PUT, value))

    def delete(self, key: str) -> None:
        self._check_open()
        self._check_key(key)
        self.write(self._one(key, DEL, None))

    # maintenance

    def _write_run(self, rows: DataFrame, level: int) -> Run:
        run_id = f"run-{uuid.uuid4().hex}"
        path = os.path.join(self.config.data_dir, f"level={level}", run_id)
        rows.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.config.bloom_fpp)).option(
            "parquet.page.size", self.config.block_bytes
        ).parquet(path)
        facts = run_catalog(self._read([path]).withColumn("run_id", F.lit(run_id)), "run_id").first()
        if facts is None:
            return Run(run_id, level, path, 0, 0, 0, None, None, 0, 0)
        return Run(level=level, path=path, **facts.asDict())

    def flush(self) -> None:
        """Rewrite the log's rows as one sorted run of level 0. Tombstones stay."""
        self._check_open()
        m = self.manifest
        if not m.log:
            return
        run = self._write_run(sorted_run(self._read(list(m.log))), 0)
        new = replace(m, runs=(*m.runs, run), log=(), log_bytes=0, log_ops=0, flushed_seq=m.next_seq - 1)
        if not self._publish(new):
            self.refresh()
            self.flush()
        elif self.config.truncate_log:
            for path in m.log:  # the run has their rows; manifests before it lose them
                self.files.delete_tree(path)

    def catalog(self) -> DataFrame:
        rows = [tuple(asdict(r).values()) for r in self.manifest.runs]
        return self.spark.createDataFrame(
            rows, "run_id string, level int, path string, entries long, tombstones long, bytes long, min_key string, max_key string, min_seq long, max_seq long"
        )

    def compact(self) -> dict | None:
        """Merge the lowest level that needs it into the next one; a row of figures, or None if none does."""
        self._check_open()
        m = self.manifest
        of = lambda level: [r for r in m.runs if r.level == level]
        full = lambda n: len(of(n)) >= self.config.level0_runs if n == 0 else sum(r.bytes for r in of(n)) > self.config.level_limit(n)
        level = next((n for n in range(self.config.max_level - 1) if of(n) and full(n)), None)
        if level is None:
            return None
        sources = of(0) if level == 0 else [max(of(level), key=lambda r: r.bytes)]
        meets = lambda some: [r for r in of(level + 1) if any(_overlap(r, x) for x in some)]
        joined = sources + meets(sources)
        gone = {r.run_id for r in joined}
        # the merged run is as wide as all it is made of: a tombstone in it may hide a row of any deeper run
        deeper = [r for r in m.runs if r.level > level and r.run_id not in gone and any(_overlap(r, x) for x in joined)]
        older = self.spark.createDataFrame([(r.min_key, r.max_key) for r in deeper], "min_key string, max_key string") if deeper else None
        merged = levels.concat(levels.merge(self._read([r.path for r in joined]), bottommost=True, older=older))
        run = self._write_run(merged, level + 1)
        moved = sum(r.bytes for r in sources)
        kept = tuple(r for r in m.runs if r.run_id not in gone)
        new = replace(m, runs=kept + ((run,) if run.entries else ()), compactions=m.compactions + 1, bytes_compacted=m.bytes_compacted + moved)
        if not self._publish(new):
            self.refresh()
            return self.compact()
        return {"level": level, "target": level + 1, "sources": len(joined), "bytes": moved, "entries": run.entries}

    def vacuum(self, older_than: float = 0.0) -> list[str]:
        """Deletes batches and runs that the newest manifest does not name and that are ``older_than`` seconds old; returns their paths.

        Readers of an older manifest lose what they pin, and a writer's files are young until it publishes
        them: give at least the length of the longest read and write.
        """
        self._check_open()
        named = {*(r.path for r in self.refresh().runs), *self.manifest.log}
        places = [self.config.log_dir, *(os.path.join(self.config.data_dir, d) for d in self.files.names(self.config.data_dir) if d.startswith("level="))]
        found = [os.path.join(p, n) for p in places for n in self.files.names(p) if n.startswith(("batch-", "run-"))]
        dead = sorted(p for p in found if p not in named and self.files.age(p) >= older_than)
        for path in dead:
            self.files.delete_tree(path)
        return dead

    def stats(self) -> dict:
        m = self.manifest
        return {
            "version": m.version,
            "log_bytes": m.log_bytes,
            "log_ops": m.log_ops,
            "log_entries": self._read(list(m.log)).select("key").distinct().count() if m.log else 0,
            "runs": len(m.runs),
            "cache_shards": self.config.cache_shards,
            "compactions": m.compactions,
            "bytes_compacted": m.bytes_compacted,
            "closed": self.closed,
        }

    def close(self) -> None:
        """Flush and close; closing again does nothing."""
        if self.closed:
            return
        if self.compactor is not None:
            self.compactor.stop()
        try:
            self.flush()
        finally:
            self.closed = True

    def compact_in_background(self, delay: float = 10.0, period: float = 30.0) -> Compactor:
        """Starts, at most once, a thread that looks for work after ``delay`` seconds and then every ``period``."""
        self._check_open()
        if self.compactor is None:
            self.compactor = Compactor(self, delay, period)
            self.compactor.start()
        return self.compactor

    def begin(self) -> Transaction:
        self._check_open()
        return Transaction(self)


def _overlap(a: Run, b: Run) -> bool:
    return a.min_key is not None and b.min_key is not None and a.min_key <= b.max_key and b.min_key <= a.max_key


class Compactor:
    """Compacts a store from time to time, level by level until no level needs it; a failed round is logged and the next one tries again."""

    def __init__(self, store: KVStore, delay: float, period: float):
        self.store, self.delay, self.period, self.rounds = store, delay, period, 0
        self._ended = threading.Event()
        self._thread = threading.Thread(target=self._run, name="compactor", daemon=True)

    def start(self) -> None:
        self._thread.start()

    def stop(self) -> None:
        """Ends the thread after the merge it is at."""
        self._ended.set()
        if self._thread is not threading.current_thread():
            self._thread.join()

    def check(self) -> int:
        """Compactions done now."""
        done = 0
        self.store.refresh()
        while not self._ended.is_set() and self.store.compact() is not None:
            done += 1
        return done

    def _run(self) -> None:
        wait = self.delay
        while not self._ended.wait(wait):
            try:
                self.check()
            except Exception:
                _log.exception("compaction failed")
            self.rounds += 1
            wait = self.period


@dataclass
class Transaction:
    """Snapshot reads, staged writes, optimistic commit: all or nothing, no locks between calls."""

    store: KVStore
    staged: dict[str, bytes | None] = field(default_factory=dict)
    reads: dict[str, bytes | None] = field(default_factory=dict)
    active: bool = True

    def __post_init__(self):
        self.snapshot = self.store.refresh()

    def _check(self) -> None:
        if not self.active:
            raise RuntimeError("the transaction has ended")

    def get(self, key: str) -> bytes | None:
        self._check()
        if key in self.staged:
            return self.staged[key]
        if key not in self.reads:  # the first observation is what commit validates
            found = changelog.get(self.store.oplog(self.snapshot, key), key).select("value").head()
            self.reads[key] = None if found is None else bytes(found["value"])
        return self.reads[key]

    def put(self, key: str, value: bytes) -> None:
        self._check()
        KVStore._check_key(key)
        if value is None:
            raise ValueError("value must not be null")
        self.staged[key] = value

    def delete(self, key: str) -> None:
        self._check()
        KVStore._check_key(key)
        self.staged[key] = None

    def rollback(self) -> None:
        self.active = False
        self.staged.clear()

    def commit(self) -> None:
        """Validate the reads against the newest state and publish the writes on top of it, or raise Conflict."""
        self._check()
        spark, store = self.store.spark, self.store
        try:
            while True:
                base = store.refresh()
                if self.reads:
                    reads = spark.createDataFrame(list(self.reads.items()), "key string, expected binary")
                    now = changelog.live(store.oplog(base).join(F.broadcast(reads.select("key")), "key", "left_semi"))
                    broken = transactions.conflicts(reads, now).head()
                    if broken is not None:
                        raise Conflict(f"{broken['key']} has changed")
                if not self.staged:
                    return
                rows = spark.createDataFrame([(k, DEL if v is None else PUT, v) for k, v in self.staged.items()], "key string, op string, value binary")
                try:
                    store._write(rows, base, check_retry=False)
                    return
                except Conflict:
                    continue  # somebody published meanwhile: look again
        finally:
            self.rollback()


