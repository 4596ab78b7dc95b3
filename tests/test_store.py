"""The store against a dict: random writes, flushes, compactions, reopening; transactions; damaged logs."""

import os
import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.config import StoreConfig
from tidemark.functions import codec
from tidemark.operators import changelog
from tidemark.operators.folds import LRU, ShardedLRU
from tidemark.operators.transactions import Isolation
from tidemark.sources import files, log_frames
from tidemark.store import Conflict, KVStore


def config(tmp_path, **more):
    return StoreConfig(data_dir=str(tmp_path / "data"), log_dir=str(tmp_path / "log"), **{"level0_runs": 2, "level1_bytes": 400, **more})


def contents(store):
    return {r["key"]: bytes(r["value"]) for r in store.state().collect()}


def test_model(spark, tmp_path):
    rnd, model = random.Random(4), {}
    store = KVStore.open(spark, config(tmp_path))
    for step in range(8):
        rows, batch = [], {}
        for n in range(20):
            key = f"k{rnd.randrange(25):02d}"
            value = None if rnd.random() < 0.3 else rnd.choice([b"", b"v%d" % rnd.randrange(99)])
            rows.append((n, key, "DEL" if value is None else "PUT", None if value is None else bytearray(value)))
            batch[key] = value
        store.write(spark.createDataFrame(rows, "seq long, key string, op string, value binary"))
        model = {k: v for k, v in (model | batch).items() if v is not None}
        assert contents(store) == model
        before = store.manifest
        if step % 2:
            store.flush()
            assert contents(store) == model
        if step % 4 == 3:
            store.compact()
            store.compact()
            assert contents(store) == model
        if step == 5:
            store.close()
            store.close()
            store = KVStore.open(spark, config(tmp_path))
            assert contents(store) == model
        assert store.state(before).count() == len(model)  # a pinned version stays readable
    assert store.get("k00") == model.get("k00") and store.get("absent") is None
    got = store.multi_get(spark.createDataFrame([(k,) for k in [*model, "absent"]], "key string")).collect()
    assert {r["key"]: r["found"] for r in got} == {**{k: True for k in model}, "absent": False}
    assert store.scan("k05", "k10").count() == sum("k05" <= k < "k10" for k in model)
    assert store.scan(prefix="k1").count() == sum(k.startswith("k1") for k in model)
    assert store.stats()["compactions"] > 0 and store.catalog().count() == len(store.manifest.runs)


def test_rejections(spark, tmp_path):
    store = KVStore.open(spark, config(tmp_path))
    for bad in (lambda: store.put(None, b""), lambda: store.put("k", None), lambda: store.get(None), lambda: store.put("k" * 10_241, b""), lambda: store.put("k", b"x" * ((1 << 20) + 1))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError, match="different seq"):
        store.write(spark.createDataFrame([("a", "PUT", bytearray(b"1")), ("a", "PUT", bytearray(b"2"))], "key string, op string, value binary"))
    assert store.manifest.version == 0
    store.delete("absent")
    store.close()
    with pytest.raises(RuntimeError):
        store.get("k")
    for wrong in ({"cache_shards": 12}, {"bloom_fpp": 1.5}, {"max_level": 1}):
        with pytest.raises(ValueError):
            StoreConfig(**wrong).validate()


def test_transactions(spark, tmp_path):
    store = KVStore.open(spark, config(tmp_path))
    t = store.begin()
    t.put("a", b"1")
    t.put("b", b"2")
    assert t.get("a") == b"1" and store.get("a") is None
    t.commit()
    assert contents(store) == {"a": b"1", "b": b"2"}
    with pytest.raises(RuntimeError):
        t.get("a")
    t = store.begin()
    t.put("a", b"9")
    t.delete("b")
    assert t.get("b") is None
    t.rollback()
    assert contents(store) == {"a": b"1", "b": b"2"}
    first, second = store.begin(), store.begin()
    assert first.get("a") == second.get("a") == b"1" and second.get("new") is None
    first.put("a", b"5")
    first.commit()
    second.put("b", b"7")
    assert second.get("a") == b"1"
    with pytest.raises(Conflict):
        second.commit()
    assert contents(store) == {"a": b"5", "b": b"2"}
    blind, other = store.begin(), store.begin()
    blind.put("b", b"8")
    other.put("c", b"3")
    other.commit()
    blind.commit()
    assert contents(store) == {"a": b"5", "b": b"8", "c": b"3"}


def frame(body):
    return struct.pack(">Ii", zlib.crc32(body), len(body)) + body


def entry(key, value, seq, version=1):
    body = bytes([version, 1]) + struct.pack(">qqi", 1000 + seq, seq, len(key)) + key + struct.pack(">i", len(value)) + value
    return body + struct.pack(">I", zlib.crc32(body))


@pytest.mark.parametrize(
    "tail, stop",
    [(b"\0" * 5, "SHORT"), (struct.pack(">Ii", 0, 0), "LENGTH"), (struct.pack(">Ii", 0, -1), "LENGTH"), (struct.pack(">Ii", 0, (10 << 20) + 1), "LENGTH"), (struct.pack(">Ii", 0, 50) + b"x", "PAST_END")],
)
def test_damaged_log(spark, tail, stop):
    bad = bytearray(frame(entry(b"lost", b"v", 2)))
    bad[12] ^= 1
    raw = frame(entry(b"k", b"old", 1)) + bytes(bad) + frame(entry(b"odd", b"v", 3, version=9)) + frame(entry(b"k", b"", 4)) + tail + (b"" if stop == "SHORT" else frame(entry(b"behind", b"v", 5)))
    frames = log_frames.read_frames(spark.createDataFrame([("f", bytearray(raw))], "path string, content binary"))
    found = [r["status"] for r in log_frames.decoded(frames).orderBy("position").collect()]
    assert found == ["OK", "CRC", "VERSION", "OK", stop]
    oplog = log_frames.recover(frames).orderBy("seq").collect()
    assert [(r["key"], r["op"], bytes(r["value"])) for r in oplog] == [("k", "PUT", b"old"), ("k", "PUT", b"")]
    good, aside = log_frames.repair(frames)
    assert (good.count(), aside.count()) == (2, 3)


def test_several_logs(spark):
    """A later file wins, wherever in it the record stands."""
    old = frame(entry(b"x", b"1", 1)) + frame(entry(b"k", b"old", 2))
    frames = log_frames.read_frames(spark.createDataFrame([("wal-1", bytearray(frame(entry(b"k", b"new", 3)))), ("wal-0", bytearray(old))], "path string, content binary"))
    assert {r["key"]: bytes(r["value"]) for r in changelog.live(log_frames.recover(frames)).collect()} == {"x": b"1", "k": b"new"}


def test_decoders_agree(spark):
    """The parser's decoder and the codec's expression say the same of sound, cut and flipped entries."""
    rnd, good = random.Random(5), entry("k张".encode(), b"value", 7)
    bodies = [good, entry(b"", b"", 1), b"", good[:29], good[:-1], good + b"x", entry(b"k", b"v", 2, version=3)]
    for _ in range(60):
        bad = bytearray(good)
        bad[rnd.randrange(len(bad))] ^= 1 << rnd.randrange(8)
        bodies.append(bytes(bad))
    table = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "i int, b binary").coalesce(1)
    said = [r["d"] for r in table.select("i", codec.decode_entry(F.col("b"), log=True).alias("d")).orderBy("i").collect()]
    assert [(d["status"], d["key"], d["value"] and bytes(d["value"]), d["deleted"], d["ts"], d["seq"]) for d in said] == [
        (s, k, v, g, t, q) if v else (s, k, d["value"], g, t, q) for (s, k, v, g, t, q), d in zip(map(log_frames.decode_body, bodies), said, strict=True)
    ]


def run_of(store, *rows):
    store.write(store.spark.createDataFrame([(k, "DEL" if v is None else "PUT", None if v is None else bytearray(v)) for k, v in rows], "key string, op string, value binary"))
    store.flush()


def test_tombstones_of_the_next_level(spark, tmp_path):
    """A merge that takes in wider runs keeps their tombstones where a deeper run may hold the key."""
    store = KVStore.open(spark, config(tmp_path, level0_runs=1, level1_bytes=1, level_multiplier=10**6))
    run_of(store, ("y", b"1"), ("z", b"1"))
    assert store.compact()["target"] == 1 and store.compact()["target"] == 2
    run_of(store, ("a", b"1"), ("z", None))
    store.compact()
    assert store.get("z") is None and [r.level for r in store.manifest.runs] == [2, 1]
    run_of(store, ("a", b"2"), ("b", b"2"))
    store.compact()
    assert store.get("z") is None and contents(store) == {"a": b"2", "b": b"2", "y": b"1"}


def test_model_of_levels(spark, tmp_path):
    """Random writes, flushes and compactions over four levels; reads never change by maintenance."""
    rnd, model = random.Random(14), {}
    store = KVStore.open(spark, config(tmp_path, level0_runs=1, level1_bytes=1, level_multiplier=2, max_level=4))
    for step in range(14):
        low = rnd.randrange(20)
        rows = [(f"k{k:02d}", None if rnd.random() < 0.45 else b"v%d" % step) for k in rnd.sample(range(low, low + 8), 4)]
        run_of(store, *rows)
        model = {k: v for k, v in (model | dict(rows)).items() if v is not None}
        for _ in range(rnd.randrange(4)):
            store.compact()
        assert contents(store) == model, step
    assert max(r.level for r in store.manifest.runs) == 3


def test_maintenance(spark, tmp_path, caplog):
    store = KVStore.open(spark, config(tmp_path, level0_runs=1))
    run_of(store, ("a", b"1"))
    run_of(store, ("a", b"2"), ("b", b"2"))
    worker = store.compact_in_background(delay=0.1, period=0.1)
    assert store.compact_in_background() is worker
    for _ in range(200):
        if store.manifest.compactions:
            break
        time.sleep(0.1)
    worker.stop()
    assert store.manifest.compactions > 0 and contents(store) == {"a": b"2", "b": b"2"}
    assert store.vacuum(older_than=3600) == [] and len(store.vacuum()) >= 3 and store.vacuum() == []
    assert contents(store) == {"a": b"2", "b": b"2"}
    run_of(store, ("c", b"3"))
    store.close()
    bad = next(r for r in store.manifest.runs if r.min_key == "c")
    for name in os.listdir(bad.path):
        os.unlink(os.path.join(bad.path, name))
    again = KVStore.open(spark, config(tmp_path, level0_runs=1))
    assert bad.path in caplog.text and contents(again) == {"a": b"2", "b": b"2"}


def test_shared_files(spark, tmp_path):
    """The store over Spark's own file systems: manifests are never replaced."""
    root = f"file://{tmp_path}"
    shared = files.file_system(spark, root)
    assert isinstance(shared, files.SharedFiles) and isinstance(files.file_system(spark, str(tmp_path)), files.LocalFiles)
    assert shared.create_exclusively(f"{root}/x.json", b"1") and not shared.create_exclusively(f"{root}/x.json", b"2")
    assert shared.read(f"{root}/x.json") == b"1" and shared.read(f"{root}/none") is None and shared.names(f"{root}/none") == []
    assert shared.names(root) == ["x.json"] and shared.age(f"{root}/x.json") < 600
    one = KVStore.open(spark, StoreConfig(data_dir=f"{root}/data", log_dir=f"{root}/log", level0_runs=1, truncate_log=True))
    two = KVStore.open(spark, one.config)
    run_of(one, ("a", b"1"))
    two.put("b", b"2")
    assert two.refresh().version == 3 and contents(two) == {"a": b"1", "b": b"2"}
    assert len(two.vacuum()) == 1  # the batch of the attempt that came second; the flushed one is gone already
    assert one._publish(one.manifest) is False


def test_menu(spark, tmp_path):
    store, said = KVStore.open(spark, config(tmp_path)), []
    cli.run_menu(store, iter(["1", "2", "9", "4", "get account:002", "exit", "3", "20", "5"]), said.append)
    assert said[0] == cli.MENU and "user:1003 = (null)" in said[1] and "account:001 = 1000.00" in said[3] and "account:003 = (null)" in said[3]
    assert said[5].startswith("a number") and "2000.00" in said and any("'found': 20" in x for x in said)


def test_caches():
    cache = ShardedLRU(2, 4)
    keys = [f"user{i}" for i in range(40)]
    for k in keys:
        cache.put(k, k)
    assert 0 < len(cache) <= 8 and not cache.maps[0].is_empty() and cache.get(keys[-1]) == keys[-1]
    cache.remove(keys[-1])
    assert cache.get(keys[-1]) is None
    cache.clear()
    assert len(cache) == 0
    with pytest.raises(ValueError):
        ShardedLRU(2, 3)
    assert str(Isolation.SERIALIZABLE).startswith("Serializable (Level 4): ")


def test_shell_and_files(spark, tmp_path):
    store = KVStore.open(spark, config(tmp_path))
    ask = lambda line: cli.run_line(store, line)
    assert ask("put k hello  big world") == "OK" and ask("GET k") == "hello  big world" and ask("get none") == "(null)"
    assert ask("put k").startswith("usage") and ask("get").startswith("usage") and ask("nope x").startswith("unknown") and ask("exit") is None
    assert ask("del k") == "OK" and ask("get k") == "(null)"
    assert cli.load_test(store, 50)["found"] == 50
    path = str(tmp_path / "f.bin")
    assert files.read_if_exists(path) is None and files.file_size(path) == 0 and not files.delete_if_exists(path)
    files.write_atomically(path, b"long content")
    files.write_atomically(path, b"short")
    assert files.read_if_exists(path) == b"short" and files.last_modified_ms(path) > 0 and files.readable(path) and files.writable(path)
    assert not files.create_exclusively(path, b"x") and files.create_exclusively(path + "2", b"y")
    files.copy(path, path + "3")
    files.move(path + "3", path + "4")
    assert sorted(r["name"] for r in files.list_files(spark, str(tmp_path), "f.bin*").collect()) == ["f.bin", "f.bin2", "f.bin4"]
    assert files.directory_size(spark, str(tmp_path)).first()["files"] > 3
    cache = LRU(2)
    for k in "ab":
        cache.put(k, k)
    assert cache.get("a") == "a"
    cache.put("c", "c")
    assert cache.get("b") is None and cache.get("a") == "a"
    with pytest.raises(ValueError):
        LRU(0)


def test_stream(spark, tmp_path):
    from tidemark.streaming.tail import latest_stream, read_tail

    for n in range(2):
        spark.createDataFrame([("a", n, "PUT", bytearray(b"%d" % n))], "key string, seq long, op string, value binary").write.parquet(str(tmp_path / f"log/b{n}"))
    q = latest_stream(read_tail(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("tail").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["key"], r["seq"]) for r in spark.table("tail").collect()] == [("a", 1)]
