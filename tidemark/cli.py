"""Shell and demos over a store: ``python -m tidemark.cli [--menu] [data folder]``."""

from __future__ import annotations

import re
import sys
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

from .config import StoreConfig
from .store import KVStore

USAGE = {"put": "usage: put <key> <value>", "get": "usage: get <key>", "del": "usage: del <key>"}


def parse(line: str) -> tuple[str, list[str]]:
    """(command in lower case, arguments): two arguments at most, the second keeps its spaces."""
    parts = re.split(r"\s+", line.strip(), maxsplit=2)
    return parts[0].lower(), parts[1:]


def run_line(store: KVStore, line: str) -> str | None:
    """Answer of one shell line; None ends the shell."""
    command, args = parse(line)
    if command in ("exit", "quit"):
        return None
    if command == "put":
        if len(args) < 2:
            return USAGE["put"]
        store.put(args[0], args[1].encode())
        return "OK"
    if command == "get":
        if not args:
            return USAGE["get"]
        value = store.get(args[0])
        return "(null)" if value is None else value.decode("utf-8", "replace")
    if command == "del":
        if not args:
            return USAGE["del"]
        store.delete(args[0])
        return "OK"
    if command == "compact":
        return str(store.compact() or "nothing to do")
    return "" if not command else f"unknown command: {command}"


def load_test(store: KVStore, n: int) -> dict[str, float]:
    """n puts as one batch and n gets as one join; rows a second of each."""
    n = min(max(n, 1), 100_000)
    spark = store.spark
    keys = spark.range(n).selectExpr("format_string('perf_key_%06d', id) key", "'PUT' op", "encode(concat('performance_test_value_', id), 'UTF-8') value")
    begin = time.time()
    store.write(keys)
    wrote = time.time()
    found = store.multi_get(keys.select("key")).where("found").count()
    return {"found": found, "puts_per_s": n / max(wrote - begin, 1e-9), "gets_per_s": n / max(time.time() - wrote, 1e-9)}


MENU = """1. basic demo
2. transaction demo
3. load test
4. shell
5. exit"""


def basic_demo(store: KVStore) -> list[str]:
    """Puts, an update, a delete and reads, one line each."""
    from .plans.txn_queries import DEMO

    for key, op, value in DEMO:
        store.delete(key) if op == "DEL" else store.put(key, value.encode())
    return [f"{key} = {run_line(store, f'get {key}')}" for key in ("user:1001", "user:1002", "user:1003", "user:9999")]


def transaction_demo(store: KVStore) -> list[str]:
    """A transaction that commits, then one that is rolled back."""
    first, second = store.begin(), None
    first.put("account:001", b"1000.00")
    first.put("account:002", b"2000.00")
    first.commit()
    second = store.begin()
    second.put("account:001", b"500.00")
    second.put("account:003", b"1500.00")
    second.rollback()
    return [f"{key} = {run_line(store, f'get {key}')}" for key in ("account:001", "account:002", "account:003")]


def run_menu(store: KVStore, lines: Iterator[str], say: Callable[[str], None]) -> None:
    """The menu until its exit or the end of the input; the shell's exit leads back to it."""
    say(MENU)
    for line in lines:
        choice = line.strip()
        if choice == "1":
            say("\n".join(basic_demo(store)))
        elif choice == "2":
            say("\n".join(transaction_demo(store)))
        elif choice == "3":
            say("how many keys?")
            n = next(lines, "").strip()
            say(str(load_test(store, int(n) if n.isdigit() else 10_000)))
        elif choice == "4":
            run_shell(store, lines, say)
        elif choice == "5":
            return
        else:
            say("a number from 1 to 5, please")
        say(MENU)


def run_shell(store: KVStore, lines: Iterator[str], say: Callable[[str], None]) -> None:
    for line in lines:
        answer = run_line(store, line)
        if answer is None:
            return
        say(answer)


def main() -> None:
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    folder = next((x for x in sys.argv[1:] if not x.startswith("-")), "./data")
    with KVStore.open(spark, StoreConfig(data_dir=f"{folder}/kv-data", log_dir=f"{folder}/kv-log")) as store:
        say = lambda text: print(text, flush=True)
        run_menu(store, iter(sys.stdin), say) if "--menu" in sys.argv else run_shell(store, iter(sys.stdin), say)


if __name__ == "__main__":
    main()
