"""File helpers of the driver, and listings as DataFrames."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_directory(path: str) -> None:
    os.makedirs(path, exist_ok=True)


def delete_if_exists(path: str) -> bool:
    try:
        os.unlink(path)
        return True
    except OSError:
        return False


def delete_tree(path: str) -> None:
    if os.path.exists(path):
        shutil.rmtree(path)


def _temporary(path: str, data: bytes) -> str:
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".tmp-")
    with os.fdopen(handle, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    return name


def write_atomically(path: str, data: bytes) -> None:
    """Readers see the old content or the new one, never a part."""
    name = _temporary(path, data)
    try:
        os.replace(name, path)
    except OSError:
        delete_if_exists(name)
        raise


def create_exclusively(path: str, data: bytes) -> bool:
    """Publish ``path`` whole if nobody has; False if it exists. The compare-and-set of manifests."""
    name = _temporary(path, data)
    try:
        os.link(name, path)
        return True
    except FileExistsError:
        return False
    finally:
        delete_if_exists(name)


def read_if_exists(path: str) -> bytes | None:
    try:
        return Path(path).read_bytes()
    except FileNotFoundError:
        return None


def file_size(path: str) -> int:
    try:
        return os.stat(path).st_size
    except OSError:
        return 0


def last_modified_ms(path: str) -> int:
    try:
        return int(os.stat(path).st_mtime * 1000)
    except OSError:
        return 0


def move(source: str, target: str) -> None:
    try:
        os.replace(source, target)
    except OSError:
        shutil.move(source, target)


def copy(source: str, target: str) -> None:
    shutil.copy2(source, target)


def temporary_file(directory: str, prefix: str = "tmp", suffix: str = "") -> str:
    handle, name = tempfile.mkstemp(dir=directory, prefix=prefix, suffix=suffix)
    os.close(handle)
    return name


def sync(path: str) -> None:
    with open(path, "rb") as f, contextlib.suppress(OSError):
        os.fsync(f.fileno())


def readable(path: str) -> bool:
    return os.access(path, os.R_OK)


def writable(path: str) -> bool:
    return os.access(path, os.W_OK)


class LocalFiles:
    """What a store needs of a file system, on the driver's own."""

    def ensure_directory(self, path: str) -> None:
        ensure_directory(path)

    def names(self, path: str) -> list[str]:
        return sorted(os.listdir(path)) if os.path.isdir(path) else []

    def read(self, path: str) -> bytes | None:
        return read_if_exists(path)

    def create_exclusively(self, path: str, data: bytes) -> bool:
        return create_exclusively(path, data)

    def age(self, path: str) -> float:
        """Seconds since the last change."""
        return time.time() - os.stat(path).st_mtime

    def delete_tree(self, path: str) -> None:
        delete_tree(path)


class SharedFiles:
    """The same on any file system that Spark reads: a manifest is written aside and renamed, which must not replace a file."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._at(path)
        self._fs = root.getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def ensure_directory(self, path: str) -> None:
        self._fs.mkdirs(self._at(path))

    def names(self, path: str) -> list[str]:
        where = self._at(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def read(self, path: str) -> bytes | None:
        where = self._at(path)
        if not self._fs.exists(where):
            return None
        stream = self._fs.open(where)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create_exclusively(self, path: str, data: bytes) -> bool:
        aside = self._at(f"{path}.tmp-{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(data))
        stream.close()
        fs = self._jvm.org.apache.hadoop.fs
        plain = self._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            self._context.rename(aside, self._at(path), plain)
            return True
        except Exception as why:
            if "FileAlreadyExistsException" not in str(why):
                raise
            return False
        finally:
            self._fs.delete(aside, False)

    def age(self, path: str) -> float:
        return time.time() - self._fs.getFileStatus(self._at(path)).getModificationTime() / 1000

    def delete_tree(self, path: str) -> None:
        self._fs.delete(self._at(path), True)


def file_system(spark: SparkSession, path: str) -> LocalFiles | SharedFiles:
    """By the path's form: one with a scheme, such as hdfs://, is shared, any other the driver's."""
    return SharedFiles(spark, path) if "://" in path else LocalFiles()


def list_files(spark: SparkSession, directory: str, glob: str | None = None) -> DataFrame:
    """(name, length) of the files right in a directory, content unread."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(directory).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def directory_size(spark: SparkSession, directory: str) -> DataFrame:
    """One row: files and bytes below a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
