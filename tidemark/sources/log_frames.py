"""Framed logs: (crc, length, entry) records, read with the recovery rules.

Reading stops at a short header, a length of 0 or less or above the cap, or a frame past the end; a record
with a wrong checksum or a body that does not decode is skipped.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_FRAME_BYTES, MAX_KEY_BYTES, MAX_VALUE_BYTES
from ..operators.changelog import DEL, PUT

SCHEMA = "source string, position long, length long, status string, payload binary, entry_status string, key string, value binary, deleted boolean, ts long, seq long"


def parse(raw: bytes) -> Iterator[tuple[int, int, str, bytes | None]]:
    """(position, length, status, payload): status FRAMED, CRC or one of the stops SHORT, LENGTH, PAST_END."""
    at = 0
    while at < len(raw):
        if len(raw) - at < 8:
            yield at, 0, "SHORT", None
            return
        crc, length = struct.unpack_from(">Ii", raw, at)
        if not 0 < length <= MAX_FRAME_BYTES:
            yield at, length, "LENGTH", None
            return
        if at + 8 + length > len(raw):
            yield at, length, "PAST_END", None
            return
        body = raw[at + 8 : at + 8 + length]
        yield at, length, "FRAMED" if zlib.crc32(body) == crc else "CRC", body
        at += 8 + length


def decode_body(body: bytes) -> tuple[str, str | None, bytes | None, bool | None, int | None, int | None]:
    """(status, key, value, deleted, ts, seq) of one log entry, as ``functions.codec.decode_entry`` has it."""
    nothing = (None,) * 5
    if len(body) < 30:
        return "SHORT", *nothing
    if body[0] != 1:
        return "VERSION", *nothing
    if body[1] not in (1, 2):
        return "MARKER", *nothing
    ts, seq, key_bytes = struct.unpack_from(">qqI", body, 2)
    if key_bytes > MAX_KEY_BYTES or len(body) < 30 + key_bytes:
        return "KEY", *nothing
    (value_bytes,) = struct.unpack_from(">I", body, 22 + key_bytes)
    if value_bytes > MAX_VALUE_BYTES or len(body) != 30 + key_bytes + value_bytes:
        return "VALUE", *nothing
    if zlib.crc32(body[:-4]) != struct.unpack_from(">I", body, len(body) - 4)[0]:
        return "CRC", *nothing
    deleted = body[1] == 2
    return "OK", body[22 : 22 + key_bytes].decode("utf-8", "replace"), None if deleted else body[26 + key_bytes : -4], deleted, ts, seq


def read_frames(files: DataFrame) -> DataFrame:
    """Records of ``files(path, content)``, such as the binaryFile source gives, framed and decoded in one pass.

    A file is read in order, by one task: where a record begins is known from the one before it alone.
    """
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.binary(), pa.bool_(), pa.int64(), pa.int64())
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(path, *r, *(decode_body(r[3]) if r[2] == "FRAMED" else (None,) * 6)) for r in parse(content)]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 10_000], strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def decoded(frames: DataFrame) -> DataFrame:
    """source, position, length, payload, entry, and status: OK or the reason why a framed record is skipped or reading stops."""
    entry = F.struct("key", "value", "deleted", "ts", "seq")
    status = F.when(F.col("status") == "FRAMED", F.col("entry_status")).otherwise(F.col("status"))
    return frames.select("source", "position", "length", status.alias("status"), "payload", F.when(F.col("entry_status") == "OK", entry).alias("entry"))


def recover(frames: DataFrame) -> DataFrame:
    """Oplog rows of all readable records, in the order of (file name, place in the file): clocks may repeat.

    ``seq`` is the place in all files laid end to end, so file names have to sort as they were written. The
    base of each file is a running total over one row a file.
    """
    ends = frames.groupBy("source").agg(F.max(F.col("position") + 8 + F.greatest(F.col("length"), F.lit(0))).alias("bytes"))
    before = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select("source", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    good = decoded(frames).where(F.col("status") == "OK").join(F.broadcast(bases), "source")
    return good.select(
        (F.col("base") + F.col("position")).alias("seq"),
        F.col("entry.key").alias("key"),
        F.when(F.col("entry.deleted"), DEL).otherwise(PUT).alias("op"),
        F.col("entry.value").alias("value"),
    )


def repair(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records to keep, records to set aside): good ones survive a damaged neighbour."""
    all_of = decoded(frames)
    return all_of.where("status = 'OK'").drop("entry"), all_of.where("status <> 'OK'").drop("entry")
