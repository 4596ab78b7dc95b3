"""Exact removal of long repeats: run-length indexes over groups of passages that can match.

Every 200-byte window belongs to its minimizer, the window's smallest 32-byte gram by hash, and windows
in a row with one minimizer form a passage. Equal windows have equal minimizers, so what can match meets in
one group. Equal passages are settled by their hash. Where a group holds different passages, they are
laid end to end and a run-length Burrows-Wheeler index of them is built: suffixes sorted, the transform
cut into runs, and the common prefix with the neighbouring suffix sampled at run heads and run ends alone.
Streamed over the text, the samples give each position's longest match with any other place (between
samples it shrinks by one a byte), and positions that match for 200 bytes begin a repeated window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BOOL, LONG, STRING, cut, schema, small_batches, stage
from .jaccard_join import _mix, _powers

WINDOW = 200
GRAM = 32
#: Bytes of passages in one index.
INDEX_BYTES = 1 << 20
#: Groups with more different passages (about 1.5 MB) are dealt out by window instead of indexed in one task.
MAX_GROUP = 4096
#: Passages that a task remembers to have met.
REMEMBERED = 1 << 21
#: Long texts are read in blocks of this many bytes, which overlap by a window.
BLOCK = 1 << 21

_SPAN = WINDOW - GRAM + 1
_PLACE_BITS = 23


def _prefix_sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    return total, inverse


def passages(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, hash of content, first window, number of windows) of each passage of a text."""
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(1, len(raw) - WINDOW + 1), BLOCK):
        b = np.frombuffer(raw, np.uint8, min(len(raw) - at, BLOCK + WINDOW - 1), at)
        if len(b) < WINDOW:
            break
        total, inverse = _prefix_sums(b)
        grams = _mix((total[GRAM:] - total[:-GRAM]) * inverse[: len(b) - GRAM + 1])
        low = (grams >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= _SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < _SPAN:
            low = np.minimum(low[: len(low) - (_SPAN - width)], low[_SPAN - width :])
        place = (low & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(first, len(place)))
        end = first + count + WINDOW - 1
        content = _mix((total[end] - total[first]) * inverse[first] + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        found.append((grams[place[first]].view(np.int64), content.view(np.int64), first + at, count))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def match_lengths(parts: list[bytes]) -> list[np.ndarray]:
    """Longest match of each position with any other place of any part, from a sampled run-length index."""
    size = [len(p) for p in parts]
    n = sum(size) + len(parts)
    text = np.empty(n, np.int64)
    ends = np.cumsum(np.array(size) + 1) - 1
    keep = np.ones(n, bool)
    keep[ends] = False
    text[keep] = np.frombuffer(b"".join(parts), np.uint8)
    text[ends] = 256 + np.arange(len(parts))  # each part's end differs from all others: no match crosses it
    # suffixes sorted by doubling; ranks of each step are kept to measure common prefixes
    bits = int(256 + len(parts)).bit_length()
    per = 62 // bits
    key = np.zeros(n, np.int64)
    for j in range(per):
        key = key << bits
        key[: n - j] |= text[j:]
    length = per
    place = np.arange(n)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    # a rank is the number of suffixes in smaller classes, so a class can be split in place
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], ranked[1:] != ranked[:-1]]), place, 0))
    ranks = [(length, rank)]
    while len(where := np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)):  # only suffixes that share a rank are sorted again
        second = np.zeros(len(where), np.int64)
        inside = where + length < n
        second[inside] = rank[where[inside] + length] + 1
        pair = rank[where].astype(np.int64) << 32 | second
        by = np.argsort(pair, kind="stable")
        pair, where, at = pair[by], where[by], place[: len(by)]
        head = np.maximum.accumulate(np.where(np.concatenate([[True], pair[1:] >> 32 != pair[:-1] >> 32]), at, 0))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], pair[1:] != pair[:-1]]), at, 0))
        rank = rank.copy()
        rank[where] = (pair >> 32) + (group - head)
        length *= 2
        ranks.append((length, rank))
    suffix = np.empty(n, np.int64)
    suffix[rank] = place
    before = text[suffix - 1]  # the transform; place 0 follows the last end
    edge = before[1:] != before[:-1]  # run heads are edge + 1, run ends are edge
    heads, tails = np.flatnonzero(edge) + 1, np.flatnonzero(edge)
    common = _common_prefix(ranks, suffix[heads], suffix[heads - 1], text)  # tails are heads - 1: one sample serves both
    longest = np.zeros(n, np.int64)
    for at, with_next in ((heads, False), (tails, True)):
        reach = np.full(n, -1, np.int64)
        reach[suffix[at]] = common + suffix[at]
        np.maximum.accumulate(reach, out=reach)
        np.maximum(longest, reach - place, out=longest)
    begin = ends - np.array(size)
    return [longest[b:e] for b, e in zip(begin, ends, strict=True)]


def _common_prefix(ranks: list, a: np.ndarray, b: np.ndarray, text: np.ndarray) -> np.ndarray:
    a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    n = len(text)
    for length, rank in reversed(ranks):
        while True:
            ok = (a < n) & (b < n)
            ok[ok] = rank[a[ok]] == rank[b[ok]]
            ok &= a != b
            if not ok.any():
                break
            a[ok] += length
            b[ok] += length
            total[ok] += length
            if length > ranks[0][0]:
                break
    while True:  # fewer symbols than the first key holds
        ok = (a < n) & (b < n)
        ok[ok] = text[a[ok]] == text[b[ok]]
        if not ok.any():
            return total
        a[ok] += 1
        b[ok] += 1
        total[ok] += 1


def _ranges(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    step = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _find_passages(keyed: DataFrame) -> DataFrame:
    """gram, content, key, span, fresh of all passages.

    A task that meets a passage again need not ask others: those rows are not ``fresh`` and stay out of the
    groups. Once a passage it adds a row without key in their stead, so that the first one, too, is seen to repeat.
    However many copies there are, a task sends a group two rows for each different passage.
    """
    out = schema(gram=LONG, content=LONG, key=LONG, span=LONG, fresh=BOOL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, bool] = {}  # bounded: a task that starts anew is like two tasks
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                parts = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    gram, content, first, count = passages(text.encode("utf-8"))
                    if len(gram):
                        parts.append((gram, content, np.full(len(gram), key), first << 8 | count))
                if not parts:
                    continue
                gram, content, key, span = (np.concatenate(x) for x in zip(*parts, strict=True))
                fresh, twice = np.ones(len(gram), bool), []
                for i, c in enumerate((content ^ (gram << 1)).tolist()):
                    state = met.get(c)
                    if state is None:
                        met[c] = False
                        continue
                    fresh[i] = False
                    if not state:
                        met[c] = True
                        twice.append(i)
                if len(met) > REMEMBERED:
                    met.clear()
                columns = [np.append(gram, gram[twice]), np.append(content, content[twice])]
                gone = np.append(np.zeros(len(key), bool), np.ones(len(twice), bool))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(c, pa.int64()) for c in columns),
                        pa.array(np.append(key, np.zeros(len(twice), np.int64)), pa.int64(), mask=gone),
                        pa.array(np.append(span, np.zeros(len(twice), np.int64)), pa.int64(), mask=gone),
                        pa.array(np.append(fresh, np.ones(len(twice), bool)), pa.bool_()),
                    ],
                    out.names,
                )

    return keyed.select("key", "text").mapInArrow(run, out)


def _fetch(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, heavy, key, span, bytes) of the wanted passages."""
    listed = wanted.groupBy("key").agg(F.collect_set(F.struct("gram", "heavy", "span")).alias("want"))
    out = schema(gram=LONG, heavy=BOOL, key=LONG, span=LONG, bytes=T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                rows = []
                for r in whole.slice(start, 128).to_pylist():
                    raw = r["text"].encode("utf-8")
                    for w in r["want"]:
                        first, count = w["span"] >> 8, w["span"] & 255
                        rows.append((w["gram"], w["heavy"], r["key"], w["span"], raw[first : first + count + WINDOW - 1]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)], out.names)

    # repeated rows have one key and text: the joins' duplicates are equal and add nothing
    return keyed.select("key", "text").join(listed, "key").mapInArrow(run, out)


def _by_index(fetched: DataFrame) -> DataFrame:
    """(key, begin, end) of byte ranges that repeated windows cover, by an index over each run of whole groups."""
    out = schema(key=LONG, begin=LONG, end=LONG)

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        keys, begins, ends = [], [], []
        distinct = {(r[1], r[2]): r for r in rows}  # repeated rows of the input come twice
        rows = list(distinct.values())
        for (_, key, span, _), longest in zip(rows, match_lengths([r[3] for r in rows]), strict=True):
            a, b = _ranges(longest >= WINDOW)
            first = span >> 8
            keys.append(np.full(len(a), key))
            begins.append(first + a)
            ends.append(first + b + WINDOW - 1)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64), pa.int64()) for x in (keys, begins, ends)], out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > INDEX_BYTES and r[0] != rows[-1][0]:
                    yield judge(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
        if rows:
            yield judge(rows)

    light = fetched.where("not heavy").select("gram", "key", "span", "bytes")
    return light.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, out)


def _by_window(fetched: DataFrame) -> DataFrame:
    """The same for groups too large for a task: each window's hash is a row, counted wherever it lands."""
    out = schema(window=LONG, key=LONG, at=LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, keys, places = [], [], []
            for key, span, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total, inverse = _prefix_sums(np.frombuffer(raw, np.uint8))
                h = _mix((total[WINDOW:] - total[:-WINDOW]) * inverse[: len(raw) - WINDOW + 1])
                hashes.append(h.view(np.int64))
                keys.append(np.full(len(h), key))
                places.append((span >> 8) + np.arange(len(h)))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (hashes, keys, places)], out.names)

    each = cut(fetched.where("heavy").select("key", "span", "bytes").mapInArrow(run, out).distinct())
    twice = each.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    return each.join(twice, "window").select("key", F.col("at").alias("begin"), (F.col("at") + WINDOW).alias("end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every document.

    Removed is each byte that lies in a WINDOW-byte string which also starts anywhere else, in any document
    or in the same one; matches never cross documents. Windows and passages are compared by 64-bit hashes
    or, where passages differ, byte by byte.

    Null text: empty. Texts under WINDOW bytes lose nothing. Null ids and repeated rows: each row is a
    document of its own, so equal rows of WINDOW bytes or more lose all. Empty table: empty result. Extra
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text, F.length(text)).alias("key"))
    each = stage(_find_passages(keyed), "passages")
    # rows without key stand for copies that a task has met; they follow the passage they are like
    by_gram, listed = Window.partitionBy("gram"), Window.partitionBy("gram").orderBy("content", F.asc_nulls_last("key"), "span")
    seen = each.where("fresh").select(
        "gram",
        "content",
        "key",
        "span",
        F.lag("content").over(listed).alias("before"),
        F.lead("content").over(listed).alias("after"),
        F.min("content").over(by_gram).alias("low"),
        F.max("content").over(by_gram).alias("high"),
    )
    met = seen.where(F.col("key").isNotNull() & (F.col("before").isNotNull() | F.col("after").isNotNull()))
    first = F.col("before").isNull() | (F.col("before") != F.col("content"))
    again = (F.col("before") == F.col("content")) | (F.col("after") == F.col("content"))
    found = stage(met.select("gram", "key", "span", first.alias("first"), F.coalesce(again, F.lit(False)).alias("again"), (F.col("low") != F.col("high")).alias("mixed")), "met")

    start, count = F.shiftright("span", 8), F.col("span").bitwiseAND(F.lit(255))
    settled = found.where("again").select("key", "span").unionByName(each.where("not fresh").select("key", "span"))
    whole = settled.select("key", start.alias("begin"), (start + count + WINDOW - 1).alias("end"))
    mixed = found.where("mixed and first")
    large = mixed.groupBy("gram").agg((F.count("*") > MAX_GROUP).alias("heavy"))
    fetched = stage(_fetch(keyed, mixed.join(large, "gram").select("gram", "heavy", "key", "span")), "bytes")
    ranges = whole.unionByName(_by_index(fetched)).unionByName(_by_window(fetched))
    gone = ranges.groupBy("key").agg(F.collect_set(F.shiftleft("begin", 32).bitwiseOR(F.col("end"))).alias("gone"))
    out = schema(doc_id=docs.schema[id_col].dataType, n_bytes=LONG, n_removed=LONG, n_spans=LONG, kept_sha256=STRING, kept=T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                rows = []
                for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    raw, kept, done, n_spans = t.encode("utf-8"), [], 0, 0
                    removed, reach = 0, -1
                    for s in sorted(spans or ()):
                        a, b = s >> 32, s & 0xFFFFFFFF
                        if a > reach:
                            n_spans += 1
                            kept.append(raw[done:a])
                            removed += b - a
                        elif b > reach:
                            removed += b - reach
                        reach = max(reach, b)
                        done = reach
                    kept.append(raw[done:])
                    left = b"".join(kept)
                    rows.append((len(raw), removed, n_spans, hashlib.sha256(left).hexdigest(), left))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f) for c, f in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], out.names)

    return keyed.join(gone, "key", "left").select("doc_id", "text", "gone").mapInArrow(run, out)
