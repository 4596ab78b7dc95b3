"""Fuzzy line deduplication: MinHash bands over character shingles, exact Jaccard, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LONG, STRING, WS, Scratch, cell_of, components, id_bitmap, in_bitmap, reclaim, schema, small_batches

#: Characters of a shingle; lines with fewer characters than MIN_CHARS are left alone: they are too short to be anyone's copy.
SHINGLE = 5
MIN_CHARS = 20
SIMILARITY = 0.8
#: At similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8^5)^9 = 0.97, at 0.9 with over 0.999.
BANDS, ROWS = 9, 5
#: Lines are hashed in groups of about this many characters.
BLOCK = 1 << 20
#: Lines that a task remembers to have seen; it then starts anew and yields some twice, which later steps bear.
REMEMBERED = 1 << 20

_SLOTS = BANDS * ROWS
#: Columns of a line's parity sketch.
_PARITY = [f"parity{k}" for k in range(16)]


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hash of every SHINGLE characters, index of the line) over all lines; shorter lines give one."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE) for x in lines]
    c = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    length = np.array([len(x) for x in padded], np.int64)
    line = np.repeat(np.arange(len(padded), dtype=np.int64), length)
    h = np.zeros(len(c) - SHINGLE + 1, np.uint32)
    for j in range(SHINGLE):
        h = (h ^ c[j : len(c) - SHINGLE + 1 + j]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    inside = line[: len(h)] == line[SHINGLE - 1 :]
    return h[inside], line[: len(h)][inside]


def signatures(lines: list[str]) -> np.ndarray:
    """One-permutation MinHash of each line, lines x slots; an empty slot borrows from the next full one."""
    out = np.full((len(lines), _SLOTS), 0xFFFFFFFF, np.uint32)
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= BLOCK):
            size += max(SHINGLE, len(lines[end]))
            end += 1
        h, line = _shingle_hashes(lines[at:end])
        slot = (h.astype(np.uint64) * np.uint64(_SLOTS) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(out.reshape(-1), (line + at) * _SLOTS + slot, h * np.uint32(2654435761))
        at = end
    for far in range(1, _SLOTS):
        empty = out == 0xFFFFFFFF
        if not empty.any():
            break
        # what a slot gets depends on its distance to the one it borrows from, alike in like lines
        lent = np.roll(out, -1, axis=1)
        ok = empty & (lent != 0xFFFFFFFF)
        out[ok] = (lent[ok] * np.uint32(0x9E3779B1) + np.uint32(far)) | np.uint32(0)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """64-bit bucket of each line in each band, lines x bands."""
    s = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    key = np.repeat(key, len(signature), axis=0)
    for r in range(ROWS):
        key = (key ^ s[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def jaccard(a: str, b: str) -> float:
    """Exact Jaccard of the sets of character shingles."""
    x = {a[i : i + SHINGLE] for i in range(max(1, len(a) - SHINGLE + 1))}
    y = {b[i : i + SHINGLE] for i in range(max(1, len(b) - SHINGLE + 1))}
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _shingle_codes(lines: list[str]) -> list[np.ndarray] | None:
    """Shingles of each line, ascending, each once, as numbers that are equal only for equal shingles.

    A character counts as its place in the alphabet of ``lines``, a shingle as a number of SHINGLE digits; None if the
    alphabet is so large that such a number has over 63 bits.
    """
    padded = [x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in lines]
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.zeros(0x110000, bool)
    used[c] = True
    digits = int(used.sum())
    if digits**SHINGLE >= 1 << 63:
        return None
    digit = (np.cumsum(used) - 1)[c]
    code = np.zeros(max(0, len(c) - SHINGLE + 1), np.int64)
    for j in range(SHINGLE):
        code = code * digits + digit[j : len(c) - SHINGLE + 1 + j]
    out, at = [], 0
    for x in padded:
        own = np.sort(code[at : at + len(x) - SHINGLE + 1])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        at += len(x)
    return out


def similar(a: list[str], b: list[str]) -> list[bool]:
    """Whether ``jaccard`` of each two lines reaches the similarity; a line that comes several times is cut up once."""
    place = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    sets = _shingle_codes(list(place)) if place else []
    if sets is None:
        return [jaccard(x, y) >= SIMILARITY for x, y in zip(a, b, strict=True)]
    out = []
    for x, y in zip(a, b, strict=True):
        p, q = sets[place[x]], sets[place[y]]
        both = np.concatenate([p, q])
        both.sort()
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        out.append(common / (len(both) - common) >= SIMILARITY)
    return out


def _once(line: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which elements are the only one, or one chosen one, of those equal in line and hash.

    All write their place to a table; who finds another place there is equal to that one, or shares a cell with it
    and is sorted out among the few of that kind.
    """
    bits = max(10, int(2 * len(h) - 1).bit_length())
    cell = ((h ^ (line.astype(np.uint32) * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
    table = np.empty(1 << bits, np.int32)
    place = np.arange(len(h), dtype=np.int32)
    table[cell] = place
    there = table[cell]
    once = there == place
    lost = np.flatnonzero(~once)
    by = there[lost]
    apart = lost[(h[by] != h[lost]) | (line[by] != line[lost])]
    if len(apart):
        _, first = np.unique(line[apart].astype(np.int64) << 32 | h[apart].astype(np.int64), return_index=True)
        once[apart[first]] = True
    return once


def sketches(lines: list[str]) -> np.ndarray:
    """Number of different shingles of each line and the parity of how many fall to each of 1,024 bits, in 16 numbers.

    Two lines' sketches differ in at most as many bits as their sets have elements apart.
    """
    width = 64 * len(_PARITY)
    out = np.zeros((len(lines), 1 + len(_PARITY)), np.int64)
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or end - at < 2048 and size + len(lines[end]) <= BLOCK // 4):
            size += max(SHINGLE, len(lines[end]))
            end += 1
        h, line = _shingle_hashes(lines[at:end])
        once = _once(line, h)
        line, bit = line[once], (h[once] & np.uint32(width - 1)).astype(np.int64)
        out[at:end, 0] = np.bincount(line, minlength=end - at)
        odd = np.bincount(line * width + bit, minlength=(end - at) * width).reshape(-1, width) & 1
        out[at:end, 1:] = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view(np.int64)
        at = end
    return out


def _apart(p: str, q: str) -> Column:
    """Lower bound of the shingles that two lines have apart, from the sketches in columns with these prefixes."""
    return sum((F.bit_count(F.col(p + c).bitwiseXOR(F.col(q + c))) for c in _PARITY), F.lit(0))


def _may_link(apart: Column, a: Column, b: Column) -> Column:
    """Sets of a and b elements with so many apart can reach the similarity (apart is counted by 32-bit hashes: 1 to spare)."""
    return (1 + SIMILARITY) * (apart - 1) <= (1 - SIMILARITY) * (a + b) + 1e-6


def line_ids(text: str) -> list[tuple[str, int | None]]:
    """Each line of ``text`` without white space at both ends, with its 64-bit id (None below MIN_CHARS characters)."""
    bare = [x.strip(WS) for x in text.split("\n")]
    return [(x, xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63) if len(x) >= MIN_CHARS else None) for x in bare]


_LONGS = T.ArrayType(LONG, False)


def _lists(values: np.ndarray, counts: list[int]) -> pa.Array:
    """``values`` cut into lists of these lengths."""
    flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(values, pa.int64()))
    return flat.cast(pa.list_(pa.field("element", pa.int64(), False)))


def _signed(picked: DataFrame) -> DataFrame:
    """doc_id, row_key, lines (ids by place) of each text; fresh (ids the task had not seen) and their buckets, BANDS each."""
    out = schema(doc_id=picked.schema["doc_id"].dataType, row_key=LONG, lines=T.ArrayType(LONG), fresh=_LONGS, buckets=_LONGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                ids, fresh, lines, counts = [], [], [], []
                for text in batch.column(2).to_pylist():
                    own, before = line_ids(text), len(fresh)
                    for line, i in own:
                        if i is not None and i not in seen:
                            seen.add(i)
                            fresh.append(i)
                            lines.append(line)
                    ids.append([i for _, i in own])
                    counts.append(len(fresh) - before)
                if len(seen) > REMEMBERED:
                    seen.clear()
                flat = bands(signatures(lines)).reshape(-1)
                columns = [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64())), _lists(np.array(fresh, np.int64), counts), _lists(flat, [n * BANDS for n in counts])]
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return picked.select("doc_id", "row_key", "text").mapInArrow(run, out)


def _kept_buckets(known: DataFrame, live: DataFrame) -> DataFrame:
    """(bucket, line_id) of fresh lines in ``live`` buckets, and of some others: a bitmap of fixed size picks them."""
    shared = known.sparkSession.sparkContext.broadcast(id_bitmap(live.select(F.expr(cell_of("bucket")).alias("c"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            where = np.flatnonzero(in_bitmap(bucket, shared.value))
            line = batch.column(0).flatten().to_numpy(zero_copy_only=False)[where // BANDS]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[where], pa.int64()), pa.array(line, pa.int64())], ["bucket", "line_id"])

    return known.select("fresh", "buckets").mapInArrow(run, schema(bucket=LONG, line_id=LONG))


def _fetched(picked: DataFrame, ids: DataFrame) -> DataFrame:
    """(line_id, line, n, sketch) of ``ids(line_id)``.

    Lines are picked from the texts by a bitmap of fixed size over the ids: they are read again, but only
    those wanted are shuffled. A bitmap lets some others through and misses none.
    """
    shared = picked.sparkSession.sparkContext.broadcast(id_bitmap(ids.select(F.expr(cell_of("line_id")).alias("c"))))
    out = schema(line_id=LONG, line=STRING, n=LONG, **{c: LONG for c in _PARITY})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                own = [x for text in whole.slice(start, 256).column(0).to_pylist() for x in line_ids(text) if x[1] is not None]
                number = np.array([i for _, i in own], np.int64)
                found = {}
                for k in np.flatnonzero(in_bitmap(number, shared.value)):
                    line, i = own[k]
                    if i not in seen:
                        found[i] = line
                seen.update(found)
                if len(seen) > REMEMBERED:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], ["line_id", "line"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            own = batch.column(0).to_numpy()
            fresh = np.flatnonzero(np.concatenate([[last is None or own[0] != last], own[1:] != own[:-1]])) if len(own) else []
            if len(fresh):
                last = own[-1]
                some = batch.take(pa.array(fresh, pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(c, pa.int64()) for c in sketches(some.column(1).to_pylist()).T)], out.names)

    lines = picked.select("text").mapInArrow(pick, schema(line_id=LONG, line=STRING)).join(ids.hint("merge"), "line_id", "left_semi")
    # the join leaves a line's copies from several tasks next to each other; should it be split between them, a line comes
    # twice, which the distinct pairs later bear
    return lines.mapInArrow(sketch, out)


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose lines reach the similarity."""
    text = lambda k: lines.select(F.col("line_id").alias(k), F.col("line").alias(f"t{k}"))
    both = pairs.join(text("b"), "b").join(text("a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = similar(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, schema(a=LONG, b=LONG))


def _row_key(id_col: str, text_col: str) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(F.col(id_col).cast("string"), text, F.length(text))


def line_classes(docs: DataFrame, keep: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(places, roots): every long enough line's (row_key, doc_id, at, line_id), and (node, root) of linked different lines.

    Equal lines are one line from the start. Two different lines that share a bucket of any band are ruled out by
    their parity sketches, or verified against each other, or end in one class anyway: first each line meets
    its buckets' centres (the smallest id in each), then lines of one bucket that are still in different classes meet
    pairwise. A bucket is never gathered: its centre is a minimum, its pairs are a sort-merge join that Spark
    splits where a bucket is large, and the sketches decide inside the join.
    """
    picked = docs.select(_row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = keep.write(_signed(picked), "known")
    each = known.select("fresh", F.posexplode("buckets").alias("p", "bucket"))
    each = each.select("bucket", F.get("fresh", F.expr(f"p div {BANDS}").cast("int")).alias("line_id"))
    live = each.groupBy("bucket").agg(F.min("line_id").alias("centre"), F.max("line_id").alias("high")).where("centre <> high")
    live = keep.write(live.select("bucket", "centre"), "live")
    reclaim(docs.sparkSession)
    # a line's second entry in a bucket comes from another task that met a copy
    index = keep.write(_kept_buckets(known, live).dropDuplicates(["bucket", "line_id"]).join(live, "bucket"), "index")
    keep.drop("live")
    lines = keep.write(_fetched(picked, index.select("line_id").distinct()), "lines")
    reclaim(docs.sparkSession)
    sketch = lines.select("line_id", "n", *_PARITY)
    side = lambda k: sketch.select(F.col("line_id").alias(k), F.col("n").alias(f"n_{k}"), *[F.col(c).alias(k + c) for c in _PARITY])

    met = index.where("line_id <> centre").select(F.col("line_id").alias("a"), F.col("centre").alias("b")).distinct()
    near = met.join(side("a"), "a").join(side("b"), "b").where(_may_link(_apart("a", "b"), F.col("n_a"), F.col("n_b")))
    near = keep.write(near.select("a", "b"), "near")  # b is the smaller one
    links = keep.write(_verified(near, lines), "links")
    roots = components(links)

    classed = index.select("bucket", "line_id").join(roots.withColumnRenamed("node", "line_id"), "line_id", "left").withColumn("root", F.coalesce("root", "line_id"))
    classed = keep.write(classed, "classed")
    spread = classed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    several = keep.write(classed.join(spread.select("bucket", "low"), "bucket"), "several")
    own = several.groupBy("line_id").agg(F.collect_set("bucket").alias("buckets"))  # BANDS at most
    mixed = keep.write(several.join(own.join(sketch, "line_id"), "line_id"), "mixed")
    keep.drop("index", "classed", "several")
    reclaim(docs.sparkSession)
    # every two of different classes once: one side leaves out the class of the smallest root
    left = mixed.where(F.col("root") != F.col("low"))
    right = mixed.select("bucket", F.col("low").alias("lb"), *[F.col(c).alias("b_" + c) for c in ("line_id", "root", "n", "buckets", *_PARITY)])
    other = (F.col("root") != F.col("b_root")) & ((F.col("b_root") == F.col("lb")) | (F.col("line_id") < F.col("b_line_id")))
    # of a pair's common buckets, one yields it
    once = F.array_min(F.array_intersect("buckets", "b_buckets")) == F.col("bucket")
    met = left.join(right, "bucket").where(other & _may_link(_apart("", "b_"), F.col("n"), F.col("b_n")) & once)
    # what was verified before needs no second look
    rest = met.select(F.greatest("line_id", "b_line_id").alias("a"), F.least("line_id", "b_line_id").alias("b")).distinct().join(near, ["a", "b"], "left_anti")
    rest = keep.write(rest, "rest")
    keep.drop("mixed")
    links = keep.write(links.unionByName(_verified(rest, lines)), "links-all")
    roots = components(links)
    keep.drop("lines", "near", "rest", "links", "links-all")
    reclaim(docs.sparkSession)
    places = known.select("doc_id", "row_key", F.posexplode("lines").alias("at", "line_id")).where(F.col("line_id").isNotNull())
    return places, roots


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Input columns with the text cleaned, and n_lines, n_removed, n_fuzzy (removed, but no equal line before it).

    Lines are equal, or linked at a Jaccard of SIMILARITY of their five-character shingles, after white space
    at both ends is dropped. Of each class of linked lines the first one stays, in the order of (id, place);
    a line under MIN_CHARS characters always stays. Kept lines keep their text and order.

    Null text: no line, stays null. Null ids come first. Rows equal in id and text are one document and come
    out alike. Texts whose lines all go become empty. Empty table: empty result. Extra columns are carried
    along, whatever their names; those named like the three added ones are replaced.
    """
    small_batches(docs.sparkSession)
    keep = Scratch(docs.sparkSession)
    places, roots = line_classes(docs, keep, id_col, text_col)
    here = F.struct(F.col("doc_id"), F.col("at"), F.col("row_key"))
    # where each line occurs first, one row a task and line, then where each class does; lines met once are no one's copy
    met = places.groupBy("line_id").agg(F.min(here).alias("first"), F.count("*").alias("n"))
    by_line = met.join(roots.withColumnRenamed("node", "line_id"), "line_id", "left").withColumn("root", F.coalesce("root", "line_id"))
    by_line = keep.write(by_line, "by-line")
    by_root = by_line.groupBy("root").agg(F.min("first").alias("kept"), F.sum("n").alias("all")).where(F.col("all") > 1)
    first = keep.write(by_line.join(by_root, "root").select("line_id", "kept", "first"), "first")
    keep.drop("by-line")
    gone = (
        places.join(first, "line_id")
        .where((F.col("row_key") != F.col("kept.row_key")) | (F.col("at") != F.col("kept.at")))
        .select("row_key", "at", ((F.col("row_key") == F.col("first.row_key")) & (F.col("at") == F.col("first.at"))).alias("fuzzy"))
        .groupBy(F.col("row_key").alias("gone_key"))
        .agg(F.collect_set("at").alias("gone"), F.collect_set(F.when(F.col("fuzzy"), F.col("at"))).alias("fuzzy"))
    )
    gone = keep.write(gone, "gone")
    keep.drop("known", "first")
    reclaim(docs.sparkSession)
    # the input's columns travel in one struct, so that no name of theirs can clash
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_fuzzy")]
    whole = docs.select(_row_key(id_col, text_col).alias("gone_key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = whole.join(gone, "gone_key", "left")
    text = F.col("row").getField(text_col)
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    # kept places as a set difference, then their lines: linear in the lines of a text
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return joined.withColumn("lines", F.when(text.isNotNull(), lines)).select(
        *[cleaned.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names],
        size("lines").alias("n_lines"),
        size("gone").alias("n_removed"),
        size("fuzzy").alias("n_fuzzy"),
    )
