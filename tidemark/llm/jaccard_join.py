"""Exact set-similarity self-join on word shingles, down to classes of linked documents.

Prefix filtering with two ways to skip what set relations already decide (Wang, Qin, Lin, Zhang and
Chang, "Leveraging set relations in exact set similarity join", 2017, restated for Spark):

* index level: an index list is stored in blocks, one for each band of set sizes, and holds only entries near enough the
  front of their sets. A set looks up the two blocks whose sizes can reach the similarity; the others
  are not read, since the block is part of the join's key;
* answer level: each list has a centre, and the overlap of every entry with it is computed first. The
  answers of two other entries follow from those: both linked to the centre are one class; distances to the
  centre that differ by more than the limit rule a pair out, for Jaccard distance is a metric. Only pairs
  that neither settles are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import INT, LONG, STRING, Scratch, cell_of, cells_of, components, id_bitmap, in_bitmap, reclaim, schema, small_batches

WORDS = 5
#: Similarity as a ratio of whole numbers.
NUM, DEN = 80, 100

#: Shingles whose cell holds more index entries than this go to the end of the global order.
FREQUENT = 32
#: Entries that a set carries of the lists left, for a pair to be yielded by the first list that it shares.
CARRIED = 16
#: Texts are hashed in blocks of this many bytes.
BLOCK = 1 << 22

#: Columns of a parity sketch.
_PARITY = [f"parity{k}" for k in range(16)]
#: Sets that a task remembers to have seen; it then starts anew and yields some twice, which later steps bear.
REMEMBERED = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ROLE = np.random.default_rng(99).integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) | np.uint64(1)


def _powers(n: int, memo: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    if len(memo[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            run = np.full(n, base)
            run[0] = 1
            memo[k] = np.multiply.accumulate(run)
    return memo[0][:n], memo[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xA3AAAC63B5F3A5F5) ^ (h >> np.uint64(32))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word of ``raw``: a polynomial in its bytes, from prefix sums."""
    starts, hashes, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and not _IS_SPACE[raw[end]]:
            end += 1
        b = np.frombuffer(raw, np.uint8, end - at, at)
        gap = np.ones(len(b) + 2, bool)
        gap[1:-1] = _IS_SPACE[b]
        s, e = np.flatnonzero(gap[:-2] & ~gap[1:-1]), np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
        power, inverse = _powers(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        starts.append(s + at)
        hashes.append(_mix((total[e] - total[s]) * inverse[s]))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, ascending (signed 64-bit)."""
    raw = [(t or "").encode("utf-8").lower() for t in texts]  # lower() of bytes is A-Z alone
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
    start, h = word_hashes(b" ".join(raw))
    bound = np.searchsorted(start, begin)
    rolled = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        rolled += h[j : len(h) - WORDS + 1 + j] * _ROLE[j]
    rolled = _mix(rolled).view(np.int64)
    out = []
    for i in range(len(raw)):
        a, b = int(bound[i]), int(bound[i + 1])
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            short = np.append(h[a:b] * _ROLE[: b - a], _ROLE[WORDS:] * np.uint64(b - a))
            out.append(_mix(short.sum(keepdims=True, dtype=np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def set_id(values: np.ndarray) -> int:
    """64 bits of the set's digest; of 10^9 different sets two share one with odds of 3 in 100."""
    return int.from_bytes(hashlib.md5(values.tobytes(), usedforsecurity=False).digest()[:8], "little", signed=True)


def prefix_length(n: int) -> int:
    """Two sets that reach the similarity share an element among this many first ones of each."""
    return n - -(-NUM * n // DEN) + 1


def _row_key(id_col: str, text_col: str) -> Column:
    return F.md5(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def parity(values: np.ndarray) -> list[int]:
    """Parity sketch: bit b says whether an odd number of elements falls to b.

    The exclusive or of two sets' sketches is the sketch of their symmetric difference, so it has at
    most as many bits set as the sets have elements apart.
    """
    odd = np.bincount(values & (64 * len(_PARITY) - 1), minlength=64 * len(_PARITY)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _fresh(ids: list[int | None], seen: set[int]) -> list[bool]:
    """Which of the sets the task has not met; remembers them."""
    out = []
    for i in ids:
        out.append(i is not None and i not in seen)
        seen.add(i)
    if len(seen) > REMEMBERED:
        seen.clear()
    return out


_LONGS = T.ArrayType(LONG, False)
_CELLS = pa.list_(pa.field("element", pa.int32(), False))


def _signatures(picked: DataFrame) -> DataFrame:
    """doc_id, row_key, sid (null: empty set), n, and once a task and set its sketch and the cells of its hash-ordered prefix."""
    out = schema(doc_id=picked.schema["doc_id"].dataType, row_key=STRING, sid=LONG, n=LONG, sketch=_LONGS, cells=T.ArrayType(INT, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            sets = shingle_sets(batch.column(2).to_pylist())
            ids = [set_id(s) if len(s) else None for s in sets]
            fresh = _fresh(ids, seen)
            sketch = [parity(s) if f else [] for s, f in zip(sets, fresh, strict=True)]
            cells = [cells_of(s[: prefix_length(len(s))]) if f else np.zeros(0, np.int32) for s, f in zip(sets, fresh, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketch, pa.list_(pa.field("element", pa.int64(), False))), pa.array(cells, _CELLS)],
                out.names,
            )

    return picked.select("doc_id", "row_key", "text").mapInArrow(run, out)


def _frequent(signed: DataFrame) -> np.ndarray:
    """Bitmap of the cells that hold more than FREQUENT index entries.

    Only the order of elements depends on it: any bitmap gives the same links, a good one short lists.
    """
    cells = signed.select(F.explode("cells").alias("c")).groupBy("c").count().where(F.col("count") > FREQUENT)
    return id_bitmap(cells.select(F.col("c").cast("long").alias("c")))


def _postings(picked: DataFrame, frequent: np.ndarray, live: np.ndarray | None) -> DataFrame:
    """token, sid, at (size and place) of each set's prefix in the order (frequent cell, hash), once a task and set.

    With ``live``, a bitmap of tokens, only those in it.
    """
    out = schema(token=LONG, sid=LONG, at=LONG)
    shared = picked.sparkSession.sparkContext.broadcast((frequent, live))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        table, wanted = shared.value
        for batch in _slices(batches):
            sets = [s for s in shingle_sets(batch.column(0).to_pylist()) if len(s)]
            tokens, ids, places = [], [], []
            own = [set_id(s) for s in sets]
            for s, i, fresh in zip(sets, own, _fresh(own, seen), strict=True):
                if fresh:
                    p = prefix_length(len(s))
                    often = in_bitmap(s, table)
                    first = np.concatenate([s[~often][:p], s[often][: max(0, p - int((~often).sum()))]])
                    tokens.append(first)
                    ids.append(np.full(len(first), i))
                    places.append(len(s) << 32 | np.arange(len(first)))
            if tokens:
                columns = [np.concatenate(x) for x in (tokens, ids, places)]
                if wanted is not None:
                    kept = in_bitmap(columns[0], wanted)
                    columns = [c[kept] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], out.names)

    return picked.select("text").mapInArrow(run, out)


def _near_sizes(a: Column, b: Column) -> Column:
    return (DEN * a >= NUM * b) & (DEN * b >= NUM * a)


def _enough(common: Column, a: Column, b: Column) -> Column:
    """DEN * common >= NUM * (a + b - common)"""
    return (DEN + NUM) * common >= NUM * (a + b)


def _apart(p: str, q: str) -> Column:
    """Lower bound of the elements that two sets have apart, from the sketches in columns with these prefixes."""
    return sum((F.bit_count(F.col(p + c).bitwiseXOR(F.col(q + c))) for c in _PARITY), F.lit(0))


def _not_too_far(apart: Column, a: Column, b: Column) -> Column:
    """Sets with so many elements apart can still link: (DEN + NUM) * apart <= (DEN - NUM) * (a + b)"""
    return (DEN + NUM) * apart <= (DEN - NUM) * (a + b)


def _sets_of(picked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sid, tokens) of the sets in ``pairs(a, b)``, and of some others.

    A bitmap of fixed size over the ids tells tasks which sets to yield, so texts are read again but not
    shuffled. The more ids it holds, the more needless sets it lets through; none is missed.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    shared = picked.sparkSession.sparkContext.broadcast(id_bitmap(ids.select(F.expr(cell_of("s")).alias("c"))))
    out = schema(sid=LONG, tokens=_LONGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            sets = [s for s in shingle_sets(batch.column(0).to_pylist()) if len(s)]
            ids = np.array([set_id(s) for s in sets], np.int64)
            hit = in_bitmap(ids, shared.value)
            kept = [k for k, f in enumerate(_fresh([int(i) if h else None for i, h in zip(ids, hit, strict=True)], seen)) if f]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(ids[kept], pa.int64()), pa.array([sets[k] for k in kept], pa.list_(pa.field("element", pa.int64(), False)))], out.names)

    # a set that several tasks met comes several times
    return picked.select("text").mapInArrow(run, out).join(ids.withColumnRenamed("s", "sid"), "sid", "left_semi").dropDuplicates(["sid"])


def _answers(picked: DataFrame, pairs: DataFrame, keep: Scratch) -> DataFrame:
    """(a, b, common, n_a, n_b) of ``pairs(a, b)``: the exact overlap of their sets."""
    sets = keep.write(_sets_of(picked, pairs), "sets")
    side = lambda k: sets.select(F.col("sid").alias(k), F.col("tokens").alias(f"t{k}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("common"), F.size("ta").alias("n_a"), F.size("tb").alias("n_b"))


def _linked(answers: DataFrame) -> DataFrame:
    return answers.where(_enough(F.col("common"), F.col("n_a"), F.col("n_b"))).select("a", "b")


def _band(n: Column) -> Column:
    """Block of a set size: sets that link lie in one block or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(DEN / NUM)) + 1e-9).cast("int")


def _met(mixed: DataFrame) -> DataFrame:
    """Rows of two sets of different classes that meet in a list and that nothing rules out; most pairs come once, however many lists they share."""
    # of a linked pair, the smaller set has its first common element in the front: enough elements follow it there
    block = mixed.where((DEN + NUM) * (F.col("n") - F.col("pos")) >= 2 * NUM * F.col("n"))
    block = block.select("token", "band", *[F.col(c).alias("b_" + c) for c in ("sid", "n", "pos", "root", "far", "firsts", *_PARITY)])
    probe = mixed.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"))))
    other = F.col("root") != F.col("b_root")
    smaller = (F.col("b_n") < F.col("n")) | ((F.col("b_n") == F.col("n")) & (F.col("b_sid") < F.col("sid")))
    ahead = _enough(F.least(F.col("n") - F.col("pos"), F.col("b_n") - F.col("b_pos")), F.col("n"), F.col("b_n"))
    # what the centre's answers say: distances to it that differ by more than the limit (null: not compared)
    derived = ~F.coalesce(F.abs(F.col("far") - F.col("b_far")) > 1 - NUM / DEN + 1e-9, F.lit(False))
    # the first list that both carry yields the pair: entries follow one order in all sets, so it lets through whatever the
    # later lists do, unless its centre's answers rule the pair out. Pairs that carry none in common may come several times
    once = F.coalesce(F.get(F.array_intersect("firsts", "b_firsts"), F.lit(0)) == F.col("token"), F.lit(True))
    return probe.join(block, ["token", "band"]).where(
        other & smaller & _near_sizes(F.col("n"), F.col("b_n")) & ahead & derived & _not_too_far(_apart("", "b_"), F.col("n"), F.col("b_n")) & once
    )


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, row_key and is_first (the class's row with the smallest id) of every document.

    Two documents link when NUM/DEN of the union of their five-word shingles is common; component_id is the
    smallest id reachable over links. Equal sets are one set from the start, so copies cost one row a
    task. No link between different sets is lost: two sets that would link share an index list; if they
    are not in one class once the lists' centres have been compared, they meet in the blocks of that list. A list is never
    gathered: its centre is an aggregate, and its blocks meet in a sort-merge join that Spark splits where a block is large.

    Null text or no word: no shingle, a class of its own; a null id leaves the class to its other members
    (null without any). Repeated rows and ids: each row is returned, with its set's class (for a document
    without words its own id). Empty table: empty result. Extra columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = Scratch(spark)
    picked = docs.select(F.col(id_col).alias("doc_id"), _row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    signed = keep.write(_signatures(picked), "signed")
    frequent = _frequent(signed)
    sketched = signed.where(F.size("sketch") > 0).dropDuplicates(["sid"])
    sketches = keep.write(sketched.select("sid", "n", *[F.get("sketch", F.lit(k)).alias(c) for k, c in enumerate(_PARITY)]), "sketches")
    members = keep.write(signed.select("doc_id", "row_key", "sid", "n"), "members")
    keep.drop("signed")
    side = lambda k: sketches.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), *[F.col(c).alias(k + c) for c in _PARITY])

    # lists of two sets or more
    lists = _postings(picked, frequent, None).select("token", "sid").groupBy("token").agg(F.min("sid").alias("low"), F.max("sid").alias("high"))
    live = keep.write(lists.where("low <> high").select("token"), "live")
    reclaim(spark)
    entries = _postings(picked, frequent, id_bitmap(live.select(F.expr(cell_of("token")).alias("c"))))
    size, place = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))
    # a set's second entry in a list comes from another task that met a copy
    entries = entries.dropDuplicates(["token", "sid"]).join(live, "token")
    entries = keep.write(entries.select("token", "sid", size.alias("n"), place.alias("pos")), "entries")
    keep.drop("live")
    reclaim(spark)
    # a list's centre is its set with the largest share of shared elements: the one that others are edited copies of
    front = F.col("n") - F.ceil(F.col("n") * NUM / DEN) + 1
    shared = entries.groupBy("sid").agg(F.count("*").alias("c"), F.first("n").alias("n")).select("sid", F.floor(F.col("c") / front * (1 << 20)).cast("long").alias("share"))
    rank = F.shiftleft(F.least("share", F.lit(1 << 20)), 40).bitwiseOR(F.col("sid").bitwiseAND(F.lit((1 << 40) - 1)))
    centres = entries.select("token", "sid").join(shared, "sid").groupBy("token").agg(F.max_by("sid", rank).alias("centre"))
    index = keep.write(entries.join(centres, "token"), "index")
    keep.drop("entries")
    reclaim(spark)

    # the answers of the centres
    met = index.where("sid <> centre").select(F.col("sid").alias("a"), F.col("centre").alias("b")).distinct()
    near = met.join(side("a"), "a").join(side("b"), "b").where(_near_sizes(F.col("n_a"), F.col("n_b")) & _not_too_far(_apart("a", "b"), F.col("n_a"), F.col("n_b")))
    near = keep.write(near.select("a", "b"), "near")
    answers = keep.write(_answers(picked, near, keep), "answers")
    keep.drop("sets")
    reclaim(spark)
    links = keep.write(_linked(answers), "links")
    roots = components(links)

    # entries of different classes in one list
    classed = index.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    spread = classed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    told = answers.select(F.col("a").alias("sid"), F.col("b").alias("centre"), (1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("far"))
    mixed = keep.write(classed.join(spread.select("token"), "token").join(told, ["sid", "centre"], "left"), "spread")
    # a set's first lists among those left, in the order of its entries
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))  # no more than the set's front
    firsts = mixed.groupBy("sid").agg(F.transform(F.slice(ordered, 1, CARRIED), lambda x: x["token"]).alias("firsts"))
    mixed = mixed.join(firsts.join(sketches.drop("n"), "sid"), "sid")
    mixed = mixed.withColumn("far", F.when(F.col("sid") == F.col("centre"), 0.0).otherwise(F.col("far")))
    mixed = keep.write(mixed.withColumn("band", _band(F.col("n"))), "mixed")
    keep.drop("index", "spread")
    reclaim(spark)
    found = _met(mixed)
    rest = found.select(F.greatest("sid", "b_sid").alias("a"), F.least("sid", "b_sid").alias("b")).distinct()
    # what was compared before needs no second look
    known = near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = keep.write(rest.join(known, ["a", "b"], "left_anti"), "rest")
    keep.drop("mixed")
    reclaim(spark)
    links = keep.write(links.unionByName(_linked(_answers(picked, rest, keep))), "all-links")
    roots = components(links)
    keep.drop("sets", "near", "answers", "rest", "links", "all-links", "sketches")
    reclaim(spark)

    member = keep.write(members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "classed")
    keep.drop("members")
    here = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    lowest = member.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(here).alias("first"))
    alone = F.col("sid").isNull()
    return member.join(lowest, "root", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "row_key",
        (alone | (F.col("row_key") == F.col("first.row_key"))).alias("is_first"),
    )
