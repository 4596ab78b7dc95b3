"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences.

Documents are cut into blocks of words; a block's TF-IDF vector over the benchmark's own vocabulary is a row of
a matrix that no machine holds. Its leading right singular vectors come from one randomised pass: every
task adds up its share of A'(A W) for a random W, the shares are summed in a grouped aggregation, and the small
sum yields the factors (single-pass Nystroem scheme; Halko, Martinsson and Tropp 2011, Tropp, Yurtsever,
Udell and Cevher 2017). Passages (two blocks in a row) and pieces of items meet by cosine in that space; what
comes near is checked word by word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from copy import copy
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BINARY, DOUBLE, INT, LONG, Scratch, cut, schema, small_batches
from .jaccard_join import _mix, _powers

#: Words of a block; a passage is two, so it holds each run of BLOCK words and most of a run of two blocks.
BLOCK = 32
#: Words in more than this share of the items (and in more than COMMON_LEAST) do not tell items apart.
COMMON_SHARE, COMMON_LEAST = 0.015, 3
#: An item with fewer words left gets back its rarest ones, up to this many, that at most FILL_SHARE of the items have.
LEAST_WORDS, FILL_SHARE = 9, 0.05
#: Dimensions of the latent space, and surplus ones of the random test matrix.
RANK, SURPLUS = 256, 32
#: Cosine from which a passage is checked. Low: the check decides.
MIN_COSINE = 0.18
#: Share of an item's words found in order: enough alone, or enough with the answer.
MIN_COMMON, MIN_PARAPHRASE, MIN_ANSWER = 0.8, 0.6, 0.8
#: Items of a pass over the texts. They are dealt to rounds of at most as many pieces as the latent space has dimensions;
#: a round reads only the places of its words that the pass has found. What tasks hold is bounded by both.
ITEMS = 10_000
_TERMS = 64
#: Shares that one group adds up; there are as many levels of groups as the number of tasks needs.
FAN_IN = 32
#: Characters that are hashed at a time.
CHARS = 1 << 20

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a's places in the bits of one number (Hyyroe 2004)."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for w in b:
        hit = where.get(w, 0)
        if hit:
            both = state & hit
            state = ((state + both) | (state - both)) & full
    return len(a) - state.bit_count()


class Item:
    """One benchmark item: its words, its answer (the last sentence of two words or more), its pieces."""

    def __init__(self, number: int, ident, text: str):
        self.number, self.ident, self.words = number, ident, words(text)
        sentences = [s for s in map(words, _SENTENCE.split(text)) if len(s) > 1]
        self.answer = sentences[-1] if len(sentences) > 1 else self.words[-max(1, len(self.words) // 4) :]
        n = len(self.words)
        self.pieces = [self.words] if n <= 2 * BLOCK else [self.words[i : i + 2 * BLOCK] for i in range(0, n - BLOCK, BLOCK)]

    def found_in(self, region: list[str]) -> float:
        """Share of the item's words that the region has in order, 0 where neither rule holds."""
        share = common_length(self.words, region) / len(self.words)
        if share >= MIN_COMMON:
            return share
        if share >= MIN_PARAPHRASE and common_length(self.answer, region) >= MIN_ANSWER * len(self.answer):
            return share
        return 0.0


def rounds_of(items: list[Item]) -> list[list[Item]]:
    """The items dealt to rounds of at most RANK pieces; one with more pieces comes in several rounds, with some of them in each."""
    rounds: list[list[Item]] = [[]]
    free = RANK
    for item in items:
        for at in range(0, len(item.pieces), RANK):
            part = copy(item)
            part.pieces = item.pieces[at : at + RANK]
            if len(part.pieces) > free:
                rounds.append([])
                free = RANK
            rounds[-1].append(part)
            free -= len(part.pieces)
    return [r for r in rounds if r]


def vocabulary(items: list[Item]) -> dict[str, int]:
    """Number of each word that few items have, with enough words of each item."""
    count = Counter(w for item in items for w in set(item.words))
    most = max(COMMON_LEAST, COMMON_SHARE * len(items))
    kept = {w for w, n in count.items() if n <= most}
    for item in items:
        own = sorted(set(item.words), key=lambda w: (count[w], w))
        kept.update(w for w in own[:LEAST_WORDS] if count[w] <= FILL_SHARE * len(items))
        if not kept.intersection(own):
            kept.update(own)
    return {w: i for i, w in enumerate(sorted(kept))}


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Whether a code point below 2^16 is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(1 << 16)), bool, 1 << 16)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts in a row, number of the first word of each text and of the end).

    Words are those of ``words``; a hash is a polynomial in a word's characters, taken from prefix sums.
    """
    low = [t.lower() for t in texts]
    c = np.frombuffer("\n".join(low).encode("utf-32-le"), np.uint32)
    inside = _letter_table()[np.minimum(c, 0xFFFF)]
    if len(far := np.flatnonzero(c > 0xFFFF)):
        inside[far] = [chr(x).isalnum() for x in c[far].tolist()]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    hashes = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):  # words that begin within CHARS characters, the last one whole
        upto = int(np.searchsorted(start, start[at] + CHARS))
        base, stop = int(start[at]), int(end[upto - 1])
        power, inverse = _powers(stop - base + 1)
        total = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((c[base:stop].astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        s, e = start[at:upto] - base, end[at:upto] - base
        hashes[at:upto] = _mix((total[e] - total[s]) * inverse[s])
        at = upto
    begin = np.cumsum([0, *(len(t) + 1 for t in low)])
    return hashes, np.searchsorted(start, begin)


class Vocabulary:
    """Numbers of words, looked up by hash; words in order."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        hashes = hashed_words(["\n".join(terms)])[0] if terms else np.zeros(0, np.uint64)
        self.number = np.argsort(hashes)
        self.hashes = hashes[self.number]
        self.maybe = np.zeros(1 << 20, bool)  # by leading bits: most words are out at once
        self.maybe[self.hashes >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes`` that hold a word of the vocabulary, its number)."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        where = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[where] == hashes[at]
        return at[same], self.number[where[same]]


def _hits(keyed: DataFrame, terms: list[str]) -> DataFrame:
    """key, n (words), at (places) and term of the vocabulary's words in each text that has any."""
    out = schema(key=LONG, n=LONG, at=BINARY, term=BINARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(terms)
        for batch in _slices(batches):
            keys, (hashes, first) = batch.column(0).to_pylist(), hashed_words(batch.column(1).to_pylist())
            where, number = known.find(hashes)
            bound = np.searchsorted(where, first)
            rows = []
            for k, key in enumerate(keys):
                a, b = bound[k], bound[k + 1]
                if a < b:
                    rows.append((key, int(first[k + 1] - first[k]), (where[a:b] - first[k]).astype(np.uint32).tobytes(), number[a:b].astype(np.int32).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], out.names)

    return keyed.select("key", "text").mapInArrow(run, out)


def _own(hits: DataFrame, number: np.ndarray) -> DataFrame:
    """``hits`` of the terms that ``number`` gives a number of 0 or more, by that number."""
    out = hits.schema
    shared = hits.sparkSession.sparkContext.broadcast(number.astype(np.int32))  # a pass's vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, at, term in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shared.value[np.frombuffer(term, np.int32)]
                kept = own >= 0
                if kept.any():
                    rows.append((key, n, np.frombuffer(at, np.uint32)[kept].tobytes(), own[kept].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], out.names)

    return hits.mapInArrow(run, out)


def _blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first hit of each block, document of the block, number of the block in it, terms of all hits)."""
    at = [np.frombuffer(x, np.uint32).astype(np.int64) // BLOCK for x in batch.column(2).to_pylist()]
    terms = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int32)
    doc = np.repeat(np.arange(len(at), dtype=np.int64), [len(a) for a in at])
    block = np.concatenate(at)
    first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])]))
    return first, doc[first], block[first], terms


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def inverse_frequency(hits: DataFrame, size: int) -> np.ndarray:
    """log(blocks / blocks with the term) over all documents, one number for each of ``size`` terms."""
    out = schema(term=INT, n=LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(size, np.int64), 0
        for batch in _slices(batches):
            first, _, _, terms = _blocks(batch)
            block = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(terms))))
            count += np.bincount(np.unique(block * size + terms) % size, minlength=size)
            total += int(sum((n + BLOCK - 1) // BLOCK for n in batch.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size), pa.int32()), pa.array(np.append(total, count), pa.int64())], out.names)

    found = hits.mapInArrow(run, out).groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(size + 1)
    count[found["term"].to_numpy() + 1] = found["n"].to_numpy()
    return np.log((count[0] + 2) / (count[1:] + 1)).astype(np.float32)


def latent_space(hits: DataFrame, weight: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Leading right singular vectors, terms x dimensions, of all blocks' and pieces' TF-IDF rows."""
    size = len(weight)
    width = min(size, RANK + SURPLUS)
    test = np.random.default_rng(17).standard_normal((size, width)).astype(np.float32)
    shared = hits.sparkSession.sparkContext.broadcast(test * weight[:, None])  # vocabulary x width
    out = schema(part=INT, sums=BINARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled = shared.value
        sums = np.zeros((size, width), np.float32)
        for batch in _slices(batches):
            first, _, _, terms = _blocks(batch)
            projected = np.add.reduceat(scaled[terms], first, axis=0)
            block = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(terms))))
            order = np.argsort(terms, kind="stable")
            sorted_terms = terms[order]
            heads = np.flatnonzero(np.concatenate([[True], sorted_terms[1:] != sorted_terms[:-1]]))
            sums[sorted_terms[heads]] += np.add.reduceat(projected[block[order]], heads, axis=0)
        for p in range(0, size, _TERMS):
            yield pa.RecordBatch.from_arrays([pa.array([p // _TERMS], pa.int32()), pa.array([sums[p : p + _TERMS].tobytes()], pa.binary())], out.names)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows["sums"].iloc[0]) // 4)
        for share in rows["sums"]:
            total += np.frombuffer(share, np.float32)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "task": rows["task"].iloc[:1] // FAN_IN, "sums": [total.astype(np.float32).tobytes()]})

    # groups of FAN_IN shares, level by level, so that no task gathers the shares of all tasks
    wide, left = schema(part=INT, task=INT, sums=BINARY), hits.rdd.getNumPartitions()
    shares = hits.mapInArrow(run, out).withColumn("task", F.spark_partition_id())
    while left > 1:
        shares = shares.groupBy("part", F.expr(f"task div {FAN_IN}").alias("group")).applyInPandas(lambda _, rows: add(rows), wide)
        left = -(-left // FAN_IN)
    parts = shares.select("part", "sums").toPandas().sort_values("part")  # vocabulary x width in all
    image = np.concatenate([np.frombuffer(s, np.float32).astype(np.float64).reshape(-1, width) for s in parts["sums"]]) if len(parts) else np.zeros((size, width))
    # the benchmark's pieces count as much as all documents together, so that no item's direction is lost among them
    energy = float(np.trace(test.T @ (image * weight[:, None]))) / max(float(((pieces @ test) ** 2).sum()), 1e-9)
    image = image * weight[:, None] + max(energy, 1.0) * (pieces.T @ (pieces @ test))
    core = test.T.astype(np.float64) @ image
    shift = 1e-6 * max(np.trace(core), 1e-9) / width
    values, vectors = np.linalg.eigh((core + core.T) / 2 + shift * np.eye(width))
    root = vectors / np.sqrt(np.maximum(values, shift))
    left, _, _ = np.linalg.svd(image @ root, full_matrices=False)
    return left[:, : min(RANK, width)].astype(np.float32)


def _near(hits: DataFrame, weight: np.ndarray, space: np.ndarray, pieces: np.ndarray, item_of: np.ndarray) -> DataFrame:
    """key and the (item, block) of passages whose cosine with a piece of the item reaches MIN_COSINE.

    The inner product is taken in the latent space, the lengths are those of the whole vectors: a passage
    that lies mostly outside the space is near to nothing.
    """
    unit = (pieces @ space) / np.maximum(np.linalg.norm(pieces, axis=1), 1e-9)[:, None]
    shared = hits.sparkSession.sparkContext.broadcast((space * weight[:, None], unit.astype(np.float32), weight**2))  # (vocabulary + pieces) x rank
    out = schema(key=LONG, items=T.ArrayType(LONG, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, unit, square = shared.value
        for batch in _slices(batches):
            first, doc, block, terms = _blocks(batch)
            own, energy = np.add.reduceat(table[terms], first, axis=0), np.add.reduceat(square[terms], first)
            # a passage is a block and the next one; blocks without hits are zero
            follows = np.flatnonzero((doc[1:] == doc[:-1]) & (block[1:] == block[:-1] + 1))
            passage, size = own.copy(), energy.copy()
            passage[follows] += own[follows + 1]
            size[follows] += energy[follows + 1]
            size = np.sqrt(size)
            # the product is at most the length in the space
            live = np.flatnonzero(np.linalg.norm(passage, axis=1) >= MIN_COSINE * size)
            found: dict[int, set[int]] = {}
            for at in range(0, len(live), 4096):
                some = live[at : at + 4096]
                i, j = np.nonzero(passage[some] @ unit.T >= MIN_COSINE * size[some][:, None])
                for d, code in zip(doc[some[i]], item_of[j] << 32 | block[some[i]], strict=True):
                    found.setdefault(int(d), set()).add(int(code))
            if found:
                keys = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([keys[d] for d in found], pa.int64()), pa.array([sorted(x) for x in found.values()], pa.list_(pa.field("element", pa.int64(), False)))], out.names)

    return hits.mapInArrow(run, out)


def _check(keyed: DataFrame, near: DataFrame, items: dict[int, Item]) -> DataFrame:
    """(key, item, score) of the items that a text holds."""
    out = schema(key=LONG, item=LONG, score=DOUBLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = words(text)
                spans: dict[int, list[list[int]]] = {}
                for code in codes:
                    item = items[code >> 32]
                    begin, end = (code & 0xFFFFFFFF) * BLOCK - len(item.words), (code & 0xFFFFFFFF) * BLOCK + 2 * BLOCK + len(item.words)
                    last = spans.setdefault(item.number, [])
                    if last and begin <= last[-1][1] and end - last[-1][0] <= 8 * BLOCK + 2 * len(item.words):
                        last[-1][1] = end
                    else:
                        last.append([begin, end])
                for number, regions in spans.items():
                    score = max(items[number].found_in(own[max(0, b) : e]) for b, e in regions)
                    if score:
                        rows.append((key, number, round(score, 6)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], out.names)

    return keyed.select("key", "text").join(near, "key").select("key", "text", "items").mapInArrow(run, out)


def tfidf(texts: list[list[str]], terms: dict[str, int], weight: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), len(terms)), np.float32)
    for k, own in enumerate(texts):
        for w in own:
            if w in terms:
                out[k, terms[w]] += weight[terms[w]]
    return out


def _leaks(keyed: DataFrame, items: list[Item], names: T.StructType, keep: Scratch) -> DataFrame:
    """(key, item, score) of the texts that hold one of ``items``, by its id: one pass over the texts."""
    rounds = rounds_of(items)
    known = [vocabulary(r) for r in rounds]
    every = sorted(set().union(*known))
    place = {w: i for i, w in enumerate(every)}
    hits = keep.write(_hits(keyed, every), "hits")
    near = None
    for some, terms in zip(rounds, known, strict=True):
        number = np.full(len(every), -1)
        number[[place[w] for w in terms]] = list(terms.values())
        own = hits if len(rounds) == 1 else _own(hits, number)
        weight = inverse_frequency(own, len(terms))
        pieces = [(i.number, p) for i in some for p in i.pieces]
        vectors = tfidf([p for _, p in pieces], terms, weight)
        space = latent_space(own, weight, vectors)
        found = keep.write(_near(own, weight, space, vectors, np.array([n for n, _ in pieces], np.int64)), "near")
        near = found if near is None else near.unionByName(found)
    if len(rounds) > 1:
        near = near.select("key", F.explode("items").alias("i")).groupBy("key").agg(F.array_sort(F.collect_set("i")).alias("items"))
    held = {i.number: i for i in items}
    checked = keep.write(_check(keyed, near, held), "checked")
    keep.drop("hits", "near")
    idents = keyed.sparkSession.createDataFrame([(n, i.ident) for n, i in held.items()], names)
    return checked.join(F.broadcast(idents), "item").select("key", "ident", "score")  # ITEMS rows at most


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending), best_score and _key of every document.

    A document is contaminated by an item if a passage near to it in the latent space, with as many words
    around it as the item has, holds MIN_COMMON of the item's words in order, or MIN_PARAPHRASE of them and
    MIN_ANSWER of the answer's. Words are runs of letters and digits in lower case.

    A pass over the texts takes ITEMS items, in rounds of at most RANK pieces, so neither what tasks hold nor a piece's share of
    the latent space depends on the size of the benchmark or of its items. Null or wordless items
    match nothing; items with equal text are found together; null item ids are left out of item_ids. Null
    or empty texts are clean. Null or repeated ids and repeated rows: each row is judged by its own text.
    Empty tables: nothing is contaminated. Extra columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = Scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text, F.length(text)).alias("key"))
    kind = benchmark.schema[item_col].dataType
    sound = benchmark.where(F.col(item_text_col).rlike(r"[\p{L}\p{N}]")).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    passes = -(-sound.count() // ITEMS)
    found = spark.createDataFrame([], T.StructType([T.StructField("key", LONG), T.StructField("ident", kind), T.StructField("score", DOUBLE)]))
    for r in range(passes):
        part = sound.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == r).orderBy("item", "text").collect()  # about ITEMS rows
        whole = [i for i in (Item(n, row["item"], row["text"]) for n, row in enumerate(part)) if i.words]
        if whole:
            names = T.StructType([T.StructField("item", LONG), T.StructField("ident", kind)])
            found = found.unionByName(_leaks(keyed, whole, names, keep))
    per = found.groupBy("key").agg(F.array_sort(F.collect_set("ident")).alias("item_ids"), F.max("score").alias("best_score"))
    none = F.array().cast(per.schema["item_ids"].dataType)
    return keyed.select("doc_id", "key").join(cut(per), "key", "left").select(
        "doc_id",
        F.col("best_score").isNotNull().alias("contaminated"),
        F.when(F.col("item_ids").isNull(), 0).otherwise(F.size("item_ids")).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
        F.coalesce("best_score", F.lit(0.0)).alias("best_score"),
        F.col("key").alias("_key"),
    )
