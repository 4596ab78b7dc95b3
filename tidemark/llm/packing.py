"""Packing along a space-filling curve: neighbours in content share training sequences."""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BINARY, LONG, running_totals, schema, small_batches, stage
from .token_counts import SPACES, _byte_letters

SEQUENCE = 2048
END_ID = 1
DIMS = 3
BITS = 16
#: Hashed coordinates of a document's vector, before the projection.
COORDINATES = 4096
#: Words, and pieces of words, whose ids a worker remembers (two generations of this many).
MEMO_WORDS = 250_000
MEMO_PIECES = 120_000

_WORD = re.compile(f"[^{SPACES}]+")


class _Memo(dict):
    """Remembers at least the ``keep`` values used last, at most twice as many."""

    def __init__(self, make, keep: int):
        super().__init__()
        self.make, self.keep, self.old = make, keep, {}

    def __missing__(self, key):
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class WordTokenizer:
    """Ids of a vocabulary that drops white space: a text's ids are its words' ids in a row.

    Words seen lately are looked up; others are lower-cased and split as the vocabulary's file says and
    their pieces go through the library's merges. Words that hold a special string, or a file with other
    rules, go through the library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.mark = os.path.commonprefix(self.specials)
        rules = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])], [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.split = None
        if rules == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = {b: c for c, b in _byte_letters().items()}
        self.letters = {b: letters[b] for b in range(256) if chr(b) != letters[b]}
        self.pieces = _Memo(self._piece, MEMO_PIECES)
        self.words = _Memo(self._word, MEMO_WORDS)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isalpha() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        if self.split is None or self.mark in word and any(s in word for s in self.specials):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        # letter by letter where the form depends on the neighbours
        low = word.lower() if "\u03a3" not in word else "".join(c.lower() for c in word)
        if low.isalpha():
            return self.pieces[low]
        if low[-1] in ".,!?" and low[:-1].isalpha():
            return self.pieces[low[:-1]] + self.pieces[low[-1]]
        return b"".join(map(self.pieces.__getitem__, self.split.findall(low)))

    def forget(self) -> None:
        """Gives back the memory of words: a worker process outlives its task and may serve quite another one next."""
        for memo in (self.words, self.pieces):
            memo.clear()
            memo.old = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known, words = self.words.__getitem__, _WORD.findall
        return [b"".join(map(known, words(t))) for t in texts]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    """Random projection of hashed coordinates to DIMS; the same on every executor."""
    return np.random.default_rng(20240229).standard_normal((COORDINATES, DIMS)).astype(np.float32)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each grid point (n, dims; 0 to 2^bits - 1) on the Hilbert curve.

    Skilling's transform ("Programming the Hilbert curve", 2004) on whole columns: undo excess rotations
    and reflections from the top bit down, then Gray-code and interleave the bits.
    """
    x = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(len(x)):
            flip = (x[d] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[d] = x[0] if d == 0 else x[d] ^ swap
        q >>= 1
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    last, t, q = x[-1], np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((last & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = key << 1 | ((x[d] ^ t) >> b & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document: token counts hashed to coordinates, unit length, projected, put on a fixed grid."""
    table, where = projection(), np.zeros((len(ids), DIMS), np.float32)
    for k, own in enumerate(ids):
        if len(own):
            counts = np.bincount((own.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20), minlength=COORDINATES).astype(np.float32)
            np.sqrt(counts, out=counts)  # frequent words count less
            where[k] = counts @ table / np.linalg.norm(counts)
    # a unit vector's projections are nearly standard normal: +-6 covers them, the rest is clipped
    grid = np.clip((where + 6) / 12 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_key(grid.astype(np.int64))


def tokenised(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, curve (Hilbert key), doc_tokens (with the end id), ids (16-bit where the vocabulary allows it)."""
    out = schema(doc_id=docs.schema[id_col].dataType, curve=LONG, doc_tokens=LONG, ids=BINARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = word_tokenizer(tokenizer)
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    raw = machine.ids([t or "" for t in batch.column(1).to_pylist()])
                    ids = [np.frombuffer(r, "<u4") for r in raw]
                    keys = curve_keys(ids)
                    ended = [np.append(i, np.uint32(END_ID)) for i in ids]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(keys, pa.int64()), pa.array([len(i) for i in ended], pa.int64()), pa.array([_narrow(i) for i in ended], pa.binary())],
                        ["doc_id", "curve", "doc_tokens", "ids"],
                    )
        finally:
            machine.forget()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as 16-bit numbers after a 0 byte, or as 32-bit ones after a 1 byte."""
    return b"\0" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\1" + ids.astype("<u4").tobytes()


def _wide(raw: bytes) -> bytes:
    return np.frombuffer(raw, "<u2", offset=1).astype("<u4").tobytes() if raw[0] == 0 else raw[1:]


def pack(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lay all documents end to end along the curve and cut the line every ``length`` tokens.

    One row per piece: doc_id, start (ids of its document before it), length, ids_crc32, doc_tokens,
    sequence_id, offset, curve. Every sequence but the last is full, so at most one is padded.

    Documents are tokenised once into a staged table; range-sorted keys and token counts alone give the
    places by prefix sums; the ids are then joined to their places by row number. Null or empty texts
    have the end id alone. Null or repeated ids and repeated rows: each row is packed once (row numbers
    of the staged table tell them apart). Empty table: empty result. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    staged = stage(tokenised(docs, tokenizer, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "ids")
    places = running_totals(staged.select("row", "curve", "doc_tokens"), ["curve", "row"], {"place": "doc_tokens"}).select("row", "place")
    out = schema(
        doc_id=docs.schema[id_col].dataType, start=LONG, length=LONG, ids_crc32=LONG, doc_tokens=LONG, sequence_id=LONG, offset=LONG, curve=LONG
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows: list[tuple] = []
            for k, (place, raw) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4), strict=True)):
                ids = _wide(raw.as_py())
                n, at = len(ids) // 4, 0
                while at < n:
                    sequence, offset = divmod(place + at, length)
                    take = min(length - offset, n - at)
                    rows.append((k, at, take, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + take)]), sequence, offset))
                    at += take
            which, start, size, crc, sequence, offset = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(which), start, size, crc, batch.column(2).take(which), sequence, offset, batch.column(1).take(which)], out.names
            )

    return staged.join(places, "row").select("doc_id", "curve", "doc_tokens", "place", "ids").mapInArrow(run, out)
