"""Quality classifier: random-indexing word vectors, pooled, into a small calibrated network."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BOOL, DOUBLE, INT, LONG, cut, schema, small_batches

#: Rows of the word table (words share rows by hash, whatever their number) and the length of their vectors.
ROWS, DIM = 16_384, 32
#: Non-zero places of a word's index vector, and tokens on each side that are its context.
NONZERO, SPAN = 4, 3
#: Tokens whose neighbours are added up at a time.
TOKENS = 1 << 17
#: Numbers of a pooled text: mean and spread of its tokens' vectors, logarithm of how many there are.
POOLED = 2 * DIM + 1
#: Labelled documents that the network is fitted on, at most: those with the smallest hash of their id.
MAX_TRAIN = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
THRESHOLD = 0.3
FOLDS = 5
MEMO_WORDS = 250_000


def _form(word: str) -> str:
    """How a word is written: runs of capitals, letters, digits and each other sign, as one sign."""
    out: list[str] = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def _row(token: str) -> int:
    return 1 + zlib.crc32(token.encode("utf-8")) % (ROWS - 1)


class TokenRows:
    """A text as a run of tokens, each a row number of the word table, the same in every process.

    Each word gives two tokens, its letters in lower case and the form in which it is written; each line ends with one that
    says whether the text had that line before. All are words of one vocabulary and get their vectors
    from their neighbours.
    """

    def __init__(self):
        self.memo: dict[str, int] = {}
        self.line_ends = _row("\0line"), _row("\0line again")

    def _word(self, word: str) -> int:
        both = self.memo.get(word)
        if both is None:
            core = "".join(filter(str.isalpha, word)).lower()
            both = (_row(core) if core else 0) << 16 | _row("\0" + _form(word))
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            if len(word) <= 40:
                self.memo[word] = both
        return both

    def __call__(self, text: str) -> np.ndarray:
        words: list[str] = []
        ends, kinds, seen = [], [], set()
        for line in text.split("\n"):
            own = line.split()
            if own:
                words += own
                ends.append(2 * len(words))
                kinds.append(self.line_ends[line in seen])
                seen.add(line)
        both = np.fromiter(map(self._word, words), np.int64, len(words))
        run = np.empty(2 * len(words), np.int64)
        run[::2], run[1::2] = both >> 16, both & 0xFFFF
        run = np.insert(run, ends, kinds)
        return run[run > 0]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's random index vector; the same on every executor."""
    rng = np.random.default_rng(7)
    return rng.integers(0, DIM, (ROWS, NONZERO)), rng.choice([-1.0, 1.0], (ROWS, NONZERO))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context sums of every row over all documents: unit vectors, rows x DIM.

    A task adds the index vectors of the words around each word it reads and yields its table by rows;
    sums of whole numbers give the same table in any order. The table's size does not depend on the data.
    """
    out = schema(row=INT, v=T.ArrayType(LONG, False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        own = np.zeros((ROWS + 1, DIM), np.float32)  # the last row stands for the gap between texts
        np.add.at(own, (np.repeat(np.arange(ROWS), NONZERO), place.reshape(-1)), sign.reshape(-1))
        number, total = TokenRows(), np.zeros((ROWS + 1, DIM))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                gap = np.full(SPAN, ROWS)
                parts: list[np.ndarray] = []
                for t in whole.column(0).slice(at, 256).to_pylist():
                    if t:
                        parts += [number(t), gap]
                if not parts:
                    continue
                every = np.concatenate(parts).astype(np.uint16)
                for low in range(0, len(every), TOKENS):  # with the neighbours of the first and the last one
                    start, stop = max(0, low - SPAN), min(len(every), low + TOKENS + SPAN)
                    rows = every[start:stop]
                    vectors, around = own[rows], np.zeros((len(rows), DIM), np.float32)
                    for far in range(1, SPAN + 1):
                        around[far:] += vectors[:-far]
                        around[:-far] += vectors[far:]
                    rows, around = rows[low - start : low - start + TOKENS], around[low - start : low - start + TOKENS]
                    order = np.argsort(rows, kind="stable")
                    by_row = rows[order]
                    heads = np.flatnonzero(np.concatenate([[True], by_row[1:] != by_row[:-1]]))
                    total[by_row[heads]] += np.add.reduceat(around[order], heads, axis=0)
        total = total[:ROWS]
        table = total.reshape(ROWS, DIM).astype(np.int64)
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(table[used]), pa.list_(pa.field("element", pa.int64(), False)))], out.names)

    sums = docs.select("text").mapInArrow(run, out).groupBy("row").agg(*[F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(DIM)])
    found = sums.toPandas()  # ROWS rows
    table = np.zeros((ROWS, DIM))
    if len(found):
        table[found["row"].to_numpy()] = found[[f"v{k}" for k in range(DIM)]].to_numpy(dtype=float)
    # frequent neighbours dominate sums: damp, then unit length
    table = np.sign(table) * np.log1p(np.abs(table))
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(norm, 1e-9)).astype(np.float32)


def pool(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of a text's tokens, and how many there are."""
    out = np.zeros(POOLED, np.float32)
    if len(rows):
        own, n = np.unique(rows, return_counts=True)
        v, w = table[own], (n / len(rows)).astype(np.float32)
        mean = w @ v
        out[:DIM], out[DIM:-1] = mean, np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0))
        out[-1] = np.log1p(len(rows))
    return np.round(out, 5)


def pooled(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, x: the pooled vectors of each text's tokens."""
    out = schema(doc_id=docs.schema["doc_id"].dataType, x=T.ArrayType(T.FloatType(), False))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # ROWS x DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TokenRows()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x = [pool(number(t or ""), shared.value) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.field("element", pa.float32(), False)))], out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


class Network:
    """Two layers with a logistic end and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(3)
        order = rng.permutation(len(x))
        aside = order[: len(x) // 5]  # sets the temperature
        fit = order[len(x) // 5 :]
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
        self.w1 = rng.standard_normal((x.shape[1], HIDDEN)) * (1 / x.shape[1]) ** 0.5
        self.b1, self.w2, self.b2 = np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * (1 / HIDDEN) ** 0.5, 0.0
        self.temperature = 1.0
        z = (x - self.mean) / self.scale
        params = [self.w1, self.b1, self.w2, np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            fit = rng.permutation(fit)
            for i in range(0, len(fit), BATCH):
                a, t = z[fit[i : i + BATCH]], y[fit[i : i + BATCH]]
                h = np.tanh(a @ params[0] + params[1])
                p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -30, 30)))
                e = (p - t) / len(a)
                back = np.outer(e, params[2]) * (1 - h * h)
                grads = [a.T @ back + DECAY * params[0], back.sum(0), h.T @ e + DECAY * params[2], np.array([e.sum()])]
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = *params[:3], float(params[3][0])
        held = aside if len(aside) else order
        raw, t = self.logit(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.mean(np.logaddexp(0, -np.where(t > 0, 1, -1) * raw / g)) for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    Word vectors come from all documents. The network is fitted on at most MAX_TRAIN labelled documents
    outside the held-out fold (crc32 of the id as text, mod 5, is 0), chosen by a hash of the id; a fifth of
    them sets the temperature. Only the text enters a score.

    Null or empty text: the pooled vector of no words, scored like any other. Null id: not held out,
    never learned from. Repeated labels: each is learned from; null labels are not. No usable label, or
    one class alone: every score is that class's share, 0.5 without any. Empty table: empty result.
    Repeated rows are scored each. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vectors = cut(pooled(picked, word_vectors(picked)))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(fold != 0)
    chosen = known.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "y").limit(MAX_TRAIN)
    sample = chosen.join(vectors, "doc_id").orderBy("h", "doc_id", "y", F.xxhash64("x")).limit(MAX_TRAIN).select("x", "y").toPandas()
    y = sample["y"].to_numpy(dtype=float)
    flat = float(y.mean()) if len(y) else 0.5
    network = Network(np.stack(sample["x"].to_numpy()).astype(np.float64), y) if len(set(y)) > 1 else None
    out = schema(doc_id=docs.schema[id_col].dataType, held_out=BOOL, score=DOUBLE, predicted=INT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, POOLED).astype(np.float64)
            p = np.round(network.score(x), 9) if network else np.full(batch.num_rows, flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())], out.names
            )

    return vectors.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "x").mapInArrow(run, out)
