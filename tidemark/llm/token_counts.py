"""Token counts by a compiled finite-state tokenizer.

Two deterministic machines run over a text and annotate their transitions with emitted tokens:

* the *piece automaton* reads characters by class and ends a piece where the vocabulary's
  split rule does (contractions, letters, digits, other signs, white space);
* the *merge automaton* reads a piece's bytes. Its states are the nodes of the vocabulary's trie
  with failure links; a transition yields the tokens that end here. Exactly one of them may follow the
  best split of what is before it - the one whose pair stays unmerged - so the count of every
  prefix is one more than that of a shorter prefix, and no merge list is replayed.

Texts are cut into chunks of fixed length. Whatever the state before a chunk, the machine is
in its start state where white space follows a sign, so a chunk's state map is (head, tokens
between first and last such place, tail). Maps compose associatively: a task composes the chunks it reads by a prefix
scan over all of them that starts anew at each text, and the pieces of a text that several tasks read are
composed by another.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BOOL, LONG, STRING, schema, small_batches

# Unicode White_Space, which the split rule's \s means. Fixed values.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
# Suffixes that the split rule takes off after an apostrophe. Fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Characters of a chunk, and of the pieces that a longer text is dealt out in, each a row of its own.
CHUNK = 1 << 14
PIECE = 1 << 20
#: Texts of one scan.
ROWS = 256
#: Bounds of the memory that the machines keep of what they have seen; beyond it they forget and go on.
MEMO_SEGMENTS = 200_000
MEMO_PAIRS = 400_000

_SEGMENT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_SYNC = re.compile(f"(?<=[^{SPACES}])[{SPACES}]")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files use: visible Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _classes(ch: str) -> int:
    """Character class: 0 white space, 1 letter, 2 number, 3 other."""
    if ch in SPACES:
        return 0
    kind = unicodedata.category(ch)[0]
    return 1 if kind == "L" else 2 if kind == "N" else 3


class CountingTransducer:
    """Tokens of a byte-level BPE vocabulary, counted without building them."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.mark = os.path.commonprefix(self.specials)
        if any(c in SPACES for x in self.specials for c in x):
            raise ValueError("special strings with white space inside are not compiled")
        self._special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        # rank of a token: the merge that makes it; single bytes come first
        self.rank: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for merge in spec["model"]["merges"]:
            a, b = map(as_bytes, merge.split(" ") if isinstance(merge, str) else merge)
            if a + b not in vocab or a + b in self.rank:
                continue
            n = len(self.halves)
            self.rank[a + b] = n
            self.halves.append((self.rank[a], self.rank[b]))
            self.pairs[self.rank[a], self.rank[b]] = n
        self.length = [0] * len(self.halves)
        for token, n in self.rank.items():
            self.length[n] = len(token)
        self._compile()
        self.kind: dict[str, int] = {}
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, int] = {}
        self.segments: dict[str, int] = {}

    def _compile(self) -> None:
        """Trie of all tokens with failure links; ``ends[state]`` lists the tokens that are suffixes of what was read."""
        step: list[dict[int, int]] = [{}]
        own = [-1]
        for token, n in self.rank.items():
            at = 0
            for b in token:
                nxt = step[at].get(b)
                if nxt is None:
                    nxt = step[at][b] = len(step)
                    step.append({})
                    own.append(-1)
                at = nxt
            own[at] = n
        fail, ends = [0] * len(step), [()] * len(step)
        queue = list(step[0].values())
        for at in queue:
            ends[at] = (own[at],) if own[at] >= 0 else ()
        for at in queue:  # grows while it is read: breadth first
            for b, nxt in step[at].items():
                to = fail[at]
                while to and b not in step[to]:
                    to = fail[to]
                fail[nxt] = step[to].get(b, 0)
                ends[nxt] = ((own[nxt],) if own[nxt] >= 0 else ()) + ends[fail[nxt]]
                queue.append(nxt)
        self.step, self.fail, self.ends = step, fail, ends

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves ``left`` and ``right`` apart.

        Takes back the merges inside both tokens, latest first, and asks at each stage whether the tokens
        that then touch would have been merged before the merge taken back last.
        """
        halves, pairs = self.halves, self.pairs
        before = 1 << 60
        while True:
            joined = pairs.get((left, right))
            if joined is not None and joined < before:
                return False
            split_left = left >= 256 and (left > right or right < 256)
            if split_left:
                before, left = left, halves[left][1]
            elif right >= 256:
                before, right = right + 1, halves[right][0]
            else:
                return True

    def _run(self, piece: bytes) -> int:
        """Walk the merge automaton over one piece; returns the emitted tokens."""
        step, fail, ends, length, fits = self.step, self.fail, self.ends, self.length, self.fits
        last, count, at = [-1], [0], 0
        for i, b in enumerate(piece, 1):
            while at and b not in step[at]:
                at = fail[at]
            at = step[at].get(b, 0)
            for token in ends[at]:
                start = i - length[token]
                if start == 0:
                    break
                key = last[start] << 20 | token
                fit = fits.get(key)
                if fit is None:
                    if len(fits) >= MEMO_PAIRS:
                        fits.clear()
                    fit = fits[key] = self._fits(last[start], token)
                if fit:
                    break
            last.append(token)
            count.append(count[start] + 1)
        return count[-1]

    def _kinds(self, s: str) -> list[int]:
        kind = self.kind
        try:
            return [kind[c] for c in s]
        except KeyError:
            kind.update((c, _classes(c)) for c in set(s) if c not in kind)
            return [kind[c] for c in s]

    def _cuts(self, s: str) -> Iterator[str]:
        """The piece automaton: pieces of a segment (white space, then signs), which starts in the start state."""
        kinds, n, i = self._kinds(s), len(s), 0
        while i < n and kinds[i] == 0:
            i += 1
        if i == n:
            yield s
            return
        if i > 1:
            yield s[: i - 1]  # all but the last of a run before a sign
        start = i
        if i:
            start = i - 1
            if s[start] != " ":  # only a plain space joins what follows
                yield s[start]
                start = i
        while i < n:
            if s[i] == "'" and start == i and (tail := next((c for c in CONTRACTIONS if s.startswith(c, i + 1)), None)):
                end = i + 1 + len(tail)
            else:
                end = i + 1
                while end < n and kinds[end] == kinds[i]:
                    end += 1
            yield s[start:end]
            start = i = end

    def segment(self, s: str) -> int:
        """Tokens emitted on the way from start state to start state over one segment."""
        total, pieces = 0, self.pieces
        for piece in self._cuts(s):
            n = pieces.get(piece)
            if n is None:
                if len(pieces) >= MEMO_SEGMENTS:
                    pieces.clear()
                n = self._run(piece.encode("utf-8"))
                if len(piece) <= 64:
                    pieces[piece] = n
            total += n
        return total

    def between(self, s: str) -> int:
        """Tokens of text that begins and ends in the start state."""
        known, total = self.segments, 0
        for part in _SEGMENT.findall(s):
            n = known.get(part)
            if n is None:
                n = self.segment(part)
                if len(part) <= 64:
                    if len(known) >= MEMO_SEGMENTS:
                        known.clear()
                    known[part] = n
            total += n
        return total

    def state_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(head, tokens, tail): tail None if the start state is nowhere certain."""
        first = _SYNC.search(chunk)
        if first is None:
            return chunk, 0, None
        i = j = first.start()
        for back in (48, 512):  # any such place will do; the later, the shorter the tail
            for found in _SYNC.finditer(chunk, max(i, len(chunk) - back)):
                j = found.start()
            if j > i:
                break
        return chunk[:i], self.tokens(chunk[i:j]) if j > i else 0, chunk[j:]

    def compose(self, a: tuple[str, int, str | None], b: tuple[str, int, str | None]) -> tuple[str, int, str | None]:
        """State map of a then b; associative."""
        if a[2] is None:
            head, n, tail = self.state_map(a[0] + b[0])
            if tail is None or b[2] is None:
                return (head, b[1], b[2]) if tail is None else (head, n, tail)
            return head, n + self.tokens(tail) + b[1], b[2]
        joined = a[2] + b[0]
        if b[2] is None:
            return a[0], a[1], joined
        return a[0], a[1] + self.tokens(joined) + b[1], b[2]

    def scan(self, maps: list, text: list[int]) -> list:
        """Inclusive prefix scan of the maps by doubling, within each run of equal numbers in ``text``: log2 rounds of independent compositions."""
        far, longest = 1, max(Counter(text).values(), default=0)
        while far < longest:
            maps = [self.compose(maps[i - far], m) if i >= far and text[i - far] == text[i] else m for i, m in enumerate(maps)]
            far *= 2
        return maps

    def maps_of(self, texts: list[str], chunk: int = CHUNK) -> list[tuple[str, int, str | None]]:
        """State map of each text, composed from those of its chunks; an empty text has one empty chunk."""
        owner, maps = [], []
        for k, text in enumerate(texts):
            for i in range(0, max(1, len(text)), chunk):
                owner.append(k)
                maps.append(self.state_map(text[i : i + chunk]))
        done = self.scan(maps, owner)
        return [done[i] for i in range(len(done)) if i + 1 == len(done) or owner[i + 1] != owner[i]]

    def tokens(self, s: str) -> int:
        """Tokens of text that begins and ends in the start state; a special string inside it is one token, as the library has it."""
        if self._special is None or self.mark not in s or not any(x in s for x in self.specials):
            return self.between(s)
        parts = self._special.split(s)
        return len(parts) - 1 + sum(self.between(p) for p in parts if p)

    def finish(self, state: tuple[str, int, str | None]) -> int:
        """Tokens of a whole text from its state map."""
        head, n, tail = state
        return self.tokens(head) + n + (self.tokens(tail) if tail else 0)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        return self.finish(self.maps_of([text], chunk)[0])


@lru_cache(maxsize=2)
def transducer(path: str) -> CountingTransducer:
    """Compiled once in each worker process."""
    return CountingTransducer(path)


def _mapped(rows: DataFrame, tokenizer: str, *carried: str) -> DataFrame:
    """The carried columns, then head, n, tail: the state map of ``text``."""
    out = T.StructType([*(rows.schema[c] for c in carried), *schema(head=STRING, n=LONG, tail=STRING)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                maps = machine.maps_of(batch.column(len(carried)).to_pylist())
                ends = [pa.array(c, k) for c, k in zip(zip(*maps, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *ends], out.names)

    return rows.select(*carried, "text").mapInArrow(run, out)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (``n_tokens > limit``) of every whole text.

    ``tokenizer``: path of a byte-level BPE vocabulary that every executor can read. A text of over PIECE characters is
    cut into rows of that many, which are dealt out, so that no task reads a long text alone; what is
    composed at the end is their maps, 2,048 of a text at most (2 GB). Other texts need no shuffle. Rows of one batch are
    in memory at a time. Null and empty texts: 0 bytes, 0 tokens. Null
    or repeated ids and repeated rows are counted each. Empty table: empty result. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = schema(doc_id=docs.schema[id_col].dataType, n_bytes=LONG, n_tokens=LONG, over_limit=BOOL)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            n = [machine.finish(m) for m in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], out.names)

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        """The map of a text from those of its pieces."""
        rows, machine = rows.sort_values("piece"), transducer(tokenizer)
        maps = [(h, n, None if t is None else t) for h, n, t in zip(rows["head"], rows["n"], rows["tail"], strict=True)]
        head, n, tail = machine.scan(maps, [0] * len(maps))[-1]
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[:1], "n_bytes": rows["n_bytes"].iloc[:1], "head": [head], "n": [n], "tail": [tail]})

    # by bytes, as a text's characters are not counted without reading it
    short = _mapped(picked.where(F.col("n_bytes") <= PIECE), tokenizer, "doc_id", "n_bytes")
    long = picked.where(F.col("n_bytes") > PIECE).withColumn("row", F.monotonically_increasing_id())
    places = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int"))
    pieces = long.select("doc_id", "n_bytes", "row", F.posexplode(F.transform(places, lambda i: F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE)))).alias("piece", "text"))
    kind = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *schema(n_bytes=LONG, head=STRING, n=LONG, tail=STRING)])
    whole = _mapped(pieces.repartition("row", "piece"), tokenizer, "doc_id", "n_bytes", "row", "piece").groupBy("row").applyInPandas(joined, kind)
    return short.unionByName(whole).mapInArrow(finished, out)
