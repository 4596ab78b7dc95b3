"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeats, extra columns, no rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, signature long"


def sentence(rnd, n, base=400):
    return " ".join(f"w{rnd.randrange(base):03d}" for _ in range(n))


def corpus():
    rnd = random.Random(11)
    texts = [None, "", " \n\t ", "One.", "two words", "same text", "same text", "x" * 5000, "é   日本語 \x1c 😀", "a|b # $ % & < > *"]
    base = sentence(rnd, 120)
    for k in range(12):  # near copies, some within and some beyond the limit
        words = base.split()
        for _ in range(k // 2):
            words[rnd.randrange(len(words))] = "edit%d" % rnd.randrange(10**6)
        texts.append(" ".join(words))
    passage = sentence(rnd, 70)
    texts += [sentence(rnd, rnd.randrange(3, 90)) + "\n" + passage + "\n" + sentence(rnd, rnd.randrange(3, 90)) for _ in range(6)]
    texts += [sentence(rnd, rnd.randrange(1, 200)) for _ in range(40)]
    texts.append(sentence(rnd, 30_000))
    texts.append("loop it again " * 400)
    rows = [(i, t, ["en", "fr", None][i % 3], None if i % 7 == 0 else f"s{i % 2}", None if t is None else len(t), "clash", 1) for i, t in enumerate(texts)]
    return [*rows, (5, "same text", "en", "s1", 9, "clash", 1), rows[12], (None, base, None, None, 1, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality_rules(docs, rows, none):
    from tidemark.llm.quality_rules import quality_rules

    def brute(text):
        words = WORD.findall(text or "")
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + d for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        chars = sum(map(len, words))
        return len(words), chars, len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)

    got = quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert multiset(got) == Counter((r[0], *brute(r[1])) for r in rows)
    kept = quality_rules(docs)
    assert kept.where("kept and base_failed").count() == 0 and kept.where("kept is null").count() == 0
    assert quality_rules(none).count() == 0


def test_quality_rules_adapt(spark):
    from tidemark.llm._common import cut
    from tidemark.llm.quality_rules import bucket, bucket_floor, measure, quality_rules, thresholds

    rnd = random.Random(2)
    # s0 writes plain prose, s1 one with a few signs in each text: what is odd in one is usual in the other
    signs = lambda n: " ".join(w + ("#" if i < n else "") for i, w in enumerate(sentence(rnd, 100, 10**6).split()))
    clean = [(i, signs(rnd.randrange(8, 14) if i % 2 else 0), "en", f"s{i % 2}", 0, "", 0) for i in range(2000)]
    junk = [(5000 + i, signs(12 if i % 2 == 0 else 100), "en", f"s{i % 2}", 0, "", 0) for i in range(200)]
    table = spark.createDataFrame(clean + junk, SCHEMA)
    got = {r["doc_id"]: r["kept"] for r in quality_rules(table).collect()}
    assert all(got[r[0]] for r in clean) and not any(got[r[0]] for r in junk)
    fence = {r["_source"]: r["symbol_pm_max"] for r in thresholds(cut(measure(table))).collect()}
    assert fence["s0"] < fence["s1"] / 2
    # nothing stands apart: nothing goes
    even = [(i, signs(i % 40), "en", "s", 0, "", 0) for i in range(400)]
    assert quality_rules(spark.createDataFrame(even, SCHEMA)).where("kept").count() == 400
    numbers = spark.range(5000)
    for r in numbers.select("id", bucket_floor(bucket(F.col("id"))).alias("low"), bucket_floor(bucket(F.col("id")) + 1).alias("high")).collect():
        assert r["low"] <= r["id"] < r["high"] and r["high"] - r["low"] <= max(1, r["id"] / 16)


def test_sharding(docs, rows, none):
    from tidemark.llm.sharding import shard_by_bytes

    got = shard_by_bytes(docs, 7).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    sizes = Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(7))
    assert max(abs(v - sum(sizes.values()) / 7) for v in sizes.values()) < max(r["size"] for r in got)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert shard_by_bytes(none, 7).count() == 0


def test_token_counts(spark, docs, rows, none, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.token_counts import token_counts, transducer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = token_counts(docs, path)
    assert multiset(got) == Counter((r[0], len((r[1] or "").encode()), n := count(r[1] or ""), n > 1024) for r in rows)
    machine, rnd = transducer(path), random.Random(1)
    alphabet = [*"ab 's'tllre\n\t.,!?12é日 \x1c<|>", "the", "ing", " of", "\r\n", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60)))
        # any cutting into chunks gives the same count
        assert machine.count(text, chunk=5) == machine.count(text) == count(text), text
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 90))) for _ in range(40)]
    assert [machine.finish(m) for m in machine.maps_of(texts, 7)] == [count(t) for t in texts]
    assert token_counts(none, path).count() == 0
    # texts longer than a piece: rows of their own, composed at the end; special strings may be cut by the pieces
    from tidemark.llm import token_counts as t

    monkeypatch.setattr(t, "PIECE", 37)
    assert multiset(token_counts(docs.where("length(text) < 20000"), path)) == Counter((r[0], len(r[1].encode()), n := count(r[1]), n > 1024) for r in rows if r[1] is not None and len(r[1]) < 20000)
    odd = spark.createDataFrame([(i, x, "en", "s", 1, "", 1) for i, x in enumerate(texts + ["a<|endoftext|>b " * 30, "x" * 500 + " y"])], SCHEMA)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(odd, path).collect()} == {i: count(x) for i, x in enumerate(texts + ["a<|endoftext|>b " * 30, "x" * 500 + " y"])}


def test_packing(docs, rows, none):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.packing import hilbert_key, pack

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = pack(docs, path, length=256).collect()
    want = Counter()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[r[0], len(ids)] += 1
        own = np.array(ids, "<u4")
        for p in pieces[r[0], len(ids)]:
            assert p["start"] + p["length"] <= len(ids)
        # with equal ids and lengths any of the copies may be meant; their pieces agree in content
        if want[r[0], len(ids)] == 1 and len([x for x in rows if x[0] == r[0]]) == 1:
            at = 0
            for p in sorted(pieces[r[0], len(ids)], key=lambda p: p["start"]):
                assert p["start"] == at and zlib.crc32(own[at : at + p["length"]].tobytes()) == p["ids_crc32"]
                at += p["length"]
            assert at == len(ids)
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(filled) == list(range(len(filled)))
    for k, parts in filled.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 256 or k == max(filled)
    assert pack(none, path).count() == 0
    grid = np.stack(np.meshgrid(*[range(8)] * 3), -1).reshape(-1, 3)
    order = grid[np.argsort(hilbert_key(grid, 3))]
    assert sorted(hilbert_key(grid, 3)) == list(range(512)) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def linked_classes(sets, ids, link):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if link(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i in range(len(sets)):
        members[find(i)].append(i)
    return {i: min((ids[j] for j in own if ids[j] is not None), default=None) for own in members.values() for i in own}


@pytest.mark.parametrize("frequent, remembered", [(32, 1 << 18), (6, 1)])
def test_jaccard_join(spark, docs, rows, none, frequent, remembered, monkeypatch):
    from tidemark.llm import jaccard_join as j

    monkeypatch.setattr(j, "REMEMBERED", remembered)
    monkeypatch.setattr(j, "FREQUENT", frequent)

    def shingles(text):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())

    sets, ids = [shingles(r[1]) for r in rows], [r[0] for r in rows]
    root = linked_classes(sets, ids, lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b))
    got = j.similarity_classes(docs)
    assert multiset(got.select("doc_id", "n_shingles", "component_id")) == Counter((ids[i], len(sets[i]), root[i] if sets[i] else ids[i]) for i in range(len(rows)))
    assert j.similarity_classes(none).count() == 0


def test_components(spark):
    """A path of 1,000 in random order, a star, a ring and pairs; no links."""
    from tidemark.llm._common import components

    rnd = random.Random(9)
    path = rnd.sample(range(1000), 1000)
    edges = [*zip(path, path[1:]), *((2000, 2000 + i) for i in range(1, 60)), *((3000 + i, 3000 + (i + 1) % 50) for i in range(50)), (5001, 5000), (7, 7)]
    want = {**{i: 0 for i in range(1000)}, **{2000 + i: 2000 for i in range(60)}, **{3000 + i: 3000 for i in range(50)}, 5000: 5000, 5001: 5000}
    table = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")
    assert {r["node"]: r["root"] for r in components(table, rounds=15).collect()} == want
    assert components(table.limit(0)).count() == 0


def test_jaccard_join_chains(spark):
    """Versions of one page, each linked to the next alone, and a hub whose copies differ from each other."""
    from tidemark.llm.jaccard_join import similarity_classes

    rnd = random.Random(31)
    words, texts = [f"p{i}" for i in range(120)], []
    for k in range(40):
        texts.append(" ".join(words))
        for at in (3 * k % 120, (3 * k + 60) % 120):
            words[at] = f"v{k}x{at}"
    hub = [f"h{i}" for i in range(150)]
    texts += [" ".join(hub)] + [" ".join(f"c{k}y{i}" if i in (a, a + 1) else w for i, w in enumerate(hub)) for k in range(60) for a in [rnd.randrange(148)]]
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    ids = list(range(len(texts)))
    root = linked_classes(sets, ids, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    table = spark.createDataFrame([(i, t, "en", "s", 1, "", 1) for i, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in similarity_classes(table).collect()} == root
    assert len({root[i] for i in range(40)}) < 40 and len({root[i] for i in range(40, len(texts))}) < 10


@pytest.mark.parametrize("carried", [16, 2])
def test_jaccard_join_yields_a_pair_once(spark, carried, monkeypatch):
    """Copies of one page that differ about as much as links allow share many lists; a pair came once for each of them."""
    from tidemark.llm import jaccard_join as j4

    monkeypatch.setattr(j4, "CARRIED", carried)
    rnd = random.Random(17)
    page = [f"q{i}" for i in range(150)]
    texts = []
    for k in range(60):
        words = page.copy()
        for at in rnd.sample(range(150), 3):
            words[at] = f"e{k}x{at}"
        texts.append(" ".join(words))
    met, plain = [], j4._met
    monkeypatch.setattr(j4, "_met", lambda mixed: met.append([tuple(sorted(r)) for r in plain(mixed).select("sid", "b_sid").collect()]) or plain(mixed))
    table = spark.createDataFrame([(i, t, "en", "s", 1, "", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in j4.similarity_classes(table).collect()}
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(146)) for t in texts]
    assert got == linked_classes(sets, list(range(60)), lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    assert met[0]
    if carried == 16:
        assert len(met[0]) == len(set(met[0]))


def test_line_dedup(spark, docs, rows, none):
    from tidemark.llm.line_dedup import dedup_lines, jaccard

    rnd = random.Random(5)
    lines = [sentence(rnd, 12) for _ in range(20)]
    edited = [x[:30] + "#" + x[31:] for x in lines[:10]]
    texts = ["\n".join(lines[:5] + ["short", ""]), "\n".join(lines[3:12] + ["short", edited[0]]), "\n".join(edited), None, "", "\n".join([lines[15], lines[15] + " ", "tail"])]
    table = spark.createDataFrame([(i, t, "en", "s", 1, "clash", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in dedup_lines(table).collect()}
    first = []
    for i, t in enumerate(texts):
        if t is None:
            assert got[i]["text"] is None and got[i]["n_lines"] == 0
            continue
        kept = []
        for line in t.split("\n"):
            bare = line.strip()
            if len(bare) >= 20:
                if any(jaccard(bare, x) >= 0.8 for x in first):
                    continue
                first.append(bare)
            kept.append(line)
        assert got[i]["text"] == "\n".join(kept) and got[i]["n_removed"] == len(t.split("\n")) - len(kept)
    clash = table.selectExpr("*", *[f"doc_id + 7 AS {c}" for c in ("_gone", "_fuzzy", "_key", "gone", "fuzzy", "gone_key", "lines", "line_id", "row", "row_key", "at", "n_lines")])
    again = dedup_lines(clash)
    assert again.columns == [*[c for c in clash.columns if c != "n_lines"], "n_lines", "n_removed", "n_fuzzy"]
    for r in again.collect():
        assert r["text"] == got[r["doc_id"]]["text"] and r["_key"] == r["gone"] == r["_fuzzy"] == r["lines"] == r["doc_id"] + 7 and r["n_lines"] == got[r["doc_id"]]["n_lines"]
    assert set(dedup_lines(docs).columns) == {*docs.columns, "n_lines", "n_removed", "n_fuzzy"}
    assert dedup_lines(docs).count() == len(rows) and dedup_lines(none).count() == 0
    recall = [(a, b) for a in range(60) for b in [a + 100]]
    far = {}
    many = []
    for a, b in recall:
        line = sentence(rnd, 20)
        other = line[:40] + "@" + line[41:70] + "@" + line[71:]
        far[a] = jaccard(line, other)
        many += [(a, line, "en", "s", 1, "", 1), (b, other, "en", "s", 1, "", 1)]
    out = {r["doc_id"]: r["n_removed"] for r in dedup_lines(spark.createDataFrame(many, SCHEMA)).collect()}
    true = [a for a, _ in recall if far[a] >= 0.8]
    assert len(true) > 40 and sum(out[a + 100] for a in true) >= 0.9 * len(true)


def test_line_dedup_weak_links(spark):
    """Every pair of similar lines that shares a bucket of any size counts, also one whose lines have nearer partners."""
    from tidemark.llm.line_dedup import SIMILARITY, bands, dedup_lines, jaccard, signatures

    rnd = random.Random(21)
    lines = []
    edited = lambda x, at, n: x[:at] + "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n)) + x[at + n :]
    for _ in range(300):  # copies of A ~ A ~ A1 - B1 ~ B ~ copies of B: the link in the middle is the weakest
        inner = sentence(rnd, 24)
        weak = edited(inner, 50, 8)
        first, last = edited(inner, 10, 6), edited(weak, 90, 6)
        lines += [first, edited(first, 30, 1), edited(first, 100, 1), inner, weak, last, edited(last, 20, 1), edited(last, 115, 1)]
    buckets = [set(b) for b in bands(signatures(lines)).tolist()]
    root = linked_classes(list(range(len(lines))), list(range(len(lines))), lambda i, j: bool(buckets[i] & buckets[j]) and jaccard(lines[i], lines[j]) >= SIMILARITY)
    table = spark.createDataFrame([(i, x, "en", "s", 1, "", 1) for i, x in enumerate(lines)], SCHEMA)
    assert {r["doc_id"]: r["n_removed"] for r in dedup_lines(table).collect()} == {i: int(root[i] != i) for i in range(len(lines))}


def test_line_similarity_of_batches():
    """Answers for many pairs at once are those of the sets, also for very large alphabets."""
    from tidemark.llm.line_dedup import SIMILARITY, jaccard, similar

    rnd = random.Random(8)
    for letters in ("ab ", "abc é日😀", [chr(0x4E00 + i) for i in range(9000)]):
        own = ["".join(rnd.choice(letters) for _ in range(n)) for n in (0, 1, 4, 5, 6, *[rnd.randrange(20, 200) for _ in range(60)])]
        if len(letters) == 9000:
            own.append("".join(letters))
        other = [x[:at] + "#" * n + x[at + n :] for x in own for at, n in [(rnd.randrange(len(x) + 1), rnd.randrange(6))]]
        a, b = [*own, *own, ""], [*other, *reversed(own), ""]
        assert similar(a, b) == [jaccard(x, y) >= SIMILARITY for x, y in zip(a, b, strict=True)]
    assert similar([], []) == []


@pytest.mark.parametrize("group", [4096, 1])
def test_run_index_dedup(docs, rows, none, group, monkeypatch):
    from tidemark.llm import run_index_dedup as r3

    monkeypatch.setattr(r3, "MAX_GROUP", group)
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    starts = Counter(b[i : i + 200] for _, b in raw for i in range(len(b) - 199))
    want = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for a in range(len(b) - 199):
            if starts[b[a : a + 200]] > 1:
                gone[a : a + 200] = b"\1" * 200
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for a in range(len(b)) if gone[a] and (a == 0 or not gone[a - 1]))
        want[i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()] += 1
    assert multiset(r3.remove_repeats(docs).drop("kept")) == want
    assert r3.remove_repeats(none).count() == 0


def test_match_lengths():
    from tidemark.llm.run_index_dedup import match_lengths

    rnd = random.Random(5)
    for _ in range(12):
        base = bytes(rnd.choice(b"ab") for _ in range(60))
        parts = [base[rnd.randint(0, 20) : rnd.randint(30, 60)] for _ in range(3)]
        for p, longest in zip(parts, match_lengths(parts), strict=True):
            i = parts.index(p)
            for a in range(len(p)):
                best = 0
                for j, q in enumerate(parts):
                    for b in range(len(q)):
                        if (i, a) != (j, b):
                            n = 0
                            while a + n < len(p) and b + n < len(q) and p[a + n] == q[b + n]:
                                n += 1
                            best = max(best, n)
                assert best == longest[a]


def test_decontamination(spark, docs, rows, none):
    from tidemark.llm.decontaminate import common_length, find_leaks, words

    rnd = random.Random(8)
    items = [(100 + i, sentence(rnd, rnd.randrange(12, 60), 5000) + ". Answer " + sentence(rnd, 4, 5000) + ".") for i in range(30)]
    clean = [sentence(rnd, 300, 5000) for _ in range(40)]
    leaks = {}
    texts = list(clean)
    for k, (ident, text) in enumerate(items):
        own = words(text)
        if k % 3 == 1:  # a paraphrase: some words replaced and some put in
            own = [w if rnd.random() > 0.12 else "other" for w in own]
        body = sentence(rnd, rnd.randrange(0, 90), 5000) + " " + (" ".join(own).upper() if k % 3 == 2 else " ".join(own)) + " " + sentence(rnd, 90, 5000)
        leaks[len(texts)] = ident
        texts.append(body)
    table = spark.createDataFrame([(i, t, "en", "s", 1, "", 1) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([*items, (7, None), (8, ""), (None, items[0][1])], "item_id long, text string")
    got = {r["doc_id"]: r for r in find_leaks(table, bench).collect()}
    assert not any(got[i]["contaminated"] for i in range(len(clean)))
    assert sum(leaks[i] in got[i]["item_ids"] for i in leaks) >= 0.95 * len(leaks)
    assert all(got[i]["item_ids"] in ([], [leaks[i]]) for i in leaks)
    assert find_leaks(docs, bench).count() == len(rows)
    assert find_leaks(none, bench).count() == 0 and find_leaks(table, bench.limit(0)).where("contaminated").count() == 0
    for _ in range(200):
        a, b = [[rnd.choice("abcd") for _ in range(rnd.randrange(1, 12))] for _ in range(2)]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert common_length(a, b) == best[-1][-1]


def test_decontamination_recall(spark):
    """Against all documents x items, each item compared with every stretch of words as long as two blocks and twice the item."""
    from tidemark.llm import decontaminate as d

    rnd = random.Random(18)
    bench = [(n, sentence(rnd, rnd.randrange(10, 70), 3000) + ". So it is " + sentence(rnd, 3, 3000) + ".") for n in range(60)]
    items = [d.Item(n, n, t) for n, t in bench]
    texts = []
    for k in range(90):
        own = list(items[k % 60].words)
        for i in range(len(own)):  # from verbatim to beyond recognition
            if rnd.random() < (k // 15) * 0.07:
                own[i] = "w%03d" % rnd.randrange(3000)
        texts.append(sentence(rnd, rnd.randrange(5, 150), 3000) + " " + " ".join(own) + " " + sentence(rnd, 60, 3000))
    texts += [None, "", "  ", items[0].words[0]] + [sentence(rnd, 400, 3000) for _ in range(20)]
    brute = set()
    for n, t in enumerate(texts):
        own = d.words(t or "")
        for item in items:
            wide = 2 * (d.BLOCK + len(item.words))
            if any(item.found_in(own[at : at + wide]) for at in range(0, max(1, len(own) - len(item.words) // 2), 4)):
                brute.add((n, item.number))
    table = spark.createDataFrame([(n, t, "en", "s", 1, "", 1) for n, t in enumerate(texts)], SCHEMA)
    found = {(r["doc_id"], i) for r in d.find_leaks(table, spark.createDataFrame(bench, "item_id long, text string")).collect() for i in r["item_ids"]}
    assert len(brute) > 60 and len(found & brute) >= 0.9 * len(brute) and len(found - brute) <= 0.02 * len(brute)


def test_decontamination_words(spark):
    """Hashed words are those of ``words``, whatever the script; several rounds find what one finds."""
    from tidemark.llm import decontaminate as d

    rnd = random.Random(4)
    signs = [*"abcXYZ019_ .,-\n\t'", "é", "ß", "İ", "Σ", "日", "😀", "𝔘", "“", "\u00a0", "١"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(0, 80))) for _ in range(200)] + ["", "x" * 3000]
    hashes, first = d.hashed_words(texts)
    named = {}
    for k, t in enumerate(texts):
        own = hashes[first[k] : first[k + 1]].tolist()
        assert len(own) == len(d.words(t)), t
        for h, w in zip(own, d.words(t), strict=True):
            assert named.setdefault(h, w) == w
    assert len(set(named.values())) == len(named) and len(d.hashed_words([""])[0]) == 0
    old = d.CHARS
    try:
        d.CHARS = 7
        assert (d.hashed_words(texts)[0] == hashes).all()
    finally:
        d.CHARS = old


def test_decontamination_rounds(spark, monkeypatch):
    from tidemark.llm import decontaminate as d

    rnd = random.Random(6)
    bench = spark.createDataFrame([(n, sentence(rnd, 40, 10**5)) for n in range(25)], "item_id long, text string")
    rows = [(r["item_id"], sentence(rnd, 30, 10**5) + " " + r["text"] + " " + sentence(rnd, 50, 10**5), "en", "s", 1, "", 1) for r in bench.collect()]
    table = spark.createDataFrame(rows + [(100 + i, sentence(rnd, 200, 10**5), "en", "s", 1, "", 1) for i in range(10)], SCHEMA)
    want = {n: [n] if n < 25 else [] for n in [*range(25), *range(100, 110)]}
    for rank, items, fan in ((8, 1000, 2), (256, 7, 32)):
        monkeypatch.setattr(d, "RANK", rank)
        monkeypatch.setattr(d, "ITEMS", items)
        monkeypatch.setattr(d, "FAN_IN", fan)
        assert {r["doc_id"]: r["item_ids"] for r in d.find_leaks(table, bench).collect()} == want


def test_decontamination_long_items(spark):
    from tidemark.llm import decontaminate as d

    rnd = random.Random(3)
    long = [d.Item(n, n, sentence(rnd, rnd.choice([20, 300, 900, 9000]), 10**6)) for n in range(60)]
    rounds = d.rounds_of(long)
    assert all(sum(len(i.pieces) for i in r) <= d.RANK for r in rounds)
    dealt = defaultdict(list)
    for i in (i for r in rounds for i in r):
        dealt[i.number] += i.pieces
    assert dealt == {i.number: i.pieces for i in long}
    items = [(n, sentence(rnd, 600, 10**6)) for n in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [sentence(rnd, 40 + n, 10**6) + " " + t + " " + sentence(rnd, 90, 10**6) for n, t in items] + [sentence(rnd, 600, 10**6) for _ in range(10)]
    table = spark.createDataFrame([(n, t, "en", "s", 1, "", 1) for n, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"]: r["item_ids"] for r in d.find_leaks(table, bench).collect()} == {n: [n] if n < 30 else [] for n in range(40)}


def test_language_id(spark, docs, rows, none):
    from tidemark.llm.language_id import identify, page_evidence

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = identify(table).join(table.select("doc_id", "lang"), "doc_id")
    assert got.where("language = lang and not rejected").count() >= 0.97 * table.count()
    # without text evidence the declared language and the host decide
    short = table.select("doc_id", F.when(F.col("doc_id") % 50 == 0, "1 2 a").otherwise(F.col("text")).alias("text"), "lang", "source")
    told = identify(short).where("doc_id % 50 = 0").join(table.select("doc_id", "lang"), "doc_id")
    assert told.where("language = lang").count() >= 0.7 * told.count()
    out = identify(docs)
    assert out.count() == len(rows) and out.where("text_language is null or rejected is null").count() == 0
    assert identify(none).count() == 0
    pages = page_evidence(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    found = identify(pages, "page_id", "html", "declared", "host", "suffix")
    assert found.count() == pages.count() and pages.where("host = '' or suffix = ''").count() == 0
    assert found.where("language = declared").count() >= 0.9 * found.count()


def test_language_id_brute_force(spark):
    """The posterior recomputed with dictionaries and loops, declared language, host and suffix included."""
    import math

    import numpy as np

    from tidemark.llm import language_id as li

    rnd = random.Random(16)
    word = {c: ["".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 7))) for _ in range(30)] for c, letters in (("en", "etaoinshr"), ("fr", "eaisnrtou"), ("de", "enisratdh"))}
    rows = []
    for i in range(150):
        c = rnd.choice("en en fr de".split())
        said = rnd.choice([c, c, c, "fr", None, "x!", "EN-us"])
        mail = rnd.choice(["", "", f" a@b.example.{c}", " see http://x.y.com/"])
        rows.append((i, " ".join(rnd.choice(word[c]) for _ in range(rnd.choice([0, 1, 2, 3, 40]))) + mail, said, rnd.choice(["h1", "h2", None])))
    rows += [(900, None, "en", "h1"), rows[3], (901, '<html lang="de"> q', "en", "h1")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    told = li.document_evidence(table)
    got = li.identify(told, "doc_id", "text", "markup_lang", "source", "suffix").collect()
    seen = [(r["text"], r["markup_lang"], r["source"] or "", r["suffix"]) for r in told.collect()]
    assert {s for *_, s in seen} == {"", "en", "fr", "de", "com"} and seen[-1][1] == "de"
    code = lambda x: m.group(1).lower() if (m := re.match(r"\s*([A-Za-z]{2,3})(?![A-Za-z])", x or "")) else None
    counts = [li.histograms([t])[0].astype(float) for t, *_ in seen]
    codes = sorted({code(m) for _, m, _, _ in seen} - {None})
    share = {c: sum((h / max(h.sum(), 1) for h, (_, m, _, _) in zip(counts, seen) if code(m) == c), np.zeros(li.FEATURES)) for c in codes}
    whole = sum(share.values())
    logp = {c: np.log(((v + li.MODEL_LEAN * whole / whole.sum()) / (v + li.MODEL_LEAN * whole / whole.sum()).sum() + 1e-3 / li.FEATURES) / (1 + 1e-3)) for c, v in share.items()}
    ll = [[float(h @ logp[c]) * min(h.sum(), li.TEXT_WEIGHT) / max(h.sum(), 1) for c in codes] for h in counts]
    best = [max(range(len(codes)), key=lambda j: x[j]) if h.sum() else None for x, h in zip(ll, counts)]
    number = lambda test: [sum(b == j and test(s) for b, s in zip(best, seen)) for j in range(len(codes))]
    n = number(lambda s: True)
    base = [(x + 1) / (sum(n) + len(codes)) for x in n]
    want = Counter()
    for (text, said, host, suffix), x, b in zip(seen, ll, best):
        of_suffix, of_host = number(lambda s: s[3] == suffix), number(lambda s: s[3] == suffix and s[2] == host)
        lean = [(c + li.SUFFIX_LEAN * p) / (sum(of_suffix) + li.SUFFIX_LEAN) for c, p in zip(of_suffix, base)]
        prior = [math.log((c + li.HOST_LEAN * p) / (sum(of_host) + li.HOST_LEAN)) for c, p in zip(of_host, lean)]
        if b is None:
            want[("und", 0.0, True)] += 1
            continue
        post = []
        for j in range(len(codes)):
            p = x[j] + prior[j]
            if code(said):
                heard = sum(q == j and code(s[1]) == code(said) for q, s in zip(best, seen))
                total = sum(q == j and code(s[1]) is not None for q, s in zip(best, seen))
                p += math.log((heard + li.DECLARED_LEAN / len(codes)) / (total + li.DECLARED_LEAN))
            post.append(p)
        sure = 1 / sum(math.exp(p - max(post)) for p in post)
        want[(codes[post.index(max(post))], round(sure, 3), sure < 0.5)] += 1
    assert Counter((r["language"], round(r["confidence"], 3), r["rejected"]) for r in got) == want


@pytest.mark.parametrize("few", [1, 4])
def test_language_id_small_language(spark, few):
    from tidemark.llm.language_id import identify

    rnd = random.Random(6)
    word = {c: ["".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 8))) for _ in range(60)] for c, letters in (("en", "etaoinshr"), ("fr", "eaisnrtou"), ("mt", "jqxzkhgwb"))}
    codes = ["en"] * 200 + ["fr"] * 100 + ["mt"] * few
    rows = [(i, " ".join(rnd.choice(word[c]) for _ in range(60)), c, f"s{i % 3}", 1, "", 1) for i, c in enumerate(codes)]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i]["language"] for i in range(len(rows))] == codes and not any(r["rejected"] for r in got.values())


def test_page_language_id(spark, tmp_path):
    from tidemark.llm.queries import QUERIES

    rnd = random.Random(4)
    word = {"fr": ["bonjour", "maison", "toujours", "quelque"], "de": ["strasse", "zwischen", "haus", "immer"]}
    pages = []
    for i in range(400):
        code = ["fr", "de"][i % 2]
        body = " ".join(rnd.choice(word[code]) for _ in range(30))
        noise = "<!-- " + " ".join(word["de" if code == "fr" else "fr"] * 20) + " --><script>var x = '</p>';" + "between " * 50 + "</script>"
        pages.append((i, f"http://h{i}.example.{code}/x", f'<html lang="{code}"><body>{noise}<p>{body}</p></body></html>'))
    # one letter, no declared language, a host of its own: only the suffix tells; then only the markup tells
    pages += [(1000 + i, f"http://new{i}.example.{code}/", "<html><p>1 2 q</p></html>") for i, code in enumerate(["fr", "de"])]
    pages += [(2000 + i, f"http://other{i}.example.com/", f'<html lang="{code}"><p>1 2 q</p></html>') for i, code in enumerate(["fr", "de"])]
    pages.append((3000, None, None))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in QUERIES["op10_page_language_id"](spark, str(tmp_path)).collect()}
    assert len(got) == len(pages) and got[3000]["language"] == "und" and got[3000]["rejected"]
    assert all(got[i]["language"] == got[i]["text_language"] == ["fr", "de"][i % 2] for i in range(400))
    for at in (1000, 2000):
        assert [got[at + i]["language"] for i in range(2)] == ["fr", "de"], at


def test_quality_classifier_brute_force(spark):
    """Word vectors and pooled texts recomputed word by word, scores by a network fitted anew on them."""
    import numpy as np

    from tidemark.llm import quality_classifier as q

    rnd = random.Random(8)
    texts = [None, "", "A!! 12", "One one\nline line\nline line"] + [("### " if i % 3 == 0 else "") + sentence(rnd, rnd.randrange(1, 40), 30) + "\n" + sentence(rnd, 3, 4) for i in range(120)]
    ids = list(range(len(texts)))
    place, sign = q.index_vectors()
    tokens = []
    for t in texts:
        own, lines = [], set()
        for line in (t or "").split("\n"):
            for w in line.split():
                core = "".join(c for c in w if c.isalpha()).lower()
                own += ([q._row(core)] if core else []) + [q._row("\0" + q._form(w))]
            if line.split():
                own.append(q._row("\0line again" if line in lines else "\0line"))
                lines.add(line)
        tokens.append(own)
        assert q.TokenRows()(t or "").tolist() == own
    table = np.zeros((q.ROWS, q.DIM))
    for own in tokens:
        for i, a in enumerate(own):
            for j in range(max(0, i - q.SPAN), min(len(own), i + q.SPAN + 1)):
                if i != j:
                    for k in range(q.NONZERO):
                        table[a, place[own[j], k]] += sign[own[j], k]
    table = np.sign(table) * np.log1p(np.abs(table))
    table = (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    assert np.allclose(q.word_vectors(docs), table, atol=1e-6)
    x = np.array([np.round(np.concatenate([v.mean(0), v.std(0), [np.log1p(len(v))]]), 5) if len(v := table[own]) else np.zeros(q.POOLED) for own in tokens])
    y = {i: int(i % 3 != 1) for i in ids}
    labels = spark.createDataFrame([(i, v) for i, v in y.items()] + [(3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in q.quality_scores(docs, labels).collect()}
    hashed = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    learn = sorted((i for i in ids if zlib.crc32(str(i).encode()) % 5), key=lambda i: hashed[i])
    fitted = q.Network(x[learn], np.array([y[i] for i in learn], float))
    assert np.abs(fitted.score(x) - np.array([got[i] for i in ids])).max() < 0.02


def test_quality_classifier(spark, docs, rows, none):
    from tidemark.llm.quality_classifier import quality_scores

    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_scores(table, labels)
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 40 and sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in held) >= 0.93 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.collect())
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert multiset(quality_scores(table, flipped)) == multiset(got)
    few = quality_scores(docs, labels.limit(0))
    assert few.count() == len(rows) and {r["score"] for r in few.collect()} == {0.5}
    assert quality_scores(none, labels).count() == 0
