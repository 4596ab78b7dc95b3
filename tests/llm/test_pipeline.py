"""The registered queries run, and each stage of the pipeline against brute force."""

import random
import re
from collections import Counter

import pytest
from test_operators import SCHEMA, linked_classes, sentence

import __spark_entry__ as entry
import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns named like working ones.
CLASH = ["language", "_language", "_key", "row_key", "key", "suffix", "markup_lang", "gone", "row", "lines", "component_id", "is_first", "curve", "n_removed"]


def rows_of(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    out = [(1, None, "en", "s1", None), (2, "", "en", None, 0), (3, "  \n ", None, "s1", 4), (None, sentence(rnd, 40), None, None, 200), (4, "x" * 9000, "en", "s1", 9000)]
    shared = [sentence(rnd, 12) for _ in range(8)]
    body = sentence(rnd, 150)
    for i in range(10, 40):
        lines = [sentence(rnd, 14) for _ in range(5)] + rnd.sample(shared, 2) + ["short"]
        out.append((i, "\n".join(lines), "en", f"s{i % 3}", 1))
    out += [(50 + i, " ".join(w if k != 20 * i else f"e{i}" for k, w in enumerate(body.split())), "en", "s1", 1) for i in range(6)]
    out += [out[7], out[7], (10, out[5][1], "fr", "s9", 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'user' AS {c}" for c in CLASH]).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_all_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_no_rows(spark, none):
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_language_stage(spark, docs, rows):
    """The stage's rows are those that the operator keeps, one by one, each with its own verdict."""
    from tidemark.llm.language_id import document_evidence, identify

    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    told = identify(document_evidence(plain), "doc_id", "text", "markup_lang", "source", "suffix").collect()
    want = Counter((r["doc_id"], r["declared"], r["language"]) for r in told if not r["rejected"])
    got = pipeline.language_id(spark, docs, SF)
    assert got.columns == COLUMNS
    kept = Counter((r["doc_id"], r["lang"]) for r in got.collect())
    assert kept == Counter((i, lang) for i, _, lang in want.elements())
    assert {i for i, _ in kept}.isdisjoint({1, 2, 3})
    # equal id and text, other declared language: judged apart
    rnd = random.Random(3)
    two = {"en": "the of and that with for this from", "fr": "le de et que avec pour ce dans"}
    table = [(i, " ".join(rnd.choice(two[c].split()) for _ in range(40)), c, c, 1) for i in range(100) for c in ("en", "fr")] + [(7, "1 2 q", "en", "x", 1), (7, "1 2 q", "fr", "x", 1)]
    out = pipeline.language_id(spark, spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert sorted(r["lang"] for r in out.where("text = '1 2 q'").collect()) == ["en", "fr"]


def test_line_stage(spark, docs, rows):
    from tidemark.llm.line_dedup import jaccard

    first, want, memo = [], Counter(), {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for r in order:
        if r[1] is None:
            want[r] += 1
            continue
        if (r[0], r[1]) not in memo:  # rows equal in id and text come out alike
            kept = []
            for line in r[1].split("\n"):
                bare = line.strip(" \t\n\x0b\x0c\r")
                if len(bare) >= 20:
                    if any(jaccard(bare, x) >= 0.8 for x in first):
                        continue
                    first.append(bare)
                kept.append(line)
            memo[r[0], r[1]] = "\n".join(kept)
        text = memo[r[0], r[1]]
        if text == r[1]:
            want[r] += 1
        elif WORD.search(text):
            want[(r[0], text, r[2], r[3], len(text))] += 1
    got = pipeline.line_dedup(spark, docs, SF)
    assert got.columns == COLUMNS and rows_of(got) == want


def test_jaccard_stage(spark, docs, rows):
    def shingles(text):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())

    sets = [shingles(r[1]) for r in rows]
    ids = [10**9 if r[0] is None else r[0] for r in rows]
    root = linked_classes(sets, ids, lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b))
    want = {(r[0], r[1] or "") for i, r in enumerate(rows) if not sets[i] or root[i] == ids[i]}
    got = pipeline.jaccard_join(spark, docs, SF)
    assert got.columns == COLUMNS
    assert Counter((r["doc_id"], r["text"] or "") for r in got.collect()) == Counter(want)
    assert rows_of(got) <= Counter({r: 1 for r in rows})


def test_decontamination_stage(spark, rows, docs, tmp_path):
    item = rows[10][1].split("\n")[0] + " " + rows[10][1].split("\n")[1]
    spark.createDataFrame([(1, item), (2, None), (3, "words that no text has at all here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.decontamination(spark, docs, str(tmp_path))
    assert got.columns == COLUMNS and rows_of(got) == Counter(r for r in rows if item.replace(" ", "\n") not in (r[1] or "") and rows[10][1] != r[1])


def test_packing_stage(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = Counter((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    got = pipeline.packing(spark, docs, SF).collect()
    assert sum(r["length"] for r in got) == sum(n * k for (_, n), k in size.items())
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == size


def test_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == COLUMNS, name
        docs = docs.cache()
        assert docs.count() <= seen
        seen = docs.count()
    assert pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == seen


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") and n in entry.oracle_sql()])
def test_against_sql(spark, name):
    from oracle import differences, duck

    assert differences(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name]) is None
