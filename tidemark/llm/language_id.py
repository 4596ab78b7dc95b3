"""Language identification by fusing text, declared markup language, address suffix and host."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import LONG, STRING, cut, schema, small_batches

#: Hashed three-byte features of a text.
FEATURES = 8192
#: A text counts as at most this many independent features: neighbouring ones overlap and repeat.
TEXT_WEIGHT = 60.0
#: Documents' worth of all languages that each language's features lean on: one that a single document declares is a candidate too.
MODEL_LEAN = 0.1
#: Pseudo-counts by which a suffix leans on all documents and a host on its suffix.
SUFFIX_LEAN, HOST_LEAN, DECLARED_LEAN = 50.0, 20.0, 1.0
UNKNOWN = "und"
#: Parts that the rows of one host are dealt to.
SALTS = 32

_NO_LETTER = bytes(0x20 if i < 0x41 or 0x5B <= i < 0x61 or 0x7B <= i < 0x80 else i + 0x20 if 0x41 <= i < 0x5B else i for i in range(256))


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Adds ``declared`` (lang of the html element), ``host``, ``suffix`` (last label) and ``page_text`` (what is left without markup) to pages."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    bare = F.col(html_col)
    # comments, scripts and styles with what they hold, then tags, then character references
    for markup in (r"(?s)<!--.*?(?:-->|\z)", r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)", r"</?[A-Za-z!][^>]*>", r"&#?[A-Za-z0-9]+;"):
        bare = F.regexp_replace(bare, markup, " ")
    return pages.withColumns(
        {
            "page_text": bare,
            "declared": F.regexp_extract(F.coalesce(F.col(html_col), F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1),
            "host": host,
            "suffix": F.element_at(F.split(host, r"\."), -1),
        }
    )


def document_evidence(docs: DataFrame, text_col: str = "text", declared_col: str | None = "lang") -> DataFrame:
    """Adds ``markup_lang`` and ``suffix`` to documents, both from the text itself.

    The suffix is the last label of the first web or mail address in the text, empty without one. The declared
    language is that of an html element in the text, else the column's.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.regexp_extract(text, r"(?:://|@)((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})", 1)
    markup = F.regexp_extract(text, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    given = F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")
    # most texts hold neither sign: looking for a short string is far cheaper than matching
    addressed = text.contains("@") | text.contains("://")
    return docs.withColumns(
        {
            "suffix": F.when(addressed, F.lower(F.element_at(F.split(host, r"\."), -1))).otherwise(""),
            "markup_lang": F.when(text.contains("<") & (markup != ""), markup).otherwise(given),
        }
    )


def evidence_key(*columns: Column) -> Column:
    """Digest of all that a verdict depends on (id, text, declared language, host, suffix), nulls apart from empty values."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.length(c.cast("string")), F.lit("="), c.cast("string")), F.lit("-"))
    return F.md5(F.concat(*[part(c) for c in columns]).cast("binary"))


def language_code(c: Column) -> Column:
    """Primary subtag of a declared language in lower case; null if it has not two or three letters."""
    code = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1))
    return F.when(code != "", code)


def histograms(texts: list[str | None]) -> np.ndarray:
    """Counts of hashed three-byte windows of each text, letters in lower case, all else as blanks."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for k, text in enumerate(texts):
        if not text:
            continue
        raw = re.sub(rb" +", b" ", b" " + text.encode("utf-8").translate(_NO_LETTER) + b" ")
        if len(raw) < 3:
            continue
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761) >> np.uint32(19)
        out[k] = np.bincount(h, minlength=FEATURES)
    return out


def _count_features(docs: DataFrame) -> DataFrame:
    """Feature counts per declared language over all documents: (code, f, n), n the sum of shares.

    Each document adds at most one unit in all, so that long texts and copies of one don't rule a language.
    A task adds up what it reads and yields one row per language and feature.
    """
    out = schema(code=STRING, f=T.IntegerType(), n=T.DoubleType(), docs=LONG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        number: dict[str, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                codes = batch.column(0).to_pylist()
                shares = histograms(batch.column(1).to_pylist())
                shares /= np.maximum(shares.sum(1, keepdims=True), 1)
                for code in set(codes):
                    rows = [i for i, c in enumerate(codes) if c == code]
                    sums[code] = sums.get(code, 0.0) + shares[rows].sum(0, dtype=np.float64)
                    number[code] = number.get(code, 0) + len(rows)
        for code, total in sums.items():
            f = np.flatnonzero(total)
            n = len(f) + 1  # feature -1 carries the number of documents
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([code] * n, pa.string()),
                    pa.array(np.append(f, -1), pa.int32()),
                    pa.array(np.append(total[f], 0.0), pa.float64()),
                    pa.array([0] * (n - 1) + [number[code]], pa.int64()),
                ],
                ["code", "f", "n", "docs"],
            )

    # sums in thousandths of a millionth as whole numbers: the same result in any order
    parts = docs.where(F.col("_declared").isNotNull()).select("_declared", "text").mapInArrow(run, out)
    return parts.groupBy("code", "f").agg(F.sum(F.round(F.col("n") * 1e9).cast("decimal(28,0)")).alias("n"), F.sum("docs").alias("docs"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Candidate languages and log P(feature | language), features x languages.

    What comes to the driver has at most FEATURES rows a language code, and codes have two or three letters.
    """
    counts = cut(_count_features(docs))
    codes = [r["code"] for r in counts.where("f = -1").select("code").collect()]
    codes.sort()
    table = np.full((FEATURES, len(codes)), 0.0)
    at = {c: i for i, c in enumerate(codes)}
    rows = counts.where("f >= 0").select("code", "f", (F.col("n").cast("double") / 1e9).alias("n")).toPandas()
    table[rows["f"].to_numpy(), rows["code"].map(at).to_numpy(dtype=int)] = rows["n"].to_numpy()
    whole = table.sum(1, keepdims=True)
    table += MODEL_LEAN * whole / np.maximum(whole.sum(), 1e-9)
    total = np.maximum(table.sum(0, keepdims=True), 1e-9)
    smooth = 1e-3
    return codes, np.log((table / total + smooth / FEATURES) / (1 + smooth)).astype(np.float32)


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = "lang",
    host_col: str | None = "source",
    suffix_col: str | None = None,
    min_confidence: float = 0.5,
) -> DataFrame:
    """Posterior language of every document and whether it is kept.

    log P(l | all) = weighted log P(text | l) + log P(declared | l) + log P(l | host), where host priors are
    counts of what the texts alone say, grouped by host, leaning on those of the address suffix and these
    on those of all documents, and P(declared | l) comes from counts of the same kind.

    Returns one row per input row: doc_id, language, confidence, text_language, declared, rejected, and
    ``_key``, the ``evidence_key`` of the row: rows that share it have one verdict. Rejected: no letter in the text, or confidence below ``min_confidence``, or no candidate language
    (no document declares any). Null text: no letter, language ``und``. Null or odd
    declared language: no evidence either way. Null host or suffix: a group of their own. Repeated rows
    are judged each. Empty table: empty result. Extra columns are ignored.
    """
    small_batches(docs.sparkSession)
    none = F.lit(None).cast("string")
    given = [F.col(c) if c else none for c in (id_col, text_col, declared_col, host_col, suffix_col)]
    picked = docs.select(
        evidence_key(*given).alias("_key"),
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        (language_code(F.col(declared_col).cast("string")) if declared_col else none).alias("_declared"),
        F.coalesce(F.col(host_col).cast("string") if host_col else none, F.lit("")).alias("_host"),
        F.coalesce(F.col(suffix_col).cast("string") if suffix_col else none, F.lit("")).alias("_suffix"),
    )
    codes, logp = fit(picked)
    out = schema(
        doc_id=docs.schema[id_col].dataType, _declared=STRING, _host=STRING, _suffix=STRING, _key=STRING, _best=T.IntegerType(), _ll=T.ArrayType(T.DoubleType(), False)
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                counts = histograms(batch.column(5).to_pylist())
                n = counts.sum(1)
                ll = (counts @ logp).astype(np.float64) * (np.minimum(n, TEXT_WEIGHT) / np.maximum(n, 1))[:, None]
                best = np.where(n > 0, ll.argmax(1), -1) if len(codes) else np.full(len(n), -1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:5], pa.array(best, pa.int32()), pa.array(list(np.round(ll, 6)), pa.list_(pa.field("element", pa.float64(), False)))], out.names
                )

    scored = cut(picked.select("doc_id", "_declared", "_host", "_suffix", "_key", "text").mapInArrow(score, out))
    size = len(codes)
    known = scored.where(F.col("_best") >= 0)

    def counted(*keys: str) -> DataFrame:
        """Sums of what the texts say, one row per group: ``_n`` an array over the languages."""
        return by.groupBy(*keys).agg(*[F.sum(F.when(F.col("_best") == i, F.col("n")).otherwise(0)).cast("double").alias(f"c{i}") for i in range(size)])

    by = cut(known.groupBy("_suffix", "_host", "_best").agg(F.count("*").alias("n")))
    if size:
        whole = counted().first()  # one row
        sums = np.array([float(whole[f"c{i}"] or 0) for i in range(size)])
        base = (sums + 1) / (sums.sum() + size)
        # log P(declared | language) as one row a declared code, languages x languages in all
        heard = known.where(F.col("_declared").isin(codes)).groupBy("_best", "_declared").agg(F.count("*").alias("n"))
        heard = heard.withColumn("p", F.col("n") + DECLARED_LEAN / size)
        total_of = known.where(F.col("_declared").isin(codes)).groupBy("_best").agg((F.count("*") + DECLARED_LEAN).cast("double").alias("all"))
        heard = heard.join(total_of, "_best").select("_declared", "_best", F.log(F.col("p") / F.col("all")).alias("p"))
        unheard = total_of.select(F.map_from_entries(F.collect_list(F.struct("_best", F.log(DECLARED_LEAN / size / F.col("all")).alias("p")))).alias("silent"))
        told = heard.groupBy("_declared").agg(F.map_from_entries(F.collect_list(F.struct("_best", "p"))).alias("heard")).join(F.broadcast(unheard))  # one row
        each = F.sequence(F.lit(0), F.lit(size - 1))
        # a language that no text is of has no counts: evenly told
        told = told.select("_declared", F.transform(each, lambda i: F.coalesce(F.element_at("heard", i), F.element_at("silent", i), F.lit(float(-np.log(size))))).alias("_told"))
        total = lambda p: sum((F.col(f"{p}{i}") for i in range(1, size)), F.col(f"{p}0"))
        suffix = counted("_suffix")
        suffix = suffix.select("_suffix", *[((F.col(f"c{i}") + SUFFIX_LEAN * float(base[i])) / (total("c") + SUFFIX_LEAN)).alias(f"s{i}") for i in range(size)])
        priors = (
            counted("_suffix", "_host")
            .join(suffix, "_suffix")
            .select(
                "_suffix", "_host", F.array(*[F.log((F.col(f"c{i}") + HOST_LEAN * F.col(f"s{i}")) / (total("c") + HOST_LEAN)) for i in range(size)]).alias("_prior")
            )
        )
        # a host may hold a third of all rows: its one row of priors is dealt out SALTS times
        salted = priors.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        fused = scored.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).join(salted, ["_suffix", "_host", "_salt"], "left")
        # as many rows as declared languages, codes of two or three letters: at most languages x languages numbers
        fused = fused.join(F.broadcast(told), "_declared", "left")
        default = F.array(*[F.lit(float(np.log(b))) for b in base])
        add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
        flat = F.array(*[F.lit(0.0)] * size)
        post = add(add(F.col("_ll"), F.coalesce("_prior", default)), F.coalesce("_told", flat))
        fused = fused.withColumn("_post", post).withColumn("_top", F.array_max("_post"))
        confidence = F.round(1 / F.aggregate("_post", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top"))), 6)
        names = F.array(*[F.lit(c) for c in codes])
        language = F.get(names, F.array_position("_post", F.col("_top")).cast("int") - 1)
    else:
        fused, confidence, language, names = scored, F.lit(0.0), F.lit(UNKNOWN), F.array(F.lit(UNKNOWN))
    lettered = F.col("_best") >= 0
    return fused.select(
        "doc_id",
        F.when(lettered, language).otherwise(UNKNOWN).alias("language"),
        F.when(lettered, confidence).otherwise(0.0).alias("confidence"),
        F.when(lettered, F.get(names, F.col("_best"))).otherwise(UNKNOWN).alias("text_language"),
        F.col("_declared").alias("declared"),
        (~lettered | (F.when(lettered, confidence).otherwise(0.0) < min_confidence)).alias("rejected"),
        "_key",
    )
