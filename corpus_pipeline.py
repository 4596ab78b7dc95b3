"""Corpus pipeline: each stage reads what the one before it kept, written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import stage, table
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.jaccard_join import similarity_classes
from tidemark.llm.language_id import document_evidence, evidence_key, identify
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.packing import pack
from tidemark.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _only(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``: a stage's working columns cannot clash with any others."""
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language and sets ``lang`` to the one found.

    A verdict goes by id, text, declared language, source and address; rows that agree in all of them share it, rows of
    equal id and text that declare different languages are judged apart. Null or empty texts have no
    language and go. Empty table: empty result. Extra columns are dropped.
    """
    told = document_evidence(_only(docs))
    used = ["doc_id", "text", "markup_lang", "source", "suffix"]
    verdict = identify(told, *used).where("not rejected").select("_key", F.col("language").alias("_language")).dropDuplicates(["_key"])
    keyed = told.withColumn("_key", evidence_key(*[F.col(c) for c in used]))
    return keyed.join(verdict, "_key").select("doc_id", "text", F.col("_language").alias("lang"), "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that an earlier document or place has; documents of which nothing is left go.

    A document that had no line cut stays as it is, null or empty ones too; ``n_chars`` is the length of the text left.
    Rows equal in id and text come out alike. Empty table: empty result. Extra columns are dropped.
    """
    cleaned = dedup_lines(_only(docs))
    left = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = cleaned.where((F.col("n_removed") == 0) | left)
    return kept.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")).cast("long").alias("n_chars"))


def _digest(*columns: Column) -> Column:
    return F.md5(F.concat_ws("\x00", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]).cast("binary"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: the one with the smallest id, a null id last.

    Of rows equal in id and text the first in the order of (lang, source, n_chars), nulls first, stays. Documents without
    words are classes of their own. Empty table: empty result. Extra columns are dropped.
    """
    kept = similarity_classes(_only(docs)).where("is_first").select("row_key").distinct()
    joined = _only(docs).withColumn("row_key", _digest(F.col("doc_id"), F.col("text"))).join(kept, "row_key", "left_semi")
    # rows of one key agree in id and text (null and empty text alike), and are combined before they are shuffled
    first = joined.groupBy("row_key").agg(F.max("doc_id").alias("doc_id"), F.max("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("x"))
    return first.select("doc_id", "text", "x.lang", "x.source", "x.n_chars")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null or empty texts hold none and stay; repeated rows are judged alike. Empty table: empty result. Extra columns are dropped.
    """
    leaked = find_leaks(_only(docs), table(spark, sf_dir, "benchmark")).where("contaminated").select("_key").dropDuplicates()
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(F.col("doc_id").cast("string"), text, F.length(text))
    return _only(docs).withColumn("_key", key).join(leaked, "_key", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens along the curve, one row a piece; each row of the input is packed once, without text as its end id."""
    return pack(_only(docs), tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Tokenisers, iterated components and matrix factors are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
