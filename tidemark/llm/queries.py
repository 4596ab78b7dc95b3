"""Queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .oracle import QUALITY_RULES, SHARDING

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_key")


def op3_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .run_index_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similarity_classes

    return similarity_classes(table(spark, sf_dir, "documents")).drop("row_key", "is_first")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    cleaned = dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "n_fuzzy", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), 40)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared language from markup in the text or the column lang, suffix of an address in the text, host from source."""
    from .language_id import document_evidence, identify

    docs = document_evidence(table(spark, sf_dir, "documents"))
    return identify(docs, "doc_id", "text", "markup_lang", "source", "suffix").drop("_key")


def op10_page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 where there are markup and addresses: documents have neither, so their suffix says nothing."""
    from .language_id import identify, page_evidence

    pages = page_evidence(table(spark, sf_dir, "pages"))
    return identify(pages, "page_id", "page_text", "declared", "host", "suffix").drop("_key").withColumnRenamed("doc_id", "page_id")


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_run_index_dedup": op3_run_index_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op10_page_language_id": op10_page_language_id,
}

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": QUALITY_RULES, "op7_sharding": SHARDING}
