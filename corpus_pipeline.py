"""Corpus pipeline: quality rules, near-dedup, decontamination, secret redaction, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet below spark.checkpoint.dir and gives what it reads back to the next. All stages but
the last return the columns of documents, whatever else these are; names that an operator uses inside can't clash with them. Near-dedup takes shingles of five words,
quality rules fit their thresholds to the documents that they are given, and redaction keeps every document.

Edge cases, as each stage defines them: an empty table passes through every stage as an empty table. Null doc_id, lang, source or n_chars are values like others. Texts may have any
length and are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm.bpe import encoded
from riverbed.llm.common import scratch, table, written
from riverbed.llm.decontaminate import drop_contaminated
from riverbed.llm.near_dedup import drop_near_duplicates
from riverbed.llm.quality_rules import quality_filter
from riverbed.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null and empty texts, which have no words and fail the base rule. Repeated rows are judged alike, each for itself. Null lang or source is a group of its own."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the least doc_id (null last), of equal ids the least text hash. Of rows equal in doc_id and text one stays. Texts without words stay, as do rows that share a doc_id alone."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item, and with them all rows of their doc_id. Null and empty texts contain nothing; an empty benchmark drops nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row and replaces the secrets in its text; n_chars follows the new text, other columns are untouched. Null texts stay null."""
    return redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every row; a null or empty text has no ids."""
    return encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secret_scan", secrets), ("byte_bpe", tokenise)]

#: Tokenisation can't be expressed in SQL; tests hold run() against a version in DuckDB SQL, plain Python and the tokenizer's own library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, place = table(spark, sf_dir, "documents"), scratch(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{place}/{name}")
    return docs.withColumn("n_ids", F.size("ids").cast("long")).drop("ids")
