"""Corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns documents for the next one, the last one packed pieces.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermolake.llm import mixing, near_dedup, packing, quality_rules, surrogates
from thermolake.llm.common import DOCUMENT_COLUMNS, stored, table

SIMILARITY_PERCENT = 80
MAX_REPETITION = 1.25


def tokenizer_path() -> str:
    """Vocabulary file; ``CORPUS_TOKENIZER`` names another one."""
    if "CORPUS_TOKENIZER" in os.environ:
        return os.environ["CORPUS_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is listed; documents without an id stay."""
    wanted = ids.select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["__id"]), "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Rows that share an id go only together."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return _only(docs, judged.filter("kept").select("doc_id"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    found = near_dedup.near_duplicates(docs, threshold_percent=SIMILARITY_PERCENT)
    return _only(docs, found.filter("kept").select("doc_id"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; n_chars follows the text."""
    rewritten = surrogates.pseudonymise(docs.select(*DOCUMENT_COLUMNS))
    return rewritten.select(
        "record.doc_id", "text", "record.lang", "record.source",
        F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(
            F.col("record.n_chars")).alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mixture uses a document. Every document is used at least once."""
    mixed = mixing.mix(docs, max_repetition=MAX_REPETITION, carry=DOCUMENT_COLUMNS)
    return mixed.select("record.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", privacy_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# hashing, model thresholds and tokens can't be written in SQL; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
