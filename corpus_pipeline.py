"""A training corpus from raw documents: quality rules, language ID, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; every stage but the last
returns the columns of documents. Stages are handed written tables, so each reads its input from storage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnframe.llm import language, mixing, packing, quality, simhash, storage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their group's cutoffs reject go."""
    return quality.judge(docs, COLUMNS).where("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike any language learned, go."""
    found = language.identify(docs, language.fit(docs), COLUMNS)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("rejected")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return simhash.deduplicated(docs.select(COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as the mix takes them."""
    return mixing.mixed(docs.select(COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("simhash near-dedup", near_dedup),
    ("source mixing", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: SQL has neither the tokenizer nor the language model.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents, each written to shared storage and read again."""
    docs = storage.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = storage.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-") + uuid.uuid4().hex[:6])
    return STAGES[-1][1](spark, docs, sf_dir)
