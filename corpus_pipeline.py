"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with the columns of ``documents``; the last one returns the pieces of packed
sequences. Models are learned from the documents that reach the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import jaccard, language, packing, quality
from driftline.llm.queries import LEAST_LANGUAGE, LEAST_QUALITY, table, tokenizer_path
from driftline.session import stage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in one of the languages of the table; others and empty ones go."""
    return language.keep_identified(docs, language.learn(docs), LEAST_LANGUAGE)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that text and metadata together call good."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")), LEAST_QUALITY)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return jaccard.keep_first(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of all documents in sequences of fixed length."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_copies", drop_near_copies),
    ("packing", pack_sequences),
]

# The learned models and the packing order have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
