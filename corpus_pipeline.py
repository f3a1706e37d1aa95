"""The corpus pipeline: quality, toxicity, near-duplicates, repeated strings, packing.

Every stage works on what the one before it kept, and all but the last return the columns of
``documents``. Labels are those of the folder's ``labels`` table, held-out rows excepted.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscus.llm import packing, quality, simhash, suffixes, toxicity
from fiscus.llm.common import stored, table
from fiscus.llm.questions import VOCABULARY


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def harmless_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts."""
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash.keep_one(docs)


def unrepeated_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that a document with a smaller id has; ``n_chars`` follows the text."""
    cleaned = suffixes.clean_passages(docs)
    if "n_chars" not in cleaned.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality", good_documents),
    ("toxicity", harmless_documents),
    ("near_duplicates", different_documents),
    ("repeated_strings", unrepeated_texts),
    ("packing", packed_sequences),
]

#: The classifiers, fingerprints and the program behind the packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
