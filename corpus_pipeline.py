"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder) and returns a DataFrame, which is written as Parquet and read
back as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm.common import staged, table
from llm.contamination import clean_documents
from llm.near_copies import keep_one_row
from llm.packing import pack_texts
from llm.personal_data import redact
from llm.quality import keep_good

def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject."""
    return keep_good(docs, table(spark, folder, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group alike in shingles of five words at a similarity of 0.8 or more."""
    return keep_one_row(docs, words=5, threshold=80)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a twentieth of their words in windows of the benchmark."""
    return clean_documents(docs, table(spark, folder, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    return redact(docs, count="n_chars")


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return pack_texts(docs)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

# The classifier, the tokenizer and the near-copy components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
