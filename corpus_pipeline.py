"""The corpus pipeline: toxicity, exact and near duplicates, secrets, packing.

Each stage takes the documents that its predecessor kept, as written, and applies one operator
of ``quire.llm`` to all of them; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import materialize, read_table
from quire.llm.exact_dedup import drop_exact_duplicates
from quire.llm.near_dedup import FIVE_WORDS, drop_near_duplicates
from quire.llm.packing import pack_documents
from quire.llm.queries import END_ID, WORD_TOKENIZER, secret_model, tokenizer_path
from quire.llm.secrets import redact_secrets
from quire.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the ordinal model grades toxic."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts keep the one with the most characters, then the smallest doc_id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at similarity 0.8 keep the smallest doc_id."""
    return drop_near_duplicates(docs, FIVE_WORDS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; all documents stay."""
    return redact_secrets(docs, secret_model(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' token ids into sequences of 2048; a row for each piece."""
    return pack_documents(docs, tokenizer_path(WORD_TOKENIZER), window=2048, end_id=END_ID)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("packing", packing),
]

#: The stages of toxicity and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
