"""From raw documents to token ids: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from issue_signals.llm.common import shared_table, table
from issue_signals.llm.exact_dedup import without_copies
from issue_signals.llm.mixing import mixed_documents
from issue_signals.llm.quality import accepted, grades_of, trained
from issue_signals.llm.queries import VOCABULARY, token_digests
from issue_signals.llm.simhash import BITS, one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on those of them that have labels, finds of the best grade."""
    return accepted(docs, trained(docs, grades_of(table(spark, sf_dir, "labels"))))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that op1 links: shingles of three words, at most three differing bits."""
    return one_of_each(docs, bits=BITS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is two rows."""
    return mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(docs, VOCABULARY)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

#: The classifier, the fingerprints and the tokens are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = shared_table(docs, f"pipeline-{name}")
    return docs
