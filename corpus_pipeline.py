"""Corpus pipeline: documents to packed training sequences, each stage one operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  A stage works on all rows its predecessor kept.

In every stage null and empty texts count as texts without words and are clean; long texts are
read whole; each of several equal rows is judged by its text; columns beside doc_id, text and
n_chars stay as they are, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tailspark.llm import decontamination, packing, pii, simhash, toxicity
from tailspark.llm.common import store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score of 0.5 or more) go; without usable labels none does."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of smallest doc_id; rows without doc_id stay.

    All texts without words are one class.
    """
    return simhash.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go; from others every passage of a window or more is cut.

    A document without such a passage stays as it is; n_chars follows a text that is cut.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_span=decontamination.WINDOW - 1)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; null text stays null, n_chars follows the text."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; a text without tokens is one piece of the end id."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Nearest-neighbour votes, trees and packing plans are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
