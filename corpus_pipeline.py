"""A training corpus from documents: quality rules, line dedup, near-dedup, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, so a
stage works on what its predecessor kept.  No stage of pieces is expressible in SQL, so there is no SQL for the whole;
tests hold each stage against a brute-force version on a small fixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshlark.llm import line_dedup, mixing, near_dedup, pieces, quality_rules
from meshlark.llm._common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur, or nearly occur, earlier."""
    return line_dedup.filter_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    return near_dedup.filter_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics."""
    return mixing.filter_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document."""
    return pieces.encode(docs, pieces.Vocabulary.load())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("mixing", mixture), ("sentencepiece", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage keeps is written, as later stages read it more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
