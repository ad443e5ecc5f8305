"""From raw documents to packed training sequences: five stages, each one of the operators in geolark.llm.

Every stage gets the documents its predecessor kept, as a table that has been written and read again, and returns the columns of
documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geolark.llm.common import DOCUMENT_COLUMNS, folders_made, materialize, release
from geolark.llm.langid import drop_unidentified
from geolark.llm.linededup import drop_repeated_lines
from geolark.llm.mixing import mix_documents
from geolark.llm.packing import packed_sequences
from geolark.llm.simhash import keep_one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found, with that language as `lang`; texts that are null or have no letter go. Each row is judged on its own."""
    return drop_unidentified(docs.select(*DOCUMENT_COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that an earlier place has."""
    return drop_repeated_lines(docs.select(*DOCUMENT_COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal fingerprints."""
    return keep_one_of_each(docs.select(*DOCUMENT_COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row stands as often as it is taken. Null texts and texts without words are taken no time; equal rows as often as all of them are; an empty table stays empty."""
    return mix_documents(docs.select(*DOCUMENT_COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences. A null text is an empty one, repeated rows are packed each, an empty table gives no pieces."""
    return packed_sequences(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Tokenizing, suffix automata and winnowing are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage wrote for itself is deleted once its result stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = folders_made()
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, before, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
