"""The corpus pipeline: language ID, line dedup, near copies, secrets, packing.

Each stage gets what the one before kept, re-read from Parquet, and all but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from arbordex.llm.op2_language import reject_unknown
from arbordex.llm.op4_packing import packed_documents
from arbordex.llm.op5_jaccard import first_of_each
from arbordex.llm.op7_secrets import redact
from arbordex.llm.op10_lines import drop_common
from arbordex.llm.tables import deleted, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go; a missing label becomes the prediction."""
    return reject_unknown(docs, "doc_id", "text", "lang")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; documents stay."""
    return drop_common(docs, "text", "n_chars")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or near-equal documents the one with the smallest id stays."""
    return first_of_each(docs, "doc_id", "text")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; documents stay."""
    return redact(docs, "doc_id", "text", length="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of fixed length."""
    return packed_documents(docs, "doc_id", "text")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("secrets", secrets), ("packing", packing)]

#: Naive Bayes, Markov models and packing have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents. A stage's table goes when the next one is written; packing keeps its pieces in
    the checkpoint folder, so nothing of the last table is needed afterwards."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            deleted(spark, f"{folder}/{before}")
        before = name
    packed = STAGES[-1][1](spark, docs, sf_dir)
    deleted(spark, folder)
    return packed
