"""Training-data pipeline: documents pass through STAGES in order; each stage works on all that the one before kept.

run() writes each stage's result to the shared folder and reads it again, so that a lost executor costs one stage at most.
Every stage but the last returns the columns that it was given.

Defined results: rows without doc_id are scored like others, keep their lines, and stay in both later filters, as no id names
them; null and empty texts are scored from their statistics alone and pass all other stages, with no piece ids; of repeated rows one
stays; an empty table stays empty in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm import decontamination, line_dedup, near_dedup, pieces, quality_classifier
from llm.queries import tokenizer_file
from llm.tables import bounded, read, stored


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the classifier's threshold go. It learns from rows outside the held-out fold."""
    bounded(spark)
    labels, metadata = read(spark, sf_dir, "labels"), ("n_chars",)
    machine = quality_classifier.fit(docs, labels, metadata=metadata, where=quality_classifier.fold() != 0)
    return quality_classifier.keep(docs, machine, metadata=metadata)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier line leave the texts; every document stays."""
    bounded(spark)
    return line_dedup.without_lines(docs, line_dedup.removed_lines(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    bounded(spark)
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bounded(spark)
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' piece ids join the columns."""
    bounded(spark)
    return pieces.with_piece_ids(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify_quality),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("sentencepiece", encode_pieces),
]

#: SQL cannot express a learned classifier or piece encoding; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
