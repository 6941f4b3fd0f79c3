"""Corpus cleaning: toxic documents go, later copies of line runs are cut, one document of each near-duplicate group stays,
documents with benchmark passages go, and what is left is encoded.

Each stage works on all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, jaccard, lines, pieces, toxicity
from tessera.llm.common import piece_model, shared_dir, stored, table

#: Trained models and iterations cannot be written in SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from all labels of docs, does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of line runs of 50 words or more."""
    return lines.dedup(docs, shared_dir(spark) + "/lines")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a Jaccard similarity of 0.8 or more on five-word shingles."""
    return jaccard.keep_one(docs, shared_dir(spark) + "/jaccard", n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.flagged(docs, table(spark, sf_dir, "benchmark")).filter("leaks = 0").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document with their digests."""
    return pieces.encode(docs, piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, path = table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{path}/{name}")
    return docs
