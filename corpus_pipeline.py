"""The corpus pipeline: documents through quality, duplicates, decontamination and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from delaymill.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from delaymill.llm.support import table
from delaymill.session import spool

ORACLE_SQL = None  # trees and a lasso decide the first stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that they share with many others."""
    return line_dedup.without_repeated_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return ngram_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark test."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents sampled towards the target weights, with topic, n_tokens, probability and copies.

    The sample has a document as often as ``copies`` says; that keeps the target weights where a cell has too few tokens.

    Columns of ``docs`` with one of these names are replaced.
    """
    added = {"_topic": "topic", "_tokens": "n_tokens", "_probability": "probability", "_copies": "copies"}
    mixed = mixing.mix(docs.drop(*[c for c in docs.columns if c.lower() in (*added, *added.values(), "_source", "_lang", "_share")]))
    return mixed.drop("_source", "_lang", "_share").withColumnsRenamed(added)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
