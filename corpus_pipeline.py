"""From documents to a training mix: language, near-duplicates, contamination, source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvspark.llm import decontaminate, language, mixing, simhash
from kvspark.llm.common import Scratch, table


def recognised_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones."""
    return language.recognised(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return simhash.dedupe(docs)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("language", recognised_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", not_contaminated),
    ("mixing", source_mix),
]

#: A recurrent network and hashed fingerprints have no SQL; the tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
