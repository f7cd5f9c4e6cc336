"""The corpus pipeline: language, near copies, benchmark passages, secrets, mixture.

Each stage reads what its predecessor wrote and returns the columns of documents, except the last,
which returns the mixture's row per document. STAGES can be run one by one (each result written and
read again by the caller), or all by run().

Odd input, in every stage: rows with null or empty text go at the first stage, as they have no letter, and
pass the others; null ids and null sources are values like others; equal rows are near copies of
each other, so one stays; ties go by the operators' rules; texts of any length are read whole; further
columns pass through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import decontaminate, language, mixing, near_dup, secret_scan
from veilframe.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the known languages, go."""
    return language.in_known_language(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are masked in the text; every document stays."""
    return secret_scan.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
]

#: The stages are learned, iterative or procedural; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
