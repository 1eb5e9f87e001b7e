"""A training corpus from `documents`: language, lines, near-duplicates, benchmark passages, mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import stored, table
from tessella.llm.decontaminate import keep_clean
from tessella.llm.language import keep_identified
from tessella.llm.lines import dedup_lines
from tessella.llm.mixing import mix
from tessella.llm.simhash import keep_one


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the others go, null, empty and letterless texts among them. Else as keep_identified()."""
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that equal or resemble an earlier line go; all documents stay. Nulls, ties and the rest as in dedup_lines()."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; texts that have lost all lines are one group. Else as keep_one()."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go. Nulls, long texts and the rest as in keep_clean()."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The showings of the documents in the mix, with their places; documents without a word go. Else as mix()."""
    return mix(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
]

#: The language model and the fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on what the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
