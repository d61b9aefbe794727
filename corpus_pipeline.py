"""The corpus pipeline: each stage works on all that the one before it kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladingcheck.llm import decontaminate, language_id, line_dedup, mixing, ngram_jaccard
from ladingcheck.llm.shared import quoted, stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learnt languages go: no letters, or a code of more than MOST_BITS a byte in all of them."""
    return language_id.in_a_known_language(docs)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that later occurrences of repeated three-line windows cover go; documents that lose all their lines go with them."""
    clean = line_dedup.line_dedup(docs)
    return clean.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))).select(*quoted(docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: of each group of documents linked by five-word sets of similarity 0.8, the smallest id stays."""
    return ngram_jaccard.one_of_each(docs, width=5, part=80, whole=100)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The reading plan of what is left: as many tokens as there are, no source read more than four times."""
    return mixing.mix(docs, budget_share=1.0, max_repeats=4.0)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", lines_once),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", no_benchmark),
    ("temperature_mixing", mixed),
]

#: Code lengths of trees and an embedding are beyond SQL; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
