"""Corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again before the next one, so a stage works on all
that the one before it kept, and a lost executor never repeats more than one stage. All stages but the last return the columns of ``documents``:

1. ``quality_rules`` keeps documents that the vote model keeps.
2. ``near_duplicates`` keeps one document of each group of near copies.
3. ``repeated_passages`` removes later occurrences of lines, sentences and runs of clauses, and documents that lose all their words.
4. ``benchmark_leaks`` drops documents that hold a passage of the benchmark table.
5. ``best_fit_packing`` returns one row per packed piece.

Awkward input is defined by the operators: null and empty texts fail the quality rules, an empty table stays empty to the end,
extra columns pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relyard.llm import decontaminate, quality_rules, simhash, substring_dedup
from relyard.llm.common import read_table, stored
from relyard.llm.queries import packed_pieces


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_spans(docs, runs=True)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_pieces(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("best_fit_packing", best_fit_packing),
]

#: The vote model is iterative and packing is a search: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
