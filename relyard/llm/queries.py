"""Corpus queries op1 to op13: each applies its operator to a whole table. The pipeline is registered beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relyard.llm import decontaminate, language_id, lexical_search, packing, piece_bpe, prefix_trie, quality_rules, rule_ensemble, simhash, substring_dedup, token_counts, token_store, tokens, url_filter
from relyard.llm.common import read_table
from relyard.plans.catalog import Query
from relyard.session import new_location


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_location(spark, "token-store")
    token_store.write_tokens(read_table(spark, sf_dir, "documents"), tokens.vocabulary_path(tokens.WORD_FILE), path)
    return token_store.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Digests are taken before the places are joined, so the ids themselves are not shuffled."""
    cut = packing.stored_pieces(docs, tokens.vocabulary_path(tokens.WORD_FILE))
    digests = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.with_places(digests).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(read_table(spark, sf_dir, "documents"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept", "posterior")


def op6_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(read_table(spark, sf_dir, "documents"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokens.vocabulary_path(tokens.BYTE_FILE))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.prefix_trie(prefix_trie.spliced(read_table(spark, sf_dir, "conversations")))
    return nodes.select(prefix_trie.NODE_COLUMNS)


def op13_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(piece_bpe.decode(piece_bpe.encode(read_table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_rule_ensemble": Query(op1_rule_ensemble, None),
    "op2_token_store": Query(op2_token_store, None),
    "op3_genetic_packing": Query(op3_genetic_packing, None),
    "op4_simhash_components": Query(op4_simhash_components, None),
    "op5_quality_votes": Query(op5_quality_votes, None),
    "op6_repeated_spans": Query(op6_repeated_spans, substring_dedup.oracle()),
    "op7_benchmark_leaks": Query(op7_benchmark_leaks, decontaminate.oracle()),
    "op8_url_verdicts": Query(op8_url_verdicts, url_filter.oracle()),
    "op9_language": Query(op9_language, None),
    "op10_token_counts": Query(op10_token_counts, None),
    "op11_ranked_search": Query(op11_ranked_search, lexical_search.oracle()),
    "op12_prefix_trie": Query(op12_prefix_trie, prefix_trie.oracle()),
    "op13_piece_ids": Query(op13_piece_ids, None),
}
