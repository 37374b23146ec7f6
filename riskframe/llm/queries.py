"""Queries of this subpackage, each over its whole table, and their reference SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import common as c
from riskframe.llm import cutting, hosts, lines, lm, minhash, mixing, negatives, packing, quality, runs, seekable, toxicity, vectors


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(c.table(spark, sf_dir, "documents"))


def op2_itq_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(c.table(spark, sf_dir, "embeddings"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hosts.judge(c.table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_exponential_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(c.table(spark, sf_dir, "documents").select("doc_id", "text", "source"), texts=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_fast_similarity_sketching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(c.table(spark, sf_dir, "documents")).drop("row")


def op6_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))


def op7_exact_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(c.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("row")


def op8_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.dedup_lines(c.table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_seekable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = seekable.write_token_files(c.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return seekable.read_token_files(files)


def op10_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))


def op11_internal_pattern_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(runs.with_planted_periods(c.table(spark, sf_dir, "documents"))))


def op12_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.pack(c.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("row")


def op13_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(c.table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_deleted_interpolation": op1_deleted_interpolation,
    "op2_itq_hamming": op2_itq_hamming,
    "op3_host_rules": op3_host_rules,
    "op4_exponential_keys": op4_exponential_keys,
    "op5_fast_similarity_sketching": op5_fast_similarity_sketching,
    "op6_random_indexing": op6_random_indexing,
    "op7_exact_complement_packing": op7_exact_complement_packing,
    "op8_cuckoo_lines": op8_cuckoo_lines,
    "op9_seekable_frames": op9_seekable_frames,
    "op10_counterfactual_toxicity": op10_counterfactual_toxicity,
    "op11_internal_pattern_runs": op11_internal_pattern_runs,
    "op12_cutting_stock": op12_cutting_stock,
    "op13_slot_negatives": op13_slot_negatives,
}
ORACLE_SQL: dict[str, str] = {
    "op2_itq_hamming": vectors.SQL,
    "op3_host_rules": hosts.SQL,
    "op5_fast_similarity_sketching": minhash.SQL,
    "op8_cuckoo_lines": lines.SQL,
    "op13_slot_negatives": negatives.SQL,
}
