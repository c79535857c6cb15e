"""One query an operator, over whole tables with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat_repair, decontam, divergence, filter_audit, kd_shards, near_dedup, quality_knn, secret_automata, slack_packing, sp_dropout, substring_dedup, token_store, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_roles(_table(spark, sf_dir, "conversations"))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(_table(spark, sf_dir, "documents"), shards=24)


def op6_sp_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_dropout.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.token_digests(spark, path)


def op9_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.distribution_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_secret_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_automata.scan_secrets(_table(spark, sf_dir, "documents"))


def op11_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


ORACLE_SQL: dict[str, str] = {"op2_decontam": decontam.SQL, "op12_vector_codes": vector_codes.SQL, "op13_filter_audit": filter_audit.SQL}
