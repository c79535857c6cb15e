"""From raw documents to token ids: quality, near duplicates, benchmark passages, secrets, encoding.

Every stage works on all rows that the one before it kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontam, near_dedup, quality_knn, secret_automata, sp_dropout
from tessera.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the nearest-neighbour classifier rejects go."""
    return quality_knn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 over five-word shingles, the smallest doc_id stays."""
    return near_dedup.keep_first(docs, shingle_words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds 0.8 or more of a benchmark item's five-word shingles go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret spans are replaced in the text; n_chars follows it."""
    clean = secret_automata.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, lossless and the token ids."""
    return sp_dropout.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), tokens=True)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("SentencePiece encoding", tokens),
]

#: Models are trained on the way, so SQL cannot express the rows; tests/llm compares them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
