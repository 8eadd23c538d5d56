"""From raw documents to token ids: language ID, exact and near deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a
DataFrame that is written as Parquet and read again before the next stage. All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from landshift.llm.bpe import encode_decode
from landshift.llm.exact_dedup import drop_exact_copies
from landshift.llm.language_id import keep_identified
from landshift.llm.mixing import sample_documents
from landshift.llm.simhash import drop_near_copies
from landshift.llm.storage import store

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; texts without letters and doubtful ones go."""
    return keep_identified(docs, PIECES)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of close SimHash fingerprints the smallest doc_id stays."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with probabilities raked to the source, language and topic targets."""
    return sample_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the decoded text."""
    return encode_decode(docs, WORDS).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding),
]

# Language models, XXH64 fingerprints and subword merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
