"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.chat import ORACLE as CHAT_ORACLE
from tempora.llm.chat import format_chats
from tempora.llm.common import table
from tempora.llm.licenses import oracle as licenses_oracle
from tempora.llm.licenses import scan_licenses
from tempora.llm.multiindex import near_vectors
from tempora.llm.nearjoin import jaccard_join
from tempora.llm.passages import find_passages
from tempora.llm.pieces import encode_texts
from tempora.llm.sharding import shard_rows
from tempora.llm.templates import ORACLE as TEMPLATES_ORACLE
from tempora.llm.templates import find_leaks
from tempora.llm.toxicity import score_toxicity
from tempora.llm.wordpiece import count_tokens


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents")).drop("text_hash")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_texts(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.round("score", 3).alias("score"), "round_trip")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_sharding": op4_sharding,
    "op5_licenses": op5_licenses,
    "op6_token_counts": op6_token_counts,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLES = {
    "op3_decontamination": TEMPLATES_ORACLE,
    "op7_chat_formatting": CHAT_ORACLE,
    "op5_licenses": licenses_oracle(),
}
