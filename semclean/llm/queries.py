"""Queries and their SQL for the operators of this subpackage; ``__spark_entry__`` adds them to its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, embedding_dedup, fingerprint, langid, line_dedup, mixing, ngram_join, packing, pii, token_output
from .tokenizer import tokenizer_path


#: The key of the query, which runs on made-up texts; real ones need a secret one.
PII_KEY = b"op3 query on synthetic documents"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", words), (-7, 1, "assistant", words)], "conv_id long, turn long, role string, text string")
    path = tokenizer_path("byte_bpe_50k.json")
    return chat.chat_digests(chat.format_chat(turns.unionByName(probe), path), path)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokens_of_table(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, langid.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op4_chat": op4_chat,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_output": op6_token_output,
    "op7_fingerprint": op7_fingerprint,
    "op8_packing": op8_packing,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_langid": op10_langid,
}

ORACLE_SQL: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op5_line_dedup": line_dedup.ORACLE}
