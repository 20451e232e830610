"""The registered queries of the training-data operators: op(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import table
from quillon.llm.sql import ORACLE_SQL


def tokenizer_path(name: str) -> str:
    """Vocabulary files of the public_tokenizers package; QUILLON_TOKENIZERS names another folder."""
    folder = os.environ.get("QUILLON_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.encoding import bpe_digest

    return bpe_digest(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.encoding import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.binary import token_file_report, write_token_files

    return token_file_report(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0))


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.dedup import repeated_words_digest

    return repeated_words_digest(table(spark, sf_dir, "documents"), 20)


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.dedup import repeated_bytes_digest

    return repeated_bytes_digest(table(spark, sf_dir, "documents"), 50)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")), 0.3)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), rate=0.1)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.chat import chat_report, with_probe

    return chat_report(with_probe(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_quality, op2_bpe_codec, op3_simhash_components, op4_token_counts, op5_nearest, op6_substring_dedup, op7_token_files, op8_decontamination, op9_chat, op10_repeated_bytes)}

__all__ = ["ORACLE_SQL", "QUERIES", "tokenizer_path"]
