"""The corpus pipeline: quality, near copies, repeated passages, benchmark passages, encoding.

Every stage works on all that the one before it kept; run() writes each stage's result to the shared folder
and reads it again. Rows without doc_id pass the middle stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import discard, made, materialize, table
from quillon.llm.decontaminate import drop_contaminated
from quillon.llm.dedup import replace_repeated_words
from quillon.llm.encoding import bpe_encode
from quillon.llm.quality import drop_low_quality
from quillon.llm.queries import tokenizer_path
from quillon.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"), labelled=table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return drop_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 20-word windows that occur earlier; documents left without a word go."""
    return replace_repeated_words(docs, 20)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text."""
    return bpe_encode(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", decontamination), ("encoding", encoding)]

#: SQL has neither the classifier nor the fingerprints; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; what stages wrote on the way is deleted once the next one is done."""
    docs, begin = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", large=True)
        discard(spark, begin, keep=1)
    return docs
