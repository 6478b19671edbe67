"""The corpus pipeline: languages, exact and near duplicates, source mix, tokens.

Each stage works on all documents that its predecessor kept and returns the columns of documents; the last one
returns tokens. Stages are written to shared Parquet tables in between, so each starts from files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pubtrack.llm import bpe, exact, language, mixing, near
from pubtrack.llm.common import shared_table


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train the language model on the documents' own labels; drop what has no letters or no clear language."""
    return language.keep_known(docs, language.fit(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the largest identity."""
    return exact.keep_distinct(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents keep the one with the smallest identity."""
    return near.keep_representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources reach their target weights."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, checked by decoding."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language ID", known_languages), ("exact dedup", exact_duplicates), ("MinHash near-dedup", near_duplicates),
          ("source mix", source_mix), ("byte-level BPE", tokens)]

#: SQL expresses neither the trained model nor the tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared_table(docs, "stage")
    return docs
