"""From raw documents to packed sequences: language, near-duplicates, benchmarks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage
works on all rows its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, language, packing, secret_scan, similar, tokens
from plumbline.llm.common import table
from plumbline.session import scratch

#: A document is rejected if no language reaches this probability.
LEAST_SURE = 0.4
VOCABULARY = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those whose language is unsure."""
    return language.accepted(docs, language.learn(docs.where(~language.held_out())), LEAST_SURE)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: of fingerprints within four bits, or of texts with a five-word similarity of 0.8."""
    return similar.one_of_each(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold ten words in a row of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets; all documents stay."""
    words = secret_scan.dictionary(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "benchmark"))
    found = secret_scan.scan(docs, words, path="source")
    return secret_scan.redacted(docs, found)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence of at most 2048 tokens."""
    return packing.digest(packing.pack_documents(docs, tokens.vocabulary_path(VOCABULARY)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("benchmarks", remove_benchmarks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: A trained network, fingerprints and token ids are beyond SQL; tests compare with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
