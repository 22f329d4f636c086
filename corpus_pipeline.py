"""A training corpus from raw documents: five stages, each applying one operator to all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import language, near_copies, packing, secret_scan, toxicity
from sedimenta.session import settle, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters and those between two languages go."""
    return language.keep_known(docs, language.fit(docs))


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 for toxicity, by a model of the labelled ones among them."""
    return toxicity.keep_civil(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-copies, the one with the smallest id: SimHash links and those its radius leaves open, all at a similarity of 0.8."""
    return near_copies.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced and their length (where there is such a column) counted anew."""
    found = secret_scan.found(F.coalesce("text", F.lit("")), secret_scan.trained(docs))
    docs = docs.withColumn("text", secret_scan.redacted(F.col("text"), found))
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of 2048 tokens. Workers of earlier stages may still hold memory, so these remember fewer words."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), words=150_000)


STAGES = [("language", known_language), ("toxicity", civil), ("near_duplicates", one_of_each), ("secrets", without_secrets), ("packing", packed)]
#: Trained models and graph reachability cannot be said in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
