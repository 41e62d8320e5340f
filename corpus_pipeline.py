"""A training corpus from raw documents: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (operator 9): documents that the model rejects go."""
    from stepgrid.llm import langid

    return langid.keep_known(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (operator 8): one document of each group of exact and near copies stays."""
    from stepgrid.llm import ngram_join

    return ngram_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans (operator 6): credentials that aren't widely copied examples are replaced; every document stays.
    Owners are counted over the raw documents too: copies that show a value to be an example are gone from ``docs``."""
    from stepgrid.llm import secrets

    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secrets.redact(docs, corpus=raw).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights (operator 4): a row for each pass of the mix over a document, with the words
    that it takes."""
    from stepgrid.llm import mixing

    return mixing.mixed_documents(docs, mixing.mix(docs)).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (operator 7): the token ids of every document, read back to check and count them."""
    from stepgrid.llm import bpe
    from stepgrid.llm.queries import tokenizer

    return bpe.round_trip(docs, *tokenizer())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
