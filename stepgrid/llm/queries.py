"""Queries of the text operators over the data tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ngram_join, secrets, url_filter
from .common import held_out, table


def op1_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ann

    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import webp

    return webp.digests(webp.store(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return chat.read_back(chat.windows(turns.unionByName(more)))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def tokenizer() -> tuple[str, str]:
    """Path and pattern of the public tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer())


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", url_filter.fetched(F.col("page_id")))
    return url_filter.judge(captures, url_filter.sample_lists(pages)).select("page_id", "host", "fetched", "verdict", "domain", "since")


QUERIES = {f.__name__: f for f in (op1_multiprobe_lsh, op2_toxicity, op3_media_webp, op4_mixing, op5_chat_windows, op6_secrets, op7_byte_bpe, op8_ngram_join, op9_language_id, op10_url_filter)}


ORACLE_SQL: dict[str, str] = {"op5_chat_windows": chat.SQL, "op6_secrets": secrets.SQL, "op8_ngram_join": ngram_join.SQL, "op10_url_filter": url_filter.SQL}
