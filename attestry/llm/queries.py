"""Registered corpus queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontaminate, divergence, extract, hamming, language, metric_join, mixing, near_dup, phrases, secret_forest, sharding, substring, toxicity
from attestry.llm.common import crc_fold
from attestry.sources.tables import table

QUERIES = {}
ORACLES = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_hamming_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return hamming.nearest(vectors, vectors.where("vec_id % 100 = 0"))


ORACLES["op1_hamming_topk"] = hamming.SQL


@_query
def op2_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    return secret_forest.scan(table(spark, folder, "documents"))


@_query
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxic(table(spark, folder, "documents"), table(spark, folder, "labels"), crc_fold("doc_id", 5) == 0)


@_query
def op5_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("times", "key", "tie")


ORACLES["op5_source_mix"] = mixing.SQL


@_query
def op6_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract.extract(pages, extract.fit(pages))


@_query
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs, crc_fold("doc_id", 4) != 2)
    found = language.predict(docs, model)
    return found.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


@_query
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"))


@_query
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(table(spark, folder, "documents"))


@_query
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), percent=85).drop("key", "tie")


@_query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("key", "tie")


@_query
def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


ORACLES["op11_phrases"] = phrases.SQL


@_query
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergences(table(spark, folder, "documents"))


ORACLES["op12_source_divergence"] = divergence.SQL


@_query
def op13_embedding_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return metric_join.near_vectors(table(spark, folder, "embeddings"))


ORACLES["op13_embedding_neardup"] = metric_join.SQL
