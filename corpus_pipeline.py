"""From raw documents to shards: toxicity, near duplicates, benchmark leaks, source mix, shards.

Every stage works on all rows that the one before it kept, and reads whole texts. Rows are told
apart by id and text (``attestry.llm.common``): rows that repeat both are one document, of
which the near-duplicate stage keeps one; rows without id live by their text. Null and empty texts
pass the filters; the mix takes them as often as their source's whole repetitions and the
fill decide. The mix repeats a document's row as often as it takes it. Extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontaminate, mixing, near_dup, sharding, toxicity
from attestry.llm.common import Shelf, identity
from attestry.session import broadcast_if_small
from attestry.sources.tables import table

OWN = ["_row_key", "_row_tie"]


def _named(docs: DataFrame) -> DataFrame:
    key, tie = identity()
    return docs.withColumn(OWN[0], key).withColumn(OWN[1], tie)


def _rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("key").alias(OWN[0]), F.col("tie").alias(OWN[1]))


def _without(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows that ``found`` names by key and tie."""
    gone = Shelf(docs.sparkSession, name).keep(_rows(found).distinct())
    return _named(docs).join(broadcast_if_small(gone), OWN, "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half, learned from all labels of rows that are still there."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return _without(docs, toxicity.score(docs, model).where("score >= 0.5"), "pipeline-toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8 or more."""
    shelf = Shelf(spark, "pipeline-neardup")
    found = shelf.keep(near_dup.near_duplicates(docs, percent=80).select("kept", "key", "tie"))
    left = _without(docs, found.where("not kept"), "pipeline-neardup")
    repeated = shelf.keep(_rows(found.where("kept").groupBy("key", "tie").count().where("count > 1")))
    named = _named(left)
    single = named.join(broadcast_if_small(repeated), OWN, "left_anti")
    several = named.join(broadcast_if_small(repeated), OWN, "left_semi").dropDuplicates(OWN)
    return single.unionByName(several).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"), "pipeline-leaks")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    times = Shelf(spark, "pipeline-mix").keep(mixing.mix(docs).groupBy("key", "tie").agg(F.max("times").alias("_times")))
    counted = times.select(F.col("key").alias(OWN[0]), F.col("tie").alias(OWN[1]), "_times").where("_times > 0")
    taken = _named(docs).join(broadcast_if_small(counted), OWN)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: Scores and groups are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's result written and read again."""
    shelf = Shelf(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shelf.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
