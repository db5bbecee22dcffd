"""Joins that attribute records to sources, connectors and workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text


def _ids(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    ids = F.array_distinct(F.array_compact(F.array(*[F.nullif(F.col(n), F.lit("")) for n in names])))
    return df.select(key, F.explode(ids).alias("_id"))


def source_chunks(sources: DataFrame, chunks: DataFrame, names: list[str]) -> DataFrame:
    """Sources with every chunk that shares one of their ids; an unmatched source keeps NULL.

    The join is on identity only, never on position, and a chunk that matches through two
    ids counts once.
    """
    hits = _ids(sources, "source_key", names).join(_ids(chunks, "chunk_key", names), "_id")
    pairs = hits.select("source_key", "chunk_key").distinct()
    return sources.select("source_key").join(pairs, "source_key", "left")


def lineage(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """How each row proves it belongs to ``connector_id``.

    A named connector decides; without one, the named resource must be selected for that
    connector; without either, the row is rejected. Selected pairs join once, as a set.
    """
    chosen = selected.select("connector_id", F.col("resource_id").alias("resource"), F.lit(True).alias("_chosen")).distinct()
    joined = rows.join(chosen, ["connector_id", "resource"], "left")
    return joined.withColumn(
        "proof",
        F.when(F.col("owner").isNotNull(), F.when(F.col("owner") == F.col("connector_id"), "connector").otherwise("rejected"))
        .when(F.col("_chosen"), "resource")
        .otherwise("rejected"),
    ).drop("_chosen")


def attested(requests: DataFrame, connectors: DataFrame) -> DataFrame:
    """Requests whose missing lineage may be accepted: a single connector of the provider in
    the workspace, one connector in scope, success, a request id and agreeing filters."""
    per_provider = connectors.groupBy("workspace_id", "provider").agg(F.count(F.lit(1)).alias("_n"))
    alone = connectors.join(per_provider.where("_n = 1"), ["workspace_id", "provider"], "left_semi")
    joined = requests.join(alone.select("connector_id", "provider"), "connector_id")
    agrees = lambda c: F.col(c).isNull() | (F.col(c) == F.col("provider"))
    return joined.where(
        (F.col("scope_size") == 1)
        & F.col("status").between(200, 299)
        & (F.trim(F.coalesce("request_id", F.lit(""))) != "")
        & (F.col("filter_connector") == F.col("connector_id"))
        & (F.col("filter_provider") == F.col("provider"))
        & agrees("reported_provider")
        & (F.col("caller_connector").isNull() | (F.col("caller_connector") == F.col("connector_id")))
        & agrees("caller_provider")
    )


def owned_documents(sources: DataFrame, owned: DataFrame) -> DataFrame:
    """Sources the workspace uploaded itself, by (database, source id), labelled as documents."""
    return sources.join(owned, ["database", "source_id"]).withColumn("provider", F.lit("document"))


def all_exist(requests: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Per request: how many ids it names, how many are unknown, and whether it is accepted."""
    known = existing.select(key).distinct().withColumn("_known", F.lit(1))
    flagged = requests.join(known, key, "left")
    counted = flagged.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_requested"), F.count_if(F.col("_known").isNull()).alias("n_missing")
    )
    return counted.withColumn("accepted", F.col("n_missing") == 0)


def with_parent(rows: DataFrame, parents: DataFrame, on: Column) -> DataFrame:
    """Rows whose parent exists, ready to be appended."""
    return rows.join(parents, on, "left_semi")


def citation_closure(references: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence that a claim or contradiction refers to, with the place of its first reference."""
    first = references.groupBy("question_id", "evidence_id").agg(F.min("place").alias("first_ref"))
    return first.join(evidence, "evidence_id", "left_semi").select("question_id", "evidence_id", "first_ref")


def link_queue(answers: DataFrame, items: DataFrame) -> DataFrame:
    """Queue item that shares most exact evidence with an answer, one per question.

    ``answers``: workspace_id, question_id, question, evidence_id. ``items``: workspace_id,
    task_id, corpus, score, evidence_id. Ties go to term overlap, score, then task id.
    """
    shared = (
        answers.distinct()
        .join(items.select("workspace_id", "task_id", "evidence_id").distinct(), ["workspace_id", "evidence_id"])
        .groupBy("workspace_id", "question_id", "question", "task_id")
        .agg(F.count(F.lit(1)).alias("n_shared"))
    )
    facts = items.select("workspace_id", "task_id", "corpus", "score").distinct()
    terms = F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9-]{4,}"), F.lit(0)))
    low = F.lower("corpus")
    overlap = F.size(F.filter(terms, lambda t: F.instr(low, t) > 0))
    joined = shared.join(facts, ["workspace_id", "task_id"]).withColumn("overlap", overlap)
    order = F.struct(F.col("n_shared"), F.col("overlap"), F.col("score"), -F.col("task_id"))
    best = joined.groupBy("question_id").agg(F.max_by(F.struct("task_id", "n_shared", "overlap", "score"), order).alias("b"))
    return best.select("question_id", "b.task_id", "b.n_shared", "b.overlap", "b.score")


def state_import(upstream: DataFrame, imported: DataFrame) -> DataFrame:
    """Upstream connectors (complete rows, last one of an id) with their imported state."""
    complete = upstream.where(
        (text.first_text(F.col("connector_id")).isNotNull()) & (text.first_text(F.col("provider")).isNotNull())
    )
    last = complete.groupBy("connector_id").agg(F.max_by("provider", "seq").alias("provider"))
    live = imported.where("state <> 'deleted'").select("connector_id", "state")
    return last.join(live, "connector_id", "left").select(
        "connector_id", "provider", "state",
        F.col("state").isNotNull().alias("imported"),
        F.coalesce(F.col("state") == "data_verified", F.lit(False)).alias("retrieval_eligible"),
    )
