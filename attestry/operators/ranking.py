"""Scoring, ranking, explanation and what-if over tables of ranking inputs.

A ranking input has ``workspace_id``, ``provider``, ``task_id``, ``status``, the nine
features, the eight penalties and ``confidence`` as plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import rules
from attestry.functions import scoring, text
from attestry.operators.shape import top_k

QUEUE_ORDER = ["provider", "task_id"]

# kind of assumption -> values tried; "blocker_resolved" and "status" take none
SCENARIOS = {
    "deadline_urgency": 25.0,
    "customer_revenue": 0.0,
    "dependency_unlock": -3.0,
    "blocker_resolved": 0.0,
    "status": 0.0,
}


def with_score(df: DataFrame) -> DataFrame:
    scored = df.withColumn("score", scoring.final_score())
    return scored.withColumn("band", scoring.band(F.col("score")))


def queue(df: DataFrame, k: int = rules.QUEUE_SIZE) -> DataFrame:
    """Positively scored tasks of each workspace, best ``k`` with their rank."""
    scored = with_score(df).where(F.col("score") > 0)
    return top_k(scored, ["workspace_id"], [F.desc("score"), *map(F.asc, QUEUE_ORDER)], k)


def evidence_features(df: DataFrame, as_of: Column) -> DataFrame:
    """Ranking input of one record: ``title``, ``span``, ``source_date``, ``owner``, ``url``."""
    body = F.concat_ws(" ", "title", "span")
    names = {name: text.signal(body, regex) for name, regex in rules.SIGNALS.items()}
    closed = text.matches(body, rules.CLOSED_STATUS)
    actionable = text.matches(body, rules.ACTIONABLE)
    flags = df.select(
        "*",
        *[c.alias(f"is_{n}") for n, c in names.items()],
        closed.alias("is_closed"),
        actionable.alias("is_actionable"),
        text.matches(body, rules.COMMITMENT).alias("is_commitment"),
        text.matches(body, rules.QUICK_WIN).alias("is_quick"),
        scoring.freshness(F.datediff(as_of, F.col("source_date"))).cast("double").alias("evidence_freshness"),
    )
    c = F.col

    def pick(cond: Column, yes: float, no: float | Column) -> Column:
        return F.when(cond, yes).otherwise(no)

    known = [c("is_actionable"), c("owner").isNotNull(), c("source_date").isNotNull(), c("url").isNotNull()]
    return flags.select(
        *df.columns,
        pick(c("is_closed"), "completed", pick(c("is_dependency"), "blocked", F.lit("open"))).alias("status"),
        pick(c("is_security") | c("is_customer"), 18.0, pick(c("is_urgent"), 14.0, 9.0)).alias("business_impact"),
        pick(c("is_urgent"), 17.0, pick(c("source_date").isNotNull(), 10.0, 6.0)).alias("urgency"),
        pick(c("is_dependency"), 15.0, 5.0).alias("dependency_unlock"),
        pick(c("is_customer"), 11.0, 2.0).alias("customer_revenue"),
        pick(c("is_security"), 10.0, 0.0).alias("incident_security"),
        pick(c("is_commitment"), 8.0, 4.0).alias("commitment_strength"),
        F.lit(5.0).alias("authority_reliability"),
        "evidence_freshness",
        pick(c("is_quick"), 5.0, 2.0).alias("quick_win_leverage"),
        pick(c("is_closed"), 40.0, 0.0).alias("likely_resolved"),
        F.lit(0.0).alias("duplicate"),
        pick(c("is_dependency"), 8.0, 0.0).alias("unresolved_dependency"),
        pick(F.length("span") < 40, 9.0, 0.0).alias("weak_evidence"),
        F.lit(0.0).alias("conflicting_evidence"),
        pick(c("evidence_freshness") == 1, 5.0, 0.0).alias("stale_evidence"),
        pick(c("owner").isNotNull(), 0.0, 6.0).alias("missing_owner"),
        pick(c("is_actionable"), 0.0, 8.0).alias("low_actionability"),
        (text.count_true(known) / 4.0).alias("confidence"),
    )


def why_above_next(ranked: DataFrame) -> DataFrame:
    """Component gaps between each queue item and the next one of its workspace.

    ``ranked`` is a queue (at most ``QUEUE_SIZE`` rows per workspace), so the window
    is bounded whatever the size of a workspace.
    """
    parts = scoring.components()
    base = ranked.select(
        "workspace_id", "task_id", "rank", "score", *[c.alias(n) for n, c in parts.items()]
    )
    window = Window.partitionBy("workspace_id").orderBy("rank")
    nxt = base.select(
        "*",
        F.lead("task_id").over(window).alias("runner_up_id"),
        scoring.round_half_up(F.col("score") - F.lead("score").over(window)).alias("score_delta"),
        *[(F.col(n) - F.lead(n).over(window)).alias(f"d_{n}") for n in parts],
    ).where(F.col("runner_up_id").isNotNull())
    gaps = F.array(
        *[
            F.struct(
                (-F.abs(F.col(f"d_{n}"))).alias("size"),
                F.lit(i).alias("at"),
                F.lit(n).alias("component"),
                F.lit(rules.COMPONENT_LABELS.get(n, n)).alias("label"),
                F.col(f"d_{n}").alias("delta"),
            )
            for i, n in enumerate(parts)
        ]
    )
    ordered = F.array_sort(F.filter(gaps, lambda g: g["delta"] != 0))
    cents = lambda g: F.floor(g["delta"] * 100 + 0.5).cast("bigint").cast("string")

    def labelled(gap):
        """The signed gap in its shortest form and the name of its component."""
        points = F.regexp_replace((F.floor(gap["delta"] * 100 + 0.5) / 100).cast("decimal(12,2)").cast("string"), r"\.?0+$", "")
        return F.concat(F.when(gap["delta"] > 0, "+").otherwise(""), points, F.lit(" "), gap["label"])

    return nxt.select(
        "workspace_id",
        "rank",
        F.col("task_id").alias("leader_id"),
        "runner_up_id",
        "score_delta",
        F.array_join(F.transform(ordered, lambda g: F.concat(g["component"], F.lit("="), cents(g))), ";").alias(
            "components"
        ),
        F.array_join(F.transform(ordered, labelled), "; ").alias("labels"),
        F.when(
            F.col("score_delta") == 0,
            "Both items score identically under this policy; the tie is broken by identifier.",
        ).otherwise(
            F.concat(
                F.lit("Leads by "),
                F.regexp_replace(F.abs("score_delta").cast("decimal(12,2)").cast("string"), r"\.?0+$", ""),
                F.lit(" points."),
            )
        ).alias("summary"),
    )


def counterfactual(df: DataFrame, scenarios: dict[str, float] | None = None) -> DataFrame:
    """Re-score every row once per assumption, changing only the named field.

    The assumptions travel as a short literal array per row, so there is no join.
    """
    scenarios = scenarios or SCENARIOS
    before = with_score(df).withColumnRenamed("score", "score_before").drop("band")
    each = before.withColumn("kind", F.explode(text.literal_array(scenarios)))
    kind = F.col("kind")

    def clamped(name: str, top: float) -> Column:
        value = float(min(top, max(0.0, scenarios.get(name, 0.0))))
        return F.lit(value)

    patched = each.withColumns(
        {
            "urgency": F.when(kind == "deadline_urgency", clamped("deadline_urgency", 18)).otherwise(F.col("urgency")),
            "customer_revenue": F.when(kind == "customer_revenue", clamped("customer_revenue", 12)).otherwise(
                F.col("customer_revenue")
            ),
            "dependency_unlock": F.when(kind == "dependency_unlock", clamped("dependency_unlock", 16)).otherwise(
                F.col("dependency_unlock")
            ),
            "unresolved_dependency": F.when(kind == "blocker_resolved", 0.0).otherwise(F.col("unresolved_dependency")),
            "status": F.when(kind == "blocker_resolved", "open")
            .when(kind == "status", "completed")
            .otherwise(F.col("status")),
        }
    )
    after = patched.withColumn("score_after", scoring.final_score())
    delta = scoring.round_half_up(F.col("score_after") - F.col("score_before"))
    return after.select(
        "workspace_id", "task_id", "kind", "score_before", "score_after", delta.alias("delta"),
        (F.col("score_after") != F.col("score_before")).alias("changed"),
    )


def policy_errors(policies: DataFrame) -> DataFrame:
    """Policies (``policy_id``, ``weight``) whose weights do not sum to 100 within 0.001."""
    total = policies.groupBy("policy_id").agg(F.sum("weight").alias("total_weight"))
    return total.where(F.abs(F.col("total_weight") - 100) > 0.001)


FEATURES = [
    "business_impact", "urgency", "dependency_unlock", "customer_revenue", "incident_security",
    "commitment_strength", "authority_reliability", "evidence_freshness",
]


def input_hash() -> Column:
    """Hash of a ranking input in a canonical text form: features and penalties as integer cents."""
    cents = [F.floor(F.col(n) * 100 + 0.5).cast("bigint").cast("string") for n in FEATURES + rules.PENALTIES]
    return F.sha2(F.concat_ws("|", F.col("task_id").cast("string"), F.col("status"), *cents), 256)


def replay(stored: DataFrame, inputs: DataFrame) -> DataFrame:
    """Re-score stored inputs and flag rows whose stored score has drifted."""
    fresh = with_score(inputs).select(
        "workspace_id", "task_id", F.col("score").alias("replayed_score"), input_hash().alias("input_hash")
    )
    return stored.join(fresh, ["workspace_id", "task_id"]).select(
        "workspace_id", "task_id", "stored_score", "replayed_score", "input_hash",
        (F.col("stored_score") != F.col("replayed_score")).alias("drift"),
    )


def recency_factor(df: DataFrame, key: str, time: str) -> DataFrame:
    """Min-max position of each dated row within its pool; pools without spread give no rows.

    The bounds are an aggregate joined back, so a hot pool is not sorted in one task.
    """
    bounds = df.where(F.col(time).isNotNull()).groupBy(key).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    spread = bounds.where(F.col("_hi") > F.col("_lo"))
    return (
        df.where(F.col(time).isNotNull())
        .join(spread, key)
        .withColumn("recency", (F.col(time) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
        .drop("_lo", "_hi")
    )


def proof_freshness(df: DataFrame, verified: str, as_of: Column) -> DataFrame:
    """Age of a verification (epoch seconds) against the allowed age, with its expiry."""
    limit = rules.PROOF_MAX_AGE_HOURS * 3600
    age = F.greatest(F.lit(0), as_of - F.col(verified))
    return df.select(
        "*",
        F.when(F.col(verified).isNull(), "unverified").when(age <= limit, "current").otherwise("stale").alias("proof"),
        (F.floor(age / 3600.0 * 10 + 0.5) / 10.0).alias("age_hours"),
        (F.col(verified) + limit).alias("expires_at"),
        scoring.freshness(age / 86400.0).alias("freshness"),
    )
