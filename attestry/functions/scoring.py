"""The priority policy as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import rules


def round_half_up(col: Column, digits: int = 2) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``: the same double on every engine."""
    scale = float(10**digits)
    return F.floor(col * scale + 0.5) / F.lit(scale)


def components(weights: dict[str, float] | None = None) -> dict[str, Column]:
    w = weights or rules.POLICY_WEIGHTS
    c = F.col
    return {
        "urgency_deadline": c("urgency") / 18.0 * w["urgency_deadline"],
        "customer_operational_impact": F.greatest(
            c("business_impact") / 20.0, c("customer_revenue") / 12.0, c("incident_security") / 10.0
        )
        * w["customer_operational_impact"],
        "explicit_commitment": c("commitment_strength") / 8.0 * w["explicit_commitment"],
        "dependency_blocking": c("dependency_unlock") / 16.0 * w["dependency_blocking"],
        "source_corroboration": c("authority_reliability") / 6.0 * w["source_corroboration"],
        "recency": c("evidence_freshness") / 4.0 * w["recency"],
    }


def add(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def penalty_total() -> Column:
    return add([F.col(p) for p in rules.PENALTIES])


def final_score(weights: dict[str, float] | None = None) -> Column:
    positive = add(components(weights).values())
    closed = F.when(F.col("status").isin("completed", "cancelled"), 100.0).otherwise(0.0)
    rounded = round_half_up(positive - penalty_total() - closed)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), rounded))


def band(score: Column) -> Column:
    return (
        F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 35, "normal").otherwise("low")
    )


def one_decimal(col: Column) -> Column:
    """A non-negative number as text with one decimal, without locale formatting."""
    tenths = F.floor(col * 10 + 0.5).cast("bigint")
    return F.concat(
        F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string")
    )


def explanation() -> Column:
    closed = F.col("status").isin("completed", "cancelled")
    negative = penalty_total()
    return F.concat_ws(
        " ",
        F.concat(F.lit("Positive components total "), one_decimal(add(components().values())), F.lit(".")),
        F.when(
            negative > 0,
            F.concat(F.lit("Evidence and execution penalties total "), one_decimal(negative), F.lit(".")),
        ).otherwise("No ranking penalties applied."),
        F.when(closed, "Confirmed completed or cancelled work is not actionable.").otherwise(
            "Item remains actionable."
        ),
    )


def freshness(age_days: Column) -> Column:
    """Age buckets 1/7/30 days; a missing age counts as the oldest."""
    return (
        F.when(age_days.isNull(), 1).when(age_days <= 1, 4).when(age_days <= 7, 3).when(age_days <= 30, 2).otherwise(1)
    )
