"""Group reductions that stay safe when one key holds a large share of all rows.

Keeping the newest or the first row of a group is an aggregate here, not a window:
aggregates combine before the shuffle, so a hot key ships one row per task. Top-k
uses ``row_number() <= k``, which Spark prunes before the shuffle (WindowGroupLimit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str | Column], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    sort_key = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(chooser(F.struct(*rest), sort_key).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def latest(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row of each group with the greatest ``order`` tuple."""
    return _pick(df, keys, order, F.max_by)


def earliest(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The row of each group with the smallest ``order`` tuple."""
    return _pick(df, keys, order, F.min_by)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
