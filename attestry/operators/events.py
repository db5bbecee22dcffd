"""Folds over event logs that hold up when one run or client owns a third of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.cluster import mark_duplicates


def running_totals(
    df: DataFrame, keys: list[str], at: str, ties: list[str], width: int, values: dict[str, Column]
) -> DataFrame:
    """Running sums along ``at`` inside each key, without sorting a whole key in one task.

    A key is cut into stretches of ``width`` along ``at``: sums run inside a stretch, and
    the totals of earlier stretches, one small row each, are added as an offset.
    """
    stretch = F.floor(F.col(at) / F.lit(width)).cast("bigint")
    rows = df.withColumn("_stretch", stretch).withColumns({f"_v_{n}": c for n, c in values.items()})
    inside = Window.partitionBy(*keys, "_stretch").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in values})
    totals = rows.groupBy(*keys, "_stretch").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_stretch", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in values]
    )
    joined = local.join(offsets, [*keys, "_stretch"])
    return joined.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in values])


def trailing_counts(log: DataFrame, keys: list[str], second: str, window: int, name: str) -> DataFrame:
    """Events of the key in the last ``window`` seconds, both ends included, per (key, second).

    The count is the running total at the event less the running total just before the
    window opens; the opening is a zero-weight probe row in the same running total.
    """
    per_second = log.groupBy(*keys, second).agg(F.count(F.lit(1)).alias("_n"))
    marks = per_second.select(*keys, F.col(second).alias("_at"), F.col(second).alias("_of"), "_n", F.lit(1).alias("_kind"))
    probes = per_second.select(
        *keys, (F.col(second) - window).alias("_at"), F.col(second).alias("_of"), F.lit(0).cast("bigint").alias("_n"),
        F.lit(0).alias("_kind"),
    )
    total = running_totals(marks.unionByName(probes), keys, "_at", ["_kind"], max(1, window // 16), {"_run": F.col("_n")})
    ends = total.groupBy(*keys, F.col("_of").alias(second)).agg(
        F.max(F.when(F.col("_kind") == 1, F.col("_run"))).alias("_to"),
        F.max(F.when(F.col("_kind") == 0, F.col("_run"))).alias("_from"),
    )
    return ends.select(*keys, second, (F.col("_to") - F.col("_from")).alias(name))


def rate_limit(log: DataFrame, window: int, limit: int, global_limit: int | None = None) -> DataFrame:
    """Trailing counts per client and per operation, and whether the request is refused.

    ``log``: event_id, workspace_id, client_id, operation, second.
    """
    ceiling = global_limit or max(limit * 10, limit + 10)
    client = trailing_counts(log, ["workspace_id", "client_id", "operation"], "second", window, "client_count")
    overall = trailing_counts(log, ["workspace_id", "operation"], "second", window, "overall_count")
    joined = log.join(client, ["workspace_id", "client_id", "operation", "second"]).join(
        overall, ["workspace_id", "operation", "second"]
    )
    refused = (F.col("client_count") > limit) | (F.col("overall_count") > ceiling)
    return joined.select("event_id", "client_count", "overall_count", refused.alias("refused"))


def workflow_fold(log: DataFrame, width: int) -> DataFrame:
    """Sequence, distinct receipts so far and calls so far of every step of a run.

    ``log``: run_id, event_id, at, stage, receipt, is_call. A receipt counts at its first
    event, found by an aggregate, so distinct counting becomes a running sum.
    """
    first = log.where(F.col("receipt").isNotNull()).groupBy("run_id", "receipt").agg(
        F.min(F.struct("at", "event_id"))["event_id"].alias("_first")
    )
    marked = log.join(first, ["run_id", "receipt"], "left")
    new = F.coalesce((F.col("_first") == F.col("event_id")).cast("int"), F.lit(0))
    rows = marked.withColumn("_new", new).drop("_first")
    return running_totals(
        rows, ["run_id"], "at", ["event_id"], width,
        {"sequence": F.lit(1), "receipts": F.col("_new"), "calls": F.col("is_call").cast("int")},
    ).drop("_new")


def verification_outcome() -> Column:
    """State, stage and reason of one verification attempt.

    Reads ``resource_ok``, ``connector_ok``, ``canary_count``, ``has_cursor``, ``has_sync`` and
    ``upstream_error``.
    """
    reachable = F.col("resource_ok") & F.col("connector_ok")
    verified = reachable & (F.col("canary_count") > 0) & F.col("upstream_error").isNull()
    stage = (
        F.when(verified, "data_verified")
        .when(~reachable, "resource_status_failed")
        .when(~F.col("has_sync"), "sync_evidence_missing")
        .otherwise("canary_failed")
    )
    syncing = ~F.col("has_cursor") & reachable
    state = F.when(verified, "data_verified").when(syncing, "sync_in_progress").otherwise("degraded")
    reason = F.when(~verified & ~syncing, F.coalesce("upstream_error", stage))
    return F.struct(state.alias("state"), stage.alias("stage"), reason.alias("last_error"))


def connector_states(log: DataFrame) -> DataFrame:
    """Newest outcome of every connector; works unchanged on a stream in update mode."""
    newest = F.max_by(verification_outcome(), F.struct("at", "event_id"))
    return log.groupBy("connector_id").agg(newest.alias("o")).select("connector_id", "o.state", "o.stage", "o.last_error")


def stage_fold(log: DataFrame) -> DataFrame:
    """Newest stage and time from first to last event of every document."""
    return log.groupBy("document_id").agg(
        F.max_by("stage", F.struct("at", "event_id")).alias("stage"), (F.max("at") - F.min("at")).alias("duration")
    )


def claim_once(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first event of a key is accepted, later ones are refused."""
    return mark_duplicates(log, keys, seq).withColumn("accepted", ~F.col("is_duplicate")).drop("is_duplicate", "first_seq")


def packet_status(packets: DataFrame, log: DataFrame) -> DataFrame:
    """Newest reported status of every packet, ``available`` before any report."""
    newest = log.groupBy("packet_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("_status"))
    return packets.join(newest, "packet_id", "left").select(
        "packet_id", F.coalesce("_status", F.lit("available")).alias("status")
    )


def queue_changes(snapshots: DataFrame) -> DataFrame:
    """Entered, left and moved items between consecutive snapshots of a workspace.

    ``snapshots``: workspace_id, snapshot, item, rank. Only the short list of snapshots is
    windowed; items meet through an outer join.
    """
    runs = snapshots.select("workspace_id", "snapshot").distinct()
    follow = Window.partitionBy("workspace_id").orderBy("snapshot")
    steps = runs.withColumn("next", F.lead("snapshot").over(follow)).where(F.col("next").isNotNull())
    before = snapshots.join(steps, ["workspace_id", "snapshot"]).select(
        "workspace_id", F.col("next").alias("snapshot"), "item", F.col("rank").alias("old_rank")
    )
    later = steps.select("workspace_id", F.col("next").alias("snapshot"))
    after = snapshots.join(later, ["workspace_id", "snapshot"], "left_semi").withColumnRenamed("rank", "new_rank")
    both = before.join(after, ["workspace_id", "snapshot", "item"], "full_outer")
    change = (
        F.when(F.col("old_rank").isNull(), "entered")
        .when(F.col("new_rank").isNull(), "left")
        .when(F.col("old_rank") != F.col("new_rank"), "moved")
    )
    return both.withColumn("change", change).where(F.col("change").isNotNull())


def exact_percentiles(df: DataFrame, key: str, value: str, width: int, fractions: dict[str, float]) -> DataFrame:
    """Nearest-rank and floor-index percentiles of an integer column, exact.

    Values are counted before the shuffle and ranked by running totals, so neither a hot
    key nor a long tail is sorted in one task.
    """
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, [key], value, [], width, {"_upto": F.col("_n")})
    totals = counts.groupBy(key).agg(F.sum("_n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    joined = ranked.join(totals, key)
    picks = []
    for name, fraction in fractions.items():
        nearest = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.col("n") * F.lit(fraction))))
        floored = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(fraction))) + 1
        picks.append(F.min(F.when(F.col("_upto") >= nearest, F.col(value))).alias(name))
        picks.append(F.min(F.when(F.col("_upto") >= floored, F.col(value))).alias(f"{name}_floor"))
    return joined.groupBy(key).agg(F.max("n").alias("n"), F.max("min").alias("min"), F.max("max").alias("max"), *picks)
