"""Event-log queries in batch; ``attestry.streaming`` has the same folds on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import events
from attestry.operators.shape import top_k
from attestry.plans.ranking import AS_OF, SCORED_CTE, order_inputs
from attestry.plans.registry import query
from attestry.sources.tables import table

DAY = 86400


def log(spark, folder):
    """Events with epoch time and the number inside their properties."""
    return table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


LOG_CTE = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


@query(
    "rate_limit_windows",
    f"""WITH {LOG_CTE}, s AS (SELECT event_id, user_id % 5 AS w, user_id AS c, event_type AS o, us // 1000000 AS sec FROM ev),
    n AS (SELECT event_id, count(*) OVER (PARTITION BY w, c, o ORDER BY sec RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW) AS client_count,
      count(*) OVER (PARTITION BY w, o ORDER BY sec RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW) AS overall_count FROM s)
    SELECT *, client_count > 2 OR overall_count > 40 AS refused FROM n""",
)
def rate_limit_windows(spark, folder):
    requests = log(spark, folder).select(
        "event_id", (F.col("user_id") % 5).alias("workspace_id"), F.col("user_id").alias("client_id"),
        F.col("event_type").alias("operation"), F.floor(F.col("at") / 1000000).cast("bigint").alias("second"),
    )
    return events.rate_limit(requests, window=3 * DAY, limit=2, global_limit=40)


@query(
    "workflow_fold",
    f"""WITH {LOG_CTE}, r AS (SELECT *, CASE WHEN k % 4 <> 0 THEN k END AS receipt FROM ev),
    f AS (SELECT *, CASE WHEN receipt IS NOT NULL AND row_number() OVER (PARTITION BY user_id, receipt ORDER BY us, event_id) = 1 THEN 1 ELSE 0 END AS fresh FROM r)
    SELECT user_id AS run_id, event_id, event_type AS stage, row_number() OVER w AS sequence, CAST(sum(fresh) OVER w AS BIGINT) AS receipts,
      CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS calls
    FROM f WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)""",
)
def workflow_fold(spark, folder):
    steps = log(spark, folder).select(
        F.col("user_id").alias("run_id"), "event_id", "at", F.col("event_type").alias("stage"),
        F.when(F.col("k") % 4 != 0, F.col("k")).alias("receipt"), (F.col("event_type") == "purchase").alias("is_call"),
    )
    out = events.workflow_fold(steps, width=DAY * 1000000)
    return out.select("run_id", "event_id", "stage", "sequence", "receipts", "calls")


def verification_log(spark, folder):
    k = F.col("k")
    return log(spark, folder).select(
        F.col("user_id").alias("connector_id"), "event_id", "at",
        (F.col("event_type") != "error").alias("resource_ok"), (F.col("event_type") != "signup").alias("connector_ok"),
        (k % 3).alias("canary_count"), (k % 2 == 0).alias("has_cursor"), ((k % 2 == 0) | (k % 5 == 0)).alias("has_sync"),
        F.when(k % 11 == 0, "rate limited").alias("upstream_error"),
    )


@query(
    "connector_state_fold",
    f"""WITH {LOG_CTE}, v AS (SELECT *, event_type NOT IN ('error', 'signup') AS ok, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS n FROM ev),
    s AS (SELECT user_id, ok, k, ok AND k % 3 > 0 AND k % 11 <> 0 AS good FROM v WHERE n = 1),
    g AS (SELECT user_id AS connector_id, CASE WHEN good THEN 'data_verified' WHEN k % 2 = 1 AND ok THEN 'sync_in_progress' ELSE 'degraded' END AS state,
      CASE WHEN good THEN 'data_verified' WHEN NOT ok THEN 'resource_status_failed' WHEN k % 2 = 1 AND k % 5 <> 0 THEN 'sync_evidence_missing' ELSE 'canary_failed' END AS stage, k FROM s)
    SELECT connector_id, state, stage, CASE WHEN state = 'degraded' THEN CASE WHEN k % 11 = 0 THEN 'rate limited' ELSE stage END END AS last_error FROM g""",
)
def connector_state_fold(spark, folder):
    return events.connector_states(verification_log(spark, folder))


@query(
    "ingestion_stage_fold",
    f"""WITH {LOG_CTE} SELECT user_id * 100 + k AS document_id, max_by(event_type, (us, event_id)) AS stage, max(us) - min(us) AS duration FROM ev GROUP BY 1""",
)
def ingestion_stage_fold(spark, folder):
    stages = log(spark, folder).select(
        (F.col("user_id") * 100 + F.col("k")).alias("document_id"), "event_id", "at", F.col("event_type").alias("stage")
    )
    return events.stage_fold(stages)


@query(
    "claim_once",
    f"""WITH {LOG_CTE} SELECT event_id, event_id = min(event_id) OVER (PARTITION BY user_id, k) AS accepted FROM ev""",
)
def claim_once(spark, folder):
    return events.claim_once(log(spark, folder), ["user_id", "k"], "event_id").select("event_id", "accepted")


@query(
    "incremental_rerank",
    f"""WITH {SCORED_CTE}, touched AS (SELECT DISTINCT workspace_id FROM inputs WHERE task_date > DATE '{AS_OF}' - 3)
    SELECT workspace_id, task_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY score DESC, provider, task_id) AS rank
      FROM scored WHERE score > 0 AND workspace_id IN (SELECT workspace_id FROM touched)) t WHERE rank <= 18""",
)
def incremental_rerank(spark, folder):
    from attestry.streaming.folds import rerank_touched

    inputs = order_inputs(spark, folder)
    fresh = inputs.where(F.col("task_date") > F.date_sub(F.to_date(F.lit(AS_OF)), 3))
    return rerank_touched(fresh, inputs).select("workspace_id", "task_id", "score", "rank")


@query(
    "queue_change_diff",
    """WITH m AS (SELECT c_nationkey AS workspace_id, year(o_orderdate) AS snapshot, c_custkey AS item, sum(CAST(floor(o_totalprice) AS BIGINT)) AS amount
      FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, snapshot ORDER BY amount DESC, item) AS rank FROM m) t WHERE rank <= 18),
    s AS (SELECT workspace_id, snapshot, lag(snapshot) OVER (PARTITION BY workspace_id ORDER BY snapshot) AS prev FROM (SELECT DISTINCT workspace_id, snapshot FROM r) d),
    b AS (SELECT s.workspace_id, s.snapshot, item, rank AS old_rank FROM s JOIN r ON r.workspace_id = s.workspace_id AND r.snapshot = s.prev),
    a AS (SELECT s.workspace_id, s.snapshot, item, rank AS new_rank FROM s JOIN r ON r.workspace_id = s.workspace_id AND r.snapshot = s.snapshot WHERE prev IS NOT NULL)
    SELECT * FROM (SELECT *, CASE WHEN old_rank IS NULL THEN 'entered' WHEN new_rank IS NULL THEN 'left' WHEN old_rank <> new_rank THEN 'moved' END AS change
      FROM b FULL JOIN a USING (workspace_id, snapshot, item)) x WHERE change IS NOT NULL""",
)
def queue_change_diff(spark, folder):
    joined = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey")
    )
    amounts = joined.groupBy(
        F.col("c_nationkey").alias("workspace_id"), F.year("o_orderdate").alias("snapshot"), F.col("c_custkey").alias("item")
    ).agg(F.sum(F.floor("o_totalprice").cast("bigint")).alias("amount"))
    ranks = top_k(amounts, ["workspace_id", "snapshot"], [F.desc("amount"), F.asc("item")], 18)
    return events.queue_changes(ranks.select("workspace_id", "snapshot", "item", "rank"))


def result_log(spark, folder):
    status = (
        F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "view", "blocked")
    )
    return log(spark, folder).withColumn("status", status).where(F.col("status").isNotNull()).select(
        (F.col("user_id") * 10 + F.col("k") % 10).alias("packet_id"), "event_id", "at", "status"
    )


@query(
    "packet_status_fold",
    f"""WITH {LOG_CTE}, s AS (SELECT user_id * 10 + k % 10 AS p, max_by(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'blocked' END, (us, event_id)) AS status
      FROM ev WHERE event_type IN ('purchase', 'error', 'view') GROUP BY 1)
    SELECT c_custkey AS packet_id, coalesce(status, 'available') AS status FROM customer LEFT JOIN s ON p = c_custkey""",
)
def packet_status_fold(spark, folder):
    packets = table(spark, folder, "customer").select(F.col("c_custkey").alias("packet_id"))
    return events.packet_status(packets, result_log(spark, folder))
