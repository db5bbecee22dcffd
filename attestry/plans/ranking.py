"""Scoring and ranking queries. Orders stand for tasks, nations for workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import rules
from attestry.operators import ranking
from attestry.operators.shape import latest, top_k
from attestry.plans.fixtures import RECORDS_CTE, records
from attestry.plans.registry import query, quote
from attestry.sources.tables import table

AS_OF = "2001-08-01"


def order_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking input of every order.

    Lines are reduced to one row per order before the join. Corroboration is capped at
    two sources, so min and max of the supplier decide it without a distinct count.
    """
    lines = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
            F.max((F.col("l_linestatus") == "O").cast("int")).alias("any_open"),
            (F.min("l_suppkey") != F.max("l_suppkey")).alias("corroborated"),
        )
    )
    joined = (
        table(spark, folder, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    age = F.datediff(F.to_date(F.lit(AS_OF)), F.to_date("o_orderdate"))
    blocked = F.col("o_orderstatus") == "P"
    fresh = F.when(age <= 1, 4.0).when(age <= 7, 3.0).when(age <= 30, 2.0).otherwise(1.0)
    digit = F.left("o_orderpriority", F.lit(1)).cast("int")
    zero = F.lit(0.0)
    return joined.select(
        F.col("c_nationkey").alias("workspace_id"),
        F.col("c_mktsegment").alias("provider"),
        F.col("o_orderkey").alias("task_id"),
        F.to_date("o_orderdate").alias("task_date"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(blocked, "blocked").otherwise("open").alias("status"),
        F.least(F.lit(20.0), F.floor(F.col("o_totalprice") / 25000).cast("double")).alias("business_impact"),
        F.element_at(F.array(*map(F.lit, [18.0, 14.0, 10.0, 6.0, 3.0])), digit).alias("urgency"),
        F.when(blocked, 15.0).otherwise(5.0).alias("dependency_unlock"),
        F.least(F.lit(12.0), F.greatest(zero, F.floor(F.col("c_acctbal") / 800).cast("double"))).alias("customer_revenue"),
        F.least(F.lit(10.0), (F.col("n_returned") * 3).cast("double")).alias("incident_security"),
        F.when(F.col("any_open") == 1, 8.0).otherwise(4.0).alias("commitment_strength"),
        F.when(F.col("corroborated"), 6.0).otherwise(5.0).alias("authority_reliability"),
        fresh.alias("evidence_freshness"),
        zero.alias("likely_resolved"),
        zero.alias("duplicate"),
        F.when(blocked, 8.0).otherwise(zero).alias("unresolved_dependency"),
        F.when(F.col("n_lines") == 1, 9.0).otherwise(zero).alias("weak_evidence"),
        zero.alias("conflicting_evidence"),
        F.when(fresh == 1, 5.0).otherwise(zero).alias("stale_evidence"),
        F.when(F.col("c_acctbal") < 0, 6.0).otherwise(zero).alias("missing_owner"),
        zero.alias("low_actionability"),
        F.lit(1.0).alias("confidence"),
    )


INPUTS_CTE = f"""
li AS (SELECT l_orderkey, count(*) AS n_lines, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned,
              max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS any_open, count(DISTINCT l_suppkey) AS n_supp
       FROM lineitem GROUP BY 1),
aged AS (SELECT o.*, c.*, li.*, date_diff('day', cast(o_orderdate AS DATE), DATE '{AS_OF}') AS age
         FROM orders o JOIN li ON l_orderkey = o_orderkey JOIN customer c ON c_custkey = o_custkey),
inputs AS (SELECT c_nationkey AS workspace_id, c_mktsegment AS provider, o_orderkey AS task_id,
  CAST(o_orderdate AS DATE) AS task_date,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'blocked' ELSE 'open' END AS status,
  CAST(least(20, floor(o_totalprice / 25000)) AS DOUBLE) AS business_impact,
  CAST(CASE o_orderpriority[1] WHEN '1' THEN 18 WHEN '2' THEN 14 WHEN '3' THEN 10 WHEN '4' THEN 6 ELSE 3 END AS DOUBLE) AS urgency,
  CASE WHEN o_orderstatus = 'P' THEN 15e0 ELSE 5e0 END AS dependency_unlock,
  CAST(least(12, greatest(0, floor(c_acctbal / 800))) AS DOUBLE) AS customer_revenue,
  CAST(least(10, 3 * n_returned) AS DOUBLE) AS incident_security,
  CASE WHEN any_open = 1 THEN 8e0 ELSE 4e0 END AS commitment_strength,
  CAST(least(6, 4 + n_supp) AS DOUBLE) AS authority_reliability,
  CASE WHEN age <= 1 THEN 4e0 WHEN age <= 7 THEN 3e0 WHEN age <= 30 THEN 2e0 ELSE 1e0 END AS evidence_freshness,
  0e0 AS likely_resolved, 0e0 AS duplicate,
  CASE WHEN o_orderstatus = 'P' THEN 8e0 ELSE 0e0 END AS unresolved_dependency,
  CASE WHEN n_lines = 1 THEN 9e0 ELSE 0e0 END AS weak_evidence, 0e0 AS conflicting_evidence,
  CASE WHEN age > 30 THEN 5e0 ELSE 0e0 END AS stale_evidence,
  CASE WHEN c_acctbal < 0 THEN 6e0 ELSE 0e0 END AS missing_owner, 0e0 AS low_actionability
  FROM aged)"""

COMPONENTS_SQL = {
    "urgency_deadline": "urgency / 18e0 * 25e0",
    "customer_operational_impact": "greatest(business_impact / 20e0, customer_revenue / 12e0, incident_security / 10e0) * 25e0",
    "explicit_commitment": "commitment_strength / 8e0 * 15e0",
    "dependency_blocking": "dependency_unlock / 16e0 * 15e0",
    "source_corroboration": "authority_reliability / 6e0 * 10e0",
    "recency": "evidence_freshness / 4e0 * 10e0",
}
POSITIVE_SQL = " + ".join(f"({c})" for c in COMPONENTS_SQL.values())
NEGATIVE_SQL = "(" + " + ".join(rules.PENALTIES) + ")"
SCORE_SQL = (
    f"least(100e0, greatest(0e0, floor(({POSITIVE_SQL} - {NEGATIVE_SQL} - "
    "(CASE WHEN status IN ('completed', 'cancelled') THEN 100e0 ELSE 0e0 END)) * 100 + 0.5e0) / 100e0))"
)
BAND_SQL = "CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'normal' ELSE 'low' END"
SCORED_CTE = f"{INPUTS_CTE}, scored AS (SELECT *, {SCORE_SQL} AS score FROM inputs)"
QUEUE_CTE = f"""{SCORED_CTE}, queue AS (SELECT *, {BAND_SQL} AS band FROM (SELECT *,
  row_number() OVER (PARTITION BY workspace_id ORDER BY score DESC, provider, task_id) AS rank
  FROM scored WHERE score > 0) t WHERE rank <= 18)"""


def order_queue(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.queue(order_inputs(spark, folder))


@query(
    "queue_topk",
    f"WITH {QUEUE_CTE} SELECT workspace_id, provider, task_id, status, score, band, rank FROM queue",
)
def queue_topk(spark, folder):
    return order_queue(spark, folder).select("workspace_id", "provider", "task_id", "status", "score", "band", "rank")


def _tenths(x: str) -> str:
    return (
        f"concat(CAST(CAST(floor({x} * 10 + 0.5e0) AS BIGINT) // 10 AS VARCHAR), '.', "
        f"CAST(CAST(floor({x} * 10 + 0.5e0) AS BIGINT) % 10 AS VARCHAR))"
    )


@query(
    "priority_score",
    f"""WITH {SCORED_CTE} SELECT workspace_id, task_id, status, score, {BAND_SQL} AS band,
    concat('Positive components total ', {_tenths('(' + POSITIVE_SQL + ')')}, '. ',
      CASE WHEN {NEGATIVE_SQL} > 0 THEN concat('Evidence and execution penalties total ', {_tenths(NEGATIVE_SQL)}, '.')
           ELSE 'No ranking penalties applied.' END, ' ',
      CASE WHEN status = 'completed' THEN 'Confirmed completed or cancelled work is not actionable.'
           ELSE 'Item remains actionable.' END) AS explanation FROM scored""",
)
def priority_score(spark, folder):
    from attestry.functions import scoring

    return ranking.with_score(order_inputs(spark, folder)).select(
        "workspace_id", "task_id", "status", "score", "band", scoring.explanation().alias("explanation")
    )


def _sig(name: str) -> str:
    """One hit of a signal without a negation in the 40 characters before it."""
    marked = f"regexp_replace(body, {quote('(?i)' + rules.SIGNALS[name])}, chr(1) || '\\0' || chr(2), 'g')"
    return f"""coalesce(len(list_filter(range(1, len(string_split({marked}, chr(1)))), lambda i:
      NOT regexp_matches(right(replace(array_to_string(string_split({marked}, chr(1))[1:i], ''), chr(2), ''), 40),
      {quote(rules.NEGATION)}))) > 0, false)"""


@query(
    "signal_features",
    f"""WITH {RECORDS_CTE}, b AS (SELECT record_id, concat(title, ' ', excerpt) AS body FROM records
      UNION ALL SELECT concat('doc-', doc_id), text FROM documents)
    SELECT record_id, {', '.join(f'{_sig(n)} AS is_{n}' for n in rules.SIGNALS)},
      regexp_matches(body, {quote(rules.COMMITMENT)}) AS is_commitment,
      regexp_matches(body, {quote(rules.ACTIONABLE)}) AS is_actionable FROM b""",
)
def signal_features(spark, folder):
    from attestry.functions import text

    rec = records(spark, folder).select("record_id", F.concat_ws(" ", "title", "excerpt").alias("body"))
    docs = table(spark, folder, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("record_id"), F.col("text").alias("body")
    )
    body = F.col("body")
    return rec.unionByName(docs).select(
        "record_id",
        *[text.signal(body, regex).alias(f"is_{n}") for n, regex in rules.SIGNALS.items()],
        text.matches(body, rules.COMMITMENT).alias("is_commitment"),
        text.matches(body, rules.ACTIONABLE).alias("is_actionable"),
    )


@query(
    "ranking_features",
    f"""WITH {RECORDS_CTE}, b AS (SELECT *, concat(title, ' ', excerpt) AS body,
        date_diff('day', source_date, DATE '{AS_OF}') AS age FROM records),
    f AS (SELECT *, {', '.join(f'{_sig(n)} AS is_{n}' for n in rules.SIGNALS)},
      regexp_matches(body, {quote(rules.COMMITMENT)}) AS is_commitment,
      regexp_matches(body, {quote(rules.ACTIONABLE)}) AS is_actionable,
      regexp_matches(body, {quote(rules.CLOSED_STATUS)}) AS is_closed,
      regexp_matches(body, {quote(rules.QUICK_WIN)}) AS is_quick,
      CASE WHEN age <= 1 THEN 4e0 WHEN age <= 7 THEN 3e0 WHEN age <= 30 THEN 2e0 ELSE 1e0 END AS fresh FROM b)
    SELECT record_id, CASE WHEN is_closed THEN 'completed' WHEN is_dependency THEN 'blocked' ELSE 'open' END AS status,
      CASE WHEN is_security OR is_customer THEN 18e0 WHEN is_urgent THEN 14e0 ELSE 9e0 END AS business_impact,
      CASE WHEN is_urgent THEN 17e0 ELSE 10e0 END AS urgency,
      CASE WHEN is_dependency THEN 15e0 ELSE 5e0 END AS dependency_unlock,
      CASE WHEN is_customer THEN 11e0 ELSE 2e0 END AS customer_revenue,
      CASE WHEN is_security THEN 10e0 ELSE 0e0 END AS incident_security,
      CASE WHEN is_commitment THEN 8e0 ELSE 4e0 END AS commitment_strength,
      5e0 AS authority_reliability, fresh AS evidence_freshness,
      CASE WHEN is_quick THEN 5e0 ELSE 2e0 END AS quick_win_leverage,
      CASE WHEN is_closed THEN 40e0 ELSE 0e0 END + CASE WHEN is_dependency THEN 8e0 ELSE 0e0 END
        + CASE WHEN length(excerpt) < 40 THEN 9e0 ELSE 0e0 END + CASE WHEN fresh = 1 THEN 5e0 ELSE 0e0 END
        + CASE WHEN owner IS NULL THEN 6e0 ELSE 0e0 END + CASE WHEN is_actionable THEN 0e0 ELSE 8e0 END AS penalty_total,
      (CAST(is_actionable AS INT) + CAST(owner IS NOT NULL AS INT) + 1 + CAST(url IS NOT NULL AS INT)) / 4e0 AS confidence
    FROM f""",
)
def ranking_features(spark, folder):
    from attestry.functions import scoring

    spans = records(spark, folder).withColumn("span", F.col("excerpt"))
    out = ranking.evidence_features(spans, F.to_date(F.lit(AS_OF)))
    return out.select(
        "record_id", "status", "business_impact", "urgency", "dependency_unlock", "customer_revenue",
        "incident_security", "commitment_strength", "authority_reliability", "evidence_freshness",
        "quick_win_leverage", scoring.penalty_total().alias("penalty_total"), "confidence",
    )


@query(
    "policy_validate",
    f"""WITH {SCORED_CTE}, p AS (SELECT concat('policy-', s_suppkey // 5) AS policy_id, 20e0 + (s_suppkey % 50) // 48 AS weight FROM supplier)
    SELECT policy_id, sum(weight) AS total_weight FROM p GROUP BY 1 HAVING abs(sum(weight) - 100) > 0.001""",
)
def policy_validate(spark, folder):
    weights = table(spark, folder, "supplier").select(
        F.expr("concat('policy-', s_suppkey div 5)").alias("policy_id"),
        F.expr("20D + (s_suppkey % 50) div 48").alias("weight"),
    )
    return ranking.policy_errors(weights)


_DELTA_SQL = ", ".join(
    f"({c}) - lead({c}) OVER (PARTITION BY workspace_id ORDER BY rank) AS d_{n}" for n, c in COMPONENTS_SQL.items()
)
_GAPS_SQL = ", ".join(
    f"{{'size': -abs(d_{n}), 'at': {i}, 'txt': concat('{n}=', CAST(floor(d_{n} * 100 + 0.5e0) AS BIGINT)), 'label': concat(CASE WHEN d_{n} > 0 THEN '+' ELSE '' END, "
    f"regexp_replace(CAST(CAST(floor(d_{n} * 100 + 0.5e0) / 100 AS DECIMAL(12, 2)) AS VARCHAR), '\\.?0+$', ''), ' {rules.COMPONENT_LABELS.get(n, n)}')}}"
    for i, n in enumerate(COMPONENTS_SQL)
)


@query(
    "why_above_next",
    f"""WITH {QUEUE_CTE}, d AS (SELECT workspace_id, rank, task_id AS leader_id,
      lead(task_id) OVER (PARTITION BY workspace_id ORDER BY rank) AS runner_up_id,
      floor((score - lead(score) OVER (PARTITION BY workspace_id ORDER BY rank)) * 100 + 0.5e0) / 100e0 AS score_delta, {_DELTA_SQL}
      FROM queue)
    SELECT workspace_id, rank, leader_id, runner_up_id, score_delta,
      array_to_string(list_transform(list_sort(list_filter([{_GAPS_SQL}], lambda g: g.size <> 0)), lambda g: g.txt), ';') AS components,
      array_to_string(list_transform(list_sort(list_filter([{_GAPS_SQL}], lambda g: g.size <> 0)), lambda g: g.label), '; ') AS labels,
      CASE WHEN score_delta = 0 THEN 'Both items score identically under this policy; the tie is broken by identifier.' ELSE concat('Leads by ', regexp_replace(CAST(CAST(abs(score_delta) AS DECIMAL(12, 2)) AS VARCHAR), '\\.?0+$', ''), ' points.') END AS summary
    FROM d WHERE runner_up_id IS NOT NULL""",
)
def why_above_next(spark, folder):
    return ranking.why_above_next(order_queue(spark, folder))


_CF = {
    "deadline_urgency": {"urgency": "18e0"},
    "customer_revenue": {"customer_revenue": "0e0"},
    "dependency_unlock": {"dependency_unlock": "0e0"},
    "blocker_resolved": {"unresolved_dependency": "0e0", "status": "'open'"},
    "status": {"status": "'completed'"},
}


def _cf_select(kind: str, changes: dict[str, str]) -> str:
    replaced = ", ".join(f"{v} AS {k}" for k, v in changes.items())
    return (
        f"SELECT workspace_id, task_id, '{kind}' AS kind, score AS score_before, {SCORE_SQL} AS score_after "
        f"FROM (SELECT * REPLACE ({replaced}) FROM scored) p"
    )


@query(
    "counterfactual",
    f"""WITH {SCORED_CTE}, u AS ({' UNION ALL '.join(_cf_select(k, v) for k, v in _CF.items())})
    SELECT *, floor((score_after - score_before) * 100 + 0.5e0) / 100e0 AS delta, score_after <> score_before AS changed FROM u""",
)
def counterfactual(spark, folder):
    return ranking.counterfactual(order_inputs(spark, folder))


_CENTS = ", ".join(f"CAST(CAST(floor({n} * 100 + 0.5e0) AS BIGINT) AS VARCHAR)" for n in ranking.FEATURES + rules.PENALTIES)


@query(
    "replay_check",
    f"""WITH {SCORED_CTE} SELECT workspace_id, task_id,
      CASE WHEN task_id % 97 = 0 THEN score + 1 ELSE score END AS stored_score, score AS replayed_score,
      sha256(concat_ws('|', CAST(task_id AS VARCHAR), status, {_CENTS})) AS input_hash,
      task_id % 97 = 0 AS drift FROM scored""",
)
def replay_check(spark, folder):
    inputs = order_inputs(spark, folder)
    # A stored run in which every 97th score was tampered with.
    stored = ranking.with_score(inputs).select(
        "workspace_id", "task_id",
        F.when(F.col("task_id") % 97 == 0, F.col("score") + 1).otherwise(F.col("score")).alias("stored_score"),
    )
    return ranking.replay(stored, inputs)


@query(
    "freshness_bucket",
    """WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(floor(epoch(ts)) AS BIGINT) END AS verified,
        CAST(epoch(TIMESTAMP '2024-01-20 00:00:00') AS BIGINT) AS as_of FROM events),
    a AS (SELECT *, CASE WHEN verified IS NOT NULL THEN greatest(0, as_of - verified) END AS age FROM e)
    SELECT event_id, CASE WHEN verified IS NULL THEN 'unverified' WHEN age <= 604800 THEN 'current' ELSE 'stale' END AS proof,
      floor(age / 3600e0 * 10 + 0.5e0) / 10e0 AS age_hours, verified + 604800 AS expires_at,
      CASE WHEN age IS NULL THEN 1 WHEN age <= 86400 THEN 4 WHEN age <= 604800 THEN 3 WHEN age <= 2592000 THEN 2 ELSE 1 END AS freshness
    FROM a""",
)
def freshness_bucket(spark, folder):
    as_of = F.unix_seconds(F.lit("2024-01-20 00:00:00").cast("timestamp"))
    events = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.unix_seconds(F.col("ts").cast("timestamp"))).alias("verified"),
    )
    age = ranking.proof_freshness(events, "verified", as_of)
    return age.withColumn("age_hours", F.when(F.col("verified").isNotNull(), F.col("age_hours"))).select(
        "event_id", "proof", "age_hours", "expires_at",
        F.when(F.col("verified").isNull(), 1).otherwise(F.col("freshness")).alias("freshness"),
    )


@query(
    "recency_minmax",
    """WITH e AS (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) END AS t FROM events),
    b AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS lo, max(t) OVER (PARTITION BY user_id) AS hi FROM e WHERE t IS NOT NULL)
    SELECT event_id, user_id, floor((t - lo) / CAST(hi - lo AS DOUBLE) * 10000 + 0.5e0) / 10000e0 AS recency FROM b WHERE hi > lo""",
)
def recency_minmax(spark, folder):
    from attestry.functions import scoring

    events = table(spark, folder, "events").select(
        "event_id", "user_id",
        F.when(F.col("event_type") != "error", F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"),
    )
    out = ranking.recency_factor(events, "user_id", "t")
    return out.select("event_id", "user_id", scoring.round_half_up(F.col("recency"), 4).alias("recency"))


@query(
    "latest_per_task",
    f"""WITH {SCORED_CTE}, h AS (SELECT l_partkey AS task_id, l_shipdate AS created, l_orderkey AS run, l_linenumber AS line,
      floor(l_extendedprice) AS score FROM lineitem),
    t AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created DESC, run DESC, line DESC) AS n FROM h)
    SELECT a.task_id AS first_task, b.task_id AS second_task, a.score AS first_score, b.score AS second_score,
      a.score - b.score AS delta FROM t a JOIN t b ON b.task_id = a.task_id + 1 AND b.n = 1 WHERE a.n = 1""",
)
def latest_per_task(spark, folder):
    history = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("task_id"), F.col("l_shipdate").alias("created"),
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("line"),
        F.floor("l_extendedprice").cast("double").alias("score"),
    )
    newest = latest(history, ["task_id"], ["created", "run", "line"]).select("task_id", "score")
    other = newest.select((F.col("task_id") - 1).alias("prior"), F.col("task_id").alias("second_task"),
                          F.col("score").alias("second_score"))
    return newest.join(other, F.col("task_id") == F.col("prior")).select(
        F.col("task_id").alias("first_task"), "second_task", F.col("score").alias("first_score"), "second_score",
        (F.col("score") - F.col("second_score")).alias("delta"),
    )


@query(
    "queue_sort_modes",
    f"""WITH {QUEUE_CTE}, q AS (SELECT workspace_id, task_id, score,
      CASE WHEN task_id % 3 = 0 THEN task_date + 14 END AS deadline, task_date,
      (CASE WHEN status = 'open' THEN 1 ELSE 0 END + CASE WHEN band = 'critical' THEN 1 ELSE 0 END) / 2e0 AS confidence FROM queue)
    SELECT workspace_id, task_id,
      row_number() OVER (PARTITION BY workspace_id ORDER BY score DESC, task_id) AS by_score,
      row_number() OVER (PARTITION BY workspace_id ORDER BY confidence DESC, task_id) AS by_confidence,
      row_number() OVER (PARTITION BY workspace_id ORDER BY deadline ASC NULLS LAST, task_id) AS by_deadline,
      row_number() OVER (PARTITION BY workspace_id ORDER BY task_date DESC, task_id) AS by_newest FROM q""",
)
def queue_sort_modes(spark, folder):
    from pyspark.sql import Window

    q = order_queue(spark, folder).withColumns(
        {
            "deadline": F.when(F.col("task_id") % 3 == 0, F.date_add("task_date", 14)),
            "confidence": ((F.col("status") == "open").cast("int") + (F.col("band") == "critical").cast("int")) / 2.0,
        }
    )

    def place(order):
        return F.row_number().over(Window.partitionBy("workspace_id").orderBy(order, "task_id"))

    return q.select(
        "workspace_id", "task_id",
        place(F.desc("score")).alias("by_score"),
        place(F.desc("confidence")).alias("by_confidence"),
        place(F.asc_nulls_last("deadline")).alias("by_deadline"),
        place(F.desc("task_date")).alias("by_newest"),
    )


@query(
    "evidence_timeline",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) END AS t FROM events)
    SELECT user_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t ASC NULLS LAST, event_id) AS place FROM e) x
    WHERE place <= 10""",
)
def evidence_timeline(spark, folder):
    events = table(spark, folder, "events").select(
        "user_id", "event_id",
        F.when(F.col("event_type") != "error", F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"),
    )
    first = top_k(events, ["user_id"], [F.asc_nulls_last("t"), F.asc("event_id")], 10, rank="place")
    return first.select("user_id", "event_id", "place")
