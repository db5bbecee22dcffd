"""Evaluation, rollup and check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import rules
from attestry.functions import text
from attestry.operators import evaluate, events, ranking
from attestry.plans.eventlog import LOG_CTE, log
from attestry.plans.evidence import clean_sql
from attestry.plans.fixtures import RECORDS_CTE, records
from attestry.plans.ranking import SCORED_CTE, order_inputs
from attestry.plans.registry import query, quote, sql_list
from attestry.session import written_table
from attestry.sources.tables import spread, table


def _count():
    return F.count(F.lit(1))


def routed(spark, folder):
    """Labels as routed cases: quality says what was expected, toxic what was predicted."""
    mode = lambda c: F.when(F.col(c) == 1, "thinking").otherwise("fast")
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("category"))
    return table(spark, folder, "labels").join(docs, "doc_id").select(
        "doc_id", "category", mode("quality").alias("expected"), mode("toxic").alias("predicted")
    )


@query(
    "router_metrics",
    """WITH c AS (SELECT source AS category, quality = 1 AS e, toxic = 1 AS p FROM labels JOIN documents USING (doc_id))
    SELECT coalesce(category, 'all') AS category, count(*) AS total, count(*) FILTER (e = p) AS correct, count(*) FILTER (p) AS predicted_thinking,
      count(*) FILTER (e) AS expected_thinking, count(*) FILTER (p AND NOT e) AS over_escalated, count(*) FILTER (e AND NOT p) AS under_escalated,
      floor(count(*) FILTER (e = p) / CAST(count(*) AS DOUBLE) * 10000 + 0.5e0) / 10000e0 AS accuracy FROM c GROUP BY ROLLUP (category)""",
)
def router_metrics(spark, folder):
    return evaluate.router_metrics(routed(spark, folder))


def _cases(spark, folder):
    """Documents as evaluation cases with a category and the providers they need."""
    providers = F.array_compact(
        F.array(*[F.when(F.col("doc_id") % (i + 2) == 0, F.lit(p)) for i, p in enumerate(rules.EVAL_PROVIDERS)])
    )
    category = F.element_at(F.array(*map(F.lit, rules.EVAL_CATEGORIES)), (F.col("doc_id") % 15 + 1).cast("int"))
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("case_id"), category.alias("category"), providers.alias("required_providers")
    )


_CAT = f"([{sql_list(rules.EVAL_CATEGORIES)}])[doc_id % 15 + 1]"


@query(
    "provider_gap",
    """SELECT provider, count(*) AS n_cases FROM (SELECT 'linear' AS provider FROM documents WHERE doc_id % 4 = 0
      UNION ALL SELECT 'github' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT 'document' FROM documents WHERE doc_id % 6 = 0) t GROUP BY 1""",
)
def provider_gap(spark, folder):
    return evaluate.provider_gap(_cases(spark, folder), ["slack", "gmail"])


@query(
    "coverage_buckets",
    f"""WITH c AS (SELECT doc_id, {_CAT} AS category FROM documents), d AS (SELECT 'total' AS dimension FROM c
      UNION ALL SELECT 'document_pdf' FROM c WHERE category = 'large-pdf' OR doc_id % 6 = 0 {''.join(f" UNION ALL SELECT '{k}' FROM c WHERE category IN ({sql_list(v)})" for k, v in rules.COVERAGE_DIMENSIONS.items())})
    SELECT dimension, count(*) AS n, count(*) >= 200 AS enough FROM d GROUP BY 1""",
)
def coverage_buckets(spark, folder):
    return evaluate.coverage(_cases(spark, folder), 200)


def _grade_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(
    "fact_match",
    f"""WITH {RECORDS_CTE}, n AS (SELECT record_id, {_grade_sql('excerpt')} AS t FROM records)
    SELECT record_id, 'state' AS fact_id, contains(t, 'is resolved') OR contains(t, 'still open') AS matched FROM n
    UNION ALL SELECT record_id, 'risk', (contains(t, 'customer') OR contains(t, 'client')) AND (contains(t, 'blocked') OR contains(t, 'impact')) FROM n""",
)
def fact_match(spark, folder):
    arr = lambda *xs: F.array(*map(F.lit, xs))
    none, no_groups = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    facts = F.array(
        F.struct(F.lit("state").alias("fact_id"), arr("is resolved", "Still open!").alias("any_of"), no_groups.alias("all_of")),
        F.struct(F.lit("risk").alias("fact_id"), none.alias("any_of"),
                 F.array(arr("customer", "client"), arr("blocked", "impact")).alias("all_of")),
    )
    from attestry.functions import text

    each = records(spark, folder).select(
        "record_id", text.grade_text(F.col("excerpt")).alias("corpus"), F.explode(facts).alias("f")
    )
    matched = evaluate.fact_matched(F.col("corpus"), F.col("f.any_of"), F.col("f.all_of"))
    return each.select("record_id", "f.fact_id", matched.alias("matched"))


def _cited_records(spark, folder):
    """The records as claims and citations of their customer; written once, since every step reads them."""
    rec = written_table(records(spark, folder).select("cust", "seq", "record_id", "provider", "title", "excerpt"))
    case = F.col("cust").alias("case_id")
    first = F.substring_index("excerpt", ". ", 1)
    claims = rec.select(
        case, F.col("seq").alias("claim_no"), first.alias("claim"),
        F.array(F.when(F.col("seq") % 70 == 0, F.lit("rec-none")).otherwise(F.col("record_id"))).alias("citation_ids"),
        F.array(F.when(F.col("seq") % 110 == 1, F.lit("notion")).otherwise(F.col("provider"))).alias("providers"),
    )
    return rec, claims, rec.select(case, F.col("record_id").alias("citation_id"), "provider", "title", "excerpt")


def _first_states():
    """First record of a customer that reports its item resolved, and first that reports it open."""
    first = lambda digit, name: F.min(F.when(F.col("seq") % 10 == digit, F.col("record_id"))).alias(name)
    return [first(1, "done"), first(2, "open")]


def _item():
    return F.concat(F.lit("ENG-"), F.col("case_id").cast("string"))


def _conflicts(base):
    """Contradictions of customers whose item is reported both resolved and open."""
    return base.where("done IS NOT NULL AND open IS NOT NULL").select(
        "case_id", F.lit(1).alias("conflict_no"),
        F.concat(F.lit("github reports "), _item(), F.lit(" is resolved while linear reports "), _item(), F.lit(" still open.")).alias("summary"),
        F.array("done", "open").alias("evidence_ids"),
    )


def conflicts(spark, folder):
    """The contradictions of :func:`answers` alone."""
    return _conflicts(records(spark, folder).groupBy(F.col("cust").alias("case_id")).agg(*_first_states()))


def answers(spark, folder):
    """One graded case per customer: the records about its ``ENG`` item as claims and citations."""
    rec, claims, citations = _cited_records(spark, folder)
    base = written_table(rec.groupBy(F.col("cust").alias("case_id")).agg(
        F.min_by("excerpt", "seq").alias("answer"), F.max(F.col("seq") % 2).alias("odd"), *_first_states()
    ))
    fact = F.struct(
        F.lit("item").alias("fact_id"), F.array(_item()).alias("any_of"), F.array().cast("array<array<string>>").alias("all_of")
    )
    cases = base.select(
        "case_id", "answer", F.array(fact).alias("facts"), F.array(F.lit("slack")).alias("required_providers"),
        F.array(F.lit("slack"), F.lit("github")).alias("provider_coverage"), (F.col("odd") == 1).alias("needs_contradiction"),
    )
    return cases, claims, citations, _conflicts(base)


_CLAIMS_CTE = f"""{RECORDS_CTE}, k AS (SELECT cust AS case_id, seq, record_id, provider, excerpt, split_part(excerpt, '. ', 1) AS claim,
   seq % 70 <> 0 AS resolves, seq % 70 <> 0 AND seq % 110 <> 1 AS supports FROM records)"""


@query(
    "claim_support",
    f"""WITH {_CLAIMS_CTE} SELECT case_id, count(*) AS n_claims, CAST(count(*) AS BIGINT) AS n_pairs, count(*) FILTER (supports) AS n_supported_pairs, count(*) FILTER (supports) AS n_supported_claims,
      count(*) FILTER (NOT resolves) AS n_invalid, floor(count(*) FILTER (supports) / CAST(count(*) AS DOUBLE) * 10000 + 0.5e0) / 10000e0 AS citation_precision,
      floor(count(*) FILTER (supports) / CAST(count(*) AS DOUBLE) * 10000 + 0.5e0) / 10000e0 AS citation_completeness FROM k GROUP BY 1""",
)
def claim_support(spark, folder):
    _, claims, citations = _cited_records(spark, folder)
    return evaluate.claim_support(evaluate.claim_citations(claims, citations))


@query(
    "contradiction_support",
    f"""WITH {RECORDS_CTE}, d AS (SELECT cust, min(record_id) FILTER (seq % 10 = 1) AS a, min(record_id) FILTER (seq % 10 = 2) AS b FROM records GROUP BY 1)
    SELECT cust AS case_id, 1 AS conflict_no, 2 AS n_ids, 2 AS n_resolved, 2 AS n_providers, true AS holds FROM d WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def contradiction_support(spark, folder):
    return evaluate.supported_contradictions(*evaluate.assessed(*answers(spark, folder)))


@query(
    "case_grade",
    f"""WITH {_CLAIMS_CTE}, c AS (SELECT case_id, max(seq % 2) = 1 AS needs, min_by(seq % 10 IN (0, 1, 2, 4), seq) AS fact, bool_and(seq % 10 IN (0, 1, 2)) AS relevant, bool_and(supports) AS cited,
        coalesce(bool_or(seq % 10 = 1) AND bool_or(seq % 10 = 2), false) AS conflict, bool_or(provider = 'slack' AND supports AND seq % 10 IN (0, 1, 2)) AS slack,
        bool_or(provider = 'github' AND supports AND seq % 10 IN (0, 1, 2)) AS gh, bool_or(provider = 'linear' AND supports AND seq % 10 IN (0, 1, 2)) AS lin FROM k GROUP BY 1),
    x AS (SELECT *, gh OR conflict AS g2, lin OR conflict AS l2 FROM c)
    SELECT case_id, fact AS fact_pass, slack AS provider_pass, cited AS citation_pass, relevant AS relevance_pass, NOT needs OR conflict AS contradiction_pass,
      CASE WHEN slack THEN '' ELSE 'slack' END AS missing_providers, array_to_string(list_filter([CASE WHEN NOT g2 THEN 'github' END, CASE WHEN NOT slack THEN 'slack' END], lambda p: p IS NOT NULL), ',') AS reported_unsupported,
      CASE WHEN l2 THEN 'linear' ELSE '' END AS cited_unreported, fact AND relevant AND slack AND cited AND (NOT needs OR conflict) AS pass FROM x""",
)
def case_grade(spark, folder):
    return evaluate.grade(*answers(spark, folder))


@query(
    "quality_ratios",
    """WITH l AS (SELECT l_suppkey AS run_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS matched, 1 AS facts, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS supported,
      CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE 1 END AS claims FROM lineitem)
    SELECT run_id, floor(sum(matched) / CAST(sum(facts) AS DOUBLE) * 10000 + 0.5e0) / 10000e0 AS fact_recall,
      CASE WHEN sum(claims) > 0 THEN floor(sum(supported) / CAST(sum(claims) AS DOUBLE) * 10000 + 0.5e0) / 10000e0 END AS completeness FROM l GROUP BY 1""",
)
def quality_ratios(spark, folder):
    flag = lambda c: c.cast("int")
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("run_id"), flag(F.col("l_returnflag") == "R").alias("matched"), F.lit(1).alias("facts"),
        flag(F.col("l_linestatus") == "F").alias("supported"), flag(F.col("l_suppkey") % 7 != 0).alias("claims"),
    )
    return evaluate.quality_ratios(rows, "run_id", {"fact_recall": ("matched", "facts"), "completeness": ("supported", "claims")})


def _pct(f: float, name: str) -> str:
    return (
        f"max(ms) FILTER (r = greatest(1, least(n, CAST(ceil(n * {f}e0) AS BIGINT)))) AS {name}, "
        f"max(ms) FILTER (r = least(n - 1, CAST(floor(n * {f}e0) AS BIGINT)) + 1) AS {name}_floor"
    )


@query(
    "latency_percentiles",
    f"""WITH v AS (SELECT event_type AS mode, CAST(floor(value * 100 + 0.5e0) AS BIGINT) AS ms FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY ms) AS r, count(*) OVER (PARTITION BY mode) AS n FROM v)
    SELECT mode, max(n) AS n, min(ms) AS min, max(ms) AS max, {_pct(0.5, 'p50')}, {_pct(0.95, 'p95')} FROM r GROUP BY 1""",
)
def latency_percentiles(spark, folder):
    runs = table(spark, folder, "events").select(
        F.col("event_type").alias("mode"), F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("ms")
    )
    return events.exact_percentiles(runs, "mode", "ms", 1000, {"p50": 0.5, "p95": 0.95})


@query(
    "mode_comparison",
    f"""WITH {LOG_CTE}, f AS (SELECT user_id % 5 AS run_key, user_id AS n, concat('c', user_id) AS id, count_if(value > 50) > 0 AS ok, count(*) AS cost FROM ev WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3),
    t AS (SELECT user_id % 5 AS run_key, user_id AS n, concat(CASE WHEN user_id % 5 = 3 AND user_id % 2 = 0 THEN 'x' ELSE 'c' END, user_id) AS id, count_if(value > 50) > 0 AS ok, count(*) * 3 AS cost
      FROM ev WHERE event_type IN ('error', 'purchase', 'signup') AND user_id % 5 <> 4 GROUP BY 1, 2, 3),
    b AS (SELECT coalesce(f.run_key, t.run_key) AS run_key, f.id AS fi, t.id AS ti, f.ok AS fo, t.ok AS tok, f.cost AS fc, t.cost AS tc FROM f FULL JOIN t ON t.run_key = f.run_key AND t.n = f.n),
    s AS (SELECT run_key, count(fi) AS fast_cases, count(ti) AS thinking_cases, count_if(fi IS DISTINCT FROM ti) AS case_mismatches,
      count_if(coalesce(tok, false)) - count_if(coalesce(fo, false)) AS dp, sum(tc) - sum(fc) AS dc FROM b GROUP BY 1),
    u AS (SELECT *, CASE WHEN fast_cases = 0 OR thinking_cases = 0 THEN 'partial' WHEN case_mismatches > 0 THEN 'incompatible' ELSE 'measured' END AS status FROM s)
    SELECT run_key, fast_cases, thinking_cases, case_mismatches, status, CASE WHEN status = 'measured' THEN dp END AS delta_passes, CASE WHEN status = 'measured' THEN CAST(dc AS BIGINT) END AS delta_cost FROM u""",
)
def mode_comparison(spark, folder):
    rows = log(spark, folder)

    def run(part, weight, ident):
        grouped = part.groupBy((F.col("user_id") % 5).alias("run_key"), F.col("user_id").alias("case_no")).agg(
            (F.count_if(F.col("value") > 50) > 0).alias("passed"), (_count() * weight).alias("cost_units")
        )
        return grouped.select(
            "run_key", "case_no", F.concat(ident, "case_no").alias("case_id"), F.lit("site").alias("target"),
            F.lit("r1").alias("release"), "passed", "cost_units",
        )

    fast = run(rows.where(F.col("event_type").isin("click", "view")), 1, F.lit("c"))
    renamed = F.when((F.col("run_key") == 3) & (F.col("case_no") % 2 == 0), "x").otherwise("c")
    slow = run(rows.where(F.col("event_type").isin("error", "purchase", "signup") & (F.col("user_id") % 5 != 4)), 3, renamed)
    return evaluate.compare_modes(fast, slow)


@query(
    "canary_pivot",
    """WITH l AS (SELECT source, doc_id, quality = 1 AS ok, doc_id % 4 AS m FROM labels JOIN documents USING (doc_id))
    SELECT source, coalesce(min_by(ok, doc_id) FILTER (m = 0), false) AS beginning, coalesce(min_by(ok, doc_id) FILTER (m = 1), false) AS middle,
      coalesce(min_by(ok, doc_id) FILTER (m = 2), false) AS "end" FROM l GROUP BY 1""",
)
def canary_pivot(spark, folder):
    kinds = F.array(*map(F.lit, [*rules.CANARY_KINDS.values(), "table_lookup"]))
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "source"), "doc_id").select(
        "source", F.col("doc_id").alias("seq"), (F.col("quality") == 1).alias("passed"),
        F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("kind"),
    )
    return evaluate.canaries(rows, "source")


@query(
    "topk_order_check",
    f"""WITH {SCORED_CTE}, c AS (SELECT o_custkey AS case_id, task_id, status, score, o_totalprice FROM scored JOIN orders ON o_orderkey = task_id),
    e AS (SELECT case_id, arg_max(task_id, (floor(o_totalprice), -task_id)) AS expected_top FROM c GROUP BY 1),
    g AS (SELECT case_id, count(*) AS n_candidates, arg_max(task_id, (score, -task_id)) AS observed_top, bool_and(score BETWEEN 0 AND 100) AS bounded,
      bool_and(status <> 'completed' OR score = 0) AS inert_closed FROM c GROUP BY 1)
    SELECT g.*, expected_top, observed_top = expected_top AS order_pass FROM g JOIN e USING (case_id) WHERE n_candidates >= 2""",
)
def topk_order_check(spark, folder):
    scored = ranking.with_score(order_inputs(spark, folder)).select("task_id", "status", "score")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("case_id"), F.floor("o_totalprice").alias("amount")
    )
    candidates = scored.join(orders, "task_id")
    expected = candidates.groupBy("case_id").agg(
        F.max_by("task_id", F.struct(F.col("amount"), -F.col("task_id"))).alias("expected_top")
    )
    return evaluate.order_checks(candidates, expected)


@query(
    "fixture_quality_checks",
    """WITH c AS (SELECT sha256(text) AS case_id, lang AS category FROM documents), s AS (SELECT category, count(*) AS n FROM c GROUP BY 1)
    SELECT 'duplicate_id' AS problem, case_id AS subject, count(*) AS n FROM c GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'unknown_category', category, n FROM s WHERE category NOT IN ('en', 'fr', 'de')
    UNION ALL SELECT 'thin_category', category, n FROM s WHERE category IN ('en', 'fr', 'de') AND n < 140""",
)
def fixture_quality_checks(spark, folder):
    cases = table(spark, folder, "documents").select(F.sha2("text", 256).alias("case_id"), F.col("lang").alias("category"))
    return evaluate.fixture_problems(cases, ["en", "fr", "de"], 140)


@query(
    "cost_rollup",
    f"""WITH {LOG_CTE}, r AS (SELECT user_id % 5 AS workspace_id, user_id AS run_id, sum(CASE WHEN event_type = 'purchase' THEN 3 ELSE 1 END) AS units, count(*) AS calls FROM ev GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY calls) AS r, count(*) OVER (PARTITION BY workspace_id) AS c FROM r)
    SELECT workspace_id, max(c) AS n_runs, CAST(sum(units) AS BIGINT) AS cost_units, CAST(sum(calls) AS BIGINT) AS calls, floor(sum(calls) / CAST(max(c) AS DOUBLE) * 100 + 0.5e0) / 100e0 AS mean_calls,
      max(calls) FILTER (r = CAST(ceil(c * 0.5e0) AS BIGINT)) AS median_calls FROM n GROUP BY 1""",
)
def cost_rollup(spark, folder):
    from attestry.functions import scoring

    calls = log(spark, folder).select(
        (F.col("user_id") % 5).alias("workspace_id"), F.col("user_id").alias("run_id"),
        F.when(F.col("event_type") == "purchase", "thinking").otherwise("fast").alias("mode"),
    )
    runs = evaluate.run_costs(calls, ["workspace_id", "run_id"])
    totals = runs.groupBy("workspace_id").agg(
        _count().alias("n_runs"), F.sum("cost_units").alias("cost_units"), F.sum("calls").alias("calls")
    )
    median = events.exact_percentiles(runs, "workspace_id", "calls", 64, {"median_calls": 0.5})
    mean = scoring.round_half_up(F.col("calls") / F.col("n_runs"))
    return totals.withColumn("mean_calls", mean).join(median.select("workspace_id", "median_calls"), "workspace_id")


@query(
    "provider_counts",
    """WITH v AS (SELECT l_returnflag AS provider, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
    p AS (SELECT l_suppkey, l_returnflag AS provider, count(*) AS own FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey AS connector_id, p.provider, own AS n_rows, coalesce(n, 0) AS n_verified FROM p LEFT JOIN v ON v.provider = p.provider""",
)
def provider_counts(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("connector_id"), F.col("l_returnflag").alias("provider"), "l_linestatus"
    )
    per_connector = rows.groupBy("connector_id", "provider").agg(
        _count().alias("n_rows"), F.count_if(F.col("l_linestatus") == "F").alias("_v")
    )
    # The count every row would ask for by a correlated subquery is one aggregate joined back.
    verified = per_connector.groupBy("provider").agg(F.sum("_v").alias("n_verified"))
    return per_connector.drop("_v").join(verified, "provider").select("connector_id", "provider", "n_rows", "n_verified")


@query(
    "provider_usage",
    """SELECT name, count(*) AS receipts FROM (SELECT DISTINCT user_id, trim(event_type) AS name FROM events) t GROUP BY 1 ORDER BY 2 DESC, 1""",
)
def provider_usage(spark, folder):
    named = table(spark, folder, "events").select("user_id", F.trim("event_type").alias("name"))
    used = named.where("name <> ''").distinct().groupBy("name").agg(_count().alias("receipts"))
    return used.orderBy(F.desc("receipts"), "name")


@query(
    "set_coverage_by_provider",
    f"""WITH {LOG_CTE}, g AS (SELECT user_id AS run_id, event_type AS provider, count(DISTINCT CASE WHEN k % 4 <> 0 AND value < 100 THEN k END) AS receipts,
      max_by(value < 100, (us, event_id)) AS ok FROM ev GROUP BY 1, 2)
    SELECT run_id, provider, receipts, CASE WHEN ok THEN CASE WHEN receipts > 0 THEN 'received' ELSE 'partial' END WHEN receipts > 0 THEN 'partial' ELSE 'failed' END AS status FROM g""",
)
def set_coverage_by_provider(spark, folder):
    ok = F.col("value") < 100
    grouped = log(spark, folder).groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("provider")).agg(
        F.countDistinct(F.when(ok & (F.col("k") % 4 != 0), F.col("k"))).alias("receipts"),
        F.max_by(ok, F.struct("at", "event_id")).alias("ok"),
    )
    some = F.col("receipts") > 0
    status = F.when(F.col("ok") & some, "received").when(F.col("ok") | some, "partial").otherwise("failed")
    return grouped.select("run_id", "provider", "receipts", status.alias("status"))


@query(
    "provider_support_class",
    """SELECT p_partkey AS provider, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_linenumber = 1) THEN 'verified'
      WHEN p_size % 3 > 0 THEN 'contract-compatible' ELSE 'experimental' END AS support_class FROM part""",
)
def provider_support_class(spark, folder):
    verified = table(spark, folder, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(
        F.col("l_partkey").alias("provider")
    ).distinct().withColumn("_v", F.lit(True))
    contracts = table(spark, folder, "part").select(F.col("p_partkey").alias("provider"), (F.col("p_size") % 3).alias("n_fields"))
    label = F.when(F.col("_v"), "verified").when(F.col("n_fields") > 0, "contract-compatible").otherwise("experimental")
    return contracts.join(verified, "provider", "left").select("provider", label.alias("support_class"))


@query(
    "inventory_rollup",
    """WITH a AS (SELECT s_nationkey AS w, count_if(s_acctbal > 0) AS n FROM supplier GROUP BY 1),
    b AS (SELECT c_nationkey AS w, count_if(o_orderstatus = 'P') AS p, count_if(o_orderstatus = 'F') AS e FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
    SELECT n_nationkey AS workspace_id, coalesce(n, 0) AS verified_sources, coalesce(p, 0) AS pending, coalesce(e, 0) AS executed FROM nation LEFT JOIN a ON a.w = n_nationkey LEFT JOIN b ON b.w = n_nationkey""",
)
def inventory_rollup(spark, folder):
    sources = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("workspace_id")).agg(
        F.count_if(F.col("s_acctbal") > 0).alias("verified_sources")
    )
    work = (
        table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .groupBy(F.col("c_nationkey").alias("workspace_id"))
        .agg(F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.count_if(F.col("o_orderstatus") == "F").alias("executed"))
    )
    spaces = table(spark, folder, "nation").select(F.col("n_nationkey").alias("workspace_id"))
    joined = spaces.join(sources, "workspace_id", "left").join(work, "workspace_id", "left")
    return joined.na.fill(0, ["verified_sources", "pending", "executed"])


@query(
    "membership_resolution",
    """WITH m AS (SELECT o_custkey AS u, count(DISTINCT o_orderkey % 3) AS n, min(o_orderkey % 3) AS w FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
    SELECT c_custkey AS user_id, CASE WHEN n = 1 THEN w END AS workspace_id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome
    FROM customer LEFT JOIN m ON u = c_custkey""",
)
def membership_resolution(spark, folder):
    members = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.min(F.col("o_orderkey") % 3).alias("lo"), F.max(F.col("o_orderkey") % 3).alias("hi")
    )
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id")).join(members, "user_id", "left")
    one = F.col("lo") == F.col("hi")
    outcome = F.when(F.col("lo").isNull(), "none").when(one, "resolved").otherwise("ambiguous")
    return users.select("user_id", F.when(one, F.col("lo")).alias("workspace_id"), outcome.alias("outcome"))


@query(
    "doc_listing",
    """SELECT doc_id, lang, n_chars, CASE WHEN trim(CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE source END) <> '' THEN 1 ELSE 0 END AS has_receipt FROM documents ORDER BY doc_id DESC LIMIT 100""",
)
def doc_listing(spark, folder):
    receipt = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.col("source"))
    newest = table(spark, folder, "documents").select("doc_id", "lang", "n_chars", receipt.alias("receipt")).orderBy(F.desc("doc_id"))
    return newest.limit(100).select("doc_id", "lang", "n_chars", (F.trim("receipt") != "").cast("int").alias("has_receipt"))


PAGE_LINES = 10
#: Pages of one document with a fact on its page, one on another page than declared, one on two pages and one on none.
_PAGES = [
    (-1, 1, "The rollout of ORB-77 begins on the first of May\nafter the board has met."),
    (-1, 2, "Support keeps the old contract until the end of the year.\nThe rollout owner is named in ORB-78 and nowhere else here."),
    (-1, 3, "Support keeps the old contract until the end of the year.\nSee XORB-78b."),
]
_FACTS = [
    ("fact-own", "begins on the first of May after the board has met.", -1, 1),
    ("fact-wrong", "owner is named in ORB-78 and nowhere else", -1, 1),
    ("fact-twice", "keeps the old contract until the end of the year", -1, 2),
    ("fact-none", "keeps the new contract until the end of the year", -1, 2),
    ("fact-part", "llout of ORB-77 begins on the first of Ma", -1, 1),
    ("fact-short", "rollout owner", -1, 2),
]
_DECLARED = [("ORB-77", -1, 1), ("ORB-78", -1, 2), ("ORB-79", -1, 3)]


def _rows_sql(rows: list[tuple], columns: str) -> str:
    cell = lambda v: quote(v).replace("\n", "' || chr(10) || '") if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({columns})"


_PAGES_CTE = f"""raw AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
pages AS (SELECT doc_id, p AS page, {clean_sql(f"array_to_string(lines[(p - 1) * {PAGE_LINES} + 1 : p * {PAGE_LINES}], ' ')")} AS flat
    FROM (SELECT doc_id, lines, unnest(range(1, (len(lines) - 1) // {PAGE_LINES} + 2)) AS p FROM raw) x
  UNION ALL SELECT doc_id, page, {clean_sql('text')} FROM {_rows_sql(_PAGES, 'doc_id, page, text')})"""


def _pages(spark, folder):
    # Pages are cut by one pass over a text, which then stays behind: a page does not carry the lines of its document.
    pages = F.regexp_extract_all(F.concat("text", F.lit("\n")), F.lit(rf"(?:[^\n]*\n){{1,{PAGE_LINES}}}"), F.lit(0))
    # The outer forms keep Spark from cutting each text twice, the first time to see whether it has parts.
    docs = spread(table(spark, folder, "documents")).where("text IS NOT NULL").select("doc_id", F.posexplode_outer(pages).alias("at", "text"))
    paged = docs.select("doc_id", (F.col("at") + 1).alias("page"), F.translate("text", "\n", " ").alias("text"))
    return paged.unionByName(spark.createDataFrame(_PAGES, "doc_id bigint, page int, text string"))


@query(
    "passage_grounding_check",
    f"""WITH {_PAGES_CTE}, said AS (SELECT trim(s) AS passage, min({{'d': doc_id, 'p': page}}) AS place
      FROM (SELECT doc_id, page, unnest(regexp_extract_all(flat, '[^.!?]+[.!?]')) AS s FROM pages WHERE doc_id >= 0) x
      WHERE len(string_split(trim(s), ' ')) >= 8 GROUP BY 1),
    facts AS (SELECT md5(passage) AS item_id, passage, place.d AS doc_id, place.p AS page FROM said
      UNION ALL SELECT concat('item-', item_id), {clean_sql('text')}, NULL, NULL FROM benchmark
      UNION ALL SELECT item_id, passage, doc_id, page FROM {_rows_sql(_FACTS, 'item_id, passage, doc_id, page')}),
    folds AS (SELECT flat, count(*) AS n, min({{'d': doc_id, 'p': page}}) AS place FROM pages GROUP BY 1),
    places AS (SELECT flat, n, place, string_split(flat, ' ') AS w FROM folds),
    runs AS (SELECT DISTINCT flat, n, place, array_to_string(w[i : i + 2], ' ') AS run FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM places) x),
    asked AS (SELECT *, string_split(passage, ' ') AS w FROM facts),
    met AS (SELECT item_id, n, r.place FROM asked JOIN runs r ON r.run = array_to_string(w[2:4], ' ') AND contains(flat, passage) WHERE len(w) >= 5
      UNION ALL SELECT item_id, n, f.place FROM asked JOIN folds f ON contains(flat, passage) WHERE len(w) < 5),
    hits AS (SELECT item_id, sum(n) AS n, min(place) AS place FROM met GROUP BY 1)
    SELECT item_id, CAST(coalesce(n, 0) AS BIGINT) AS n_pages, place.d AS first_doc, CAST(place.p AS INT) AS first_page,
      CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'several' WHEN doc_id IS NULL OR (place.d = doc_id AND place.p = page) THEN 'grounded' ELSE 'elsewhere' END AS verdict
    FROM facts LEFT JOIN hits USING (item_id)""",
)
def passage_grounding_check(spark, folder):
    pages = _pages(spark, folder)
    # Cut behind every mark: a pattern that looks ahead for the mark reads a long text without one again from each of its places.
    parts = F.split(text.clean(F.col("text")), r"(?<=[.!?])")
    cut = pages.where("doc_id >= 0").select("doc_id", "page", F.explode_outer(parts).alias("s"))
    ended = cut.where((F.length("s") > 1) & F.right("s", F.lit(1)).isin(".", "!", "?"))
    said = ended.select(F.trim("s").alias("passage"), F.struct("doc_id", "page").alias("place")).where(F.size(F.split("passage", " ")) >= 8)
    sentences = said.groupBy("passage").agg(F.min("place").alias("place")).select(
        F.md5("passage").alias("item_id"), "passage", "place.doc_id", "place.page"
    )
    items = table(spark, folder, "benchmark").select(
        F.concat(F.lit("item-"), "item_id").alias("item_id"), F.col("text").alias("passage"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("int").alias("page")
    )
    literal = spark.createDataFrame(_FACTS, "item_id string, passage string, doc_id bigint, page int")
    return evaluate.grounding(sentences.unionByName(items).unionByName(literal), pages)


@query(
    "identifier_leaks",
    f"""WITH {_PAGES_CTE}, told AS (SELECT * FROM {_rows_sql(_DECLARED, 'identifier, doc_id, page')}),
    seen AS (SELECT DISTINCT identifier, p.doc_id, p.page FROM (SELECT DISTINCT identifier FROM told) t JOIN pages p ON contains(flat, identifier)),
    b AS (SELECT coalesce(s.identifier, t.identifier) AS identifier, t.identifier IS NULL AS u, s.identifier IS NULL AS a
      FROM seen s FULL JOIN told t ON s.identifier = t.identifier AND s.doc_id = t.doc_id AND s.page = t.page)
    SELECT identifier, count_if(u) AS n_undeclared, count_if(a) AS n_absent FROM b GROUP BY 1 HAVING count_if(u) + count_if(a) > 0""",
)
def identifier_leaks(spark, folder):
    return evaluate.identifier_leaks(spark.createDataFrame(_DECLARED, "identifier string, doc_id bigint, page int"), _pages(spark, folder))


@query(
    "closure_check",
    """WITH s AS (SELECT l_orderkey AS q, l_partkey AS e, max(CASE WHEN l_tax < 0.08 THEN 1 ELSE 0 END) AS s, max(CASE WHEN l_discount < 0.1 THEN 1 ELSE 0 END) AS c, 1 AS r FROM lineitem GROUP BY 1, 2),
    g AS (SELECT q AS question_id, count_if(s = 1 AND r = 0) AS shown_unreferenced, count_if(s = 0 AND r = 1) AS referenced_not_shown, count_if(c <> r) AS citation_gaps FROM s GROUP BY 1)
    SELECT * FROM g WHERE shown_unreferenced + referenced_not_shown + citation_gaps > 0""",
)
def closure_check(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), F.col("l_partkey").alias("evidence_id"), "l_tax", "l_discount"
    )
    return evaluate.closure_problems(rows.where("l_tax < 0.08"), rows.where("l_discount < 0.1"), rows)


@query(
    "artifact_completeness",
    """WITH r AS (SELECT l_orderkey, count(*) AS n, bool_and(l_discount BETWEEN 0 AND 1 AND l_tax BETWEEN 0 AND 1) AS units, bool_and(l_returnflag <> 'R') AS clean FROM lineitem GROUP BY 1),
    a AS (SELECT o_orderkey AS artifact_id, coalesce(n, 0) AS n, units, clean, o_orderstatus = 'P' AS old, 1 + o_orderkey % 7 AS stated, o_orderpriority < '3' AS flag FROM orders LEFT JOIN r ON l_orderkey = o_orderkey),
    p AS (SELECT artifact_id, concat_ws(',', CASE WHEN n = 0 THEN 'no_rows' END, CASE WHEN NOT units THEN 'metric_range' END, CASE WHEN stated <> n THEN 'row_count' END,
      CASE WHEN clean IS DISTINCT FROM flag THEN 'aggregate_flag' END, CASE WHEN old THEN 'release' END) AS problems FROM a)
    SELECT artifact_id, problems FROM p WHERE problems <> ''""",
)
def artifact_completeness(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("artifact_id")).agg(
        _count().alias("n"), F.min(F.col("l_discount").between(0, 1) & F.col("l_tax").between(0, 1)).alias("units"),
        F.min(F.col("l_returnflag") != "R").alias("clean"),
    )
    artifacts = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("artifact_id"), (F.col("o_orderstatus") == "P").alias("old"),
        (F.col("o_orderkey") % 7 + 1).alias("stated"), (F.col("o_orderpriority") < "3").alias("flag"),
    )
    a = artifacts.join(rows, "artifact_id", "left")
    n = F.coalesce("n", F.lit(0))
    problems = F.concat_ws(
        ",", F.when(n == 0, "no_rows"), F.when(~F.col("units"), "metric_range"), F.when(F.col("stated") != n, "row_count"),
        F.when(~F.equal_null("clean", "flag"), "aggregate_flag"), F.when(F.col("old"), "release"),
    )
    return a.select("artifact_id", problems.alias("problems")).where("problems <> ''")


@query(
    "scope_fanout",
    """SELECT p_brand AS database, p_type AS collection, count(*) AS n_connectors, min(p_partkey) AS first_connector FROM part WHERE p_size < 45 GROUP BY 1, 2""",
)
def scope_fanout(spark, folder):
    connectors = table(spark, folder, "part").where("p_size < 45")
    # Connectors stay rows keyed by scope; a scope carries counts, not a list that could grow without bound.
    return connectors.groupBy(F.col("p_brand").alias("database"), F.col("p_type").alias("collection")).agg(
        _count().alias("n_connectors"), F.min("p_partkey").alias("first_connector")
    )
