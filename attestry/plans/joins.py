"""Attribution joins and relational reads. Suppliers stand for connectors, parts for resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import secrets
from attestry.operators import lineage, ranking
from attestry.operators.shape import latest, top_k
from attestry.plans.ranking import QUEUE_CTE, SCORED_CTE, order_inputs, order_queue
from attestry.plans.registry import query
from attestry.sources.tables import table


def _line_key():
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_LINE_KEY = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query(
    "source_chunk_join",
    f"""WITH s AS (SELECT p_partkey AS source_key, CASE WHEN p_partkey % 2 = 0 THEN concat('p', p_partkey) END AS id, concat('s', p_partkey) AS source_id FROM part),
    c AS (SELECT {_LINE_KEY} AS chunk_key, CASE WHEN l_linenumber % 2 = 0 THEN concat('p', l_partkey) END AS id,
      CASE WHEN l_linenumber % 3 = 0 THEN concat('s', l_partkey) END AS source_id FROM lineitem WHERE l_returnflag = 'R')
    SELECT DISTINCT source_key, chunk_key FROM s LEFT JOIN (SELECT s.source_key AS k, c.chunk_key FROM s JOIN c ON s.id = c.id
      UNION SELECT s.source_key, c.chunk_key FROM s JOIN c ON s.source_id = c.source_id) m ON m.k = source_key""",
)
def source_chunk_join(spark, folder):
    key = F.col("p_partkey")
    sources = table(spark, folder, "part").select(
        key.alias("source_key"), F.when(key % 2 == 0, F.concat(F.lit("p"), key)).alias("id"),
        F.concat(F.lit("s"), key).alias("source_id"), F.lit("").alias("context_id"),
    )
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    chunks = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(
        _line_key().alias("chunk_key"), F.when(n % 2 == 0, F.concat(F.lit("p"), part)).alias("id"),
        F.when(n % 3 == 0, F.concat(F.lit("s"), part)).alias("source_id"), F.lit("").alias("context_id"),
    )
    return lineage.source_chunks(sources, chunks, ["id", "source_id", "context_id"])


@query(
    "lineage_join",
    """WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'),
    r AS (SELECT l.l_suppkey AS connector_id, CASE l_linenumber % 3 WHEN 0 THEN l.l_suppkey WHEN 1 THEN l.l_suppkey + 1 END AS owner, s.l_partkey AS hit
      FROM lineitem l LEFT JOIN s ON s.l_suppkey = l.l_suppkey AND s.l_partkey = l.l_partkey)
    SELECT connector_id, CASE WHEN owner IS NOT NULL THEN CASE WHEN owner = connector_id THEN 'connector' ELSE 'rejected' END
      WHEN hit IS NOT NULL THEN 'resource' ELSE 'rejected' END AS proof, count(*) AS n_rows FROM r GROUP BY 1, 2""",
)
def lineage_join(spark, folder):
    lines = table(spark, folder, "lineitem")
    n, supp = F.col("l_linenumber"), F.col("l_suppkey")
    rows = lines.select(
        supp.alias("connector_id"), F.col("l_partkey").alias("resource"),
        F.when(n % 3 == 0, supp).when(n % 3 == 1, supp + 1).alias("owner"),
    )
    selected = lines.where("l_returnflag = 'R'").select(supp.alias("connector_id"), F.col("l_partkey").alias("resource_id"))
    return lineage.lineage(rows, selected).groupBy("connector_id", "proof").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "attested_owner",
    """WITH c AS (SELECT s_suppkey AS k, s_nationkey AS w, s_suppkey % 3 AS p FROM supplier), one AS (SELECT w, p FROM c GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT k AS connector_id, count(*) AS n_accepted FROM c JOIN one USING (w, p) JOIN lineitem ON l_suppkey = k
    WHERE l_linenumber < 6 AND l_tax > 0 AND l_partkey % 4 <> 3 AND l_orderkey % 5 <> 4 AND l_quantity < 40 GROUP BY 1""",
)
def attested_owner(spark, folder):
    connectors = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("connector_id"), F.col("s_nationkey").alias("workspace_id"),
        (F.col("s_suppkey") % 3).cast("string").alias("provider"),
    )
    own = (F.col("l_suppkey") % 3).cast("string")
    requests = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("connector_id"),
        F.when(F.col("l_quantity") < 40, 1).otherwise(2).alias("scope_size"),
        F.when(F.col("l_linenumber") < 6, 200).otherwise(503).alias("status"),
        F.when(F.col("l_tax") > 0, F.col("l_orderkey").cast("string")).otherwise(" ").alias("request_id"),
        F.col("l_suppkey").alias("filter_connector"), own.alias("filter_provider"),
        F.when(F.col("l_partkey") % 4 == 3, "other").when(F.col("l_partkey") % 4 == 2, own).alias("reported_provider"),
        F.when(F.col("l_orderkey") % 5 == 4, F.col("l_suppkey") + 1).alias("caller_connector"),
        F.when(F.col("l_orderkey") % 5 == 3, own).alias("caller_provider"),
    )
    accepted = lineage.attested(requests, connectors)
    return accepted.groupBy("connector_id").agg(F.count(F.lit(1)).alias("n_accepted"))


@query(
    "owned_document_join",
    """WITH o AS (SELECT concat('db', p_partkey % 5) AS d, p_partkey AS s FROM part WHERE p_size < 20)
    SELECT l_partkey AS source_id, 'document' AS provider, count(*) AS n_chunks FROM lineitem
    JOIN o ON s = l_partkey AND d = concat('db', (l_partkey + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) % 5) GROUP BY 1""",
)
def owned_document_join(spark, folder):
    owned = table(spark, folder, "part").where("p_size < 20").select(
        F.concat(F.lit("db"), F.col("p_partkey") % 5).alias("database"), F.col("p_partkey").alias("source_id")
    )
    shift = F.when(F.col("l_linenumber") == 7, 1).otherwise(0)
    sources = table(spark, folder, "lineitem").select(
        F.concat(F.lit("db"), (F.col("l_partkey") + shift) % 5).alias("database"), F.col("l_partkey").alias("source_id")
    )
    hits = lineage.owned_documents(sources, owned)
    return hits.groupBy("source_id", "provider").agg(F.count(F.lit(1)).alias("n_chunks"))


@query(
    "require_all_exist",
    """SELECT l_orderkey AS request_id, count(*) AS n_requested, count(*) - count(p_partkey) AS n_missing, count(*) = count(p_partkey) AS accepted
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size < 45 GROUP BY 1""",
)
def require_all_exist(spark, folder):
    requests = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("evidence_id"))
    existing = table(spark, folder, "part").where("p_size < 45").select(F.col("p_partkey").alias("evidence_id"))
    return lineage.all_exist(requests, existing, "evidence_id")


@query(
    "guarded_insert",
    """SELECT l_orderkey, count(*) AS n_inserted FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O') GROUP BY 1""",
)
def guarded_insert(spark, folder):
    open_orders = table(spark, folder, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    rows = table(spark, folder, "lineitem").select("l_orderkey")
    kept = lineage.with_parent(rows, open_orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return kept.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_inserted"))


@query(
    "citation_closure",
    """WITH r AS (SELECT l_orderkey AS q, l_partkey AS e, l_linenumber AS place FROM lineitem UNION ALL
      SELECT l_orderkey, l_partkey + 1, 100 + l_linenumber FROM lineitem WHERE l_returnflag = 'R')
    SELECT q AS question_id, e AS evidence_id, min(place) AS first_ref FROM r JOIN part ON p_partkey = e AND p_size < 40 GROUP BY 1, 2""",
)
def citation_closure(spark, folder):
    lines = table(spark, folder, "lineitem")
    claims = lines.select(
        F.col("l_orderkey").alias("question_id"), F.col("l_partkey").alias("evidence_id"), F.col("l_linenumber").alias("place")
    )
    conflicts = lines.where("l_returnflag = 'R'").select(
        "l_orderkey", (F.col("l_partkey") + 1).alias("evidence_id"), (F.col("l_linenumber") + 100).alias("place")
    )
    evidence = table(spark, folder, "part").where("p_size < 40").select(F.col("p_partkey").alias("evidence_id"))
    return lineage.citation_closure(claims.union(conflicts), evidence)


@query(
    "action_status",
    """WITH p AS (SELECT o_orderkey, c_nationkey AS workspace_id, o_orderpriority, o_orderdate,
        row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders JOIN customer ON c_custkey = o_custkey),
    a AS (SELECT l_orderkey, max(l_returnflag) AS decision FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
    x AS (SELECT l_orderkey, max(l_linestatus) AS execution FROM lineitem WHERE l_linenumber = 2 GROUP BY 1)
    SELECT workspace_id, o_orderkey AS proposal_id, o_orderpriority AS risk_class, decision, execution FROM p
    LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN x ON x.l_orderkey = o_orderkey WHERE n <= 50""",
)
def action_status(spark, folder):
    proposals = (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .select(F.col("c_nationkey").alias("workspace_id"), F.col("o_orderkey").alias("proposal_id"),
                F.col("o_orderpriority").alias("risk_class"), "o_orderdate")
    )
    # The list shows the newest 50 of a workspace; cutting first keeps the joins small.
    newest = top_k(proposals, ["workspace_id"], [F.desc("o_orderdate"), F.desc("proposal_id")], 50)
    lines = table(spark, folder, "lineitem")
    approvals = lines.where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("proposal_id")).agg(F.max("l_returnflag").alias("decision"))
    executions = lines.where("l_linenumber = 2").groupBy(F.col("l_orderkey").alias("proposal_id")).agg(F.max("l_linestatus").alias("execution"))
    return newest.join(approvals, "proposal_id", "left").join(executions, "proposal_id", "left").select(
        "workspace_id", "proposal_id", "risk_class", "decision", "execution"
    )


@query(
    "receipt_replay",
    """SELECT o_orderkey AS run_id, o_orderkey % 5 AS workspace_id, count(*) AS n_receipts FROM orders
    JOIN lineitem ON l_orderkey = o_orderkey AND (l_orderkey + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) % 5 = o_orderkey % 5 GROUP BY 1, 2""",
)
def receipt_replay(spark, folder):
    runs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 5).alias("workspace_id"))
    shift = F.when(F.col("l_linenumber") == 7, 1).otherwise(0)
    receipts = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), ((F.col("l_orderkey") + shift) % 5).alias("workspace_id")
    )
    return receipts.join(runs, ["workspace_id", "run_id"]).groupBy("run_id", "workspace_id").agg(F.count(F.lit(1)).alias("n_receipts"))


_RUN = "(year(task_date) * 100 + month(task_date))"
_RUN_CTE = f"""{SCORED_CTE}, runs AS (SELECT *, {_RUN} AS run_id, max({_RUN}) OVER (PARTITION BY workspace_id) AS last_run FROM scored),
packets AS (SELECT l_orderkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS packet_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS n
  FROM lineitem WHERE l_returnflag = 'N'),
items AS (SELECT workspace_id, run_id, task_id, score, row_number() OVER (PARTITION BY workspace_id ORDER BY score DESC, task_id) AS rank FROM runs WHERE run_id = last_run AND score > 0)"""


def latest_run_items(spark, folder):
    """Ranked items of the newest run of each workspace; a run is a month of orders."""
    scored = ranking.with_score(order_inputs(spark, folder)).withColumn(
        "run_id", F.year("task_date") * 100 + F.month("task_date")
    )
    last = scored.groupBy("workspace_id").agg(F.max("run_id").alias("run_id"))
    current = scored.join(last, ["workspace_id", "run_id"], "left_semi").where("score > 0")
    return top_k(current, ["workspace_id"], [F.desc("score"), F.asc("task_id")], 18).select(
        "workspace_id", "run_id", "task_id", "score", "rank"
    )


def latest_packets(spark, folder):
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'N'").select(
        F.col("l_orderkey").alias("task_id"), _line_key().alias("packet_id"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"
    )
    return latest(lines, ["task_id"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]).select("task_id", "packet_id")


@query(
    "next_actions",
    f"""WITH {_RUN_CTE} SELECT workspace_id, run_id, task_id, rank, score, packet_id FROM items JOIN packets ON l_orderkey = task_id AND n = 1 WHERE rank <= 18""",
)
def next_actions(spark, folder):
    return latest_run_items(spark, folder).join(latest_packets(spark, folder), "task_id").select(
        "workspace_id", "run_id", "task_id", "rank", "score", "packet_id"
    )


@query(
    "queue_list",
    f"""WITH {_RUN_CTE} SELECT workspace_id, run_id, task_id, rank, score, concat('task ', task_id) AS title, o_orderpriority AS status
    FROM items JOIN orders ON o_orderkey = task_id WHERE rank <= 18""",
)
def queue_list(spark, folder):
    packets = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        F.to_json(
            F.struct(
                F.struct(F.concat(F.lit("task "), "o_orderkey").alias("title")).alias("task"),
                F.col("o_orderpriority").alias("status"),
            )
        ).alias("packet_json"),
    )
    joined = latest_run_items(spark, folder).join(packets, "task_id")
    parsed = joined.withColumn("p", F.from_json("packet_json", "struct<task:struct<title:string>,status:string>"))
    return parsed.select("workspace_id", "run_id", "task_id", "rank", "score", "p.task.title", "p.status")


@query(
    "queue_evidence_link",
    f"""WITH {QUEUE_CTE}, i AS (SELECT DISTINCT workspace_id, task_id, concat('task ', task_id, ' ', provider) AS corpus, score, l_partkey AS e FROM queue JOIN lineitem ON l_orderkey = task_id),
    a AS (SELECT DISTINCT c_nationkey AS workspace_id, c_custkey AS question_id, lower(concat('which task about ', c_mktsegment)) AS question, l_partkey AS e FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey),
    s AS (SELECT question_id, question, task_id, corpus, score, count(*) AS n_shared FROM a JOIN i ON i.workspace_id = a.workspace_id AND i.e = a.e GROUP BY ALL),
    o AS (SELECT *, len(list_filter(list_distinct(regexp_extract_all(question, '[a-z0-9-]{{4,}}')), lambda t: contains(lower(corpus), t))) AS overlap FROM s)
    SELECT question_id, task_id, n_shared, overlap, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n_shared DESC, overlap DESC, score DESC, task_id) AS n FROM o) t WHERE n = 1""",
)
def queue_evidence_link(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("evidence_id"))
    items = order_queue(spark, folder).join(lines, F.col("l_orderkey") == F.col("task_id")).select(
        "workspace_id", "task_id", F.concat_ws(" ", F.lit("task"), "task_id", "provider").alias("corpus"), "score", "evidence_id"
    )
    customers = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("workspace_id"), F.col("c_custkey").alias("question_id"),
        F.concat(F.lit("Which task about "), "c_mktsegment").alias("question"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("question_id"))
    answers = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("question_id", "evidence_id").distinct().join(
        customers, "question_id"
    )
    return lineage.link_queue(answers.select("workspace_id", "question_id", "question", "evidence_id"), items)


@query(
    "latest_verification",
    """WITH v AS (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS n, epoch_us(ts) AS seen_us, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
    SELECT s_suppkey AS connector_id, event_type AS stage, n AS canary_count, seen_us AS verified_us FROM supplier LEFT JOIN v ON user_id = s_suppkey AND r = 1""",
)
def latest_verification(spark, folder):
    log = table(spark, folder, "events").select(
        F.col("user_id").alias("connector_id"), "event_id", F.col("event_type").alias("stage"),
        F.floor("value").cast("bigint").alias("canary_count"), F.unix_micros(F.col("ts").cast("timestamp")).alias("verified_us"),
    )
    newest = latest(log, ["connector_id"], ["verified_us", "event_id"]).drop("event_id")
    connectors = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("connector_id"))
    return connectors.join(newest, "connector_id", "left").select("connector_id", "stage", "canary_count", "verified_us")


@query(
    "approval_compaction",
    """WITH a AS (SELECT l_orderkey AS proposal_id, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS decision, l_shipdate AS decided,
        l_partkey AS created, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, CASE l_linestatus WHEN 'F' THEN 'succeeded' ELSE 'pending' END AS status FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY proposal_id ORDER BY CASE WHEN decision IS NOT NULL THEN 0 ELSE 1 END, decided DESC, created DESC, id DESC) AS n,
      row_number() OVER (PARTITION BY proposal_id ORDER BY CASE WHEN status = 'succeeded' THEN 0 WHEN decision IS NOT NULL THEN 1 ELSE 2 END, decided DESC, created DESC, id DESC) AS m FROM a)
    SELECT p.proposal_id, p.id AS approval_id, coalesce(p.decision, 'pending') AS decision, q.id AS execution_id, q.status AS execution_status
    FROM r p JOIN r q ON q.proposal_id = p.proposal_id AND q.m = 1 WHERE p.n = 1""",
)
def approval_compaction(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("proposal_id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("decision"),
        F.col("l_shipdate").alias("decided"), F.col("l_partkey").alias("created"), _line_key().alias("id"),
        F.when(F.col("l_linestatus") == "F", "succeeded").otherwise("pending").alias("status"),
    )
    newest = ["decided", "created", "id"]
    decided = F.col("decision").isNotNull().cast("int")
    settled = F.when(F.col("status") == "succeeded", 2).when(F.col("decision").isNotNull(), 1).otherwise(0)
    pick = lambda order, *cols: F.max_by(F.struct(*cols), F.struct(order.alias("o"), *newest))
    both = rows.groupBy("proposal_id").agg(
        pick(decided, "id", "decision").alias("a"), pick(settled, "id", "status").alias("e")
    )
    return both.select(
        "proposal_id", F.col("a.id").alias("approval_id"), F.coalesce("a.decision", F.lit("pending")).alias("decision"),
        F.col("e.id").alias("execution_id"), F.col("e.status").alias("execution_status"),
    )


@query(
    "import_state_join",
    """WITH u AS (SELECT l_suppkey AS k, l_returnflag AS provider, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS n FROM lineitem WHERE l_linenumber <> 3),
    i AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 5000 THEN 'data_verified' WHEN s_acctbal > 0 THEN 'degraded' ELSE 'deleted' END AS state FROM supplier WHERE s_suppkey % 2 = 0)
    SELECT u.k AS connector_id, provider, state, state IS NOT NULL AS imported, coalesce(state = 'data_verified', false) AS retrieval_eligible
    FROM u LEFT JOIN i ON i.k = u.k AND state <> 'deleted' WHERE n = 1""",
)
def import_state_join(spark, folder):
    upstream = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("connector_id"),
        F.when(F.col("l_linenumber") == 3, " ").otherwise(F.col("l_returnflag")).alias("provider"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"),
    )
    state = F.when(F.col("s_acctbal") > 5000, "data_verified").when(F.col("s_acctbal") > 0, "degraded").otherwise("deleted")
    imported = table(spark, folder, "supplier").where("s_suppkey % 2 = 0").select(
        F.col("s_suppkey").cast("string").alias("connector_id"), state.alias("state")
    )
    out = lineage.state_import(upstream, imported)
    return out.withColumn("connector_id", F.col("connector_id").cast("bigint"))


@query(
    "alias_reverse_lookup",
    """SELECT o_orderkey AS run_id, concat('public-query-', left(sha256(concat('public-reference:', o_custkey, ':query:', o_orderkey)), 32)) AS reference
    FROM orders WHERE o_orderstatus = 'P'""",
)
def alias_reverse_lookup(spark, folder):
    alias = secrets.public_alias("public-reference", F.col("o_custkey"), "query", F.col("o_orderkey"))
    runs = table(spark, folder, "orders").select("o_custkey", F.col("o_orderkey").alias("run_id"), alias.alias("reference"))
    asked = table(spark, folder, "orders").where("o_orderstatus = 'P'").select("o_custkey", alias.alias("reference"))
    return runs.join(asked, ["o_custkey", "reference"], "left_semi").select("run_id", "reference")
