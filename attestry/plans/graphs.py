"""Evidence graphs. Orders stand for packets, answers and proposals; lines for their evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import graph
from attestry.plans.registry import query
from attestry.session import BROADCAST_LIMIT_BYTES, size_in_bytes
from attestry.sources.tables import table


def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"),
        F.col("l_suppkey").alias("supp"),
    )


def _offer():
    """Titles fall as lines go on, so that the first is not the least; the first line has none."""
    return F.when(F.col("n") > 1, F.concat(F.lit("offer "), 9 - F.col("n"))).otherwise("")


def _packet_inputs(spark, folder):
    action = F.when(F.col("o_orderstatus") != "F", "Review the cited receipt.").otherwise(" ")
    packets = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("title"), action.alias("action")
    )
    lines = _lines(spark, folder)
    evidence = lines.select(
        F.col("k").alias("task_id"), F.col("part").alias("source_id"), _offer().alias("title"), F.lit("part").alias("provider"), F.col("n").alias("seq")
    )
    # Each returned line disputes its own part, and a part that may not be among the evidence.
    returned = lines.where("flag = 'R'")
    key = F.concat_ws(":", "k", "part")
    conflicts = returned.select(
        F.col("k").alias("task_id"), key.alias("conflict_key"), F.concat(F.lit("returned "), "part").alias("summary"),
        F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("evidence_id"),
    )
    return packets, evidence, conflicts


def _packet_graph(spark, folder):
    return graph.packet_graph(*_packet_inputs(spark, folder))


_SRC = "src AS (SELECT l_orderkey AS k, l_partkey AS p, CASE WHEN min(l_linenumber) > 1 THEN concat('offer ', 9 - min(l_linenumber)) ELSE 'part' END AS t FROM lineitem GROUP BY 1, 2), ret AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R')"
_REFUTES = """SELECT CAST(r.k AS VARCHAR) AS graph, 'edge' AS part, concat('edge:source:', e, '->contradiction:', r.k, ':', r.p) AS id, 'REFUTES' AS type, concat('source:', e, '>contradiction:', r.k, ':', r.p) AS detail
  FROM (SELECT k, p, unnest([p, p + 1]) AS e FROM ret) r JOIN src ON src.k = r.k AND src.p = r.e"""
_PACKET_SQL = f"""SELECT CAST(o_orderkey AS VARCHAR) AS graph, 'node' AS part, concat('task:', o_orderkey) AS id, 'task' AS type, o_orderpriority AS detail FROM orders
  UNION ALL SELECT CAST(k AS VARCHAR), 'node', concat('source:', p), 'source', t FROM src
  UNION ALL SELECT CAST(k AS VARCHAR), 'node', concat('contradiction:', k, ':', p), 'contradiction', concat('returned ', p) FROM ret
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'node', concat('action:', o_orderkey), 'action', 'Review the cited receipt.' FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL SELECT CAST(k AS VARCHAR), 'edge', concat('edge:source:', p, '->task:', k), 'SUPPORTS', concat('source:', p, '>task:', k) FROM src
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'edge', concat('edge:task:', o_orderkey, '->action:', o_orderkey), 'RESOLVES', concat('task:', o_orderkey, '>action:', o_orderkey) FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL {_REFUTES}"""


@query("packet_graph", f"WITH {_SRC} {_PACKET_SQL}")
def packet_graph(spark, folder):
    return graph.as_rows(*_packet_graph(spark, folder))


_ANSWER_SQL = f"""SELECT CAST(k AS VARCHAR) AS graph, 'node' AS part, concat('source:', p) AS id, 'source' AS type, t AS detail FROM src
  UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), 'node', concat('claim:', l_linenumber), 'claim', concat('line ', l_linenumber) FROM lineitem
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'node', concat('task:', o_orderkey % 100), 'task', o_orderpriority FROM orders JOIN (SELECT DISTINCT k FROM ret) r ON r.k = o_orderkey
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'node', concat('action:', o_orderkey % 100), 'action', 'Review' FROM orders JOIN (SELECT DISTINCT k FROM ret) r ON r.k = o_orderkey WHERE o_orderstatus = 'O'
  UNION ALL SELECT CAST(k AS VARCHAR), 'node', concat('contradiction:', k, ':', p), 'contradiction', concat('returned ', p) FROM ret
  UNION ALL SELECT DISTINCT CAST(l.k AS VARCHAR), 'edge', concat('edge:source:', e, '->claim:', n), 'SUPPORTS', concat('source:', e, '>claim:', n)
    FROM (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber = 5 THEN l_partkey + 1 ELSE l_partkey END AS e FROM lineitem) l JOIN src ON src.k = l.k AND src.p = l.e
  UNION ALL SELECT CAST(k AS VARCHAR), 'edge', concat('edge:source:', p, '->task:', k % 100), 'SUPPORTS', concat('source:', p, '>task:', k % 100) FROM ret
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'edge', concat('edge:task:', o_orderkey % 100, '->action:', o_orderkey % 100), 'RESOLVES', concat('task:', o_orderkey % 100, '>action:', o_orderkey % 100)
    FROM orders JOIN (SELECT DISTINCT k FROM ret) r ON r.k = o_orderkey WHERE o_orderstatus = 'O'
  UNION ALL {_REFUTES}"""


def _answer_graph(spark, folder):
    lines = _lines(spark, folder)
    q = F.col("k").alias("question_id")
    citations = lines.select(q, F.col("part").alias("source_id"), _offer().alias("title"), F.lit("part").alias("provider"), F.col("n").alias("seq"))
    cited = F.when(F.col("n") == 5, F.col("part") + 1).otherwise(F.col("part"))
    claims = lines.select(q, F.col("n").alias("claim_no"), F.concat(F.lit("line "), "n").alias("claim"), cited.alias("evidence_id"))
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "O", "Review").alias("action")
    )
    tasks = lines.where("flag = 'R'").join(orders, "k").select(
        q, (F.col("k") % 100).alias("task_id"), "title", "action", F.col("part").alias("evidence_id")
    )
    _, _, conflicts = _packet_inputs(spark, folder)
    return graph.answer_graph(citations, claims, tasks, conflicts.withColumnRenamed("task_id", "question_id"))


@query("answer_graph", f"WITH {_SRC} {_ANSWER_SQL}")
def answer_graph(spark, folder):
    return graph.as_rows(*_answer_graph(spark, folder))


_LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_LINEAGE_SQL = f"""SELECT 'lineage' AS graph, 'node' AS part, concat('connector:', s_suppkey) AS id, 'connector' AS type, concat_ws(' ', s_name, CASE WHEN s_acctbal > 0 THEN 'data_verified' END) AS detail FROM supplier WHERE s_suppkey % 4 <> 0
  UNION ALL SELECT 'lineage', 'node', concat('source:', {_LINE_ID}), 'source', 'line' FROM lineitem
  UNION ALL SELECT 'lineage', 'edge', concat('edge:source:', {_LINE_ID}, '->connector:', l_suppkey), 'ORIGINATED_FROM', concat('source:', {_LINE_ID}, '>connector:', l_suppkey) FROM lineitem WHERE l_suppkey % 4 <> 0 AND l_linenumber < 6"""


def _lineage_graph(spark, folder):
    state = F.when(F.col("s_acctbal") > 0, "data_verified").otherwise("mystery")
    # Every connector is listed twice; its second name would come first by spelling.
    name = F.concat(F.when(F.col("seq") == 2, "A").otherwise(""), "s_name")
    connectors = table(spark, folder, "supplier").withColumn("seq", F.explode(F.array(F.lit(2), F.lit(1)))).select(
        F.col("s_suppkey").alias("connector_id"), F.when(F.col("s_suppkey") % 4 != 0, "erp").alias("provider"), name.alias("name"), state.alias("state"), "seq"
    )
    sources = table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("source_id"), F.lit("").alias("title"), F.lit("line").alias("provider"),
        F.when(F.col("l_linenumber") < 6, F.col("l_suppkey")).alias("connector_id"), F.col("l_linenumber").alias("seq"),
    )
    return graph.lineage_graph(connectors, sources)


@query("lineage_graph", _LINEAGE_SQL)
def lineage_graph(spark, folder):
    return graph.as_rows(*_lineage_graph(spark, folder))


@query(
    "action_graph",
    """WITH w AS (SELECT o_orderkey AS k, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE [o_orderkey % 2500, (o_orderkey + 1) % 2500] END) AS p FROM orders),
    c AS (SELECT DISTINCT k, p, p_name FROM w JOIN part ON p_partkey = p),
    a AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' END AS decision FROM orders),
    x AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority < '3' AND o_orderkey % 2 = 0)
    SELECT CAST(o_orderkey AS VARCHAR) AS graph, 'node' AS part, concat('action:', o_orderkey) AS id, 'action' AS type, 'linear create_issue' AS detail FROM orders
    UNION ALL SELECT CAST(k AS VARCHAR), 'node', concat('source:', p), 'source', p_name FROM c
    UNION ALL SELECT CAST(k AS VARCHAR), 'node', concat('approval:', k), 'approval', decision FROM a WHERE decision IS NOT NULL
    UNION ALL SELECT CAST(k AS VARCHAR), 'node', concat('receipt:', k), 'receipt', concat('resp-', k) FROM x
    UNION ALL SELECT CAST(k AS VARCHAR), 'edge', concat('edge:source:', p, '->action:', k), 'SUPPORTS', concat('source:', p, '>action:', k) FROM c
    UNION ALL SELECT CAST(k AS VARCHAR), 'edge', concat('edge:action:', k, '->approval:', k), 'REQUIRES_APPROVAL', concat('action:', k, '>approval:', k) FROM a WHERE decision IS NOT NULL
    UNION ALL SELECT CAST(k AS VARCHAR), 'edge', concat('edge:action:', k, '->receipt:', k), 'EXECUTED_AS', concat('action:', k, '>receipt:', k) FROM x""",
)
def action_graph(spark, folder):
    k = F.col("o_orderkey")
    orders = table(spark, folder, "orders")
    ids = F.concat(F.lit('["'), k % 2500, F.lit('","'), (k + 1) % 2500, F.lit('"]'))
    proposals = orders.select(
        k.alias("proposal_id"), F.lit("linear").alias("provider"), F.lit("create_issue").alias("action_type"),
        F.when(k % 3 == 0, "{broken").otherwise(ids).alias("evidence_ids_json"),
    )
    title = F.concat(F.when(F.col("seq") == 2, "!").otherwise(""), "p_name")  # a later version that sorts first
    evidence = table(spark, folder, "part").withColumn("seq", F.explode(F.array(F.lit(2), F.lit(1)))).select(
        F.col("p_partkey").cast("string").alias("source_id"), title.alias("title"), F.lit("part").alias("provider"), "seq"
    )
    decision = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "rejected")
    approvals = orders.select(k.alias("proposal_id"), decision.alias("decision"))
    executions = orders.select(
        k.alias("proposal_id"), F.when(F.col("o_orderpriority") < "3", "succeeded").otherwise("failed").alias("status"),
        F.when(k % 2 == 0, F.concat(F.lit("resp-"), k)).otherwise("").alias("response_id"),
    )
    return graph.as_rows(*graph.action_graph(proposals, evidence, approvals, executions))


@query(
    "proof_graph",
    """WITH e AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS f, l_partkey AS p FROM lineitem),
    c AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n, l_partkey + CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END AS p FROM lineitem),
    n AS (SELECT DISTINCT k, concat('provider:', f) AS id, 'provider' AS type, f AS detail FROM e WHERE f <> 'N' UNION SELECT DISTINCT k, concat('evidence:', p), 'evidence', concat('part ', p) FROM e
      UNION SELECT DISTINCT k, concat('claim:', n), 'claim', concat('line ', n) FROM c UNION SELECT DISTINCT k, concat('contradiction:', p), 'contradiction', 'returned' FROM e WHERE f = 'R'
      UNION SELECT k, concat('action:', k), 'action', concat('next ', max(p)) FROM e WHERE f = 'A' GROUP BY k),
    l AS (SELECT k, concat('returned:', f, ':', p) AS id, 'returned' AS type, concat('provider:', f) AS s, concat('evidence:', p) AS t FROM e
      UNION SELECT k, concat('supports:', p, ':claim:', n), 'supports', concat('evidence:', p), concat('claim:', n) FROM c
      UNION SELECT k, concat('conflicts:', p, ':contradiction:', p), 'conflicts', concat('evidence:', p), concat('contradiction:', p) FROM e WHERE f = 'R'
      UNION SELECT k, concat('prioritises:', p, ':action:', k), 'prioritises', concat('evidence:', p), concat('action:', k) FROM e WHERE f = 'A')
    SELECT CAST(k AS VARCHAR) AS graph, 'node' AS part, id, type, detail FROM n
    UNION ALL SELECT CAST(l.k AS VARCHAR), 'edge', l.id, l.type, concat(s, '>', t) FROM l JOIN n a ON a.k = l.k AND a.id = s JOIN n b ON b.k = l.k AND b.id = t""",
)
def proof_graph(spark, folder):
    lines = _lines(spark, folder)
    q, seq = F.col("k").alias("question_id"), (-F.col("part")).alias("seq")
    providers = lines.select(q, F.col("flag").alias("provider"), F.when(F.col("flag") == "N", "not-required").otherwise("received").alias("status"), seq)
    evidence = lines.select(q, F.col("part").alias("evidence_id"), F.concat(F.lit("part "), "part").alias("title"), F.col("flag").alias("provider"), seq)
    claims = lines.select(
        q, F.col("n").cast("string").alias("key"), F.concat(F.lit("line "), "n").alias("label"),
        (F.col("part") + F.when(F.col("n") == 5, 1).otherwise(0)).alias("evidence_id"), seq,
    )
    conflicts = lines.where("flag = 'R'").select(q, F.col("part").cast("string").alias("key"), F.lit("returned").alias("label"), F.col("part").alias("evidence_id"), seq)
    tasks = lines.where("flag = 'A'").select(q, F.col("k").cast("string").alias("key"), F.concat(F.lit("next "), "part").alias("label"), F.col("part").alias("evidence_id"), seq)
    return graph.as_rows(*graph.proof_graph(providers, evidence, claims, conflicts, tasks))


@query(
    "graph_merge_stats",
    f"""WITH {_SRC}, u AS (SELECT * FROM ({_PACKET_SQL}) a UNION ALL SELECT * FROM ({_LINEAGE_SQL}) b),
    n AS (SELECT DISTINCT id, type FROM u WHERE part = 'node'), e AS (SELECT DISTINCT id, type FROM u WHERE part = 'edge')
    SELECT 'node' AS part, type, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY 2""",
)
def graph_merge_stats(spark, folder):
    parts = 4 if size_in_bytes(table(spark, folder, "lineitem")) > BROADCAST_LIMIT_BYTES else 1
    return graph.merge_counts([_packet_graph(spark, folder), _lineage_graph(spark, folder)], parts)
