"""Evidence graphs as node and edge tables.

Where an id comes twice, its first version by ``seq`` counts, as in the order of arrival.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import rules
from attestry.operators.shape import earliest
from attestry.session import written_table

NODE = ["graph", "id", "type", "label"]
EDGE = ["graph", "id", "type", "source", "target"]


def _node(df: DataFrame, graph: str, kind: str, key: Column, label: Column, *more: str) -> DataFrame:
    return df.select(
        F.col(graph).cast("string").alias("graph"), F.concat(F.lit(f"{kind}:"), key.cast("string")).alias("id"),
        F.lit(kind).alias("type"), label.alias("label"), *more,
    )


def _edge(df: DataFrame, graph: str, kind: str, source: Column, target: Column, name: Column | None = None) -> DataFrame:
    ends = df.select(F.col(graph).cast("string").alias("graph"), F.lit(kind).alias("type"), source.alias("source"), target.alias("target"))
    return ends.select("graph", F.concat(F.lit("edge:"), "source", F.lit("->"), "target").alias("id"), "type", "source", "target")


def _tag(prefix: str, col: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(col).cast("string"))


def _known(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """Edges whose ``end`` is a node of the same graph."""
    ids = nodes.select("graph", F.col("id").alias(end)).distinct()
    return edges.join(ids, ["graph", end], "left_semi").select(*EDGE)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _sources(evidence: DataFrame, graph: str) -> DataFrame:
    """Source nodes, the first of each id within its graph."""
    first = earliest(evidence.select(graph, "source_id", "title", "provider", "seq"), [graph, "source_id"], ["seq"])
    return _node(first, graph, "source", F.col("source_id"), _title("title", "provider"))


def _title(name: str, provider: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(provider))


def _conflicts(conflicts: DataFrame, graph: str, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contradiction nodes and REFUTES edges; ``conflicts`` has ``conflict_key``, ``summary``, ``evidence_id`` rows.

    Edges are matched with ``evidence`` by key, before ids are spelt out.
    """
    nodes = _node(conflicts.select(graph, "conflict_key", "summary").distinct(), graph, "contradiction", F.col("conflict_key"), F.col("summary"))
    known = evidence.select(graph, F.col("source_id").alias("evidence_id")).distinct()
    each = conflicts.select(graph, "conflict_key", "evidence_id").join(known, [graph, "evidence_id"], "left_semi").distinct()
    return nodes, _edge(each, graph, "REFUTES", _tag("source", "evidence_id"), _tag("contradiction", "conflict_key"))


def packet_graph(packets: DataFrame, evidence: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph of every packet: task, sources, contradictions and the recommended action.

    ``packets``: task_id, title, action. ``evidence``: task_id, source_id, title, provider, seq.
    ``conflicts``: task_id, conflict_key, summary, evidence_id.
    """
    g = "task_id"
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col(g).cast("string"))
    tasks = _node(packets, g, "task", F.col(g), title)
    sources = _sources(evidence, g)
    support = _edge(evidence.select(g, "source_id").distinct(), g, "SUPPORTS", _tag("source", "source_id"), _tag("task", g))
    against, refutes = _conflicts(conflicts, g, evidence)
    acting = packets.where(F.trim(F.coalesce("action", F.lit(""))) != "")
    actions = _node(acting, g, "action", F.col(g), F.trim("action"))
    resolves = _edge(acting, g, "RESOLVES", _tag("task", g), _tag("action", g))
    return _union([tasks, sources, against, actions]), _union([support, refutes, resolves])


def answer_graph(
    citations: DataFrame, claims: DataFrame, tasks: DataFrame, conflicts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Graph of every answer.

    ``citations``: question_id, source_id, title, provider, seq. ``claims``: question_id, claim_no,
    claim, evidence_id rows. ``tasks``: question_id, task_id, title, action, evidence_id rows.
    """
    g = "question_id"
    sources = _sources(citations, g)
    said = _node(claims, g, "claim", F.col("claim_no"), F.col("claim")).distinct()
    backs = _edge(claims.select(g, "claim_no", "evidence_id").distinct(), g, "SUPPORTS", _tag("source", "evidence_id"), _tag("claim", "claim_no"))
    work = _node(tasks, g, "task", F.col("task_id"), F.col("title")).distinct()
    helps = _edge(tasks.select(g, "task_id", "evidence_id").distinct(), g, "SUPPORTS", _tag("source", "evidence_id"), _tag("task", "task_id"))
    acting = tasks.where(F.trim(F.coalesce("action", F.lit(""))) != "").select(g, "task_id", "action").distinct()
    actions = _node(acting, g, "action", F.col("task_id"), F.trim("action"))
    resolves = _edge(acting, g, "RESOLVES", _tag("task", "task_id"), _tag("action", "task_id"))
    against, refutes = _conflicts(conflicts, g, citations)
    edges = [_known(backs, sources, "source"), _known(helps, sources, "source"), resolves, refutes]
    return _union([sources, said, work, actions, against]), _union(edges)


def lineage_graph(connectors: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Connectors and the sources they produced, linked by the stored key only.

    ``connectors``: connector_id, provider, name, state, seq; ``sources``: source_id, title, provider,
    connector_id, seq. The state rides in the label when it is a known one.
    """
    usable = connectors.where("connector_id IS NOT NULL AND provider IS NOT NULL")
    c = earliest(usable, ["connector_id"], ["seq"]).withColumn("g", F.lit("lineage"))
    state = F.when(F.col("state").isin(rules.CONNECTOR_STATES), F.col("state"))
    label = F.concat_ws(" ", F.coalesce(F.nullif(F.col("name"), F.lit("")), "provider"), state)
    hubs = _node(c, "g", "connector", F.col("connector_id"), label)
    s = earliest(sources.where("source_id IS NOT NULL"), ["source_id"], ["seq"]).withColumn("g", F.lit("lineage"))
    leaves = _node(s, "g", "source", F.col("source_id"), _title("title", "provider"))
    came = _edge(s.where("connector_id IS NOT NULL"), "g", "ORIGINATED_FROM", _tag("source", "source_id"), _tag("connector", "connector_id"))
    return _union([hubs, leaves]), _known(came, hubs, "target")


def action_graph(
    proposals: DataFrame, evidence: DataFrame, approvals: DataFrame, executions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Proposals with their evidence, approval and confirmed execution.

    ``proposals``: proposal_id, provider, action_type, evidence_ids_json. ``evidence``: source_id, title,
    provider, seq. Unreadable JSON gives
    no evidence; only a succeeded execution with a response id is a receipt.
    """
    g = "proposal_id"
    name = F.trim(F.concat_ws(" ", F.coalesce("provider", F.lit("unknown")), F.coalesce("action_type", F.lit("unknown"))))
    actions = _node(proposals, g, "action", F.col(g), name)
    raw = F.trim("evidence_ids_json")
    ids = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    wanted = proposals.select(g, F.explode(F.array_distinct(ids)).alias("source_id"))
    found = earliest(evidence.select("source_id", "title", F.col("provider").alias("s_provider"), "seq"), ["source_id"], ["seq"])
    cited = wanted.join(found, "source_id")
    sources = _node(cited, g, "source", F.col("source_id"), _title("title", "s_provider"))
    support = _edge(cited, g, "SUPPORTS", _tag("source", "source_id"), _tag("action", g))
    decided = approvals.where("decision IS NOT NULL AND decision <> ''").join(proposals.select(g), g, "left_semi")
    gates = _node(decided, g, "approval", F.col(g), F.col("decision"))
    needs = _edge(decided, g, "REQUIRES_APPROVAL", _tag("action", g), _tag("approval", g))
    done = executions.where("status = 'succeeded' AND response_id IS NOT NULL AND response_id <> ''").join(proposals.select(g), g, "left_semi")
    receipts = _node(done, g, "receipt", F.col(g), F.col("response_id"))
    ran = _edge(done, g, "EXECUTED_AS", _tag("action", g), _tag("receipt", g))
    return _union([actions, sources, gates, receipts]), _union([support, needs, ran])


def proof_graph(
    providers: DataFrame, evidence: DataFrame, claims: DataFrame, conflicts: DataFrame, tasks: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Providers, what they returned, and the claims, contradictions and actions built on it.

    All inputs carry ``question_id`` and ``seq``; links are (``key``, ``evidence_id``) rows with a ``label``.
    Edges survive only between nodes that exist.
    """
    g = "question_id"
    asked = providers.where("status <> 'not-required'").select(g, F.col("provider").alias("key"), F.col("provider").alias("label"), "seq")
    facts = evidence.select(g, F.col("evidence_id").alias("key"), F.col("title").alias("label"), "seq")
    kinds = [("claim", claims, "supports"), ("contradiction", conflicts, "conflicts"), ("action", tasks, "prioritises")]

    def first(df: DataFrame, kind: str) -> DataFrame:
        """First version of each node; kinds have ids of their own."""
        return _node(earliest(df.select(g, "key", "label", "seq"), [g, "key"], ["seq", "label"]), g, kind, F.col("key"), F.col("label"))

    def link(df: DataFrame, kind: str, a: Column, b: Column, ident: Column) -> DataFrame:
        return df.select(F.col(g).cast("string").alias("graph"), ident.alias("id"), F.lit(kind).alias("type"), a.alias("source"), b.alias("target"))

    def between(df: DataFrame, other: str, known: DataFrame, by: str) -> DataFrame:
        """Distinct links whose end ``by`` is known; the other end is a node made of the same rows."""
        ends = known.select(g, F.col("key").alias(by)).distinct()
        rows = df.select(g, by, other).where(F.col(other).isNotNull())
        return rows.join(ends, [g, by], "left_semi").select(g, by, other).distinct()

    # Keys travel as they came; ids are spelt out at the end, so that no shuffle carries them.
    nodes = _union([first(asked, "provider"), first(facts, "evidence"), *[first(df, kind) for kind, df, _ in kinds]])
    edges = [link(between(evidence, "evidence_id", asked, "provider"), "returned", _tag("provider", "provider"), _tag("evidence", "evidence_id"),
                  F.concat_ws(":", F.lit("returned"), "provider", "evidence_id"))]
    for kind, df, verb in kinds:
        edges.append(link(between(df, "key", facts, "evidence_id"), verb, _tag("evidence", "evidence_id"), _tag(kind, "key"),
                          F.concat_ws(":", F.lit(verb), "evidence_id", F.lit(kind), "key")))
    return nodes, _union(edges)


def merged(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Several graphs as one: first version of a node by graph order, edges with a known source.

    Edges meet their sources first; their copies then lie together and are dropped without another shuffle.
    """
    nodes = _union([n.select(*NODE).withColumn("_g", F.lit(i)) for i, (n, _) in enumerate(graphs)])
    best = F.min_by(F.struct("type", "label"), F.struct("_g", "graph")).alias("_b")
    first = nodes.groupBy("id").agg(best).select("id", "_b.type", "_b.label")
    edges = _union([e.select("id", "type", "source", "target") for _, e in graphs])
    known = nodes.select(F.col("id").alias("source")).distinct()
    return first, edges.join(known, "source", "left_semi").select("id", "type", "source", "target").distinct()


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    each = nodes.select(F.lit("node").alias("part"), "type").union(edges.select(F.lit("edge"), "type"))
    return each.groupBy("part", "type").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(graphs: list[tuple[DataFrame, DataFrame]], parts: int = 1) -> DataFrame:
    """:func:`counts` of the :func:`merged` graphs, one part of the ids after the other, so that disk holds the shuffles of one.

    An edge goes with its source. The part is told by the id alone, so Spark drops the other parts where the rows are read.
    """
    def part(p: int) -> DataFrame:
        own = lambda df, col: df.where(F.pmod(F.xxhash64(col), F.lit(parts)) == p) if parts > 1 else df
        return counts(*merged([(own(n, "id"), own(e, "source")) for n, e in graphs]))

    if parts == 1:
        return part(0)
    every = reduce(DataFrame.unionByName, [written_table(part(p)) for p in range(parts)])
    return every.groupBy("part", "type").agg(F.sum("n").alias("n"))


def as_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges in one table for comparison and export."""
    n = nodes.select("graph", F.lit("node").alias("part"), "id", "type", F.col("label").alias("detail"))
    return n.unionByName(edges.select("graph", F.lit("edge").alias("part"), "id", "type", F.concat_ws(">", "source", "target").alias("detail")))
