"""Deduplication and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import rules
from attestry.functions import text
from attestry.operators import cluster
from attestry.plans.evidence import clean_sql
from attestry.plans.fixtures import MIRRORS_CTE, MIRRORS_SQL, RECORDS_CTE, records
from attestry.plans.registry import query, quote, sql_list
from attestry.plans.textjobs import SPANS_CTE, record_spans
from attestry.sources.tables import spread, table


def task_evidence(spark, folder):
    """Records with an actionable span, and the same tasks as another tool reports them."""
    columns = ["workspace_id", "record_id", "seq", "provider", "title", "span", "source_date"]
    mirrors = spark.sql(MIRRORS_SQL, records=records(spark, folder)).select(*columns)
    return record_spans(spark, folder).select(*columns).unionByName(mirrors)


TASKS_CTE = f"""{RECORDS_CTE}, {MIRRORS_CTE}, {SPANS_CTE},
tasks AS (SELECT workspace_id, r.record_id, seq, provider, title, span, source_date FROM records r JOIN spans s ON s.record_id = r.record_id
  UNION ALL SELECT workspace_id, record_id, seq, provider, title, span, source_date FROM mirrors),
corp AS (SELECT *, concat(workspace_id, '/', record_id) AS node, concat(title, ' ', span) AS body FROM tasks),
idd AS (SELECT *, list_transform(list_distinct(regexp_extract_all(body, {quote(rules.TASK_ID)})), lambda i: concat(workspace_id, '/', i)) AS ids FROM corp)"""


@query(
    "content_dedup",
    """SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, sha256(text)) AS first_seq,
      doc_id <> min(doc_id) OVER (PARTITION BY lang, sha256(text)) AS is_duplicate FROM documents""",
)
def content_dedup(spark, folder):
    docs = spread(table(spark, folder, "documents")).select("doc_id", "lang", F.sha2("text", 256).alias("content_hash"))
    return cluster.mark_duplicates(docs, ["lang", "content_hash"], "doc_id").select("doc_id", "first_seq", "is_duplicate")


@query(
    "evidence_dedup",
    f"""SELECT min(doc_id) AS doc_id, source, doc_id % 50 AS external_id FROM documents
    GROUP BY source, doc_id % 50, sha256({clean_sql('lower(text)')})""",
)
def evidence_dedup(spark, folder):
    docs = spread(table(spark, folder, "documents")).select(
        "doc_id", "source", (F.col("doc_id") % 50).alias("external_id"), F.sha2(text.clean(F.lower("text")), 256).alias("span")
    )
    return cluster.first_wins(docs, ["source", "external_id", "span"], "doc_id").select("doc_id", "source", "external_id")


@query(
    "lane_merge_dedup",
    """WITH l AS (SELECT sha256(text) AS k, doc_id, 1 AS t, 0 AS h FROM documents WHERE contains(text, ' the ')
      UNION ALL SELECT sha256(text), doc_id, 0, 1 FROM documents WHERE n_chars > 1000 OR NOT contains(text, ' the '))
    SELECT k AS chunk_key, min(doc_id) AS doc_id, max(t) AS in_text, max(h) AS in_hybrid FROM l GROUP BY 1""",
)
def lane_merge_dedup(spark, folder):
    docs = spread(table(spark, folder, "documents"))
    pick = lambda d: d.select(F.sha2("text", 256).alias("chunk_key"), "doc_id")
    worded = F.coalesce(F.col("text").contains(" the "), F.lit(False))
    lanes = {"text": pick(docs.where(worded)), "hybrid": pick(docs.where((F.col("n_chars") > 1000) | ~worded))}
    return cluster.merge_lanes(lanes, ["chunk_key"], "doc_id")


_LINES_CTE = """lines AS (SELECT DISTINCT concat('d', doc_id) AS node, md5(x) AS id FROM
  (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\\n'))) AS x FROM documents) y WHERE length(x) >= 24)"""


def _components_sql(members: str) -> str:
    """Components by walking a spanning star per identifier; ``members`` has (node, id)."""
    return f"""hub AS (SELECT node, min(node) OVER (PARTITION BY id) AS hub FROM {members}),
    link AS (SELECT DISTINCT node AS a, hub AS b FROM hub WHERE node <> hub UNION SELECT hub, node FROM hub WHERE node <> hub),
    walk AS (SELECT DISTINCT node, node AS seen FROM {members} UNION SELECT w.node, l.b FROM walk w JOIN link l ON l.a = w.seen),
    comp AS (SELECT node, min(seen) AS root FROM walk GROUP BY 1)"""


@query(
    "id_components",
    f"""WITH RECURSIVE {_LINES_CTE}, {_components_sql('lines')}
    SELECT node, root FROM comp""",
)
def id_components(spark, folder):
    docs = spread(table(spark, folder, "documents")).select("doc_id", F.split("text", "\n").alias("parts"))
    ids = F.array_distinct(
        F.transform(
            F.filter(F.transform("parts", lambda x: F.trim(x)), lambda x: F.length(x) >= 24), lambda x: F.md5(x)
        )
    )
    rows = docs.select(F.concat(F.lit("d"), "doc_id").alias("node"), ids.alias("ids"))
    parts = cluster.identifier_components(rows, "node", "ids")
    # Name a component by its least member, as identifiers are hashes here.
    roots = parts.groupBy("component").agg(F.min("node").alias("root"))
    return parts.join(roots, "component").select("node", "root")


_TOKENS = f"list_distinct(list_filter(regexp_extract_all(lower(span), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({sql_list(rules.WORDING_STOP_WORDS)})))"
_MONTH_RE = rules._MONTHS_LONG
_DATES = f"""list_distinct(list_concat(list_concat(regexp_extract_all(lower(span), '\\d{{4}}-\\d{{2}}-\\d{{2}}'),
  list_transform(regexp_extract_all(lower(span), '\\d{{1,2}} (?:{_MONTH_RE}) \\d{{4}}'), lambda d: CAST(CAST(strptime(d, '%-d %B %Y') AS DATE) AS VARCHAR))),
  CASE WHEN contains(lower(span), 'tomorrow') THEN [CAST(source_date + 1 AS VARCHAR)] ELSE [] END))"""
_YEARS = f"list_transform(list_concat(regexp_extract_all(lower(span), '\\d{{4}}-\\d{{2}}-\\d{{2}}'), regexp_extract_all(lower(span), '(?:{_MONTH_RE}) (\\d{{4}})', 1)), lambda y: left(y, 4))"
_SAME_CTE = f"""feat AS MATERIALIZED (SELECT *, {_TOKENS} AS tok, {_DATES} AS dts, list_concat({_YEARS},
    CASE WHEN starts_with(span, 'Priya Raman') THEN ['priya', 'raman'] WHEN starts_with(span, 'Engineering') THEN ['engineering'] WHEN starts_with(span, 'Support') THEN ['support']
    WHEN contains(span, 'AtlasLaunch') THEN regexp_extract_all(lower(span), 'atlaslaunch\\d+') ELSE [] END) AS ok FROM idd),
same AS MATERIALIZED (SELECT l.node AS a, r.node AS b, l.ids AS ids_a, r.ids AS ids_b FROM feat l JOIN feat r ON l.workspace_id = r.workspace_id AND l.node < r.node
    AND l.provider <> r.provider AND len(list_intersect(l.tok, r.tok)) >= 5
  WHERE len(list_intersect(l.tok, r.tok)) >= 0.8 * least(len(l.tok), len(r.tok))
    AND len(list_intersect(l.tok, r.tok)) >= 0.65 * (len(l.tok) + len(r.tok) - len(list_intersect(l.tok, r.tok)))
    AND (len(l.dts) = 0 OR len(r.dts) = 0 OR len(list_intersect(l.dts, r.dts)) > 0)
    AND len(list_filter(l.tok, lambda t: NOT list_contains(r.tok, t) AND NOT list_contains(l.ok, t))) = 0
    AND len(list_filter(r.tok, lambda t: NOT list_contains(l.tok, t) AND NOT list_contains(r.ok, t))) = 0)"""


def _keyed(spark, folder):
    corpus = F.concat_ws(" ", "title", "span")
    return task_evidence(spark, folder).withColumns(
        {
            "node": F.concat_ws("/", F.col("workspace_id").cast("string"), "record_id"),
            "home": F.when(F.size(text.task_ids(corpus)) > 0, "id").otherwise(""),
        }
    )


@query(
    "wording_pairs",
    f"""WITH {TASKS_CTE}, {_SAME_CTE}, links AS (SELECT a AS node, b AS other FROM same UNION ALL SELECT b, a FROM same)
    SELECT f.node, count(other) AS n_links, min(other) AS first_match FROM feat f LEFT JOIN links ON links.node = f.node GROUP BY 1""",
)
def wording_pairs(spark, folder):
    return cluster.wording_links(_keyed(spark, folder), "node")


@query(
    "reciprocal_unique_match",
    f"""WITH {TASKS_CTE}, {_SAME_CTE}, sides AS (SELECT a AS x, b AS y FROM same WHERE len(ids_a) = 0 AND len(ids_b) = 0
      UNION ALL SELECT b, a FROM same WHERE len(ids_a) = 0 AND len(ids_b) = 0),
    one AS (SELECT x, min(y) AS y FROM sides GROUP BY 1 HAVING count(*) = 1)
    SELECT p.x AS a, p.y AS b FROM one p JOIN one q ON q.x = p.y AND q.y = p.x WHERE p.x < p.y""",
)
def reciprocal_unique_match(spark, folder):
    features = cluster.folded(_keyed(spark, folder).where("home = ''"), "node", [])
    sigs = cluster.cut_lineage(cluster.signatures(features, "node", []))
    pairs = cluster.wording_pairs(sigs).select(
        F.col("rep").alias("a"), F.col("rep2").alias("b"), F.col("l.n").alias("n_a"), F.col("r.n").alias("n_b")
    )
    return cluster.reciprocal_unique(pairs).select("a", "b")


def _known(spark, folder):
    corpus = F.concat_ws(" ", "title", "span")
    scope = F.col("workspace_id").cast("string")
    tasks = task_evidence(spark, folder).withColumns(
        {
            "node": F.concat_ws("/", scope, "record_id"),
            "ids": F.transform(text.task_ids(corpus), lambda i: F.concat_ws("/", scope, i)),
            "entities": text.product_names(corpus),
        }
    )
    tasks = cluster.cut_lineage(tasks)  # spans are taken from the texts once; components read them several times
    parts = cluster.identifier_components(tasks, "node", "ids")
    return tasks.join(parts, "node", "left")


_COMP_CTE = f"""memb AS (SELECT node, unnest(ids) AS id FROM idd), {_components_sql('memb')},
rooted AS (SELECT m.node, min(m2.id) AS component FROM comp m JOIN comp c2 ON c2.root = m.root JOIN memb m2 ON m2.node = c2.node GROUP BY 1)"""
_ATTACH_CTE = f"""{_COMP_CTE},
wm AS (SELECT DISTINCT a AS node, component FROM same JOIN rooted ON rooted.node = b WHERE len(ids_a) = 0 AND len(ids_b) > 0
  UNION SELECT DISTINCT b, component FROM same JOIN rooted ON rooted.node = a WHERE len(ids_b) = 0 AND len(ids_a) > 0),
ent AS (SELECT node, workspace_id, ids, dts, unnest(list_distinct(regexp_extract_all(body, {quote(rules.PRODUCT_NAME)}))) AS entity FROM feat),
em AS (SELECT DISTINCT l.node, component FROM ent l JOIN ent r ON l.workspace_id = r.workspace_id AND l.entity = r.entity AND len(l.ids) = 0 AND len(r.ids) > 0
  AND (len(l.dts) = 0 OR len(r.dts) = 0 OR len(list_intersect(l.dts, r.dts)) > 0) JOIN rooted ON rooted.node = r.node),
wc AS (SELECT node, count(*) AS n, min(component) AS component FROM wm GROUP BY 1),
ec AS (SELECT node, count(*) AS n, min(component) AS component FROM em GROUP BY 1),
attached AS (SELECT f.node, CASE WHEN wc.n = 1 THEN wc.component WHEN wc.n IS NULL AND ec.n = 1 THEN ec.component END AS component,
  CASE WHEN wc.n = 1 THEN 'wording' WHEN wc.n IS NULL AND ec.n = 1 THEN 'entity' END AS matched_by
  FROM feat f LEFT JOIN wc ON wc.node = f.node LEFT JOIN ec ON ec.node = f.node WHERE len(f.ids) = 0)"""


@query(
    "idless_attach",
    f"WITH RECURSIVE {TASKS_CTE}, {_SAME_CTE}, {_ATTACH_CTE} SELECT node AS record_id, component, matched_by FROM attached WHERE component IS NOT NULL",
)
def idless_attach(spark, folder):
    known = cluster.cut_lineage(_known(spark, folder))
    wording, entities, _ = cluster.match_records(known)
    idless = known.where("component IS NULL").select(F.col("node").alias("record_id"))
    return cluster.attach_idless(idless, wording, entities)


@query(
    "document_attach",
    f"""WITH RECURSIVE {TASKS_CTE}, work AS (SELECT * FROM idd WHERE provider <> 'document'), memb AS (SELECT node, unnest(ids) AS id FROM work), {_components_sql('memb')},
    ids_of AS (SELECT DISTINCT root, id FROM comp JOIN memb USING (node)),
    d AS (SELECT concat(workspace_id, '/', record_id) AS node, workspace_id, unnest(regexp_extract_all(concat(title, ' ', excerpt), {quote(rules.TASK_ID)})) AS id FROM records WHERE provider = 'document')
    SELECT d.node AS record_id, min(root) AS cluster_root FROM d JOIN ids_of o ON o.id = concat(d.workspace_id, '/', d.id) GROUP BY 1 HAVING count(DISTINCT root) = 1""",
)
def document_attach(spark, folder):
    scope = F.col("workspace_id").cast("string")
    located = lambda ids: F.transform(ids, lambda i: F.concat_ws("/", scope, i))
    work = task_evidence(spark, folder).where("provider <> 'document'").select(
        F.concat_ws("/", scope, "record_id").alias("node"), located(text.task_ids(F.concat_ws(" ", "title", "span"))).alias("ids")
    )
    work = cluster.cut_lineage(work)
    parts = cluster.identifier_components(work, "node", "ids")
    roots = parts.groupBy("component").agg(F.min("node").alias("root"))
    ids_of = work.join(parts, "node").join(roots, "component").select(F.col("root").alias("cluster"), F.explode("ids").alias("identifier"))
    docs = records(spark, folder).where("provider = 'document'").select(
        F.concat_ws("/", scope, "record_id").alias("record_id"),
        located(text.task_ids(F.concat_ws(" ", "title", "excerpt"))).alias("ids"),
    )
    return cluster.attach_documents(docs, ids_of).select("record_id", F.col("cluster").alias("cluster_root"))


@query(
    "task_clusters",
    f"""WITH RECURSIVE {TASKS_CTE}, {_SAME_CTE}, {_ATTACH_CTE},
    pairs AS (SELECT a AS x, b AS y FROM same WHERE len(ids_a) = 0 AND len(ids_b) = 0 UNION ALL SELECT b, a FROM same WHERE len(ids_a) = 0 AND len(ids_b) = 0),
    one AS (SELECT x, min(y) AS y FROM pairs GROUP BY 1 HAVING count(*) = 1),
    tie AS (SELECT coalesce(r.component, i.node) AS home, i.node FROM idd i LEFT JOIN rooted r ON r.node = i.node),
    e AS (SELECT node AS a, component AS b FROM attached WHERE component IS NOT NULL
      UNION SELECT p.x, p.y FROM one p JOIN one q ON q.x = p.y AND q.y = p.x),
    e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    walk2 AS (SELECT DISTINCT home AS n, home AS seen FROM tie UNION SELECT w.n, e2.b FROM walk2 w JOIN e2 ON e2.a = w.seen),
    fin AS (SELECT n, min(seen) AS cluster FROM walk2 GROUP BY 1)
    SELECT tie.node AS record, cluster FROM tie JOIN fin ON fin.n = tie.home""",
)
def task_clusters(spark, folder):
    out = cluster.cluster_tasks(task_evidence(spark, folder))
    return out.select(F.concat_ws("/", F.col("workspace_id").cast("string"), "record_id").alias("record"), "cluster")


@query(
    "cluster_primary",
    f"""WITH {TASKS_CTE}, k AS (SELECT *, coalesce(list_sort(ids)[1], node) AS cluster FROM idd)
    SELECT cluster, record_id, provider FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY CASE WHEN provider = 'document' THEN 1 ELSE 0 END,
      length(span) DESC, seq) AS n FROM k) t WHERE n = 1""",
)
def cluster_primary(spark, folder):
    return cluster.primary(_by_first_id(spark, folder), "cluster").select("cluster", "record_id", "provider")


def _by_first_id(spark, folder):
    scope = F.col("workspace_id").cast("string")
    first = F.array_min(text.task_ids(F.concat_ws(" ", "title", "span")))
    return task_evidence(spark, folder).withColumn("cluster", F.concat_ws("/", scope, F.coalesce(first, "record_id")))


@query(
    "supporting_evidence",
    f"""WITH {TASKS_CTE}, k AS (SELECT *, coalesce(list_sort(ids)[1], node) AS cluster FROM idd)
    SELECT cluster, record_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY CASE WHEN provider = 'document' THEN 1 ELSE 0 END,
      length(span) DESC, seq) AS n FROM k) t WHERE n > 1""",
)
def supporting_evidence(spark, folder):
    members = _by_first_id(spark, folder)
    main = cluster.primary(members, "cluster").select("record_id")
    return members.join(main, "record_id", "left_anti").select("cluster", "record_id")


@query(
    "task_key",
    f"""WITH {RECORDS_CTE}, b AS (SELECT *, list_sort(list_distinct(regexp_extract_all(concat(title, ' ', excerpt), {quote(rules.TASK_ID)}))) AS ids,
      list_sort(list_distinct(regexp_extract_all(concat(title, ' ', excerpt), {quote(rules.PRODUCT_NAME)}))) AS names FROM records)
    SELECT record_id, CASE WHEN len(ids) > 0 THEN concat('id:', array_to_string(ids, '|')) WHEN len(names) > 0 THEN concat('entity:', array_to_string(names, '|'))
      ELSE concat('source:', provider, ':', external_id) END AS task_key FROM b""",
)
def task_key(spark, folder):
    key = cluster.task_key(F.col("provider"), F.col("external_id"), F.concat_ws(" ", "title", "excerpt"))
    return records(spark, folder).select("record_id", key.alias("task_key"))
