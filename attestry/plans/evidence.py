"""Scans, projections and filters over evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from attestry import rules
from attestry.functions import secrets, text
from attestry.operators import evidence
from attestry.operators.shape import latest
from attestry.plans.fixtures import QUESTIONS_CTE, RECORDS_CTE, questions, records
from attestry.plans.ranking import QUEUE_CTE, order_queue
from attestry.plans.registry import query, quote
from attestry.session import cut_lineage
from attestry.sources import intake, sinks
from attestry.sources.tables import spread, table


def redact_sql(column: str) -> str:
    return reduce(
        lambda e, r: f"regexp_replace({e}, {quote(r[1])}, {quote(r[2].replace('$', chr(92)))}, 'g')",
        rules.SECRET_RULES,
        column,
    )


def clean_sql(column: str, limit: int | None = None) -> str:
    out = f"trim(regexp_replace(regexp_replace({column}, '[\\s\\x0b]+', ' ', 'g'), '[\\x00-\\x1f]', ' ', 'g'))"
    return out if limit is None else f"left({out}, {limit})"


@query(
    "scan_verified_scope",
    """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS order_day FROM orders
    WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey""",
)
def scan_verified_scope(spark, folder):
    orders = table(spark, folder, "orders")
    scope = orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))
    return scope.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_day")).orderBy("o_orderkey")


RESPONSE_SQL = """CASE event_id % 3
  WHEN 0 THEN concat('{"sources":[{"id":"s', cast(event_id AS string), '","title":"', event_type, '","app_provider":"Slack"}],"chunks":[',
    '{"source_id":"s', cast(event_id AS string), '","chunk_id":"c1","chunk_content":"one","relevancy_score":0.5},',
    '{"id":"s', cast(event_id AS string), '","chunk_id":"c2","chunk_content":"two","relevancy_score":0.25}]}')
  WHEN 1 THEN concat('{"data":{"sources":[{"source_id":"s', cast(event_id AS string), '","title":"', event_type,
    '"},{"context_id":"x', cast(event_id AS string), '"}],"chunks":[]}}')
  ELSE props END"""


@query(
    "nested_response_explode",
    """WITH e AS (SELECT event_id, event_type, concat('s', event_id) AS sid FROM events)
    SELECT event_id, 0 AS pos, sid AS source_id, event_type AS title, 'slack' AS provider, 2 AS n_chunks FROM e WHERE event_id % 3 = 0
    UNION ALL SELECT event_id, 0, sid, event_type, NULL, 0 FROM e WHERE event_id % 3 = 1
    UNION ALL SELECT event_id, 1, concat('x', event_id), NULL, NULL, 0 FROM e WHERE event_id % 3 = 1
    UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, 0 FROM e WHERE event_id % 3 = 2""",
)
def nested_response_explode(spark, folder):
    responses = table(spark, folder, "events").select("event_id", F.expr(RESPONSE_SQL).alias("payload"))
    sources = intake.response_sources(responses, "payload", "event_id")
    chunks = (
        intake.response_chunks(responses, "payload", "event_id")
        .groupBy("event_id", "source_id")
        .agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
    )
    return sources.join(chunks, ["event_id", "source_id"], "left").select(
        "event_id", "pos", "source_id", "title", "provider", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")
    )


INTAKE_SQL = """SELECT page_id,
  CASE page_id % 6 WHEN 0 THEN concat('%PDF-1.7 ', html) WHEN 1 THEN '' WHEN 2 THEN concat('%PDF-', url) ELSE html END AS body,
  CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html; charset=utf-8' WHEN 2 THEN '' ELSE 'text/plain' END AS mime,
  CASE page_id % 5 WHEN 0 THEN 'notes.md' WHEN 1 THEN 'scan.PDF' WHEN 2 THEN 'readme' ELSE 'page.html' END AS filename
FROM {pages}"""


@query(
    "doc_intake_classify",
    f"""WITH p AS ({INTAKE_SQL.format(pages='pages')}), b AS (SELECT *, strlen(body) AS n, starts_with(body, '%PDF-') AS pdf,
       lower(filename) AS fn, trim(split_part(lower(mime), ';', 1)) AS m FROM p)
    SELECT page_id,
      CASE WHEN n = 0 OR n > 3000 THEN NULL WHEN pdf THEN CASE WHEN m NOT IN ('', 'application/pdf', 'application/octet-stream') THEN NULL ELSE 'pdf' END
        WHEN m = 'application/pdf' OR fn LIKE '%.pdf' THEN NULL WHEN fn LIKE '%.md' THEN 'markdown' ELSE 'text' END AS kind,
      CASE WHEN n = 0 THEN 'The uploaded file is empty.' WHEN n > 3000 THEN 'File exceeds the 0 MB limit.'
        WHEN pdf THEN CASE WHEN m NOT IN ('', 'application/pdf', 'application/octet-stream') THEN concat('File content is a PDF but was declared as ', m, '.') END
        WHEN m = 'application/pdf' OR fn LIKE '%.pdf' THEN 'File claims to be a PDF but does not begin with the PDF signature.' END AS reason
    FROM b""",
)
def doc_intake_classify(spark, folder):
    files = spark.sql(INTAKE_SQL, pages=table(spark, folder, "pages"))
    result = intake.classify_document(F.encode("body", "UTF-8"), F.col("mime"), F.col("filename"), limit=3000)
    return files.select("page_id", result.alias("r")).select("page_id", "r.kind", "r.reason")


@query("run_output_append", f"WITH {QUEUE_CTE} SELECT workspace_id, task_id, rank, score FROM queue")
def run_output_append(spark, folder):
    base = f"{run_folder(spark)}/queue-runs"
    # Items, packets and snapshot all read one materialised queue, so a retry cannot mix two.
    items = cut_lineage(order_queue(spark, folder).select("workspace_id", "task_id", "rank", "score"))
    packets = items.select(
        "workspace_id", "task_id", F.to_json(F.struct("task_id", "rank", "score")).alias("packet_json")
    )
    snapshot = items.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n_items"))
    run_id = "run-" + spark.sparkContext.applicationId
    sinks.append_run(base, run_id, {"items": items, "packets": packets}, snapshot)
    written = sinks.read_committed(spark, base, "items").where(F.col("run_id") == run_id)
    return written.select("workspace_id", "task_id", "rank", "score")


def run_folder(spark) -> str:
    """Shared folder for written runs: beside the checkpoints the cluster names."""
    import tempfile

    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="attestry-runs-")
    return folder.rstrip("/")


@query(
    "upsert_latest",
    """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status, floor(o_totalprice) AS amount, 0 AS version FROM orders
      UNION ALL SELECT l_orderkey, l_linestatus, floor(l_extendedprice), l_linenumber + 10 * l_partkey FROM lineitem WHERE l_returnflag = 'R')
    SELECT k, status, amount FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY version DESC, amount DESC, status DESC) AS n FROM a) t WHERE n = 1""",
)
def upsert_latest(spark, folder):
    base = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"),
        F.floor("o_totalprice").cast("double").alias("amount"), F.lit(0).cast("bigint").alias("version"),
    )
    updates = table(spark, folder, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("status"),
        F.floor("l_extendedprice").cast("double").alias("amount"),
        (F.col("l_linenumber") + 10 * F.col("l_partkey")).alias("version"),
    )
    return latest(base.unionByName(updates), ["k"], ["version", "amount", "status"]).select("k", "status", "amount")


def _csv_sql(column: str) -> str:
    cell = f"CASE WHEN regexp_matches({column}, '^[=+\\-@]') THEN concat('''', {column}) ELSE {column} END"
    return f"CASE WHEN regexp_matches({cell}, '[\",\\n]') THEN concat('\"', replace({cell}, '\"', '\"\"'), '\"') ELSE {cell} END"


@query(
    "csv_report",
    f"""WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN concat('=', text) ELSE text END AS body FROM documents)
    SELECT concat(CAST(doc_id AS VARCHAR), ',', lang, ',', {_csv_sql('body')}) AS line FROM d""",
)
def csv_report(spark, folder):
    docs = spread(table(spark, folder, "documents")).select(
        "doc_id", "lang",
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("="), "text")).otherwise(F.col("text")).alias("body"),
    )
    return sinks.csv_lines(docs)


SNAPSHOT_SQL = """CASE event_id % 7 WHEN 0 THEN 'not json' WHEN 1 THEN '{"a":1}'
  ELSE concat('["p', cast(event_id AS string), '","', event_type, '"]') END"""


@query(
    "snapshot_list",
    """SELECT event_id AS snapshot_id, CASE WHEN event_id % 7 IN (0, 1) THEN '' ELSE concat('p', event_id, ',', event_type) END AS packet_ids,
      CASE WHEN event_id % 7 IN (0, 1) THEN 0 ELSE 2 END AS n_packets
    FROM events WHERE user_id % 5 = 2 ORDER BY ts DESC, event_id DESC LIMIT 50""",
)
def snapshot_list(spark, folder):
    snapshots = table(spark, folder, "events").where(F.col("user_id") % 5 == 2)
    raw = F.expr(SNAPSHOT_SQL)
    parsed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
    ids = F.coalesce(parsed, F.array().cast("array<string>"))
    newest = snapshots.orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return newest.select(
        F.col("event_id").alias("snapshot_id"), F.array_join(ids, ",").alias("packet_ids"), F.size(ids).alias("n_packets")
    )


@query(
    "evidence_normalise",
    f"""WITH n AS (
      SELECT concat('doc-', doc_id) AS rid, NULL AS name, {clean_sql('text')} AS raw, lower(source) AS provider, CAST(NULL AS VARCHAR) AS stamp FROM documents
      UNION ALL SELECT concat('conv-', conv_id, '-', turn), CASE WHEN turn % 2 = 0 THEN concat('  ', role, ' turn ') ELSE ' ' END,
        {clean_sql('text')}, lower(role), CASE WHEN turn % 3 = 0 THEN '2024-01-05 10:00:00' ELSE 'soon' END FROM conversations)
    SELECT rid, {redact_sql(clean_sql("coalesce(nullif(trim(name), ''), regexp_split_to_array(raw, '[.!?]\\s')[1])", 180))} AS title,
      {redact_sql('raw')} AS excerpt, 'primary' AS authority, epoch(try_cast(stamp AS TIMESTAMP)) AS event_epoch,
      regexp_matches(raw, {quote(rules.INJECTION)}) AS unsafe, provider FROM n""",
)
def evidence_normalise(spark, folder):
    docs = spread(table(spark, folder, "documents")).select(
        F.concat(F.lit("doc-"), "doc_id").alias("rid"), F.lit(None).cast("string").alias("name"), "text",
        F.lower("source").alias("provider"), F.lit(None).cast("string").alias("stamp"),
    )
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("rid"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  "), "role", F.lit(" turn "))).otherwise(" ").alias("name"),
        "text", F.lower("role").alias("provider"),
        F.when(F.col("turn") % 3 == 0, "2024-01-05 10:00:00").otherwise("soon").alias("stamp"),
    )
    out = evidence.normalise(docs.unionByName(turns), ["name"], ["text"], ["stamp"])
    return out.select(
        "rid", "title", "excerpt", "authority",
        F.unix_seconds(F.col("event_time")).cast("double").alias("event_epoch"), "unsafe", "provider",
    )


LABEL_SQL = """CASE doc_id % 6 WHEN 0 THEN 'Google' WHEN 1 THEN 'MSTeams' WHEN 2 THEN 'google_mail' WHEN 3 THEN '' END"""


@query(
    "provider_canonical",
    """SELECT CASE doc_id % 6 WHEN 0 THEN 'gmail' WHEN 1 THEN 'microsoft_teams' WHEN 2 THEN 'gmail' ELSE lower(source) END AS provider,
      count(*) AS n_records FROM documents GROUP BY 1""",
)
def provider_canonical(spark, folder):
    docs = spread(table(spark, folder, "documents"))
    provider = evidence.canonical_provider(F.expr(LABEL_SQL), F.col("source"))
    return docs.groupBy(provider.alias("provider")).agg(F.count(F.lit(1)).alias("n_records"))


def _hits_sql(column: str) -> str:
    parts, expr = [], column
    for name, regex, value in rules.SECRET_RULES:
        parts.append(f"len(regexp_extract_all({expr}, {quote(regex)})) AS {name}")
        expr = f"regexp_replace({expr}, {quote(regex)}, {quote(value.replace('$', chr(92)))}, 'g')"
    return ", ".join(parts)


_NAMES = [n for n, _, _ in rules.SECRET_RULES]


@query(
    "secret_redact_scan",
    f"""WITH {RECORDS_CTE}, b AS (SELECT source, text AS body FROM documents UNION ALL SELECT provider, excerpt FROM records),
    h AS (SELECT source, {_hits_sql('body')} FROM b)
    SELECT source, count(*) AS n_texts, CAST(sum(CASE WHEN {' + '.join(_NAMES)} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_with_secret,
      {', '.join(f'CAST(sum({n}) AS BIGINT) AS n_{n}' for n in _NAMES)} FROM h GROUP BY 1""",
)
def secret_redact_scan(spark, folder):
    docs = spread(table(spark, folder, "documents")).select("source", F.col("text").alias("body"))
    rec = records(spark, folder).select(F.col("provider").alias("source"), F.col("excerpt").alias("body"))
    return evidence.secret_counts(docs.unionByName(rec), "body", "source")


@query(
    "deep_redact",
    """SELECT event_id, concat('apiKey=[REDACTED];k=', json_extract_string(props, '$.k'), ';note=Bearer [REDACTED] for ', event_type,
      ';token_count=', user_id) AS fields,
      concat('{"k":', to_json(json_extract_string(props, '$.k')), ',"calls":[{"apiKey":"[REDACTED]","note":"Bearer [REDACTED] for ', event_type, '","labels":{"password":"[REDACTED]","kind":"', event_type, '"}},',
        '{"note":"', event_type, '","labels":{}}]}') AS nested FROM events""",
)
def deep_redact(spark, folder):
    events = table(spark, folder, "events")
    fields = F.create_map(
        F.lit("apiKey"), F.concat(F.lit("v"), "event_id"),
        F.lit("k"), F.get_json_object("props", "$.k"),
        F.lit("note"), F.concat(F.lit("Bearer abc"), "event_id", F.lit(" for "), "event_type"),
        F.lit("request_id"), F.col("event_id").cast("string"),
        F.lit("token_count"), F.col("user_id").cast("string"),
    )
    safe = F.map_entries(secrets.redact_map(fields, hidden=True))
    note = F.concat(F.lit("Bearer abc"), "event_id", F.lit(" for "), "event_type")
    labels = F.create_map(F.lit("password"), F.lit("x"), F.lit("request_id"), F.lit("y"), F.lit("kind"), F.col("event_type"))
    call = lambda key, text, marks: F.struct(
        key.cast("string").alias("apiKey"), F.col("event_id").cast("string").alias("request_id"), text.alias("note"), marks.alias("labels")
    )
    calls = F.array(call(F.col("user_id"), note, labels), call(F.lit(None), F.col("event_type"), F.map_filter(labels, lambda k, _: k.isNull())))
    made = events.select("event_id", F.get_json_object("props", "$.k").alias("k"), calls.alias("calls"), safe.alias("safe"))
    kinds = {f.name: f.dataType for f in made.schema.fields}
    walked = F.struct(*[secrets.redact_deep(F.col(n), kinds[n], n, hidden=True).alias(n) for n in ("k", "calls")])
    return made.select(
        "event_id", F.array_join(F.transform("safe", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"),
        F.to_json(walked).alias("nested"),
    )


@query(
    "injection_screen",
    f"""WITH {RECORDS_CTE}, b AS (SELECT role AS provider, text AS body FROM conversations UNION ALL SELECT provider, excerpt FROM records)
    SELECT provider, count(*) AS n_screened, CAST(sum(CASE WHEN regexp_matches(body, {quote(rules.INJECTION)}) THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged,
      CAST(sum(CASE WHEN regexp_matches(body, {quote(rules.INJECTION)}) THEN 0 ELSE length(body) END) AS BIGINT) AS kept_chars FROM b GROUP BY 1""",
)
def injection_screen(spark, folder):
    turns = table(spark, folder, "conversations").select(F.col("role").alias("provider"), F.col("text").alias("body"))
    rec = records(spark, folder).select("provider", F.col("excerpt").alias("body"))
    screened = turns.unionByName(rec).withColumn("flagged", secrets.injected(F.col("body")))
    return screened.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n_screened"),
        F.count_if("flagged").alias("n_flagged"),
        F.sum(F.when(F.col("flagged"), 0).otherwise(F.length("body"))).cast("bigint").alias("kept_chars"),
    )


def _is(column: str, regex: str) -> str:
    return f"regexp_matches({column}, {quote(regex)})"


@query(
    "hostile_question_filter",
    f"""WITH {QUESTIONS_CTE}, q AS (SELECT *, {_is('question', rules.CREDENTIAL_MENTION)} AS c, {_is('question', rules.DISCLOSURE_VERB)} AS d,
      {_is('question', rules.INSTRUCTION_OVERRIDE)} AS o FROM questions)
    SELECT question_id, CASE WHEN c AND d THEN {quote(rules.REASON_DISCLOSURE)} ELSE {quote(rules.REASON_OVERRIDE)} END AS reason
    FROM q WHERE (c AND d) OR (o AND (c OR d))""",
)
def hostile_question_filter(spark, folder):
    asked = questions(spark, folder).select("question_id", secrets.hostile_reason(F.col("question")).alias("reason"))
    return asked.where(F.col("reason").isNotNull())


KIND_SQL = """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'document' WHEN 1 THEN 'message' END AS kind,
  CASE page_id % 5 WHEN 0 THEN 'application/pdf' ELSE 'text/html' END AS mime,
  CASE page_id % 3 WHEN 0 THEN url ELSE concat('thread-', cast(page_id AS string)) END AS filename FROM {pages}"""


@query(
    "doc_kind_filter",
    f"""WITH p AS ({KIND_SQL.format(pages='pages')})
    SELECT page_id, coalesce(kind IN ('file', 'document', 'uploaded_document', 'pdf'), false) OR mime = 'application/pdf'
      OR regexp_matches(filename, {quote(rules.DOCUMENT_EXTENSION)}) AS is_document FROM p""",
)
def doc_kind_filter(spark, folder):
    pages = spark.sql(KIND_SQL, pages=table(spark, folder, "pages"))
    return pages.select(
        "page_id", evidence.document_like(F.col("kind"), F.col("mime"), F.col("filename")).alias("is_document")
    )


_NOISE = " + ".join(f"CAST({_is('body', p)} AS INT)" for p in rules.NOISE_PATTERNS)


@query(
    "noise_signal_filter",
    f"""WITH {RECORDS_CTE}, b AS (SELECT record_id, provider, concat(title, ' ', excerpt) AS body FROM records
      UNION ALL SELECT concat('doc-', doc_id), 'github', text FROM documents)
    SELECT provider, count(*) AS n_kept, CAST(sum(CASE WHEN {_NOISE} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_single_signal FROM b
    WHERE provider <> 'github' OR {_NOISE} < 2 GROUP BY 1""",
)
def noise_signal_filter(spark, folder):
    rec = records(spark, folder).select("record_id", "provider", F.concat_ws(" ", "title", "excerpt").alias("body"))
    docs = spread(table(spark, folder, "documents")).select(
        F.concat(F.lit("doc-"), "doc_id").alias("record_id"), F.lit("github").alias("provider"), F.col("text").alias("body")
    )
    kept = evidence.without_noise(rec.unionByName(docs), F.col("body"))
    return kept.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n_kept"),
        F.count_if(evidence.noise_hits(F.col("body")) == 1).alias("n_single_signal"),
    )


@query(
    "exact_id_filter",
    f"""WITH {RECORDS_CTE}, {QUESTIONS_CTE},
    q AS (SELECT question_id, workspace_id, regexp_extract_all(question, {quote(rules.RECORD_ID)}) AS ids FROM questions),
    p AS (SELECT DISTINCT workspace_id, record_id, seq, unnest(regexp_extract_all(concat(title, ' ', excerpt), {quote(rules.RECORD_ID)})) AS identifier FROM records)
    SELECT request_id, identifier, record_id, place FROM (
      SELECT question_id AS request_id, identifier, record_id, row_number() OVER (PARTITION BY question_id ORDER BY seq) AS place
      FROM q JOIN p ON p.workspace_id = q.workspace_id AND p.identifier = q.ids[1] WHERE len(ids) = 1) t WHERE place <= 6""",
)
def exact_id_filter(spark, folder):
    ids = text.record_ids(F.col("question"))
    requests = questions(spark, folder).where(F.size(ids) == 1).select(
        F.col("question_id").alias("request_id"), "workspace_id", F.upper(F.get(ids, F.lit(0))).alias("identifier")
    )
    rec = records(spark, folder).select(
        "workspace_id", "record_id", "seq", F.concat_ws(" ", "title", "excerpt").alias("body")
    )
    return evidence.exact_id_hits(rec, requests)


@query(
    "metadata_scope_filter",
    """WITH s AS (SELECT s_suppkey AS lineage, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey WHEN 2 THEN s_suppkey + 1 END AS caller FROM supplier)
    SELECT lineage AS connector_id, count(l_orderkey) AS n_rows FROM s
    LEFT JOIN lineitem ON l_suppkey = lineage AND l_suppkey = coalesce(caller, lineage) AND l_returnflag = 'N' GROUP BY 1""",
)
def metadata_scope_filter(spark, folder):
    scopes = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("connector_id"),
        F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey"))
        .when(F.col("s_suppkey") % 3 == 2, F.col("s_suppkey") + 1)
        .alias("caller"),
    )
    # Rows are counted per connector before the join, so a hot connector joins as one row.
    counts = (
        table(spark, folder, "lineitem")
        .where(F.col("l_returnflag") == "N")
        .groupBy(F.col("l_suppkey").alias("connector_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    agrees = evidence.merged_scope(F.col("connector_id"), F.col("caller")) == F.col("connector_id")
    return scopes.join(counts, "connector_id", "left").select(
        "connector_id", F.coalesce(F.when(agrees, F.col("n")), F.lit(0)).cast("bigint").alias("n_rows")
    )


@query(
    "public_projection",
    f"""WITH {RECORDS_CTE} SELECT concat('public-record-', left(sha256(concat('public-reference:', workspace_id, ':record:', record_id)), 32)) AS record_id,
      CAST(NULL AS VARCHAR) AS url, provider, {redact_sql('title')} AS title, {redact_sql('excerpt')} AS excerpt,
      {redact_sql('title')} AS inner_note, concat('public-chunk-', left(sha256(concat('public-reference:', workspace_id, ':chunk:', external_id)), 32)) AS inner_chunk,
      'chunkid,label,notes' AS inner_keys, {redact_sql('excerpt')} AS first_line FROM records""",
)
def public_projection(spark, folder):
    rec = records(spark, folder).select(
        "workspace_id", "record_id", "external_id", "url", "provider", "title", "excerpt",
        F.sha2("excerpt", 256).alias("content_hash"),
        F.struct(
            F.col("title").alias("note"), F.sha2("title", 256).alias("row_hash"),
            F.create_map(F.lit("chunkId"), F.col("external_id"), F.lit("payload_hash"), F.lit("x"), F.lit("label"), F.col("title"), F.lit("notes"), F.col("excerpt")).alias("labels"),
            F.array(F.struct(F.col("excerpt").alias("line"), F.col("url").alias("link_url"))).alias("lines"),
        ).alias("inner"),
    )
    shown = evidence.public_projection(rec, "workspace_id")
    keys = F.array_join(F.array_sort(F.map_keys("inner.labels")), ",")
    return shown.select(
        "record_id", "url", "provider", "title", "excerpt", F.col("inner.note").alias("inner_note"),
        F.col("inner.labels")["chunkId"].alias("inner_chunk"), F.lower(keys).alias("inner_keys"), F.col("inner.lines")[0]["line"].alias("first_line"),
    )


@query(
    "integrity_filter",
    """SELECT doc_id, sha256(text) AS stored_hash FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 0""",
)
def integrity_filter(spark, folder):
    docs = spread(table(spark, folder, "documents")).select(
        "doc_id", "text",
        F.when(F.col("doc_id") % 10 == 0, F.sha2(F.concat("text", F.lit("x")), 256))
        .otherwise(F.sha2("text", 256)).alias("stored_hash"),
        F.when(F.col("doc_id") % 7 == 0, "r1").otherwise("r2").alias("release"),
    )
    return evidence.intact(docs, "text", "stored_hash", "release", F.lit("r2")).select("doc_id", "stored_hash")


URL_SQL = """SELECT page_id, CASE page_id % 4
  WHEN 0 THEN url WHEN 1 THEN concat('https://api.example.com/a?token=t', cast(page_id AS string), '&q=1&Sig=2#frag')
  WHEN 2 THEN concat('https://bob:pw@example.com/', cast(page_id AS string)) ELSE concat('https://x.example.com/p?code=', cast(page_id AS string)) END AS link FROM {pages}"""


@query(
    "url_sanitise",
    f"""WITH p AS ({URL_SQL.format(pages='pages')}),
    c AS (SELECT *, regexp_replace(link, '#.*$', '') AS l FROM p),
    s AS (SELECT *, list_filter(string_split(CASE WHEN strpos(l, '?') > 0 THEN substr(l, strpos(l, '?') + 1) ELSE '' END, '&'),
        lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), {quote(rules.URL_SECRET_PARAM)})) AS ps FROM c)
    SELECT page_id, CASE WHEN starts_with(link, 'https://') AND NOT regexp_matches(link, '^https://[^/?#]*@')
      THEN concat(split_part(l, '?', 1), CASE WHEN len(ps) > 0 THEN '?' ELSE '' END, array_to_string(ps, '&')) END AS safe_url FROM s""",
)
def url_sanitise(spark, folder):
    links = spark.sql(URL_SQL, pages=table(spark, folder, "pages"))
    return links.select("page_id", evidence.safe_url(F.col("link")).alias("safe_url"))
