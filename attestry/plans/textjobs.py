"""Text extraction as corpus jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry import rules
from attestry.functions import text
from attestry.operators import textjobs
from attestry.plans.evidence import clean_sql
from attestry.plans.fixtures import QUESTIONS_CTE, RECORDS_CTE, questions, records
from attestry.plans.registry import query, quote, sql_list
from attestry.sources.tables import spread, table

def body():
    """Title and excerpt of a record as one text."""
    return F.concat_ws(". ", "title", "excerpt")


def corpus(spark, folder):
    """Documents and records as one table of texts."""
    docs = spread(table(spark, folder, "documents")).select(
        F.concat(F.lit("doc-"), "doc_id").alias("rid"), F.col("text").alias("body")
    )
    rec = records(spark, folder).select(F.col("record_id").alias("rid"), body().alias("body"))
    return docs.unionByName(rec)


CORPUS_CTE = f"""{RECORDS_CTE}, corpus AS (SELECT concat('doc-', doc_id) AS rid, text AS body FROM documents
  UNION ALL SELECT record_id, concat(title, '. ', excerpt) FROM records)"""


@query(
    "record_id_index",
    f"""WITH {CORPUS_CTE}, h AS (SELECT rid, unnest(regexp_extract_all(body, {quote(rules.RECORD_ID)})) AS identifier FROM corpus)
    SELECT identifier, rid, count(*) AS n_hits FROM h GROUP BY 1, 2""",
)
def record_id_index(spark, folder):
    return textjobs.identifier_postings(corpus(spark, folder), "rid", F.col("body"))


def stem_tokens_sql(column: str) -> str:
    return f"""list_transform(list_filter(string_split(trim(regexp_replace(lower({clean_sql(column)}), '[^a-z0-9-]+', ' ', 'g')), ' '),
      lambda w: length(w) > 2 AND w NOT IN ({sql_list(rules.ANSWER_STOP_WORDS)})), lambda w: regexp_replace(w, '(ing|ed|es|s)$', ''))"""


@query(
    "token_counts",
    f"""WITH t AS (SELECT unnest({stem_tokens_sql('text')}) AS token FROM documents)
    SELECT token, count(*) AS n FROM t GROUP BY 1""",
)
def token_counts(spark, folder):
    return textjobs.token_counts(spread(table(spark, folder, "documents")), F.col("text"))


def search_tokens_sql(column: str) -> str:
    return f"""list_filter(list_transform(regexp_split_to_array(lower({column}), '[^a-z0-9#-]+'), lambda w: regexp_replace(w, '^[#-]+|[#-]+$', '', 'g')),
      lambda w: length(w) > 1 AND w NOT IN ({sql_list(rules.SEARCH_STOP_WORDS)}))"""


@query(
    "doc_frequency",
    f"""WITH t AS (SELECT DISTINCT doc_id, unnest({search_tokens_sql('text')}) AS token FROM documents)
    SELECT token, count(*) AS df FROM t GROUP BY 1""",
)
def doc_frequency(spark, folder):
    return textjobs.document_frequency(spread(table(spark, folder, "documents")), F.col("text"))


SHEET_SQL = """SELECT record_id AS rid, concat('Overview of ', title, '. ## Notes for the reader
- ', excerpt, '
- second item about ', provider, ' with details
| id | provider | day |
| ', record_id, ' | ', provider, ' | ', cast(source_date AS string), ' |') AS body FROM {records}"""

_SENT = r"regexp_split_to_array(regexp_replace(b, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query(
    "sentence_units",
    f"""WITH {RECORDS_CTE}, raw AS (SELECT concat('doc-', doc_id) AS rid, text AS body FROM documents
      UNION ALL {SHEET_SQL.format(records='records')}),
    l AS (SELECT rid, regexp_split_to_array(body, '\\r?\\n') AS lines FROM raw),
    t AS (SELECT rid, lines, list_filter(lines, lambda x: regexp_matches(x, '^\\s*\\\\?\\|') OR len(regexp_extract_all(x, '\\|')) >= 3) AS tr FROM l),
    p AS (SELECT rid, CASE WHEN len(tr) >= 2 THEN list_transform(tr, lambda x: {clean_sql('x')}) ELSE [] END AS tr,
      array_to_string(CASE WHEN len(tr) >= 2 THEN list_filter(lines, lambda x: NOT (regexp_matches(x, '^\\s*\\\\?\\|') OR len(regexp_extract_all(x, '\\|')) >= 3)) ELSE lines END, chr(10)) AS prose FROM t),
    i AS (SELECT rid, tr, prose, list_filter(list_transform(string_split(regexp_replace(prose, '\\n([ \\t]*[-*][ \\t]+)', chr(1) || '\\1', 'g'), chr(1)),
        lambda x: {clean_sql("regexp_replace(x, '^[ \\t]*[-*][ \\t]+', '')")}), lambda x: x <> '') AS items,
      {clean_sql("regexp_replace(regexp_replace(prose, '\\s+(?:#{1,6}\\s+|-{3,}\\s*|={2,}\\s*)', '. ', 'g'), '\\s+[-*]\\s+([A-Z0-9])', '. \\1', 'g')")} AS whole FROM p),
    b AS (SELECT rid, list_concat(CASE WHEN len(items) > 1 THEN items ELSE [whole] END, tr) AS blocks FROM i),
    s AS (SELECT rid, flatten(list_transform(blocks, lambda b: list_transform({_SENT}, lambda x: {clean_sql('x')}))) AS us FROM b),
    e AS (SELECT rid, u, min(pos) AS pos FROM (SELECT rid, unnest(us) AS u, generate_subscripts(us, 1) AS pos FROM s) x GROUP BY 1, 2)
    SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY pos) - 1 AS ordinal, u AS unit FROM e WHERE length(u) BETWEEN 18 AND 420""",
)
def sentence_units(spark, folder):
    docs = spread(table(spark, folder, "documents")).select(
        F.concat(F.lit("doc-"), "doc_id").alias("rid"), F.col("text").alias("body")
    )
    sheets = spark.sql(SHEET_SQL, records=records(spark, folder))
    return textjobs.sentence_units(docs.unionByName(sheets), ["rid"], F.col("body"))


def pairs(spark, folder):
    """Questions with the records of their workspace that name the same identifier.

    Equal questions of one workspace are answered once; the join is on the identifier,
    never on the workspace alone.
    """
    asked = questions(spark, folder).groupBy("workspace_id", "question").agg(F.min("question_id").alias("question_id"))
    wanted = asked.select(
        "workspace_id", "question_id", "question",
        F.explode(F.array_distinct(text.record_ids(F.col("question")))).alias("identifier"),
    )
    rec = records(spark, folder)
    named = rec.select(
        "workspace_id", "record_id", "provider", "title", "excerpt", "seq", "source_date",
        F.explode(F.array_distinct(text.record_ids(body()))).alias("identifier"),
    )
    return wanted.join(named, ["workspace_id", "identifier"]).dropDuplicates(["question_id", "record_id"])


PAIRS_CTE = f"""{RECORDS_CTE}, {QUESTIONS_CTE},
asked AS (SELECT workspace_id, question, min(question_id) AS question_id FROM questions GROUP BY 1, 2),
wanted AS (SELECT DISTINCT workspace_id, question_id, question, unnest(regexp_extract_all(question, {quote(rules.RECORD_ID)})) AS identifier FROM asked),
named AS (SELECT DISTINCT workspace_id, record_id, provider, title, excerpt, seq, source_date,
  unnest(regexp_extract_all(concat(title, '. ', excerpt), {quote(rules.RECORD_ID)})) AS identifier FROM records),
pairs AS (SELECT DISTINCT w.workspace_id, question_id, question, record_id, provider, title, excerpt, seq, source_date
  FROM wanted w JOIN named n ON n.workspace_id = w.workspace_id AND n.identifier = w.identifier)"""


def _window_sql() -> str:
    """Windows of the pairs; excerpts are no longer than a window, so nothing is cut inside a sentence."""
    most = rules.CONTEXT_MAX
    tokens = f"list_filter({stem_tokens_sql('question')}, lambda w: length(w) >= 4 AND w NOT IN ({sql_list(rules.GENERIC_QUESTION_TOKENS)}))"
    named = f"list_transform(regexp_extract_all(question, {quote(rules.RECORD_ID)}), lambda i: lower(i))"
    full_stop = lambda name: f"concat({name}, CASE WHEN length({name}) < length(after) THEN '.' ELSE '' END)"
    return f"""WITH {PAIRS_CTE},
    anchored AS (SELECT question_id, record_id, excerpt, lower(excerpt) AS low, list_concat({named}, {tokens}) AS every FROM pairs),
    each AS (SELECT question_id, record_id, excerpt, low, unnest(every) AS anchor, generate_subscripts(every, 1) AS n FROM anchored),
    firsts AS (SELECT question_id, record_id, excerpt, low, anchor, min(n) AS n, instr(low, anchor) AS pos FROM each GROUP BY 1, 2, 3, 4, 5),
    seconds AS (SELECT *, instr(substr(low, pos + length(anchor)), anchor) AS step FROM firsts WHERE pos > 0),
    hits AS (SELECT question_id, record_id, excerpt, anchor, n, pos FROM seconds
      UNION ALL SELECT question_id, record_id, excerpt, anchor, n, pos + length(anchor) - 1 + step FROM seconds WHERE step > 0),
    parts AS (SELECT question_id, record_id, n, pos, substr(excerpt, pos, length(anchor)) AS hit,
      string_split(substr(excerpt, 1, pos - 1), '. ') AS b, substr(excerpt, pos + length(anchor)) AS after FROM hits),
    runs AS (SELECT *, b[-1] AS left1, array_to_string(b[-2:], '. ') AS left2, string_split(after, '. ')[1] AS r1, array_to_string(string_split(after, '. ')[1:2], '. ') AS r2 FROM parts),
    stops AS (SELECT *, {full_stop('r1')} AS right1, {full_stop('r2')} AS right2 FROM runs),
    lefts AS (SELECT *, CASE WHEN length(left2) + length(hit) + length(right1) <= {most} THEN left2 ELSE left1 END AS l FROM stops),
    whole AS (SELECT *, concat(l, hit, CASE WHEN length(l) + length(hit) + length(right2) <= {most} THEN right2 ELSE right1 END) AS w FROM lefts)
    SELECT question_id, record_id, row_number() OVER (PARTITION BY question_id, record_id ORDER BY n, pos) - 1 AS ordinal, {clean_sql('w')} AS window_text FROM whole"""


@query("focus_windows", _window_sql())
def focus_windows(spark, folder):
    rows = pairs(spark, folder).withColumn("body", F.col("excerpt"))
    return textjobs.focus_windows(rows, ["question_id", "record_id"])


_VALUE_SQL = " UNION ALL ".join(
    f"SELECT question_id, record_id, '{intent}' AS intent, unnest(regexp_extract_all(excerpt, {quote(p)})) AS value FROM pairs "
    f"WHERE regexp_matches(question, {quote(asks)})"
    for intent, asks, _, patterns in rules.VALUE_INTENTS
    for p in patterns
)


@query("value_pattern_hits", f"WITH {PAIRS_CTE} SELECT DISTINCT * FROM ({_VALUE_SQL}) v")
def value_pattern_hits(spark, folder):
    hit = F.explode(textjobs.value_hits(F.col("question"), F.col("excerpt"))).alias("h")
    return pairs(spark, folder).select("question_id", "record_id", hit).select(
        "question_id", "record_id", "h.intent", "h.value"
    )


_STRONG = " OR ".join(f"regexp_matches(s, {quote(p)})" for p in rules.STRONG_TASK_SIGNALS)
_SCORE = f"4 * len(regexp_extract_all(s, {quote(rules.TASK_ID)}))" + "".join(
    f" + CASE WHEN regexp_matches(s, {quote(p)}) THEN {w} ELSE 0 END" for w, p in rules.SPAN_SCORE
)
_SEGMENTS = (
    r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(body, '\r?\n+', chr(1), 'g'), "
    r"'([.!?])\s+', '\1' || chr(1), 'g'), '\s+([*-]\s+)', chr(1) || '\1', 'g'), chr(1)), "
    + f"lambda x: {clean_sql('x')}), lambda x: x <> '')"
)


SPANS_CTE = f"""b AS (SELECT record_id, concat(title, '. ', excerpt) AS body FROM records),
    seg AS (SELECT record_id, unnest(xs) AS s, generate_subscripts(xs, 1) AS nth, regexp_matches(xs[1], {quote(rules.TASK_ID)}) AS head_id
      FROM (SELECT record_id, {_SEGMENTS} AS xs FROM b) y),
    live AS (SELECT *, {_SCORE} AS pts FROM (SELECT *, head_id OR regexp_matches(s, {quote(rules.TASK_ID)}) AS ided FROM seg) z
      WHERE length(s) >= 12 AND ({_STRONG})
        AND (regexp_matches(s, {quote(rules.TASK_ID)}) OR regexp_matches(s, {quote(rules.TASK_ACTION)}) OR regexp_matches(s, {quote(rules.LIVE_TASK_STATE)})
          OR (regexp_matches(s, {quote(rules.TEMPORAL_ANCHOR)}) AND (regexp_matches(s, {quote(rules.ACTOR_COMMITMENTS[0])}) OR regexp_matches(s, {quote(rules.ACTOR_COMMITMENTS[1])}))))
        AND (ided OR NOT regexp_matches(s, {quote(rules.NEGATIVE_OBLIGATION)})) AND (ided OR NOT regexp_matches(s, {quote(rules.NON_TASK_CONTEXT)}))),
    spans AS (SELECT record_id, s AS span FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pts DESC, length(s), nth) AS n FROM live) w WHERE n = 1)"""


def record_spans(spark, folder):
    """Records that carry an actionable statement, with it."""
    keep = ["workspace_id", "seq", "provider", "external_id", "title", "excerpt", "source_date", "owner", "url"]
    return textjobs.task_spans(records(spark, folder), "record_id", keep, body())


_CORPUS_SPANS = SPANS_CTE.replace(
    "b AS (SELECT record_id, concat(title, '. ', excerpt) AS body FROM records)",
    "b AS (SELECT rid AS record_id, body FROM corpus)",
)


@query("task_span_extract", f"WITH {CORPUS_CTE}, {_CORPUS_SPANS} SELECT record_id AS rid, span FROM spans")
def task_span_extract(spark, folder):
    return textjobs.task_spans(corpus(spark, folder), "rid", [], F.col("body"))


@query(
    "date_mentions",
    f"""WITH {RECORDS_CTE}, b AS (SELECT record_id, lower(excerpt) AS x, source_date FROM records),
    m AS (SELECT record_id, unnest(regexp_extract_all(x, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS anchor FROM b
      UNION SELECT record_id, CAST(CAST(strptime(unnest(regexp_extract_all(x, '\\d{{1,2}} (?:{'|'.join(rules._MONTHS_LONG.split('|'))}) \\d{{4}}')), '%-d %B %Y') AS DATE) AS VARCHAR) FROM b
      UNION SELECT record_id, CAST(source_date + 1 AS VARCHAR) FROM b WHERE x LIKE '%tomorrow%')
    SELECT b.record_id, anchor, false AS unresolved FROM b LEFT JOIN m ON m.record_id = b.record_id""",
)
def date_mentions(spark, folder):
    return textjobs.date_mentions(records(spark, folder), ["record_id"], F.col("excerpt"), F.col("source_date"))


@query(
    "deadline_resolve",
    f"""WITH {RECORDS_CTE}, b AS (SELECT record_id, seq, excerpt, source_date,
        CASE seq % 6 WHEN 0 THEN CAST(source_date + 3 AS VARCHAR) WHEN 1 THEN 'soon' END AS due FROM records)
    SELECT record_id, CAST(coalesce(try_cast(due AS DATE), list_last(list_transform(regexp_extract_all(excerpt, '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{1,2}} [A-Z][a-z]+ \\d{{4}}'),
      lambda d: coalesce(try_cast(d AS DATE), CAST(try_strptime(d, '%-d %B %Y') AS DATE))))) AS VARCHAR) AS deadline FROM b""",
)
def deadline_resolve(spark, folder):
    due = F.when(F.col("seq") % 6 == 0, F.date_add("source_date", 3).cast("string")).when(F.col("seq") % 6 == 1, "soon")
    rec = records(spark, folder)
    return rec.select(
        "record_id", textjobs.deadline(due, F.col("excerpt"), F.col("source_date")).cast("string").alias("deadline")
    )


@query(
    "entity_phrases",
    f"""WITH h AS (SELECT source, unnest(regexp_extract_all(text, {quote(rules.RECORD_ID)})) AS raw, 20 AS w FROM documents
      UNION ALL SELECT source, raw, CASE WHEN regexp_matches(raw, '[a-z][A-Z]') THEN 9 WHEN contains(raw, ' ') THEN 6 ELSE 3 END
        FROM (SELECT source, unnest(regexp_extract_all(text, {quote(rules.CAPITALISED_PHRASE)})) AS raw FROM documents) x),
    p AS (SELECT source, regexp_replace(regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '^(The|A|An)\\s+', ''), '[.,:;!?]+$', '') AS phrase, w FROM h),
    s AS (SELECT source, phrase, CAST(sum(w) AS BIGINT) AS weight FROM p WHERE length(phrase) BETWEEN 4 AND 64
      AND lower(phrase) NOT IN ({sql_list(rules.PHRASE_STOP_WORDS)}) GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, length(phrase) DESC, phrase) AS place FROM s) r WHERE place <= 6""",
)
def entity_phrases(spark, folder):
    docs = spread(table(spark, folder, "documents"))
    return textjobs.entity_phrases(docs, "source", F.col("text"))


PROVIDERS = ["slack", "gmail", "linear", "github", "google_calendar"]
_ALIAS_WORDS = {"slack": "slack", "gmail": "gmail|email", "linear": "linear", "github": "github|git hub",
                "google_calendar": "google calendar|gcal"}


@query(
    "provider_mentions",
    f"WITH {QUESTIONS_CTE} "
    + " UNION ALL ".join(
        f"SELECT question_id, '{p}' AS provider FROM questions WHERE regexp_matches(lower(question), '(^|[^a-z0-9])({w})([^a-z0-9]|$)')"
        for p, w in _ALIAS_WORDS.items()
    ),
)
def provider_mentions(spark, folder):
    named = textjobs.providers_named(F.col("question"), PROVIDERS)
    return questions(spark, folder).select("question_id", F.explode(named).alias("provider"))


def _clamp_sql(x: str) -> str:
    p = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    cut = f"left({p}, 121)"
    blank = f"(length({cut}) - strpos(reverse({cut}), ' '))"
    return (
        f"CASE WHEN length({p}) <= 120 THEN {p} ELSE concat(trim(left({cut}, CASE WHEN strpos(reverse({cut}), ' ') > 0 AND {blank} >= 78 "
        f"THEN {blank} ELSE 120 END)), '…') END"
    )


@query(
    "title_repair",
    f"""WITH {RECORDS_CTE}, b AS (SELECT concat(conv_id, '-', turn) AS rid, CASE turn % 3 WHEN 0 THEN 'Message' WHEN 1 THEN left(text, 30) ELSE concat(role, '.pdf') END AS title, text AS span FROM conversations
      UNION ALL SELECT record_id, title, excerpt FROM records),
    n AS (SELECT rid, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t, trim(regexp_replace(span, '\\s+', ' ', 'g')) AS s FROM b)
    SELECT rid, CASE WHEN length(t) >= 8 AND NOT regexp_matches(t, {quote(rules.GENERIC_TITLE)}) AND NOT regexp_matches(t, {quote(rules.DOCUMENT_EXTENSION)})
      THEN CASE WHEN length(s) > length(t) AND starts_with(lower(s), lower(t)) AND NOT regexp_matches(t, '[.!?…]$') THEN {_clamp_sql('s')} ELSE {_clamp_sql('t')} END
      ELSE coalesce(nullif({_clamp_sql('s')}, ''), t) END AS title FROM n""",
)
def title_repair(spark, folder):
    title = F.when(F.col("turn") % 3 == 0, "Message").when(F.col("turn") % 3 == 1, F.left("text", F.lit(30)))
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("rid"),
        title.otherwise(F.concat("role", F.lit(".pdf"))).alias("title"), F.col("text").alias("span"),
    )
    rec = records(spark, folder).select(F.col("record_id").alias("rid"), "title", F.col("excerpt").alias("span"))
    both = turns.unionByName(rec)
    return both.select("rid", textjobs.repaired_title(F.col("title"), F.col("span")).alias("title"))
