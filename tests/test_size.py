"""What the work of large inputs hangs on: no pairs shuffled, no rule run over texts that cannot match, no step taken twice."""

from datetime import date

from pyspark.sql import functions as F

from attestry import rules
from attestry.functions import secrets
from attestry.operators import asking, cluster, evaluate, evidence, graph, textjobs


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_ranking_shuffles_no_postings_or_pairs(spark):
    queries = spark.createDataFrame([(1, "red fox", 0.3, ["b"], None), (2, "zz", 0.0, [], None)], "query_id long, body string, bias double, named array<string>, identifier string")
    documents = spark.createDataFrame(
        [(1, "a", "Red fox, red hen", date(2024, 1, 1)), (2, "b", "-a- #nothing#", date(2024, 1, 2)), (3, "a", None, None)],
        "doc_id long, provider string, body string, day date",
    )
    found = asking.tfidf_topk(queries, documents, 2)
    assert "hashpartitioning(doc_id" not in _plan(found) and "hashpartitioning(query_id, doc_id" not in _plan(found)
    assert [(r.query_id, r.doc_id, r["rank"]) for r in found.orderBy("query_id", "rank").collect()] == [(1, 1, 1), (1, 2, 2)]


def test_rules_skip_texts_without_their_words(spark):
    texts = ["a-" * 20000, "API_KEY = 'x1'", "my bearer abc", "see https://u:p@h/x", "no Secret here", None, "ATTIO_abcdefghijklmnop"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(secrets.redact(F.col("t"))).collect()] == [
        texts[0], "API_KEY = '[REDACTED]'", "my bearer [REDACTED]", "see https://u:[REDACTED]@h/x", texts[4], None, "[REDACTED]"
    ]


def test_counting_skips_texts_without_secret_words(spark):
    df = spark.createDataFrame([("a", "b-" * 20000), ("a", "token: x1, password=y"), ("b", None)], "g string, t string")
    rows = {r.g: r for r in evidence.secret_counts(df, "t", "g").collect()}
    assert (rows["a"].n_texts, rows["a"].n_with_secret, rows["a"].n_credential, rows["a"].n_bearer) == (2, 1, 2, 0)
    assert (rows["b"].n_texts, rows["b"].n_with_secret, rows["b"].n_credential) == (1, 0, None)


def test_ids_of_one_row_make_no_links(spark, monkeypatch):
    seen = []
    real = cluster.connected
    monkeypatch.setattr(cluster, "connected", lambda e: seen.append(e.count()) or real(e))
    rows = spark.createDataFrame([("a", ["1", "2", "x"]), ("b", ["3", "x"]), ("c", ["4", "5", "6"]), ("d", ["6x", "7"]), ("e", ["4", "9"])], "k string, ids array<string>")
    out = {r.k: r.component for r in cluster.identifier_components(rows, "k", "ids").collect()}
    assert out == {"a": "1", "b": "1", "c": "4", "d": "6x", "e": "4"} and seen == [1]


def test_units_cut_a_text_once(spark):
    body = "Intro line of some words. Second  sentence\there it is.\n- first item of the list is long\n- second item of the list too"
    df = textjobs.sentence_units(spark.createDataFrame([(1, body)], "k int, body string"), ["k"], F.col("body"))
    assert [r.unit for r in df.orderBy("ordinal").collect()] == [
        "Intro line of some words.", "Second sentence here it is.", "first item of the list is long", "second item of the list too"
    ]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("(?=[ \\t]*[-*][ \\t]+)") == 1


def test_every_strong_signal_holds_a_strong_word(spark):
    said = [
        "We will ship it", "the team 'll do", "Dana Fox needs to go", "it was promised", "still open", "an escalation", "deadline was Friday",
        "postponed to 2026-01-02", "are being reviewed", "is in progress", "please merge", "action:fix", "could you please update", "AB-1 isdue", "renewal due",
        "reported outage", "unsubscribe now", "remains blocked", "OVERDUE",
    ]
    signal = textjobs._any(F.col("t"), rules.STRONG_TASK_SIGNALS)
    rows = spark.createDataFrame([(t,) for t in said], "t string").select(signal.alias("s"), F.col("t").rlike(rules.STRONG_TASK_WORDS).alias("w")).collect()
    assert all(r.w for r in rows) and sum(r.s for r in rows) >= 15


def test_spans_cut_a_text_once(spark):
    df = spark.createDataFrame([("a", "Engineering will ship ENG-1 today. Nothing else is said.")], "k string, body string")
    spans = textjobs.task_spans(df, "k", [], F.col("body"))
    assert spans.collect()[0].span == "Engineering will ship ENG-1 today."
    assert spans._jdf.queryExecution().optimizedPlan().toString().count("(?=[*-]\\s+)") == 1


def test_proof_graph_shuffles_keys_not_ids(spark):
    rows = lambda data, names: spark.createDataFrame(data, f"question_id long, seq int, {names}")
    providers = rows([(1, 1, "a", "received"), (1, 2, "b", "not-required")], "provider string, status string")
    evidence = rows([(1, 2, 5, "late", "a"), (1, 1, 5, "early", "a"), (1, 3, 6, "six", "b")], "evidence_id long, title string, provider string")
    links = rows([(1, 1, "c1", "claim", 5), (1, 2, "c1", "other", 5), (1, 3, "c2", "none", 9)], "key string, label string, evidence_id long")
    nodes, edges = graph.proof_graph(providers, evidence, links, links.limit(0), links.limit(0))
    assert {(r.id, r.label) for r in nodes.collect()} == {("provider:a", "a"), ("evidence:5", "early"), ("evidence:6", "six"), ("claim:c1", "claim"), ("claim:c2", "none")}
    assert sorted(r.id for r in edges.collect()) == ["returned:a:5", "supports:5:claim:c1"]
    assert "hashpartitioning(graph" not in _plan(edges) + _plan(nodes)


def test_grading_reads_a_citation_once(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(value):
        reads.add(1)
        return value

    fact = lambda phrase: ("f", [phrase], [])
    cases = spark.createDataFrame(
        [(k, "Atlas launch: 42.", [fact("42"), fact("Atlas launch")], ["slack"], ["slack"], False) for k in (1, 2)],
        "case_id int, answer string, facts array<struct<fact_id:string,any_of:array<string>,all_of:array<array<string>>>>, "
        "required_providers array<string>, provider_coverage array<string>, needs_contradiction boolean",
    )
    claims = spark.createDataFrame(
        [(k, 1, "It took 42 hours", ["a"], ["Slack"]) for k in (1, 2)],
        "case_id int, claim_no int, claim string, citation_ids array<string>, providers array<string>",
    )
    # Whether the bare number is about the launch is told by the title of the citation alone.
    citations = spark.createDataFrame(
        [(1, "a", "slack", "Atlas launch", "It took 42 hours. Fine."), (2, "a", "slack", "Other", "It took 42 hours. Fine.")],
        "case_id int, citation_id string, provider string, title string, excerpt string",
    ).withColumn("excerpt", read("excerpt"))
    contradictions = spark.createDataFrame([(1, 1, "slack says 42", ["a"])], "case_id int, conflict_no int, summary string, evidence_ids array<string>")
    got = evaluate.grade(cases, claims, citations, contradictions).collect()
    assert {r.case_id: (r.citation_pass, r.relevance_pass, r.provider_pass, r["pass"]) for r in got} == {1: (True,) * 4, 2: (True, False, False, False)}
    assert reads.value == 2
