"""Text rules on literal rows."""

import datetime

from pyspark.sql import functions as F

from attestry import rules
from attestry.functions import dates, secrets, text
from attestry.operators import textjobs


def one(spark, value, make):
    return spark.createDataFrame([(value,)], ["t"]).select(make(F.col("t")).alias("x")).collect()[0].x


def test_negated_signal(spark):
    check = lambda v: one(spark, v, lambda c: text.signal(c, rules.SIGNALS["customer"]))
    assert not check("Low priority. No customer impact.")
    assert check("No customer impact yet. The enterprise renewal is due.")
    assert check("customer first")


def test_ascii_boundary(spark):
    assert one(spark, "éAB-12 xAB-13 AB-14", lambda c: text.task_ids(c)) == ["AB-12", "AB-14"]


def test_redaction(spark):
    raw = 'Bearer abc.def and api_key = "k123" at https://bob:pw@x.io access_token_count=3 ghp_' + "a" * 24
    out = one(spark, raw, secrets.redact)
    assert "abc.def" not in out and "k123" not in out and "pw@" not in out and "ghp_a" not in out
    assert "access_token_count=3" in out


def spans(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), ["k", "t"])
    return {r.k: r.span for r in textjobs.task_spans(df, "k", [], F.col("t")).collect()}


def test_task_spans(spark):
    got = spans(
        spark,
        "Hello there. We will ship ENG-456 before 2026-08-14. Thanks.",
        "Nothing to do here at all.",
        "Employees must not share the report with anyone.",
        "Homework. Please submit the review for question 4.",
    )
    assert got == {0: "We will ship ENG-456 before 2026-08-14."}


def test_last_deadline_wins(spark):
    base = F.lit(datetime.date(2026, 8, 1))
    body = "The deadline moved from 7 August to 14 August 2026."
    got = one(spark, body, lambda c: textjobs.deadline(F.lit(None).cast("string"), c, base))
    assert got == datetime.date(2026, 8, 14)


def test_anchors(spark):
    base = F.lit(datetime.date(2026, 8, 5))  # a Wednesday
    got = one(spark, "Due friday, or 3 Sept, or tomorrow; not next monday", lambda c: dates.anchors(c, base))
    assert got == ["2026-08-06", "2026-08-07", "2026-09-03"]


def test_windows_snap_to_sentences(spark):
    body = "First part is here. The billing desk answers. Last part ends."
    df = spark.createDataFrame([(body, ["billing"])], ["body", "anchors"])
    assert df.select(textjobs.windows(F.col("body"), F.col("anchors"), 60).alias("w")).collect()[0].w == ["First part is here. The billing desk answers."]
    long = spark.createDataFrame([("word " * 100 + "mark " + "word " * 99, ["mark"])], ["body", "anchors"])
    cut = long.select(textjobs.windows(F.col("body"), F.col("anchors")).alias("w")).collect()[0].w[0]
    assert len(cut) <= 420 and " mark " in cut


def test_projection_and_redaction_reach_nested_values(spark):
    from pyspark.sql import functions as F

    from attestry.functions import secrets
    from attestry.operators import evidence

    df = spark.sql(
        """SELECT 'w' AS workspace, array('Bearer abcdefghijklmnop1234', NULL) AS notes, map('apiKey', 'v1', 'rowHash', 'h', 'pageUrl', 'u', 'chunkId', 'c') AS extra,
        named_struct('apiKey', 'v2', 'inner', array(named_struct('content_hash', 'h', 'sourceIds', array('a', NULL), 'link_url', 'u', 'n', 1))) AS nested, CAST(NULL AS STRUCT<a: STRING>) AS none"""
    )
    shown = evidence.public_projection(df, "workspace").collect()[0].asDict(recursive=True)
    assert "[REDACTED]" in shown["notes"][0] and shown["notes"][1] is None and shown["none"] is None
    assert "rowHash" not in shown["extra"] and shown["extra"]["pageUrl"] is None and shown["extra"]["chunkId"].startswith("public-chunk-")
    inner = shown["nested"]["inner"][0]
    assert set(inner) == {"sourceIds", "link_url", "n"} and inner["link_url"] is None
    assert len(inner["sourceIds"]) == 1 and inner["sourceIds"][0].startswith("public-source-")
    cols = [secrets.redact_deep(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields]
    deep = df.select(*cols).collect()[0].asDict(recursive=True)
    assert deep["extra"]["apiKey"] == "[REDACTED]" and deep["nested"]["apiKey"] == "[REDACTED]" and "[REDACTED]" in deep["notes"][0]


def test_windows_snap_to_sentences_and_cut_long_ones_at_words(spark):
    rows = [
        ("Alpha one. Beta two. Gamma hit three. Delta four. Omega five.", ["hit"], 420),
        ("Alpha one. Beta two. Gamma hit three. Delta four. Omega five.", ["hit"], 30),
        ("a hit and a HIT and a hit", ["hit", "none"], 420),
        ("word " * 40 + "needle" + " more" * 40, ["needle"], 40),
        ("", ["hit"], 420),
        ("text", [], 420),
    ]
    got = []
    for body, anchors, limit in rows:
        df = spark.createDataFrame([(body, anchors)], "body string, anchors array<string>")
        got.append(df.select(textjobs.windows(F.col("body"), F.col("anchors"), limit).alias("w")).collect()[0].w)
    assert got == [
        ["Beta two. Gamma hit three. Delta four."],
        ["Beta two. Gamma hit three."],
        ["a hit and a HIT and a hit"] * 2,
        ["word word word needle more more"],
        [],
        [],
    ]
