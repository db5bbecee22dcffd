"""Attachment reads its texts once."""

from attestry.operators import cluster
from attestry.plans import clusters as plans


def test_dates_of_a_record_are_read_once(spark, monkeypatch):
    calls = []
    anchors = cluster.dates.anchors
    monkeypatch.setattr(cluster.dates, "anchors", lambda *a: calls.append(1) or anchors(*a))
    rows = [
        (1, "r0", "slack", "ENG-1 launch", "We will deploy AtlasLaunch to the fleet."), (1, "r1", "gmail", "Note", "Support will watch AtlasLaunch closely."),
        (1, "r2", "gmail", "Note", "Support will watch OtherLaunch closely."),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], "workspace_id int, record_id string, provider string, title string, span string, source_date date")
    got = {r.record_id: r.cluster for r in cluster.cluster_tasks(df).collect()}
    assert got == {"r0": "1/ENG-1", "r1": "1/ENG-1", "r2": "1/r2"} and calls == [1]


def test_spans_are_taken_before_components(spark, monkeypatch):
    seen = []
    parts = cluster.identifier_components
    monkeypatch.setattr(cluster, "identifier_components", lambda df, *a: seen.append(df) or parts(df, *a))
    plans._known(spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "regexp" not in plan
