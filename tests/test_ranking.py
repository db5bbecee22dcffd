"""Published scores and ranking invariants."""

from pyspark.sql import functions as F

from attestry import rules
from attestry.operators import ranking

NAMES = [
    "business_impact", "urgency", "dependency_unlock", "customer_revenue", "incident_security", "commitment_strength",
    "authority_reliability", "evidence_freshness",
]
BASE = (18.0, 16.0, 14.0, 10.0, 0.0, 6.0, 5.0, 4.0)


def inputs(spark, rows):
    data = [(1, "p", i, status, *f, *pen) for i, (status, f, pen) in enumerate(rows)]
    return spark.createDataFrame(data, ["workspace_id", "provider", "task_id", "status", *NAMES, *rules.PENALTIES])


def scores(spark, rows):
    out = ranking.with_score(inputs(spark, rows)).orderBy("task_id").collect()
    return [(round(r.score, 2), r.band) for r in out]


def test_published_scores(spark):
    none = (0.0,) * 8
    heavy = (40.0, 30.0, 0.0, 12.0, 0.0, 12.0, 0.0, 0.0)
    slow = (BASE[0], 4.0, *BASE[2:])
    got = scores(spark, [("open", BASE, none), ("completed", BASE, none), ("cancelled", BASE, none), ("open", BASE, heavy), ("open", slow, none)])
    assert got[0] == (87.43, "critical")
    assert got[1][0] == got[2][0] == got[3][0] == 0
    assert round(got[0][0] - got[4][0], 2) == 16.67


def test_counterfactual_changes_one_field(spark):
    blocked = (0.0, 0.0, 8.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    out = {r.kind: r for r in ranking.counterfactual(inputs(spark, [("blocked", BASE, blocked)])).collect()}
    assert out["blocker_resolved"].delta == 8.0
    assert out["status"].score_after == 0
    assert out["deadline_urgency"].delta == round(2 / 18 * 25, 2)


def test_queue_does_not_depend_on_row_order(spark):
    rows = [("open", (float(i % 20), *BASE[1:]), (0.0,) * 8) for i in range(60)]
    df = inputs(spark, rows)
    a = [r.task_id for r in ranking.queue(df).orderBy("rank").collect()]
    b = [r.task_id for r in ranking.queue(df.orderBy(F.rand(3)).repartition(7)).orderBy("rank").collect()]
    assert a == b and len(a) == rules.QUEUE_SIZE


def test_follow_up_reads_the_best_ranked_passages(spark, monkeypatch):
    from attestry.plans import asking as plans

    read = []
    monkeypatch.setattr(plans.asking, "follow_up", lambda placed: read.append(placed) or placed)
    plans.follow_up_query(spark, "/root/testdata/sf0.001")
    got = {(r.question_id, r.place): r.passage for r in read[0].collect()}
    ranked = plans.asking.rank_evidence(plans.feature_pairs(spark, "/root/testdata/sf0.001"))
    assert got == {(r.question_id, r["rank"]): f"{r.title}. {r.excerpt}" for r in ranked.collect()}


def test_only_records_that_meet_a_question_are_read_for_features(spark, monkeypatch):
    import attestry.plans.asking as plans
    from attestry.plans.fixtures import records

    folder, read = "/root/testdata/sf0.001", []
    features = plans.asking.passage_features
    monkeypatch.setattr(plans.asking, "passage_features", lambda df, body: read.append(df.count()) or features(df, body))
    met = plans.feature_pairs(spark, folder).select("record_id").distinct().count()
    assert read == [met] and met < records(spark, folder).count()
