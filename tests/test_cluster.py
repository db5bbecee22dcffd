"""Components against brute force, and refusals on ambiguity."""

import datetime
import random

from pyspark.sql import functions as F

from attestry.functions import dates
from attestry.operators import cluster

DAY = datetime.date(2026, 8, 1)


def brute(rows):
    parent = {k: k for k, _ in rows}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if set(x) & set(y):
                parent[find(b)] = find(a)
    groups = {}
    for k, _ in rows:
        groups.setdefault(find(k), set()).add(k)
    return {frozenset(g) for g in groups.values()}


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"r{i}", sorted({f"A-{rng.randrange(60)}" for _ in range(rng.randrange(1, 3))})) for i in range(70)]
    rows += [(f"chain{i}", [f"C-{i}", f"C-{i + 1}"]) for i in range(30)]
    rows += [(f"hot{i}", ["HOT-1"]) for i in range(200)]
    out = cluster.identifier_components(spark.createDataFrame(rows, ["k", "ids"]), "k", "ids").collect()
    groups = {}
    for r in out:
        groups.setdefault(r.component, set()).add(r.k)
    assert {frozenset(g) for g in groups.values()} == brute(rows)


def clusters(spark, rows):
    data = [(1, f"r{i}", p, t, s, d) for i, (p, t, s, d) in enumerate(rows)]
    df = spark.createDataFrame(data, "workspace_id int, record_id string, provider string, title string, span string, source_date date")
    out = cluster.cluster_tasks(df.repartition(3)).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.cluster, set()).add(r.record_id)
    return {frozenset(g) for g in groups.values()}


def test_ambiguous_record_stays_alone(spark):
    got = clusters(spark, [
        ("slack", "ENG-1 launch", "We will deploy AtlasLaunch to the fleet.", DAY),
        ("linear", "ENG-2 launch", "We will deploy AtlasLaunch to the shop.", DAY),
        ("gmail", "Note", "Support will watch AtlasLaunch closely.", DAY),
    ])
    assert got == {frozenset({"r0"}), frozenset({"r1"}), frozenset({"r2"})}


def test_unique_entity_attaches_and_years_separate(spark):
    promise = "Support will send the quarterly audit report to Northwind by 7 August {}."
    got = clusters(spark, [
        ("slack", "ENG-1 launch", "We will deploy AtlasLaunch to the fleet.", DAY),
        ("gmail", "Note", "Support will watch AtlasLaunch closely.", DAY),
        ("slack", "Audit", promise.format(2026), DAY),
        ("gmail", "Audit", promise.format(2026), DAY),
        ("linear", "Other", promise.format(2027).replace("Northwind", "Contoso"), DAY),
    ])
    assert got == {frozenset({"r0", "r1"}), frozenset({"r2", "r3"}), frozenset({"r4"})}


def test_first_copy_wins_whatever_the_order(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], ["seq", "k"]).orderBy(F.rand(1)).repartition(5)
    kept = {r.seq for r in cluster.first_wins(df, ["k"], "seq").collect()}
    assert kept == {0, 1, 2}


ANCHORS = [[], ["2026-08-01"], ["*-08-01"], ["2025-08-01"], ["2026-08-02"], ["*-08-02", "2026-08-01"], ["2025-08-01", "2026-08-02"]]


def test_meeting_codes_equal_the_date_rule(spark):
    sides = spark.createDataFrame([(i, a) for i, a in enumerate(ANCHORS)], "i int, anchors array<string>")
    left = sides.select("i", F.col("anchors").alias("x"), dates.meeting_codes(F.col("anchors"), True).alias("seeks"))
    right = sides.select(F.col("i").alias("j"), F.col("anchors").alias("y"), dates.meeting_codes(F.col("anchors"), False).alias("offers"))
    rule = (F.size("x") == 0) | (F.size("y") == 0) | dates.compatible(F.col("x"), F.col("y"))
    got = left.crossJoin(right).select("i", "j", (F.size(F.array_intersect("seeks", "offers")) > 0).alias("met"), rule.alias("rule"))
    rows = got.collect()
    assert len(rows) == len(ANCHORS) ** 2 and all(r.met == r.rule for r in rows)


def wording_table(spark, rows):
    data = [(1 + i % 2, f"r{i:04}", p, t, s, DAY) for i, (p, t, s) in enumerate(rows)]
    return spark.createDataFrame(data, "workspace_id int, record_id string, provider string, title string, span string, source_date date")


def test_wording_links_equal_all_pairs(spark):
    rng = random.Random(3)
    bodies = [
        "should send the quarterly audit report for every regional warehouse",
        "should send the quarterly audit report for every regional warehouse lately",
        "should check room 2024 and 2025 before the quarterly audit report arrives",
        "will review contract renewal terms covering storage transport packing labels",
    ]
    wide = " ".join(f"Alpha{c}orge{c}" for c in "BCDEFGHI")
    rows = []
    for _ in range(420):
        actor = rng.choice(["", "Priya Raman ", "Engineering ", "Support ", "priya raman "])
        product = rng.choice(["", " AtlasLaunch", " atlaslaunch", " AtlasLaunch BlueHarbor", f" {wide}", f" {wide.lower()}"])
        when = rng.choice(["", " by 2026-08-03", " by 3 August 2026", " by August 3", " by 2025-08-03", " tomorrow", " next sprint"])
        title = rng.choice(["Note", "note", "Quarterly Harvest"])
        rows.append((rng.choice(["slack", "gmail", "linear"]), title, f"{actor}{rng.choice(bodies)}{product}{when}."))
    rows += [("slack", None, None), ("gmail", "Note", "")]
    df = wording_table(spark, rows)
    feats = cluster.wording_features(df).select("workspace_id", "record_id", F.struct("provider", *cluster.FEATURE_COLUMNS).alias("s"))
    left = feats.select("workspace_id", F.col("record_id").alias("x"), F.col("s").alias("l"))
    right = feats.select(F.col("workspace_id").alias("w"), F.col("record_id").alias("y"), F.col("s").alias("r"))
    pairs = left.join(right, (F.col("workspace_id") == F.col("w")) & (F.col("x") != F.col("y"))).where(
        (F.col("l.provider") != F.col("r.provider")) & cluster.same_wording("l", "r")
    )
    want = {r.x: (r.n, r.y) for r in pairs.groupBy("x").agg(F.count("y").alias("n"), F.min("y").alias("y")).collect()}
    got = {r.record_id: (r.n_links, r.first_match) for r in cluster.wording_links(df, "record_id").collect()}
    assert len(want) > 60 and len(got) == len(rows)
    assert {k: v for k, v in got.items() if v[0]} == want


def test_template_meets_only_where_it_may_match(spark):
    """One template with its own day in every record: candidates grow with the records, not their square."""
    counts = []
    for n in (100, 200):
        rows = [
            (p, "Note", f"Support should send the quarterly audit report for every warehouse by {y}-{1 + i % 12:02}-{1 + i // 12:02}.")
            for i in range(n // 2) for p, y in (("slack", 2026), ("slack", 2027), ("gmail", 2026), ("gmail", 2028))
        ]
        df = wording_table(spark, rows).withColumn("workspace_id", F.lit(1))
        counts.append(cluster.wording_candidates(cluster.signatures(df, "record_id", [])).count())
    assert counts == [50, 100]


def test_pairs_without_an_open_side_are_left_out(spark):
    said = "Support should send the quarterly audit report for every warehouse."
    rows = [(p, "Note", said) for p in ("slack", "gmail", "linear")]
    df = wording_table(spark, rows).withColumns({"workspace_id": F.lit(1), "home": F.when(F.col("provider") == "slack", "").otherwise("x")})
    sigs = cluster.signatures(df, "record_id", ["home"]).withColumn("is_open", F.col("home") == "")
    got = {(r.rep, r.rep2) for r in cluster.wording_pairs(sigs, "is_open").collect()}
    assert got == {("r0000", "r0001"), ("r0000", "r0002")}


def test_wording_features_are_taken_once(spark, monkeypatch):
    calls = []
    features = cluster.wording_features
    monkeypatch.setattr(cluster, "wording_features", lambda df: calls.append(1) or features(df))
    span = "Please review the contract for the northern harbour office."
    rows = [(1, f"r{i}", p, "Note", span, DAY) for i, p in enumerate(["slack", "gmail", "slack"])]
    df = spark.createDataFrame(rows, "workspace_id int, record_id string, provider string, title string, span string, source_date date")
    got = {r.record_id: r.n_links for r in cluster.wording_links(df, "record_id").collect()}
    assert got == {"r0": 1, "r1": 2, "r2": 1} and calls == [1]
