"""Streams fed with the batch rows end where the batch folds end."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import events
from attestry.plans import eventlog
from attestry.streaming import folds

FOLDER = "/root/testdata/sf0.001"
START = datetime.datetime(2026, 8, 1)


@pytest.fixture(autouse=True, scope="module")
def rocksdb(spark):
    folds.keep_state_in_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def stream_of(spark, df, path, parts=2):
    df.repartitionByRange(parts, "event_id").write.parquet(str(path))
    for i, file in enumerate(sorted(path.glob("part-*"))):  # the source reads by time of change; parts are written at once
        os.utime(file, (file.stat().st_mtime + i, file.stat().st_mtime + i))
    schema = spark.read.parquet(str(path)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def in_order(spark, batches, schema, path):
    """One file and one micro-batch for each list of rows, in the given order (of writing)."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(query):
    query.processAllAvailable()
    query.stop()


def test_connector_states(spark, tmp_path):
    rows = eventlog.verification_log(spark, FOLDER)
    stream = stream_of(spark, rows, tmp_path / "in")
    run(events.connector_states(stream).writeStream.outputMode("complete").format("memory").queryName("states").start())
    expected = events.connector_states(rows).collect()
    assert {tuple(r) for r in spark.table("states").collect()} == {tuple(r) for r in expected}


def test_workflow_steps(spark, tmp_path):
    rows = eventlog.log(spark, FOLDER).select(
        F.col("user_id").alias("run_id"), "event_id", "at", F.col("event_type").alias("stage"),
        F.when(F.col("k") % 4 != 0, F.col("k")).alias("receipt"), (F.col("event_type") == "purchase").alias("is_call"),
    )
    stream = stream_of(spark, rows, tmp_path / "in", parts=1)
    run(folds.workflow_steps(stream).writeStream.outputMode("append").format("memory").queryName("steps").start())
    columns = ["run_id", "event_id", "stage", "sequence", "receipts", "calls"]
    expected = events.workflow_fold(rows, 3600 * 1000000).select(*columns).collect()
    assert {tuple(r) for r in spark.table("steps").select(*columns).collect()} == {tuple(r) for r in expected}


def test_claims_are_kept_for_good(spark, tmp_path):
    rows = eventlog.log(spark, FOLDER).select("event_id", "user_id", "k")
    stream = stream_of(spark, rows, tmp_path / "in")
    keys = str(tmp_path / "keys")
    run(stream.writeStream.foreachBatch(folds.claim_batches(keys, ["user_id", "k"])).option("checkpointLocation", str(tmp_path / "c")).start())
    kept = spark.read.parquet(keys)
    assert kept.count() == rows.select("user_id", "k").distinct().count()
    first = {r.event_id for r in events.claim_once(rows, ["user_id", "k"], "event_id").where("accepted").collect()}
    assert {r.event_id for r in kept.collect()} == first


def test_trailing_count_matches_a_plain_window(spark):
    rows = spark.createDataFrame([(i, 1, "a", (i * 7919) % 1000) for i in range(300)], ["event_id", "w", "c", "second"])
    got = {r.second: r.n for r in events.trailing_counts(rows, ["w", "c"], "second", 90, "n").collect()}
    seconds = [(i * 7919) % 1000 for i in range(300)]
    assert got == {s: sum(s - 90 <= x <= s for x in seconds) for s in seconds}


STEPS = "run_id bigint, event_id bigint, at bigint, stage string, receipt bigint, is_call boolean, ts timestamp"


def step(run, event, second, receipt, call=False):
    ts = START + datetime.timedelta(seconds=second)
    return (run, event, int(ts.replace(tzinfo=datetime.timezone.utc).timestamp()) * 1000000, "retrieving", receipt, call, ts)


def test_runs_go_on_over_batches_and_are_forgotten_when_idle(spark, tmp_path):
    batches = [
        [step(1, 1, 0, 7), step(1, 2, 5, None, True), step(1, 3, 9, 7)],
        [step(1, 4, 12, 8), step(1, 5, 11, 7, True), step(2, 6, 12, 7)],
        [step(3, 7, 500, None)],  # moves the watermark past run 1 and 2
        [step(3, 8, 600, None)],
        [step(1, 9, 610, 7), step(3, 10, 610, 7)],
    ]
    stream = in_order(spark, batches, STEPS, tmp_path / "in").withWatermark("ts", "10 seconds")
    sink = folds.workflow_steps(stream, idle_seconds=120).writeStream.outputMode("append").format("memory").queryName("idle")
    run(sink.option("checkpointLocation", str(tmp_path / "c")).start())
    got = {r.event_id: (r.run_id, r.sequence, r.receipts, r.calls) for r in spark.table("idle").collect()}
    assert got == {
        1: (1, 1, 1, 0), 2: (1, 2, 1, 1), 3: (1, 3, 1, 1), 5: (1, 4, 1, 2), 4: (1, 5, 2, 2), 6: (2, 1, 1, 0),
        7: (3, 1, 0, 0), 8: (3, 2, 0, 0), 9: (1, 1, 1, 0), 10: (3, 3, 1, 0),
    }


REQUESTS = "client string, event_id bigint, ts timestamp"


def trailing(spark, tmp_path, batches, name):
    rows = [[(c, i, START + datetime.timedelta(seconds=s)) for c, i, s in batch] for batch in batches]
    stream = in_order(spark, rows, REQUESTS, tmp_path / "in")
    out = folds.trailing_counts(stream, ["client"], 90, "30 seconds", "client_count")
    run(out.writeStream.outputMode("append").format("memory").queryName(name).start())
    return {r.event_id: r.client_count for r in spark.table(name).collect()}


def test_trailing_counts_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    seconds = sorted(rng.randrange(900) for _ in range(400))
    events_ = [(rng.choice("aab"), i, s) for i, s in enumerate(seconds)]
    cuts = [0, *[i for i in range(80, 400, 80)], 400]
    # Events of one second stay together, as the batch counts them all for each other.
    cuts = [next((j for j in range(i, 400) if j == 0 or seconds[j] != seconds[j - 1]), 400) for i in cuts]
    got = trailing(spark, tmp_path, [events_[a:b] for a, b in zip(cuts, cuts[1:])], "trail")
    assert got == {i: sum(d == c and s - 90 <= t <= s for d, _, t in events_) for c, i, s in events_}


def test_late_requests_count_inside_the_watermark_only(spark, tmp_path):
    batches = [[("a", 1, 100)], [("a", 2, 180)], [("a", 3, 170)], [("a", 4, 400)], [("a", 5, 405)], [("a", 6, 200), ("a", 7, 410)]]
    got = trailing(spark, tmp_path, batches, "late")
    assert got == {1: 1, 2: 2, 3: 2, 4: 1, 5: 2, 7: 3}


def test_claims_read_their_buckets_and_survive_a_restart(spark, tmp_path):
    keys = str(tmp_path / "keys")
    write = folds.claim_batches(keys, ["user_id", "k"])
    schema = "event_id bigint, user_id bigint, k int"
    one = spark.createDataFrame([(i, i % 40, 0) for i in range(100)], schema)
    two = spark.createDataFrame([(i, i % 60, 0) for i in range(100, 200)] + [(300, None, None), (301, None, None)], schema)
    write(one, 0)
    write(two, 1)
    want = {(u, 0): u for u in range(40)} | {(u, 0): 100 + (u - 100) % 60 for u in range(40, 60)} | {(None, None): 300}
    read = lambda: {(r.user_id, r.k): r.event_id for r in spark.read.parquet(keys).collect()}
    assert read() == want
    write(two, 1)  # a retried batch
    folds.claim_batches(keys, ["user_id", "k"])(one.union(two), 2)  # a new process
    assert read() == want and spark.read.parquet(keys).count() == 61
