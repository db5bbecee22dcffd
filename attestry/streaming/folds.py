"""Event-log folds as Structured Streaming jobs.

Aggregating folds (connector state, stage, packet status) are the batch functions of
``attestry.operators.events`` run on a stream in update mode. What differs is here:

* sequences of runs and exact trailing counts keep keyed state with ``transformWithState``:
  one entry per receipt or second, so a batch writes only what it changes, and timers on
  event time that drop the state of keys gone quiet. They need the RocksDB state store
  (``keep_state_in_rocksdb``);
* uniqueness holds inside the watermark only, so the sink also keeps a table of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType

from attestry.operators import ranking
from attestry.sources.sinks import append_run

STEP_SCHEMA = "run_id bigint, event_id bigint, stage string, sequence bigint, receipts bigint, calls bigint"
CLAIM_BUCKETS = 64


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Keyed state with maps and timers lives in RocksDB; the setting holds for queries started later."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


def sliding_counts(stream: DataFrame, window: str, slide: str, late: str) -> DataFrame:
    """Requests per client and operation in sliding windows of event time ``ts``."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", window, slide), "workspace_id", "client_id", "operation")
        .agg(F.count(F.lit(1)).alias("client_count"))
    )


def first_claims(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """First event of each key inside the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class _QuietKeys(StatefulProcessor):
    """State of a key that is dropped once the watermark is ``keep_ms`` past its newest event."""

    keep_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def expire_after(self, newest_ms: int) -> None:
        """Move the key's one timer behind its newest event."""
        if self.keep_ms is None:
            return
        due = newest_ms + self.keep_ms
        timers = list(self.handle.listTimers())
        if not timers or max(timers) < due:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.forget()
        return iter([])

    def close(self) -> None:
        pass


class _RunSteps(_QuietKeys):
    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle):
        super().init(handle)
        self.totals = handle.getValueState("totals", "sequence bigint, calls bigint, receipts bigint")
        self.receipts = handle.getMapState("receipts", "receipt bigint", "event_id bigint")

    def forget(self):
        self.totals.clear()
        self.receipts.clear()

    def handleInputRows(self, key, rows, timerValues):
        steps = pd.concat(list(rows)).sort_values(["at", "event_id"], ignore_index=True)
        sequence, calls, receipts = self.totals.get() if self.totals.exists() else (0, 0, 0)
        named = steps["receipt"].dropna()
        first = named[~named.duplicated()]
        fresh = np.zeros(len(steps), dtype="int64")
        for at, receipt in first.items():
            if not self.receipts.containsKey((int(receipt),)):
                self.receipts.updateValue((int(receipt),), (int(steps["event_id"][at]),))
                fresh[at] = 1
        out = pd.DataFrame(
            {
                "run_id": key[0],
                "event_id": steps["event_id"],
                "stage": steps["stage"],
                "sequence": sequence + np.arange(1, len(steps) + 1),
                "receipts": receipts + np.cumsum(fresh),
                "calls": calls + steps["is_call"].fillna(False).astype("int64").cumsum(),
            }
        )
        last = out.iloc[-1]
        self.totals.update((int(last["sequence"]), int(last["calls"]), int(last["receipts"])))
        self.expire_after(int(steps["at"].iloc[-1]) // 1000)
        yield out


def workflow_steps(stream: DataFrame, idle_seconds: int | None = None) -> DataFrame:
    """Sequence, distinct receipts and calls of each step, as steps arrive.

    ``stream``: run_id, event_id, at (microseconds), stage, receipt, is_call. A batch reads and
    writes one state entry per receipt that it names. Steps are numbered in order of arrival
    of their micro-batch and by time inside it; the rows of one run in one micro-batch are
    sorted in memory, so the source's intake per trigger bounds them. With ``idle_seconds``
    (the stream then needs a watermark) a run is forgotten that long after its newest step;
    steps that come later start it anew.
    """
    keep = None if idle_seconds is None else idle_seconds * 1000
    mode = "none" if keep is None else "eventTime"
    return stream.groupBy("run_id").transformWithStateInPandas(_RunSteps(keep), STEP_SCHEMA, "append", mode)


class _TrailingCounts(_QuietKeys):
    def __init__(self, keys: list[str], window: int, name: str):
        self.keys, self.window, self.name = keys, window, name
        self.keep_ms = (window + 1) * 1000

    def init(self, handle):
        super().init(handle)
        self.seconds = handle.getMapState("seconds", "second bigint", "n bigint")

    def forget(self):
        self.seconds.clear()

    def handleInputRows(self, key, rows, timerValues):
        events = pd.concat([batch[["event_id", "second"]] for batch in rows], ignore_index=True)
        kept = {second[0]: n[0] for second, n in self.seconds.iterator()}
        arrived = events["second"].value_counts()
        for second, n in arrived.items():
            kept[int(second)] = kept.get(int(second), 0) + int(n)
            self.seconds.updateValue((int(second),), (kept[int(second)],))
        # No event older than the watermark comes, so nothing looks back beyond it by more than the window.
        horizon = timerValues.getCurrentWatermarkInMs() // 1000 - self.window
        for second in [s for s in kept if s < horizon]:
            self.seconds.removeKey((second,))
        at = np.array(sorted(kept), dtype="int64")
        totals = np.concatenate([[0], np.cumsum([kept[s] for s in at.tolist()])])
        second = events["second"].to_numpy()
        count = totals[np.searchsorted(at, second, "right")] - totals[np.searchsorted(at, second - self.window, "left")]
        self.expire_after(int(at[-1]) * 1000)
        yield pd.DataFrame({**dict(zip(self.keys, key)), "event_id": events["event_id"], "second": second, self.name: count})


def trailing_counts(stream: DataFrame, keys: list[str], window: int, late: str, name: str) -> DataFrame:
    """Events of the key in the last ``window`` seconds, both ends included, exactly, per event.

    ``stream``: the keys, event_id, ts. State is one count per second that can still be asked
    for, at most window plus lateness many. An event counts what has arrived up to its own
    micro-batch, so events in time order get the counts of the batch job. One that comes out
    of order but inside the watermark gets its exact count and raises later events only from
    then on (counts once given are not taken back); one behind the watermark is dropped.
    """
    schema = stream.select(*keys).schema
    for field in ("event_id", "second", name):
        schema = schema.add(field, LongType())
    timed = stream.withWatermark("ts", late).withColumn("second", F.unix_seconds("ts"))
    counted = timed.select(*keys, "event_id", "ts", "second").groupBy(*keys)
    return counted.transformWithStateInPandas(_TrailingCounts(keys, window, name), schema, "append", "eventTime")


def rerank_touched(fresh: DataFrame, inputs: DataFrame) -> DataFrame:
    """Queue of the workspaces that new evidence touches, and of no other."""
    touched = fresh.select("workspace_id").distinct()
    return ranking.queue(inputs.join(touched, "workspace_id", "left_semi"))


def rerank_batches(base: str, inputs_of):
    """A ``foreachBatch`` function that re-ranks touched workspaces and appends a snapshot.

    ``inputs_of(session)`` gives the current ranking inputs. The run id is the batch id, so a
    batch that is retried replaces its own run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        queue = rerank_touched(batch, inputs_of(batch.sparkSession)).select("workspace_id", "task_id", "score", "rank")
        items = queue.withColumn("snapshot_of", F.lit(batch_id))
        snapshot = queue.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n_items"))
        append_run(base, f"batch-{batch_id}", {"items": items}, snapshot)

    return write


def claim_batches(keys_path: str, keys: list[str]):
    """A ``foreachBatch`` function that keeps one event per key for good.

    The watermark forgets old keys; the table of accepted keys does not. It is laid out by
    buckets of the key's hash, and a batch reads only the buckets of its own keys (a list of
    at most ``CLAIM_BUCKETS`` numbers) and writes one file to each. Retried batches rewrite
    their own partitions.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(CLAIM_BUCKETS)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy(*keys).agg(F.min("event_id").alias("event_id")).withColumn("bucket", bucket)
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]
        try:
            known = spark.read.parquet(keys_path).where(F.col("bucket").isin(touched) & (F.col("batch_id") < batch_id))
            same = [F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in ["bucket", *keys]]
            first = first.alias("new").join(known.alias("old"), same, "left_anti")
        except Exception as error:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
        (
            first.withColumn("batch_id", F.lit(batch_id))
            .repartition("bucket")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket", "batch_id").parquet(keys_path)
        )

    return write
