"""Session construction and cluster-aware settings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Largest side (bytes, by Catalyst's own estimate) a job here may broadcast by hint.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("attestry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: the checkpoint folder the cluster set.

    Only a local session without one gets a scratch folder; a cluster without one is refused,
    since a folder on a single machine would be lost with its executor.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="attestry-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of a query that starts in here when it ends: what was written is read instead."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder."""
    folder = _shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as compressed Parquet and read it back: later steps read only the columns they use."""
    spark = df.sparkSession
    place = f"{_shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan (file sizes at the leaves)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimate proves the side small.

    Beyond the limit the frame is returned as is, so the join becomes a shuffled
    one that AQE can split on skew.
    """
    return df.hint("broadcast") if size_in_bytes(df) <= limit else df
