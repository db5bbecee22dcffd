"""What the corpus operators share: shared tables, word hashing, identity keys, components.

Row identity. ``keyed`` adds ``key`` (``doc_id``; rows without one get a number of their text's
above ``NO_ID``, so they come last) and ``tie`` (31 bits of the text's hash). Rows that agree in
both are the same document repeated; rows with one ``doc_id`` and different texts stay apart
through ``tie``.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
NO_ID = 2**62
ARROW_BATCH_BYTES = 8 * 1024 * 1024
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by bytes, since texts run from nothing to megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="attestry-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Shelf:
    """Intermediate tables of one operator run, as Parquet in the shared folder.

    A kept table cuts the lineage: a lost executor costs the tasks of one job, not the run.
    Shuffle files of a keeping job are freed with it. ``drop`` deletes a table that a later
    round has replaced.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.places: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        place = f"{self.folder}/{self.count}"
        before = self.spark.conf.get(CLEAN_UP, None)
        try:
            self.spark.conf.set(CLEAN_UP, "true")
            df.write.option("compression", "zstd").parquet(place)
        finally:
            if before is None:
                self.spark.conf.unset(CLEAN_UP)
            else:
                self.spark.conf.set(CLEAN_UP, before)
        kept = self.spark.read.schema(df.schema).parquet(place)
        self.places[id(kept)] = place
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for kept in tables:
            place = self.places.pop(id(kept), None)
            if place is not None:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


COUNTED_LIMIT_BYTES = 32 * 1024 * 1024


def counted_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast if the rows, counted, stay under the limit at ``row_bytes`` each; else leave the join to shuffles.

    Files say little of memory: a kept table is several times smaller on disk.
    """
    return df.hint("broadcast") if df.count() * row_bytes <= COUNTED_LIMIT_BYTES else df


def identity() -> tuple[Column, Column]:
    """``key`` and ``tie`` of a row of documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.xxhash64(text).bitwiseAND(F.lit(2**61 - 1)) + F.lit(NO_ID)
    return F.coalesce(F.col("doc_id").cast("long"), number), F.xxhash64(text).bitwiseAND(F.lit(2**31 - 1)).cast("int")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, with the identity columns; other columns cannot clash."""
    key, tie = identity()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        key.alias("key"), tie.alias("tie"),
    )


def crc_fold(column: str, parts: int) -> Column:
    """Fold of a row: crc32 of the id as text, modulo ``parts`` (rows without an id: fold 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(0))


class WordHashes(dict):
    """Word bytes to 64-bit hash, remembered up to a bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(h: np.ndarray, size: int, at: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes, or of those starting at ``at``."""
    n = max(0, len(h) - size + 1)
    part = (lambda j: h[j : j + n]) if at is None else (lambda j: h[at + j])
    out = part(0) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)
    for j in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + part(j)
    return mixed(out)


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def components(shelf: Shelf, links: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes of ``links`` (a, b): the smallest node reachable.

    Each round takes the smallest label among the neighbours and then jumps to that label's own
    label, so chains halve. Rounds are tables; no round gathers a component anywhere.
    """
    both = shelf.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = shelf.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = shelf.keep(
            labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("label"))
        )
        roots = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        jumped = shelf.keep(
            stepped.join(roots, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("component"))
        )
        changed = jumped.where("component <> was").limit(1).count()
        shelf.drop(stepped, labels)
        labels = jumped.select("node", "component")
        shelf.places[id(labels)] = shelf.places.pop(id(jumped))
        if not changed:
            return labels
