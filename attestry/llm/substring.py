"""Substring deduplication by level-wise doubling.

A window of ``size`` words can only repeat if a window of half that length inside it repeats.
The first level looks at windows of ``size / 2`` words, and of those only at the ones that are
the smallest hash of some full window: equal full windows have equal smallest halves, so no
repeat is lost and about a sixth of all positions is shuffled. Full windows are hashed (128
bits) only around halves that repeat, and a window falls when a smaller ``doc_id`` has it too, or the
same document has it earlier. ``doubled`` goes on to twice that length, and so on, until
nothing repeats.

Nulls count as empty texts. Rows without ``doc_id`` come after all others, by text hash. Rows that share
their ``doc_id`` are one document if their texts agree and are not compared with each other if
not. Texts shorter than a window lose nothing. Equal texts are settled before the levels: all but the
first of them lose every word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Shelf, WordHashes, keyed, sliding, window_hashes
from attestry.session import broadcast_if_small

SIZE = 20
NOTHING = hashlib.sha256(b"").hexdigest()
ID = ["key", "tie"]


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # bytes.split() parts at 0x20 and 0x09-0x0D and nowhere else


def _smallest(g: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per full window its smallest half hash; and the positions that are smallest in some window."""
    least = sliding(g, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    return least, np.flatnonzero(g == most)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _halves(size: int):
    half = size // 2

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            n, sha, h, p = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = _words(text)
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) < size:
                    h.append(np.zeros(0, np.int64))
                    p.append(np.zeros(0, np.int32))
                    continue
                g = window_hashes(hashes.of(words), half)
                at = _smallest(g, size - half + 1)[1]
                h.append(g[at].view(np.int64))
                p.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), batch.column("tie"), pa.array(n, pa.int64()), pa.array(sha),
                 _lists(h, pa.int64()), _lists(p, pa.int32())],
                ["doc_id", "key", "tie", "n_words", "sha", "h", "p"],
            )

    return run


def _windows(size: int):
    """Full windows around repeated halves: those first in their document, and starts that repeat inside it."""
    half = size // 2
    width = size - half + 1

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            start, first, second, again = [], [], [], []
            for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("found")):
                h = hashes.of(_words(text))
                g = window_hashes(h, half)
                least = _smallest(g, width)[0]
                repeated = np.zeros(len(g), bool)
                repeated[found.values.to_numpy(zero_copy_only=False)] = True
                live = np.zeros(len(least), bool)
                for o in range(width):
                    live |= repeated[o : o + len(least)] & (g[o : o + len(least)] == least)
                at = np.flatnonzero(live)
                a = window_hashes(h, size, at, 1).view(np.int64)
                b = window_hashes(h, size, at, 2).view(np.int64)
                fresh = np.zeros(len(at), bool)
                if len(at):
                    order = np.lexsort((at, b, a))
                    fresh[order] = np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
                start.append(at[fresh].astype(np.int32))
                first.append(a[fresh])
                second.append(b[fresh])
                again.append(at[~fresh].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("tie"), _lists(start, pa.int32()), _lists(first, pa.int64()), _lists(second, pa.int64()), _lists(again, pa.int32())],
                ["key", "tie", "start", "a", "b", "again"],
            )

    return run


def _cut(size: int):
    def run(batches):
        for batch in batches:
            removed, sha = [], []
            for text, starts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("starts")):
                words = _words(text)
                s = starts.values.to_numpy(zero_copy_only=False)
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, s, 1)
                np.add.at(steps, s + size, -1)
                covered = np.cumsum(steps[:-1]) > 0
                removed.append(int(covered.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, c in zip(words, covered.tolist()) if not c])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("tie"), pa.array(removed, pa.int64()), pa.array(sha)], ["key", "tie", "cut_words", "cut_sha"]
            )

    return run


def repeated_windows(shelf: Shelf, docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """All documents (``doc_id, key, tie, n_words, sha, copy``), and per document the ``starts`` of windows that occur earlier.

    ``copy`` marks a document whose whole word sequence occurs under a smaller id; such
    documents have no row among the starts.
    """
    base = shelf.keep(
        keyed(docs).mapInArrow(_halves(size), "doc_id long, key long, tie int, n_words long, sha string, h array<long>, p array<int>")
    )
    lead = shelf.keep(base.groupBy("sha").agg(F.min("key").alias("lead"), F.max("key").alias("last")).where("lead < last").select("sha", "lead"))
    copies = shelf.keep(
        base.where(F.col("n_words") >= size).select(*ID, "sha").join(lead, "sha").where("key > lead").select(*ID).withColumn("copy", F.lit(True))
    )
    known = base.select("doc_id", *ID, "n_words", "sha").join(broadcast_if_small(copies.distinct()), ID, "left")
    known = known.withColumn("copy", F.col("copy").isNotNull())

    originals = base.where(F.size("h") > 0).join(broadcast_if_small(copies), ID, "left_anti")
    halves = originals.select(*ID, F.explode(F.arrays_zip("h", "p")).alias("at")).select(*ID, F.col("at.h").alias("h"), F.col("at.p").alias("p"))
    often = shelf.keep(halves.groupBy("h").count().where("count > 1").select("h"))
    found = shelf.keep(
        halves.join(often.hint("shuffle_hash"), "h").groupBy(*ID).agg(F.collect_set("p").alias("found"))
    )
    windows = shelf.keep(
        keyed(docs).select(*ID, "text").join(found, ID).mapInArrow(
            _windows(size), "key long, tie int, start array<int>, a array<long>, b array<long>, again array<int>"
        )
    )
    each = windows.select(*ID, F.explode(F.arrays_zip("a", "b", "start")).alias("w")).select(*ID, "w.a", "w.b", "w.start")
    earliest = shelf.keep(
        each.groupBy("a", "b").agg(F.min("key").alias("lead"), F.max("key").alias("last")).where("lead < last").select("a", "b", "lead")
    )
    later = each.join(earliest.hint("shuffle_hash"), ["a", "b"]).where("key > lead").groupBy(*ID).agg(F.collect_set("start").alias("later"))
    inside = windows.where(F.size("again") > 0).groupBy(*ID).agg(F.first("again").alias("again"))
    starts = shelf.keep(
        later.join(inside, ID, "full").select(*ID, F.concat(F.coalesce("later", F.array().cast("array<int>")), F.coalesce("again", F.array().cast("array<int>"))).alias("starts"))
    )
    shelf.drop(often, found, windows, earliest)
    return known, starts


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row of ``docs``."""
    shelf = Shelf(docs.sparkSession, "substring")
    known, starts = repeated_windows(shelf, docs, size)
    cut = (
        keyed(docs).select(*ID, "text").join(starts, ID).mapInArrow(_cut(size), "key long, tie int, cut_words long, cut_sha string")
    ).groupBy(*ID).agg(F.first("cut_words").alias("cut_words"), F.first("cut_sha").alias("cut_sha"))
    return known.join(cut, ID, "left").select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(NOTHING)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )


def doubled(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``(doc_id, start, length)``: starts whose window of ``length`` words occurs earlier, for ``size``, twice ``size``, ...

    A window of twice a length is named by the names of its two halves, so each level joins the
    survivors of the last one with themselves at a distance of one length; the loop ends with
    the first level at which nothing repeats. Equal texts take part like all others here.
    """
    shelf = Shelf(docs.sparkSession, "doubling")
    base = keyed(docs).mapInArrow(_every(size), "doc_id long, key long, tie int, a array<long>")
    level = shelf.keep(base.select("doc_id", *ID, F.posexplode("a").alias("start", "a")))
    found, length = None, size
    while True:
        again = level.groupBy("a").agg(F.min(F.struct("key", "start")).alias("lead"), F.count("*").alias("n")).where("n > 1")
        level = shelf.keep(level.join(shelf.keep(again), "a"))
        hits = level.where(F.struct("key", "start") > F.col("lead")).select("doc_id", "start", F.lit(length).alias("length"))
        found = hits if found is None else found.unionByName(hits)
        if not level.limit(1).count():
            return found
        right = level.select(*ID, (F.col("start") - length).alias("start"), F.col("a").alias("b"))
        level = shelf.keep(level.join(right, [*ID, "start"]).select("doc_id", *ID, "start", F.xxhash64("a", "b").alias("a")))
        length *= 2


def _every(size: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            out = [window_hashes(hashes.of(w), size).view(np.int64) for w in map(_words, batch.column("text").cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "tie")), _lists(out, pa.int64())], ["doc_id", "key", "tie", "a"])

    return run
