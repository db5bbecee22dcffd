"""Near-duplicate groups by SuperMinHash, banding, exact verification and connected components.

SuperMinHash gives every shingle one random permutation of the signature's slots and writes
``rank + fraction`` into them, so the slots of a text are correlated and vary less than
independent minima. A text stops as soon as no higher rank can lower any of its slots, which for
a text of some hundred shingles is after one or two ranks.

A band hashes a fixed subset of slots; texts that share a band are candidates. Texts with equal
shingle sets are folded first. Within a band only the member that shares most bands with others
(the hub) is paired with all; the links found that way give first components. Texts whose bands
still hold several components get a longer signature with longer, more bands, which texts well
below the threshold rarely share, and there every member outside a band's largest component
is paired with the members of other components, unless two-bit sketches of the signatures differ by
four standard deviations more than at the threshold. So no group is expanded into all its pairs and
no link between components is left out. Every pair is confirmed on the full shingle sets. The bands of
both rounds are chosen so that a pair at the threshold shares none about once in 10^5.

Shingles are runs of five lower-cased words, or the whole sequence of a shorter text. Null and
empty texts have no shingles and stay alone. A ``doc_id`` is one node: rows that repeat it belong
together. Rows without ``doc_id`` are nodes by their text; a group of only such rows has no
``component_id``, and its rows are kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import NO_ID, Shelf, WordHashes, components, keyed, mixed, window_hashes
from attestry.session import broadcast_if_small

SHINGLE = 5
CHUNK = 20_000  # shingles that are signed together


@dataclass(frozen=True)
class Bands:
    """A signature of ``slots`` slots, read in ``count`` bands that a pair at the threshold shares with chance ``chance``."""

    slots: int
    count: int
    chance: float

    def rows(self, percent: int) -> int:
        return max(1, int(math.log(self.chance) / math.log(min(percent, 99) / 100)))

    def apart(self, percent: int) -> int:
        """Sketched slots in which a pair at the threshold differs, plus four standard deviations."""
        odds = (1 - percent / 100) * 3 / 4
        return math.ceil(self.slots * odds + 4 * math.sqrt(self.slots * odds * (1 - odds)))


WIDE = Bands(slots=128, count=48, chance=0.32)
LONG = Bands(slots=1024, count=600, chance=0.0202)


def shingles(hashes: WordHashes, text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; ``bytes.lower`` changes A-Z alone."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(hashes.of(words), min(size, len(words)), seed=min(size, len(words))))


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One signature row per non-empty set: ``rank << 32 | fraction`` in each slot."""
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    signature = np.full(len(sets) * slots, np.uint64(2**63))
    order = None
    for rank in range(slots):
        u = mixed(x + np.uint64(0x9E3779B97F4A7C15 * (rank + 1) % 2**64))
        pick = rank + (((u & np.uint64(0xFFFFFFFF)) * np.uint64(slots - rank)) >> np.uint64(32)).astype(np.int64)
        value = (u >> np.uint64(32)) | np.uint64(rank << 32)
        if rank == 0:
            slot, first = pick, pick
        else:
            if order is None:  # most texts are done before any permutation is needed
                order = np.tile(np.arange(slots, dtype=np.uint16), (len(x), 1))
                each = np.arange(len(x))
                order[each, first], order[each, 0] = 0, first
            each = np.arange(len(x))
            slot = order[each, pick].astype(np.int64)
            order[each, pick], order[each, rank] = order[each, rank], slot
        np.minimum.at(signature, doc * slots + slot, value)
        open_ = signature.reshape(-1, slots).max(axis=1) >= np.uint64((rank + 1) << 32)
        live = open_[doc]
        if not live.any():
            break
        if not live.all():
            x, doc = x[live], doc[live]
            if order is not None:
                order = order[live]
            else:
                first = first[live]
    return signature.reshape(-1, slots)


def _sign(percent: int, plan: Bands):
    rows = plan.rows(percent)
    chance = mixed(np.arange(plan.count * plan.slots, dtype=np.uint64) + np.uint64(1)).reshape(plan.count, plan.slots)
    subsets = np.argsort(chance, axis=1)[:, :rows]
    salt = mixed(np.arange(plan.count, dtype=np.uint64) + np.uint64(77))

    def keys(sets: list[np.ndarray]) -> np.ndarray:
        """Per set two bits of each slot (the sketch), then the band keys."""
        signature = super_minhash(sets, plan.slots)
        halves = [np.packbits((signature & np.uint64(bit)).astype(bool), axis=1).view(np.int64) for bit in (1, 2)]
        sketch = np.concatenate(halves, axis=1)
        out = np.broadcast_to(salt, (len(sets), plan.count)).copy()
        for r in range(rows):
            out = mixed(out ^ (signature[:, subsets[:, r]] * np.uint64(0x9E3779B97F4A7C15)))
        return np.concatenate([sketch, out.view(np.int64)], axis=1)

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(hashes, t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            fold = [int.from_bytes(xxhash.xxh3_128_digest(s.tobytes()), "big") for s in sets]
            bands: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sets)
            sketches = list(bands)
            part: list[int] = []
            total = 0
            for i, s in enumerate([*sets, None]):
                if s is None or total * plan.slots > CHUNK * WIDE.slots:
                    if part:
                        for j, row in zip(part, keys([sets[j] for j in part])):
                            sketches[j], bands[j] = row[: plan.slots // 32], row[plan.slots // 32 :]
                    part, total = [], 0
                if s is not None and len(s):
                    part.append(i)
                    total += len(s)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("key"), batch.column("tie"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([f >> 64 for f in fold], np.uint64).view(np.int64)), pa.array(np.array([f & (2**64 - 1) for f in fold], np.uint64).view(np.int64)),
                    long_lists(sketches), long_lists(bands),
                ],
                ["doc_id", "key", "tie", "n_shingles", "fold1", "fold2", "sketch", "bands"],
            )

    return run


SIGNED = "doc_id long, key long, tie int, n_shingles long, fold1 long, fold2 long, sketch array<long>, bands array<long>"


def long_lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _confirm(percent: int):
    def run(batches):
        hashes = WordHashes()
        last, left = None, None
        for batch in batches:
            ok = []
            for a, x, y in zip(
                batch.column("a").to_pylist(), batch.column("text_a").cast(pa.binary()).to_pylist(), batch.column("text_b").cast(pa.binary()).to_pylist()
            ):
                if (a, x) != last:
                    last, left = (a, x), shingles(hashes, x)
                right = shingles(hashes, y)
                both = len(np.intersect1d(left, right, assume_unique=True))
                ok.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def confirmed(shelf: Shelf, docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    needed = shelf.keep(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct())
    texts = shelf.keep(keyed(docs).select("key", "text").join(broadcast_if_small(needed), "key"))
    other = pairs.join(texts.withColumnRenamed("key", "b").withColumnRenamed("text", "text_b"), "b")
    whole = other.join(texts.withColumnRenamed("key", "a").withColumnRenamed("text", "text_a"), "a")
    links = shelf.keep(whole.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long"))
    shelf.drop(needed, texts)
    return links


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, n_links, component_id, kept, key, tie)`` of every row of ``docs``.

    Two documents are linked when ``100 * |A and B| >= percent * |A or B|``. ``n_links`` counts the
    confirmed links of the row's class of equal shingle sets to other classes; links inside one
    component that no hub needed are not enumerated. Keep the rows with ``kept``.
    """
    shelf = Shelf(docs.sparkSession, "neardup")
    signed = shelf.keep(keyed(docs).mapInArrow(_sign(percent, WIDE), SIGNED))
    fold = ["fold1", "fold2"]
    lead = shelf.keep(signed.where("n_shingles > 0").groupBy(*fold).agg(F.min("key").alias("key")))
    reps = shelf.keep(signed.join(lead, [*fold, "key"]).select(F.col("key").alias("node"), "n_shingles", "bands"))
    banded = reps.select("node", "n_shingles", F.explode("bands").alias("band"))
    shared = shelf.keep(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    members = shelf.keep(banded.join(shared.hint("shuffle_hash"), "band"))

    mates = shelf.keep(members.groupBy("node").agg(F.sum("n").alias("mates")))
    hubs = shelf.keep(members.join(mates, "node").groupBy("band").agg(F.max(F.struct("mates", "node"))["node"].alias("hub")))
    stars = shelf.keep(
        members.join(hubs, "band").where("node <> hub")
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    )
    links = confirmed(shelf, docs, stars, percent)
    first = components(shelf, links)

    placed = shelf.keep(
        members.join(first, "node", "left").select("band", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    )
    mixed_bands = shelf.keep(
        placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    )
    unsure = shelf.keep(
        placed.join(broadcast_if_small(mixed_bands), "band").groupBy("node").agg(F.first("component").alias("component"), F.first("n_shingles").alias("n"))
    )
    again = keyed(docs).join(broadcast_if_small(unsure.select(F.col("node").alias("key"))), "key").select("doc_id", "text", "key", "tie")
    longer = shelf.keep(again.mapInArrow(_sign(percent, LONG), SIGNED).groupBy("key").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    within = shelf.keep(longer.join(unsure, longer.key == unsure.node).select("node", "n", "component", F.explode("bands").alias("band")))
    held = within.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band")
    main = shelf.keep(
        held.agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1").select("band", "main")
    )
    words = LONG.slots // 64
    parts = [F.col("sketch")[i].alias(f"s{i}") for i in range(2 * words)]
    sketches = longer.select(F.col("key").alias("node"), *parts)
    sided = shelf.keep(within.join(main.hint("shuffle_hash"), "band").join(broadcast_if_small(sketches), "node"))
    left = sided.where("component <> main")
    right = sided.select("band", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("component").alias("other_c"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(len(parts))])
    unlike = [F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}")) for i in range(2 * words)]
    differ = sum((F.bit_count(unlike[i].bitwiseOR(unlike[i + words])) for i in range(words)), F.lit(0))
    near_size = (F.col("n") * 100 >= F.col("other_n") * percent) & (F.col("other_n") * 100 >= F.col("n") * percent)
    once = (F.col("other_c") == F.col("main")) | (F.col("node") < F.col("other"))
    rest = (
        left.join(right, "band").where((F.col("component") != F.col("other_c")) & once & near_size & (differ <= LONG.apart(percent)))
        .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    )
    more = confirmed(shelf, docs, shelf.keep(rest.join(stars, ["a", "b"], "left_anti")), percent)
    every = shelf.keep(links.union(more).distinct())
    final = components(shelf, every)

    degree = shelf.keep(
        every.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    )
    classes = shelf.keep(
        lead.withColumnRenamed("key", "node").join(final, "node", "left").join(degree, "node", "left")
        .select(*fold, F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    shelf.drop(reps, shared, members, mates, hubs, stars, placed, mixed_bands, unsure, longer, within, main, sided)
    found = signed.select("doc_id", "key", "tie", "n_shingles", *fold).join(broadcast_if_small(classes), fold, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("component") < NO_ID, F.col("component")))
    return found.select(
        "doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), "key", "tie",
    )
