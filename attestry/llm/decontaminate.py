"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens: the hash covers the marked positions and ignores
the others, so a substituted token at an ignored position does not hide a copy. Hashes of all
masks at all positions of the documents meet those of the benchmark items; a hit names a document, an
item and a diagonal (the distance of their positions). Around the hits of a diagonal the whole
overlap is compared token by token: the document is contaminated when ``window`` consecutive
item tokens (the whole item if it is shorter) stand in it with at least ``percent`` percent equal.
Masks are chosen by the width of the overlap so that whatever tokens are substituted within
the rule, one mask still agrees somewhere in it: no copy that meets the rule is missed.

Tokens are runs of letters and digits, lower-cased. Everything is DataFrame functions. The
benchmark is broadcast when it is small, else joined by shuffle, where a frequent hash may be split.

Null and empty texts are clean. Items without tokens match nothing. An item without id counts, but is not listed. Repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import Shelf, keyed
from attestry.session import broadcast_if_small

WINDOW, PERCENT = 15, 80
#: (tokens, substitutions) to masks of which one agrees wherever so many tokens hold at most so many substitutions.
_WIDE = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 5, 7, 8), (0, 1, 6, 8, 9, 10))
MASKS = {
    (15, 3): _WIDE,
    (12, 2): _WIDE,
    (10, 2): ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 1, 2, 5, 6)),
    (9, 1): ((0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 5, 6)),
    (8, 1): ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 5, 6)),
    (7, 1): ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 3, 4, 5)),
    (6, 1): ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4)),
    (5, 1): ((0, 1, 2), (0, 1, 3)),
}
LONGEST = 8
ID = ["key", "tie"]


def tokens(text: Column) -> Column:
    """Hashes of the tokens in order."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def lost(width: int, percent: int) -> int:
    """Tokens of ``width`` that may differ."""
    return width * (100 - percent) // 100


def masks_for(width: int, percent: int) -> tuple[tuple[int, ...], ...]:
    """Masks of which one agrees wherever ``width`` tokens stand with at least ``percent`` percent equal.

    Besides the listed ones there is always a run: ``n`` substitutions leave one of ``n + 1`` gaps
    with ``width // (n + 1)`` tokens or more.
    """
    gone = lost(width, percent)
    run = tuple(range(min(LONGEST, max(1, width // (gone + 1)))))
    listed = [masks for (tokens, most), masks in MASKS.items() if tokens <= width and most >= gone]
    return max([(run,), *listed], key=lambda masks: (min(map(len, masks)), -len(masks)))


def seeds(masks: list[tuple[int, ...]], wanted: list[Column] | None = None) -> Column:
    """``(at, seed)`` of every position of column ``w``, of the masks that are ``wanted`` in the row."""
    none = F.array().cast("array<struct<at:int,seed:bigint>>")

    def of(number: int, mask: tuple[int, ...]) -> Column:
        places = F.size("w") - (mask[-1] + 1)
        hashed = F.transform(
            F.sequence(F.lit(0), F.greatest(places, F.lit(0))),
            lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(number), *[F.get("w", i + o) for o in mask]).alias("seed")),
        )
        return F.when((places >= 0) if wanted is None else (places >= 0) & wanted[number], hashed)

    return F.concat(none, *[F.coalesce(of(n, m), none) for n, m in enumerate(masks)])


def hits(shelf: Shelf, docs: DataFrame, items: DataFrame, window: int, percent: int) -> DataFrame:
    """``(key, tie, item, shift)``: diagonals on which some seed agrees; ``items`` has (item, w).

    Where a seed covers the whole overlap, one diagonal of a document and item tells as much as all.
    """
    width = F.least(F.lit(window), F.size("w"))
    widths = sorted(r[0] for r in items.where(F.size("w") > 0).select(width.alias("width")).distinct().collect())
    by_width = {n: masks_for(n, percent) for n in widths}
    masks = sorted({m for several in by_width.values() for m in several})
    of_mask = [[n for n in widths if m in by_width[n]] for m in masks]
    wholes = [n for n in widths if lost(n, percent) == 0 and by_width[n] == (tuple(range(n)),)]
    theirs = items.select("item", width.isin(wholes).alias("whole"), F.explode(seeds(masks, [width.isin(ns) for ns in of_mask])).alias("s"))
    theirs = theirs.select("item", "whole", F.col("s.at").alias("item_at"), F.col("s.seed").alias("seed")).distinct()
    theirs = broadcast_if_small(shelf.keep(theirs))
    mine = keyed(docs).select(*ID, tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    mine = mine.select(*ID, F.explode(seeds(masks)).alias("s")).select(*ID, F.col("s.at").alias("at"), F.col("s.seed").alias("seed"))
    met = mine.join(theirs, "seed").select(*ID, "item", "whole", (F.col("at") - F.col("item_at")).alias("shift"))
    met = met.groupBy(*ID, "item", F.when(~F.col("whole"), F.col("shift")).alias("each")).agg(F.min("shift").alias("shift"))
    return shelf.keep(met.drop("each"))


def overlaps(shelf: Shelf, docs: DataFrame, items: DataFrame, found: DataFrame, window: int, percent: int) -> DataFrame:
    """``(key, tie, item, equal)``: verified pairs, with the equal tokens of the best window."""
    touched = broadcast_if_small(shelf.keep(found.select(*ID).distinct()))
    texts = shelf.keep(keyed(docs).join(touched, ID).groupBy(*ID).agg(F.first("text").alias("text")).select(*ID, tokens(F.col("text")).alias("w")))
    both = found.join(texts, ID).join(broadcast_if_small(items.select("item", F.col("w").alias("v"))), "item")
    both = both.withColumn("same", F.transform("v", lambda x, j: (F.get("w", j + F.col("shift")) == x).cast("int")))
    both = both.select(*ID, "item", F.transform("same", lambda x: F.coalesce(x, F.lit(0))).alias("same"))
    width = F.least(F.lit(window), F.size("same"))
    sums = F.transform(
        F.sequence(F.lit(1), F.size("same") - width + 1), lambda s: F.aggregate(F.slice("same", s, width), F.lit(0), lambda a, x: a + x)
    )
    return both.select(*ID, "item", width.alias("width"), F.array_max(sums).alias("equal")).where(F.col("equal") * 100 >= F.col("width") * percent)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, contaminated, n_items, item_ids, key, tie)`` of every row of ``docs``."""
    shelf = Shelf(docs.sparkSession, "decontaminate")
    items = shelf.keep(
        benchmark.where("text is not null").select(
            F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.col("item_id").cast("string"), F.col("text").cast("string")).alias("item"),
            tokens(F.col("text").cast("string")).alias("w"),
        ).dropDuplicates(["item"])
    )
    found = hits(shelf, docs, items, window, percent)
    verified = overlaps(shelf, docs, items, found, window, percent).select(*ID, "item").distinct()
    named = verified.join(broadcast_if_small(items.select("item", "item_id")), "item")
    bad = shelf.keep(named.groupBy(*ID).agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids")))
    out = keyed(docs).select("doc_id", *ID).join(broadcast_if_small(bad), ID, "left")
    return out.select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), *ID,
    )
