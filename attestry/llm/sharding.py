"""Sharding by balanced label propagation.

Documents with equal texts are linked. Each shard may hold an equal number of rows (law
``rows``: counts differ by one at most). Documents start in a shard drawn by hash; then, round by round, the
members of a group ask to move to the shard that holds most of their group and has room. What may
move from one shard to another in a round is a quota: exchanges of equal size, and moves
into room that is free. Members of a group in one shard are alike, so the rounds work on
``(group, shard, count)`` rows and no group is ever expanded. A group too large for a shard fills
one shard after the other. Documents without links fill what is left.

Ranks (of a document in its group, its shard, or the fillers) are counted in hash ranges: sums of
about sqrt(n) ranges first, then within each range, so no group is sorted in one task.

Null texts have size 8 and no links; empty texts are equal texts. Repeated rows are rows of their
own and get slots of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import Shelf
from attestry.session import broadcast_if_small

SHARDS = 24
GROUP = ["g1", "g2"]


def ranges(h: str, n: Column) -> Column:
    """The hash range of a row among about sqrt(n) ranges; ``h`` runs from 0 to 2^62."""
    return F.floor(F.col(h) / F.lit(float(2**62)) * F.ceil(F.sqrt(n))).cast("long")


def ranked(shelf: Shelf, df: DataFrame, keys: list[str], n: Column, rank: str) -> DataFrame:
    """``df`` with the rank from 0 of each row within ``keys`` by ``h``; ``n`` is about the rows of a key."""
    df = shelf.keep(df.withColumn("_range", ranges("h", n)))
    sums = df.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    ahead = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = shelf.keep(sums.select(*keys, "_range", F.coalesce(ahead, F.lit(0)).alias("_ahead")))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("h"))
    return df.join(broadcast_if_small(sums), [*keys, "_range"]).withColumn(rank, F.col("_ahead") + inside - 1).drop("_range", "_ahead")


def quotas(demand: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Rows that may move between two shards: equal exchanges first, then moves into free room, which frees room behind them."""
    grant = {pair: min(n, demand.get(pair[::-1], 0)) for pair, n in demand.items()}
    room = list(room)
    moved = True
    while moved:
        moved = False
        for (a, b), n in sorted(demand.items(), key=lambda item: -item[1]):
            more = min(n - grant[a, b], room[b])
            if more > 0:
                grant[a, b] += more
                room[b] -= more
                room[a] += more
                moved = True
    return grant


def _granted(shelf: Shelf, asks: DataFrame, limits: DataFrame) -> DataFrame:
    """``asks`` with ``grant``: rows of (a, b) in hash order until the limit of the pair, the last one in part."""
    asks = asks.join(F.broadcast(limits), ["a", "b"]).withColumn("_range", ranges("h", F.col("n_asks")))
    asks = shelf.keep(asks)
    upto = F.sum("_n").over(Window.partitionBy("a", "b").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = asks.groupBy("a", "b", "_range").agg(F.sum("n").alias("_n")).withColumn("_ahead", F.coalesce(upto, F.lit(0)))
    sums = shelf.keep(sums.select("a", "b", "_range", "_ahead"))
    inside = F.sum("n").over(Window.partitionBy("a", "b", "_range").orderBy("h", *GROUP).rowsBetween(Window.unboundedPreceding, -1))
    before = F.col("_ahead") + F.coalesce(inside, F.lit(0))
    placed = asks.join(broadcast_if_small(sums), ["a", "b", "_range"])
    return placed.withColumn("grant", F.greatest(F.lit(0), F.least("n", F.col("quota") - before))).select(*GROUP, "a", "b", "grant")


def propagate(shelf: Shelf, cells: DataFrame, capacity: list[int], rounds: int) -> DataFrame:
    """``cells`` (g1, g2, shard, n) after label propagation under the capacities."""
    spark, shards = shelf.spark, len(capacity)
    for _ in range(rounds):
        load = [0] * shards
        for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row per shard
            load[r["shard"]] = r["n"]
        room = [c - x for c, x in zip(capacity, load)]
        open_ = [s for s in range(shards) if room[s] > 0]
        # with no room anywhere, groups still come together by exchanges
        target = cells.where(F.col("shard").isin(open_)) if open_ else cells
        best = target.groupBy(*GROUP).agg(F.max(F.col("n") * shards + (shards - 1 - F.col("shard"))).alias("best"))
        best = best.select(*GROUP, F.expr(f"cast({shards - 1} - best % {shards} as int)").alias("b"), F.expr(f"best div {shards}").alias("most"))
        asks = shelf.keep(
            cells.join(best, GROUP).where("shard <> b and n <= most").select(
                *GROUP, F.col("shard").alias("a"), "b", "n", F.xxhash64(*GROUP, "shard").bitwiseAND(F.lit(2**62 - 1)).alias("h")
            )
        )
        wishes = asks.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count("*").alias("asks")).collect()  # at most shards^2 rows
        grant = quotas({(r["a"], r["b"]): r["n"] for r in wishes}, [max(0, x) for x in room])
        if not any(grant.values()):
            break
        limits = spark.createDataFrame([(r["a"], r["b"], grant[r["a"], r["b"]], r["asks"]) for r in wishes], "a int, b int, quota long, n_asks long")
        moves = shelf.keep(_granted(shelf, asks, limits).where("grant > 0"))
        steps = cells.unionByName(moves.select(*GROUP, F.col("b").alias("shard"), F.col("grant").alias("n"))).unionByName(
            moves.select(*GROUP, F.col("a").alias("shard"), (-F.col("grant")).alias("n"))
        )
        cells = shelf.keep(steps.groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return cells


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = 12) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row."""
    shelf = Shelf(docs.sparkSession, "sharding")
    text = F.col("text").cast("string")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    base = shelf.keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.when(text.isNotNull(), F.xxhash64(text)).alias("g1"), F.when(text.isNotNull(), F.xxhash64(text, F.lit(1))).alias("g2"),
            F.xxhash64(name, text).bitwiseAND(F.lit(2**62 - 1)).alias("h"),
        )
    )
    total = base.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    groups = shelf.keep(base.where("g1 is not null").groupBy(*GROUP).agg(F.count("*").alias("members")).where("members > 1"))
    linked = shelf.keep(base.join(broadcast_if_small(groups), GROUP))
    start = linked.groupBy(*GROUP, F.pmod(F.col("h"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    cells = propagate(shelf, shelf.keep(start), capacity, rounds)

    # what a shard still holds above its capacity goes to the fillers
    load = {r["shard"]: (r["n"], r["cells"]) for r in cells.groupBy("shard").agg(F.sum("n").alias("n"), F.count("*").alias("cells")).collect()}
    over = [(s, -1, n - capacity[s], k) for s, (n, k) in load.items() if n > capacity[s]]
    if over:
        limits = docs.sparkSession.createDataFrame(over, "a int, b int, quota long, n_asks long")
        asks = cells.select(*GROUP, F.col("shard").alias("a"), F.lit(-1).alias("b"), "n", F.xxhash64(*GROUP, "shard").bitwiseAND(F.lit(2**62 - 1)).alias("h"))
        out = _granted(shelf, asks, limits).where("grant > 0").select(*GROUP, F.col("a").alias("shard"), (-F.col("grant")).alias("n"))
        cells = shelf.keep(cells.unionByName(out).groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    room = [capacity[s] - min(load.get(s, (0, 0))[0], capacity[s]) for s in range(shards)]

    ends = cells.withColumn("upto", F.sum("n").over(Window.partitionBy(*GROUP).orderBy("shard")))
    ends = shelf.keep(ends.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("ends")))
    known = ranked(shelf, linked, GROUP, F.col("members"), "rank").join(broadcast_if_small(ends), GROUP, "left")
    after = F.filter("ends", lambda e: e["upto"] > F.col("rank"))
    rows = ["doc_id", "size", "text_crc32", "h"]
    known = shelf.keep(known.select(*rows, F.get(after, F.lit(0))["shard"].alias("shard")))

    spare = base.join(broadcast_if_small(groups), GROUP, "left_anti").select(*rows).unionByName(known.where("shard is null").select(*rows))
    spare = ranked(shelf, spare, [], F.lit(max(1, sum(room))), "rank")
    bounds = [sum(room[: s + 1]) for s in range(shards)]
    place = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        place = F.when(F.col("rank") < bounds[s], F.lit(s)).otherwise(place)
    placed = known.where("shard is not null").unionByName(spare.select(*rows, place.cast("int").alias("shard")))
    # fillers of a shard are neighbours by h, so slots go by another hash
    placed = placed.withColumn("h", F.xxhash64("h").bitwiseAND(F.lit(2**62 - 1)))
    placed = ranked(shelf, placed, ["shard"], F.lit(max(1, total // shards)), "slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
