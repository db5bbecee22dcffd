"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code (the signs of an embedding) is cut into segments of at least log2(rows) bits (16 at most), and every
segment has an index. Round ``r`` probes all segment values at distance ``r`` from the query's. After
it, every code within ``segments * (r + 1) - 1`` has been seen, since a nearer code has some
segment within ``r``; a query is done when its k-th verified distance is inside that bound,
so results are exact and the radius grows only for the queries that need it.

Equal codes are one index entry with their first ids, and equal queries are searched once, so a
hot vector costs one entry. Ties go to the smaller id; a row is not its own neighbour. Rows
without id, or whose embedding is null or not 64 numbers long, have no code: they are neither found nor
asked. A repeated id is one row per code. With fewer than k other rows all of them are returned.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import Shelf
from attestry.session import broadcast_if_small

BITS = 64


def code(embedding: Column) -> Column:
    """Bit i is set when the i-th number is above 0; null unless there are 64 numbers."""
    signs = F.transform(embedding, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(embedding) == BITS, F.aggregate(signs, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))


def cuts(rows: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment; at least log2(rows) bits, so a bucket has about one code, and 16 at most."""
    parts = min(BITS, max(4, int(BITS / max(1.0, math.log2(max(2, rows))))))
    edges = [round(i * BITS / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _values(column: str, segments: list[tuple[int, int]]) -> Column:
    return F.array(*[
        F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned(F.col(column), first).bitwiseAND(F.lit((1 << bits) - 1)).alias("value"))
        for s, (first, bits) in enumerate(segments)
    ])


def _masks(bits: int, radius: int) -> Column:
    """All values of ``bits`` bits with ``radius`` of them set, as one constant array."""
    text = ",".join(str(sum(1 << i for i in c)) for c in combinations(range(bits), radius))
    return F.split(F.lit(text), ",").cast("array<bigint>")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(vec_id, rank, neighbour_id, distance)`` of the k nearest ``vectors`` of each of ``queries`` (both ``vec_id, embedding``)."""
    shelf = Shelf(vectors.sparkSession, "hamming")
    need = k + 1  # a row may find itself

    def coded(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), code(F.col("embedding")).alias("code")).where("vec_id is not null and code is not null").distinct()

    first = Window.partitionBy("code").orderBy("vec_id")
    entries = coded(vectors).withColumn("n", F.row_number().over(first)).where(F.col("n") <= need)
    entries = shelf.keep(entries.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = shelf.keep(coded(queries))
    segments = cuts(entries.count())
    index = shelf.keep(
        entries.select("code", F.col("ids")[0].alias("lead"), F.size("ids").alias("n_ids"), F.explode(_values("code", segments)).alias("s"))
        .select("code", "lead", "n_ids", "s.segment", "s.value")
    )
    active = shelf.keep(asked.select(F.col("code").alias("q")).distinct())
    best = active.select("q", F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("lead"), F.lit(0).alias("n_ids"), F.lit(0).alias("distance")).limit(0)
    done = None
    longest = max(bits for _, bits in segments)
    for radius in range(longest + 1):
        masks = F.lit(None).cast("array<bigint>")
        for s, (_, bits) in enumerate(segments):
            if radius <= bits:
                masks = F.when(F.col("s.segment") == s, _masks(bits, radius)).otherwise(masks)
        probes = active.select("q", F.explode(_values("q", segments)).alias("s"))
        probes = probes.select("q", "s.segment", F.explode(masks).alias("mask"), F.col("s.value").alias("base"))
        probes = probes.select("q", "segment", F.col("base").bitwiseXOR(F.col("mask")).alias("value"))
        seen = probes.join(broadcast_if_small(index), ["segment", "value"])
        seen = seen.select("q", "code", "lead", "n_ids", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance"))
        pool = seen.unionByName(best).groupBy("q", "code").agg(F.first("lead").alias("lead"), F.first("n_ids").alias("n_ids"), F.first("distance").alias("distance"))
        by_distance = Window.partitionBy("q").orderBy("distance", "lead")
        kept = shelf.keep(pool.withColumn("place", F.row_number().over(by_distance)).where(F.col("place") <= need).drop("place"))
        covered = len(segments) * (radius + 1) - 1 if radius < longest else BITS
        upto = kept.withColumn("upto", F.sum("n_ids").over(by_distance)).groupBy("q").agg(
            F.min(F.when(F.col("upto") >= need, F.col("distance"))).alias("kth")
        )
        state = shelf.keep(active.join(upto, "q", "left").select("q", (F.col("kth") <= covered).alias("ok")))
        finished = kept.join(state.where("ok" if radius < longest else "true").select("q"), "q")
        done = finished if done is None else done.unionByName(finished)
        active = state.where("ok is null or not ok").select("q")
        if radius == longest or not active.limit(1).count():
            break
        best = kept.join(active, "q").select(best.columns)
    found = done.join(entries, "code").select(F.col("q").alias("code"), "distance", F.explode("ids").alias("neighbour_id"))
    found = shelf.keep(found.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("distance", "neighbour_id"))).where(F.col("n") <= need).drop("n"))
    lists = asked.join(found, "code").where("neighbour_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "neighbour_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour_id", "distance")


SQL = r"""
WITH c AS (
  SELECT vec_id, list_sum([CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END FOR i IN range(1, 65)]) AS code
  FROM embeddings WHERE len(embedding) = 64),
p AS (
  SELECT a.vec_id, b.vec_id AS neighbour_id, bit_count(xor(CAST(a.code AS UBIGINT), CAST(b.code AS UBIGINT))) AS distance
  FROM c a JOIN c b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS rank FROM p)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour_id, CAST(distance AS INTEGER) AS distance FROM r WHERE rank <= 10
"""
