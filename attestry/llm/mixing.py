"""Mixing sources to target weights by capped water-filling.

Each source gets a share of all words by weight. A source's target stops at ``max_epochs`` times
its own words; what it cannot take goes to the others by weight until none is above. In order of
cap / weight the clamped sources are a prefix, so the level is found by running sums over one row per
source. A document is then taken ``floor(target / words)`` times, and the fraction that is left
is filled with whole documents in the order of a seeded hash, each if it still fits. So what is
missing at the end is less than the smallest document that was not filled in.

A pass takes the documents that fit one after the other, up to the first that does not; the next pass
leaves out all that are larger than what is left, and so on until nothing fits. This takes the same
documents as one walk along the hash would. The running sum of a pass is made in hash ranges: sums of
ranges first, single rows only in the range where the target is reached, so a hot source is never in one
task. The targets are computed in one task with one row for each source.

Null texts have size 0; documents of size 0 always fit. Null is the last source, repeated rows are rows of
their own. A source without words has target 0. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import WORD, Shelf, counted_broadcast, identity


def sized(docs: DataFrame, seed: int) -> DataFrame:
    text = F.col("text").cast("string")
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 15), 16, 10).cast("long")
    key, tie = identity()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), tie.alias("tie"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("h"),
    ).withColumn("part", F.shiftright("h", 48))


def targets(sizes: DataFrame, weights: list[int], max_epochs: int) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int")).cast("long")
    filled = sizes.select("source", "source_size", share.alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    filled = filled.withColumn("total", F.sum("source_size").over(whole))
    room = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    filled = filled.withColumn("clamped", F.col("cap") * F.sum("weight").over(after) <= F.col("weight") * room)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(whole), F.lit(0))
    open_weight = F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(whole)
    level = (F.col("weight") * left).cast("double") / open_weight
    return filled.select("source", "source_size", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def _beside(df: DataFrame, by_source: DataFrame, how: str = "left") -> DataFrame:
    """``df`` with the columns of a table that has one row for each source."""
    names = [c for c in by_source.columns if c != "source"]
    right = counted_broadcast(by_source.withColumnRenamed("source", "of"), 80)
    return df.join(right, F.col("source").eqNullSafe(F.col("of")), how).select(*df.columns, *names)


def _prefix(shelf: Shelf, rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``rows`` (source, part, h, row, size) with ``picked``: in order of ``h``, those before the first that does not fit.

    ``goals``: source, rest, used (words filled in so far).
    """
    ranges = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = _beside(ranges.withColumn("ahead", F.coalesce(ahead, F.lit(0))), goals)
    cut = shelf.keep(
        starts.where("used + ahead <= rest").groupBy("source").agg(F.max("part").alias("cut_part"), (F.max("used") + F.max("ahead")).alias("before"))
    )
    placed = _beside(_beside(rows, goals.select("source", "rest")), cut)
    upto = Window.partitionBy("source").orderBy("h", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed.where(F.col("part") == F.col("cut_part")).withColumn("picked", F.col("before") + F.sum("size").over(upto) <= F.col("rest"))
    sure = placed.where(~F.col("part").eqNullSafe(F.col("cut_part"))).withColumn("picked", F.col("part") < F.coalesce("cut_part", F.lit(-1)))
    return edge.unionByName(sure).select(*rows.columns, "picked")


def mix(docs: DataFrame, weights: list[int] = [1, 2, 3], max_epochs: int = 3, seed: int = 5) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, times, key, tie)``: ``times`` copies and ``taken`` words of each document."""
    shelf = Shelf(docs.sparkSession, "mixing")
    rows = shelf.keep(sized(docs, seed).withColumn("row", F.monotonically_increasing_id()))
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = shelf.keep(
        goals.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    state = goals.select("source", "rest", F.lit(0).cast("long").alias("used"))
    left, filled = rows.where("size > 0").select("source", "part", "h", "row", "size"), None
    while True:
        fitting = _beside(left, state, "inner").where("used + size <= rest").select(*left.columns)
        tried = shelf.keep(_prefix(shelf, fitting, state))
        if not tried.limit(1).count():
            break
        took = tried.where("picked").groupBy("source").agg(F.sum("size").alias("took"))
        state = shelf.keep(_beside(state, took).select("source", "rest", (F.col("used") + F.coalesce("took", F.lit(0))).alias("used")))
        filled = tried.where("picked").select("row") if filled is None else filled.unionByName(tried.where("picked").select("row"))
        left = tried.where("not picked").drop("picked")
    named = _beside(rows, goals.select("source", "source_size", "target", "whole"))
    if filled is None:
        named = named.withColumn("fits", F.lit(False))
    else:
        named = named.join(counted_broadcast(filled.withColumn("fits", F.lit(True)), 24), "row", "left")
    times = F.col("whole") + (F.coalesce("fits", F.lit(False)) | (F.col("size") == 0)).cast("long")
    return named.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"), "key", "tie")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('5:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM s),
c AS (SELECT *, cap * open_weight <= weight * (total - spent) AS clamped FROM o),
t AS (
  SELECT source, source_size,
         CASE WHEN clamped THEN CAST(cap AS DOUBLE)
              ELSE CAST(weight * (total - coalesce(sum(CASE WHEN clamped THEN cap END) OVER (), 0)) AS DOUBLE) / sum(CASE WHEN NOT clamped THEN weight END) OVER () END AS target
  FROM c),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
         target - (CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END) * source_size AS rest
  FROM t),
line AS (
  SELECT d.doc_id, d.size, g.*, row_number() OVER (PARTITION BY d.source ORDER BY d.h, d.size) AS n
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
walk AS (
  SELECT source, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, false AS fits FROM g
  UNION ALL
  SELECT line.source, line.n, walk.used + CASE WHEN walk.used + line.size <= line.rest THEN line.size ELSE 0 END, walk.used + line.size <= line.rest
  FROM walk JOIN line ON line.source IS NOT DISTINCT FROM walk.source AND line.n = walk.n + 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (whole + CASE WHEN fits THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM line JOIN walk ON line.source IS NOT DISTINCT FROM walk.source AND line.n = walk.n
"""
