"""How far the sources of a language differ in their words.

Inside ``mapInArrow`` texts are lower-cased, split, dictionary-encoded and counted by Arrow's own compute
functions: first per document (which gives document frequencies), then per group of language and
source. Partial counts of several batches are folded before they leave the task. Merged counts are dealt by
word, so one exchange yields the counts of a group and the totals of its language together.

Pairs of sources are computed on columnar shards. A shard holds some words of a language and the counts
of two blocks of at most ``BLOCK`` sources, as a dense matrix of a bounded number of words at a time;
it returns one partial sum for each pair of sources. A language with up to ``BLOCK`` sources has one
block, so every count is sent once; with more, once for each pair of blocks, as the result has a row for every pair.

All arithmetic is on integers: ``p`` is reached in three divisions by 1000, exact for groups of
up to 9 * 10^15 words, and a square of a difference stays below 2^60.

Nulls of ``text``, ``lang`` and ``source`` count as ''. Every row is a document of its own, repeated
rows and rows without ``doc_id`` too; other columns are not read. A group without words still takes
part in all pairs of its language; an empty table gives no rows. Texts that are not UTF-8 are refused by Arrow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.llm.common import Shelf, counted_broadcast

GAPS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
DOCUMENTS = 3
TOP = 200
BLOCK = 128
SHARDS = 64
HELD = 600_000
WORDS = 2048  # words of a shard that are laid out at once
COUNTS = ["lang", "source", "word", "n", "docs"]


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """Words of a batch per language and source: occurrences and documents."""
    texts = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), GAPS)
    flat, row = pc.list_flatten(texts), pc.list_parent_indices(texts)
    real = pc.not_equal(flat, "")
    codes = flat.filter(real).dictionary_encode()
    lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
    sources = max(1, len(source.dictionary))
    name = pc.add(pc.multiply(lang.indices.cast(pa.int64()), sources), source.indices.cast(pa.int64()))
    documents = pa.table({"row": row.filter(real), "word": codes.indices}).group_by(["row", "word"]).aggregate([([], "count_all")])
    groups = pa.table({"name": name.take(documents["row"]), "word": documents["word"], "n": documents["count_all"]})
    counts = groups.group_by(["name", "word"]).aggregate([("n", "sum"), ("n", "count")])
    which = pc.divide(counts["name"], sources)
    return pa.table({
        "lang": lang.dictionary.take(which), "source": source.dictionary.take(pc.subtract(counts["name"], pc.multiply(which, sources))),
        "word": codes.dictionary.take(counts["word"]), "n": counts["n_sum"], "docs": counts["n_count"],
    })


def _folded(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by(["lang", "source", "word"]).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.select(["lang", "source", "word", "n_sum", "docs_sum"]).rename_columns(COUNTS)


def _partial(held: int):
    def run(batches):
        tables, rows = [], 0
        for batch in batches:
            tables.append(_counted(batch))
            rows += len(tables[-1])
            if rows > held:
                tables = [_folded(tables)]
                rows = len(tables[0])
                if rows > held // 2:
                    yield from tables[0].to_batches(max_chunksize=50_000)
                    tables, rows = [], 0
        if tables:
            yield from _folded(tables).to_batches(max_chunksize=50_000)

    return run


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def per_billion(n: Column, total: Column) -> Column:
    """``floor(10^9 * n / total)`` of longs, ``n`` at most ``total``."""
    out, rest = F.lit(0).cast("long"), n
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + _div(rest, total), rest % total
    return out


def _per_billion(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    out, rest = np.zeros_like(n), n
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out


class _Cell:
    """A shard of words with the sources of two blocks; sums over its words."""

    def __init__(self, numbers: np.ndarray, totals: np.ndarray, same: bool, block: int, low: int, high: int):
        self.low, self.high, self.block, self.same = low, high, block, same
        rows, columns = numbers // block == low, numbers // block == high
        self.numbers = {True: numbers[rows], False: numbers[columns]}
        self.totals = {True: totals[rows], False: totals[columns]}
        self.sums = np.zeros((rows.sum(), columns.sum()), np.int64)
        self.seen = 0

    def add(self, word: np.ndarray, number: np.ndarray, n: np.ndarray) -> None:
        """``word`` numbers the words of this call from 0; absent sources count 0."""
        count = int(word[-1]) + 1
        self.seen += count
        for start in range(0, count, WORDS):
            mine = (word >= start) & (word < start + WORDS)
            w, g, c = word[mine] - start, number[mine], n[mine]
            p, q = self._matrix(True, w, g, c, min(WORDS, count - start)), None
            q = p if self.same else self._matrix(False, w, g, c, min(WORDS, count - start))
            for j in range(q.shape[1]):
                d = p - q[:, j : j + 1]
                self.sums[:, j] += (d * d // q[:, j : j + 1]).sum(axis=0)

    def _matrix(self, side: bool, word: np.ndarray, number: np.ndarray, n: np.ndarray, count: int) -> np.ndarray:
        numbers, totals = self.numbers[side], self.totals[side]
        out = np.zeros((count, len(numbers)), np.int64)
        mine = number // self.block == (self.low if side else self.high)
        out[word[mine], np.searchsorted(numbers, number[mine])] = n[mine]
        return 1 + _per_billion(out + 1, np.broadcast_to(totals, out.shape))


def _cells(block: int):
    """Rows come ordered by cell, the sources' totals first, then counts by word."""

    def result(at, cell):
        rows, columns = cell.numbers[True], cell.numbers[False]
        a, b = np.repeat(rows, len(columns)), np.tile(columns, len(rows))
        lang, seen = pa.array([at[0]] * len(a), pa.string()), pa.array(np.full(len(a), cell.seen))
        return pa.RecordBatch.from_arrays([lang, pa.array(a), pa.array(b), pa.array(cell.sums.ravel()), seen], ["lang", "a", "b", "part", "seen"])

    def opened(at, head):
        numbers, totals = (np.concatenate(x) for x in zip(*head))
        order = np.argsort(numbers)
        return _Cell(numbers[order], totals[order], at[1] == at[2], block, at[1], at[2])

    def run(batches):
        at, cell, head, rest = None, None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
                rest = None
            lang, low, high = table["lang"].to_pylist(), *(table[c].to_numpy() for c in ("low", "high"))
            shard, number, n = (table[c].to_numpy() for c in ("shard", "number", "n"))
            word = table["word"].combine_chunks().fill_null("").dictionary_encode().indices.to_numpy()
            change = np.ones(len(lang), bool)
            if len(lang) > 1:
                langs = np.array(pc.equal(table["lang"].combine_chunks()[1:], table["lang"].combine_chunks()[:-1]))
                change[1:] = ~langs | (np.diff(low) != 0) | (np.diff(high) != 0) | (np.diff(shard) != 0)
            edges = [*np.flatnonzero(change).tolist(), len(lang)]
            for start, stop in zip(edges, edges[1:]):
                here = (lang[start], int(low[start]), int(high[start]), int(shard[start]))
                if here != at:
                    if at is not None:
                        yield result(at, cell or opened(at, head))
                    at, cell, head = here, None, []
                header = table["word"].slice(start, stop - start).is_null().to_numpy()
                tops = start + np.flatnonzero(header)
                if len(tops):
                    head.append((number[tops], n[tops]))
                body = start + np.flatnonzero(~header)
                if not len(body):
                    continue
                cell = cell or opened(at, head)
                if stop == len(lang):  # the last word may go on in the next batch
                    last = body[word[body] == word[body[-1]]]
                    rest, body = table.slice(last[0]), body[: len(body) - len(last)]
                if len(body):
                    fresh = np.concatenate([[0], np.cumsum(np.diff(word[body]) != 0)])
                    cell.add(fresh, number[body], n[body])
        if rest is not None:
            word = rest["word"].combine_chunks().dictionary_encode().indices.to_numpy()
            cell.add(np.zeros(len(word), np.int64), rest["number"].to_numpy(), rest["n"].to_numpy())
        if at is not None:
            yield result(at, cell or opened(at, head))

    return run


def word_counts(docs: DataFrame, documents: int = DOCUMENTS, held: int = HELD) -> DataFrame:
    """``(lang, source, word, n, lang_n, lead)`` of the words in at least ``documents`` documents of their language.

    ``lang_n`` counts the word in its language; ``lead`` marks one row of each word.
    """
    parts = _filled(docs, "text").mapInArrow(_partial(held), "lang string, source string, word string, n long, docs long")
    one = W.partitionBy("lang", "word")
    return (
        parts.repartition("lang", "word").groupBy("lang", "word", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("lang_docs", F.sum("docs").over(one)).where(F.col("lang_docs") >= documents)
        .select("lang", "source", "word", "n", F.sum("n").over(one).alias("lang_n"), (F.min("source").over(one) == F.col("source")).alias("lead"))
    )


def _filled(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", *more)])


def _values(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def pair_values(groups: DataFrame, counts: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """``(lang, source, item, value)`` for every two sources of a language.

    ``groups``: lang, source, number (0, 1, ... in the language), group_n, kinds.
    """
    last = F.max("number").over(W.partitionBy("lang"))
    held = groups.withColumn("blocks", _div(last, F.lit(block)).cast("int"))
    named = counted_broadcast(held.select("lang", "source", "number", "blocks"), 80)
    mine = _div(F.col("number"), F.lit(block)).cast("int")

    def cells(df: DataFrame) -> DataFrame:
        """Each row in the cells whose row block or column block is its own."""
        other = df.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks"))))
        rows = other.withColumn("low", F.col("mine")).withColumn("high", F.col("other"))
        columns = other.where("other <> mine").withColumn("low", F.col("other")).withColumn("high", F.col("mine"))
        return rows.unionByName(columns).select("lang", "low", "high", "shard", "word", "number", "n")

    shard = F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int")
    body = cells(counts.join(named, ["lang", "source"]).withColumn("shard", shard))
    tops = cells(
        held.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("word", F.lit(None).cast("string"))
        .withColumn("n", F.col("group_n") + F.col("kinds"))
    )
    at = ["lang", "low", "high", "shard"]
    dealt = tops.unionByName(body).repartition(*at).sortWithinPartitions(*at, F.asc_nulls_first("word"))
    sums = (
        dealt.mapInArrow(_cells(block), "lang string, a long, b long, part long, seen long").where("a <> b")
        .groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    )
    total = F.col("group_n") + F.col("kinds")
    whole = counted_broadcast(groups.withColumn("never", F.when(total > 0, per_billion(F.lit(1).cast("long"), total) + 1)), 100)
    return sums.join(
        whole.select("lang", F.col("number").alias("a"), "source", "kinds", F.col("never").alias("p")), ["lang", "a"]
    ).join(
        whole.select("lang", F.col("number").alias("b"), F.col("source").alias("item"), F.col("never").alias("q")), ["lang", "b"]
    ).select(
        "lang", "source", "item",
        (F.col("part") + F.coalesce((F.col("kinds") - F.col("seen")) * _values(F.col("p"), F.col("q")), F.lit(0))).alias("value"),
    )


def divergences(docs: DataFrame, documents: int = DOCUMENTS, top: int = TOP, block: int = BLOCK, shards: int = SHARDS, held: int = HELD) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: each source against the others of its language, and its telling words.

    ``pair`` rows hold the divergence of a source from each other one, ``term`` rows the ``top``
    words that the source has more often than its language. Ranks break ties by item.
    """
    shelf = Shelf(docs.sparkSession, "divergence")
    counts = shelf.keep(word_counts(docs, documents, held))
    kinds = counts.where("lead").groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("lang_n").alias("lang_total"))
    named = _filled(docs).distinct().join(counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(kinds, "lang", "left")
    groups = shelf.keep(
        named.fillna(0, ["group_n", "kinds", "lang_total"])
        .withColumn("number", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long"))
    )
    own = counts.join(counted_broadcast(groups, 100), ["lang", "source"])
    p = per_billion(F.col("n") + 1, F.col("group_n") + F.col("kinds")) + 1
    q = per_billion(F.col("lang_n") + 1, F.col("lang_total") + F.col("kinds")) + 1
    terms = own.select("lang", "source", F.col("word").alias("item"), p.alias("p"), q.alias("q")).where("p > q").withColumn("value", _values(F.col("p"), F.col("q")))
    pairs = pair_values(groups, counts.select("lang", "source", "word", "n"), block, shards)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    every = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return every.select(columns).unionByName(best.select(columns))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM d
), kept AS (
  SELECT lang, word, count(*) AS n FROM w GROUP BY lang, word HAVING count(DISTINCT row) >= 3
), size AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT w.lang, w.source, w.word, count(*) AS n FROM w JOIN kept USING (lang, word) GROUP BY ALL
), t AS (
  SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.word, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.n, 0) + s.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (s.n + s.v) AS q
  FROM g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.word = k.word
  LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.word = b.word AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, word AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms QUALIFY rank <= 200
"""
