"""Near duplicates among vectors by an exact metric range join.

Vectors of one label are points of the unit sphere; a cosine of at least ``least`` is a distance of
at most ``r``. Pivots split a cell: each point belongs to the cell of its nearest pivot and is
a guest of every other cell that a point within ``r`` of it may belong to. The triangle inequality
bounds that by the radius of the other cell, and the distance to the plane between both pivots by the
choice of the nearest pivot. Every cell is split once, and again while it has more than ``full`` points of
its own and splitting helps. Then cells join independently: own points against own points and guests.

Equal vectors of a label are folded first. A cell that pivots cannot thin out is joined in stretches
of at most ``full`` own points, each against all of the cell, so a task holds ``full`` points and one
batch whatever the cell. Links are counted where a point belongs, and leave the task as a forest that
connects the same points, never as pairs. Distances only choose candidates; a link is decided by
the cosine in double precision. Vectors of high dimension that lie far apart in all directions are guests of most cells: there the
bounds exclude little and the work nears that of comparing all.

Null labels and vectors that are null, empty, zero, or hold a null or non-finite component link with nothing;
so do vectors of different lengths. Rows that repeat id, label and vector are one vector (each gets its row);
rows of one ``vec_id`` with different vectors are one node. Rows without ``vec_id`` are nodes by their vector
and come last; a group of only such rows has no ``component_id`` and its rows are kept. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import NO_ID, Shelf, components, counted_broadcast

LEAST = 0.93
FULL = 4096
FAN = 8
SAMPLE = 16  # points of a cell among which each pivot is chosen
STRETCH = 512  # right points compared at once
SLACK = 1e-9  # of distances, against rounding
CELL = ["cell", "part"]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _leading(batches, left_done, right):
    """Feed a partition ordered by cell, part and side: ``left_done(rows)`` gets the rows of side 0, ``right(state, rows)`` the others."""
    at, held, state = None, [], None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        cell, part, side = (table[c].to_numpy() for c in (*CELL, "side"))
        edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)) + 1
        for start, stop in zip([0, *edges], [*edges, len(table)]):
            here = (cell[start], part[start])
            if here != at:
                if state is not None:
                    yield from state.close()
                at, held, state = here, [], None
            rows = table.slice(start, stop - start)
            if side[start] == 0:
                held.append(rows)
            elif held or state is not None:
                if state is None:
                    state, held = left_done(pa.concat_tables(held)), []
                yield from right(state, rows)
    if state is not None:
        yield from state.close()


class _Pivots:
    def __init__(self, rows: pa.Table, r: float, fan: int):
        """Of the sampled points, each time the one farthest from the pivots so far."""
        x = _matrix(rows.sort_by("node")["v"])
        picked, gap = [0], 2 - 2 * x @ x[0]
        while len(picked) < fan and gap.max() > SLACK:
            picked.append(int(gap.argmax()))
            gap = np.minimum(gap, 2 - 2 * x @ x[picked[-1]])
        self.at = x[picked]
        self.between = np.sqrt(np.maximum(0, 2 - 2 * self.at @ self.at.T))
        self.r = r

    def close(self):
        return ()

    def split(self, rows: pa.Table):
        """Per point its home, and all cells (home first) that the planes between pivots leave, with distances."""
        x = _matrix(rows["v"])
        square = np.maximum(0, 2 - 2 * x @ self.at.T)
        home = square.argmin(axis=1)
        gap = square - square[np.arange(len(x)), home][:, None]
        reach = gap <= 2 * (self.r + SLACK) * self.between[home] + SLACK
        reach[np.arange(len(x)), home] = True
        row, to = np.nonzero(reach)
        # a point that is itself a guest has no home among the new cells
        guest = rows["guest"].to_numpy(zero_copy_only=False)[row] | (home[row] != to)
        took = rows.take(pa.array(row))
        yield pa.RecordBatch.from_arrays(
            [*(took[c].combine_chunks() for c in ("cell", "node", "n", "v")), pa.array(to.astype(np.int32)), pa.array(guest), pa.array(np.sqrt(square[row, to]))],
            ["cell", "node", "n", "v", "to", "guest", "d"],
        )


class _Own:
    """Own points of a cell; links to all points of the cell that pass by."""

    def __init__(self, rows: pa.Table, least: float):
        self.node, self.x, self.least = rows["node"].to_numpy(), _matrix(rows["v"]), least
        self.root = np.arange(len(self.node))
        self.links = np.zeros(len(self.node), np.int64)
        self.others: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(self, rows: pa.Table):
        y, node, n = _matrix(rows["v"]), rows["node"].to_numpy(), rows["n"].to_numpy()
        for start in range(0, len(node), STRETCH):
            to, own = np.nonzero(self.x @ y[start : start + STRETCH].T >= self.least)[::-1]
            if not len(to):
                continue
            order = np.argsort(to, kind="stable")
            to, own = to[order], own[order]
            np.add.at(self.links, own, n[start + to])
            first = np.flatnonzero(np.concatenate([[True], np.diff(to) != 0]))
            self.others.append((self.node[own[first]], node[start + to[first]]))
            while True:
                roots = self.root[own]
                low, high = np.minimum.reduceat(roots, first), np.maximum.reduceat(roots, first)
                if (low == high).all():
                    break
                self._unite(np.unique(np.stack([low, high], axis=1)[low != high], axis=0))
        if sum(len(a) for a, _ in self.others) > 50_000:
            yield from self._forest()

    def _unite(self, pairs: np.ndarray) -> None:
        up: dict[int, int] = {}

        def top(i: int) -> int:
            while i in up:
                i = up[i]
            return i

        for a, b in pairs.tolist():
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        new = np.arange(len(self.root))
        for i in up:
            new[i] = top(i)
        self.root = new[self.root]

    def _rows(self, node, other, links):
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(links, pa.int64())], ["node", "other", "links"])

    def _forest(self):
        if self.others:
            a, b = (np.concatenate(x) for x in zip(*self.others))
            self.others = []
            far = a != b
            yield from self._rows(a[far], b[far], np.zeros(far.sum(), np.int64))

    def close(self):
        yield from self._forest()
        yield from self._rows(self.node, self.node[self.root], self.links)


def _split(r: float, fan: int):
    return lambda batches: _leading(batches, lambda rows: _Pivots(rows, r, fan), lambda state, rows: state.split(rows))


def _join(least: float):
    return lambda batches: _leading(batches, lambda rows: _Own(rows, least), lambda state, rows: state.meet(rows))


def _unit(batches):
    for batch in batches:
        rows = []
        for v in batch.column("embedding"):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = x / np.abs(x).max()
            rows.append((x / math.sqrt(x @ x)).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), batch.column("cell"), pa.array(rows, pa.list_(pa.float64()))], ["node", "n", "cell", "v"])


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition(*CELL).sortWithinPartitions(*CELL, "side")


def cells(shelf: Shelf, points: DataFrame, r: float, full: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """``points`` (cell, node, n, v, guest) cut into cells, and ``(cell, own)``: their numbers of own points."""
    sizes = shelf.keep(points.groupBy("cell").agg(F.count("*").alias("own")))
    todo, done, first = sizes.where("own > 1"), sizes.where("own <= 1"), True
    level, ready, known = points, None, None
    while True:
        if not first:
            kept = level.join(counted_broadcast(done.select("cell"), 16), "cell")
            ready, known = (kept, done) if ready is None else (ready.unionByName(kept), known.unionByName(done))
        if not todo.limit(1).count():
            break
        mine = level.join(counted_broadcast(todo, 24), "cell")
        picked = (
            mine.where("not guest").withColumn("place", F.expr("row_number() OVER (PARTITION BY cell ORDER BY xxhash64(node), node)"))
            .where(F.col("place") <= SAMPLE * fan)
        )
        parts = F.greatest(F.lit(1), F.ceil(F.col("own") * 4 / full)).cast("int")
        heads = picked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("side", F.lit(0))
        tails = mine.withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")).withColumn("side", F.lit(1))
        columns = [*CELL, "side", "node", "n", "v", "guest"]
        split = shelf.keep(
            _dealt(heads.select(columns).unionByName(tails.select(columns)))
            .mapInArrow(_split(r, fan), "cell long, node long, n long, v array<double>, to int, guest boolean, d double")
        )
        radii = shelf.keep(
            split.where("not guest").groupBy("cell", "to").agg(F.max("d").alias("radius"), F.count("*").alias("own"))
            .join(todo.withColumnRenamed("own", "before"), "cell")
        )
        inner = F.xxhash64("cell", "to")
        level = shelf.keep(
            split.join(counted_broadcast(radii, 48), ["cell", "to"]).where(F.col("d") <= F.col("radius") + r + SLACK)
            .select(inner.alias("cell"), "node", "n", "v", "guest")
        )
        shelf.drop(split)
        sizes = radii.select(inner.alias("cell"), "own", "before")
        again = (F.col("own") > full) & (F.col("own") * 10 <= F.col("before") * 9)
        todo, done, first = sizes.where(again).select("cell", "own"), sizes.where(~again).select("cell", "own"), False
    return ready, known


def links(shelf: Shelf, points: DataFrame, least: float, full: int, fan: int) -> DataFrame:
    """``(node, other, links)``: rows with their count of linked vectors, and a forest over linked nodes."""
    r = math.sqrt(2 - 2 * least)
    ready, known = cells(shelf, points, r, full, fan)
    if ready is None:
        return points.select("node", F.col("node").alias("other"), F.col("n").alias("links"))
    parts = F.ceil(F.col("own") / full).cast("int")
    held = ready.join(counted_broadcast(known, 24), "cell")
    part = F.when(F.col("own") > full, F.pmod(F.xxhash64("node", F.lit(11)), parts)).otherwise(0).cast("int")
    own = held.where("not guest").withColumn("part", part).withColumn("side", F.lit(0))
    each = held.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("side", F.lit(1))
    columns = [*CELL, "side", "node", "n", "v"]
    return shelf.keep(_dealt(own.select(columns).unionByName(each.select(columns))).mapInArrow(_join(least), "node long, other long, links long"))


def near_vectors(vectors: DataFrame, least: float = LEAST, full: int = FULL, fan: int = FAN) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row of ``vectors`` (vec_id, embedding, label)."""
    shelf = Shelf(vectors.sparkSession, "metric")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    size = F.size("embedding")
    sound = F.col("label").isNotNull() & F.coalesce(
        (size > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    number = F.xxhash64("label", "embedding").bitwiseAND(F.lit(2**61 - 1)) + F.lit(NO_ID)
    marked = shelf.keep(rows.withColumn("sound", sound).withColumn("key", F.coalesce("vec_id", number)))
    fold = ["label", "embedding"]
    once = marked.where("sound").select(*fold, "key").distinct()
    classes = shelf.keep(
        once.groupBy(*fold).agg(F.count("*").alias("n"))
        .select(*fold, "n", F.monotonically_increasing_id().alias("node"), F.xxhash64("label", F.size("embedding")).alias("cell"))
    )
    points = shelf.keep(
        classes.select("node", "n", "cell", "embedding").mapInArrow(_unit, "node long, n long, cell long, v array<double>").withColumn("guest", F.lit(False))
    )
    found = links(shelf, points, least, full, fan)
    counted = shelf.keep(found.groupBy("node").agg(F.sum("links").alias("links")))
    named = shelf.keep(classes.select("node", *fold).join(counted, "node"))
    members = shelf.keep(marked.where("sound").select("key", *fold).distinct().join(classes.select(*fold, "node"), fold).select("key", "node"))
    joint = found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    groups = components(shelf, joint)
    placed = shelf.keep(members.join(groups, "node", "left").select("key", F.coalesce("component", "node").alias("group")))
    shared = placed.groupBy("group").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    ids = components(shelf, shelf.keep(placed.join(shared, "group").select(F.col("key").alias("a"), F.col("low").alias("b"))))
    out = (
        marked.join(named.select(*fold, "links").withColumn("sound", F.lit(True)), [*fold, "sound"], "left")
        .join(ids.withColumnRenamed("node", "key"), "key", "left")
    )
    component = F.coalesce("component", "key")
    component = F.when(component < NO_ID, component)
    return out.select(
        "vec_id", F.coalesce(F.col("links") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b
), low AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT v.vec_id, (SELECT count(*) FROM linked l WHERE l.a = v.vec_id) AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low ON low.a = v.vec_id
"""
