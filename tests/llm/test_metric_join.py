"""Embedding near duplicates against brute force, on clustered and hostile vectors."""

import collections
import math
import random

import pytest

from attestry.llm import metric_join

SCHEMA = "vec_id long, embedding array<double>, label string, node long, cell string, links int, n int, key string"


def spread(rng, centre, by):
    return [c + rng.gauss(0, by) for c in centre]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for label in ("a", "b"):
        for _ in range(12):
            centre = [rng.gauss(0, 1) for _ in range(6)]
            out += [(spread(rng, centre, rng.choice([0.02, 0.15, 0.4])), label) for _ in range(12)]
    out += [(out[0][0], "a")] * 30 + [(out[0][0], "b"), ([2 * x for x in out[0][0]], "a")]
    out += [(None, "a"), ([], "a"), ([0.0] * 6, "a"), ([0.0] * 6, "a"), ([1.0, None], "a"), ([float("nan")] * 6, "a"), ([float("inf")] + [1.0] * 5, "a")]
    out += [(out[0][0], None), (out[0][0], None), ([1.0], "a"), ([3.0], "a"), ([1e-300] * 6, "a"), ([1e200] * 6, "a")]
    out = [(i * 2, *r) for i, r in enumerate(out)]
    return out + [out[3], out[3], (5, out[3][1], "a"), (5, out[200][1], "b"), (None, out[3][1], "a"), (None, [-x for x in out[9][1]], "a"), (None, None, "a")]


def expected(rows, least):
    key = {}
    for at, (i, v, label) in enumerate(rows):
        good = v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if good:
            m = max(map(abs, v))
            w = [x / m for x in v]
            d = math.sqrt(sum(x * x for x in w))
            key[at] = (i if i is not None else ("none", tuple(v)), label, tuple(v), [x / d for x in w])
    items = {k[:3]: k[3] for k in key.values()}
    links, up = collections.Counter(), {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    names = list(items)
    for a in range(len(names)):
        for b in range(a):
            x, y = names[a], names[b]
            if x[1] == y[1] and len(x[2]) == len(y[2]) and sum(p * q for p, q in zip(items[x], items[y])) >= least:
                links[x] += 1
                links[y] += 1
                s, t = sorted((top(x[0]), top(y[0])), key=lambda k: (isinstance(k, tuple), k))
                if s != t:
                    up[t] = s
    out = []
    for at, (i, v, label) in enumerate(rows):
        one = key.get(at)
        root = top(one[0]) if one else i
        root = top(i) if i is not None else root
        root = None if isinstance(root, tuple) else root
        out.append((i, links[one[:3]] if one else 0, root, root is not None and root == i or i is None and root is None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("full", "fan", "least"), [(4096, 8, 0.93), (8, 3, 0.5)])
def test_matches_brute_force(spark, rows, full, fan, least):
    got = metric_join.near_vectors(spark.createDataFrame([(*r, 1, "x", 2, 3, "k") for r in rows], SCHEMA), least, full, fan).collect()
    assert sorted([tuple(r) for r in got], key=repr) == expected(rows, least)


def test_no_rows(spark):
    assert metric_join.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cells_leave_out_what_the_bounds_exclude(spark):
    rng = random.Random(8)
    points = []
    for i in range(400):
        centre = [0.0] * 8
        centre[i % 8] = 1.0
        points.append((i, spread(rng, centre, 0.02), "a"))
    shelf = metric_join.Shelf(spark, "test")
    df = spark.createDataFrame([(i, 1, 0, v) for i, v, _ in points], "node long, n long, cell long, v array<double>").selectExpr("*", "false AS guest")
    unit = df.select("node", "n", "cell", df.v.alias("embedding")).mapInArrow(metric_join._unit, "node long, n long, cell long, v array<double>").selectExpr("*", "false AS guest")
    ready, known = metric_join.cells(shelf, unit, math.sqrt(2 - 2 * 0.93), 60, 8)
    assert known.groupBy().sum("own").collect()[0][0] == 400
    assert ready.count() < 400 * 2
