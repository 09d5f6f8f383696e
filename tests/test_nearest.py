"""The k nearest targets against brute force: clusters, outliers, repeated spots, points far off, groups of all sizes."""

import random

import pytest

from framelake.operators import nearest


def brute(points, targets, k, squared):
    out = []
    for g, i, x, y in points:
        if x is None:
            continue
        near = sorted((((x - u) * (x - u) + (y - v) * (y - v)) ** (1 if squared else 0.5), m) for h, m, u, v in targets if h == g and u is not None)
        out += [(g, i, m, rn) for rn, (_, m) in enumerate(near[:k], 1)]
    return sorted(out)


def scene(seed):
    draw = random.Random(seed)
    targets = [("flat", m, draw.uniform(0, 100), draw.uniform(0, 100)) for m in range(400)]
    targets += [("cluster", m, draw.gauss(5, 0.01), draw.gauss(5, 0.01)) for m in range(300)] + [("cluster", 900, 1e6, -1e6), ("cluster", 901, None, 1.0)]
    targets += [("spot", m, 1.0, 2.0) for m in range(200)] + [("line", m, float(m % 97), 3.0) for m in range(150)] + [("few", m, float(m), 0.0) for m in range(3)]
    points = [(g, i, draw.uniform(-20, 120), draw.uniform(-20, 120)) for g in ("flat", "cluster", "spot", "line", "few", "none") for i in range(40)]
    points += [("cluster", 100 + i, draw.gauss(5, 0.01), draw.gauss(5, 0.01)) for i in range(40)] + [("flat", 100, 1e9, 1e9), ("flat", 101, None, 1.0), ("flat", 102, 50.0, 50.0)]
    return points, targets


@pytest.mark.parametrize("k,squared", [(1, True), (5, False)])
def test_nearest_are_those_of_brute_force(spark, k, squared):
    points, targets = scene(k)
    p = spark.createDataFrame(points, "pair string, pt int, x double, y double").repartition(3)
    t = spark.createDataFrame([(*r, "carried") for r in targets], "pair string, m int, tx double, ty double, n string").withColumnRenamed("n", "note").repartition(3)
    got = nearest.nearest_k(p, t, k, squared=squared)
    assert sorted((r.pair, r.pt, r.m, r.rn) for r in got.collect()) == brute(points, targets, k, squared)
    assert {r.note for r in got.select("note").distinct().collect()} == {"carried"}


def test_work_grows_with_points_and_not_with_targets(spark, monkeypatch):
    met = []
    ranked = nearest._ranked
    monkeypatch.setattr(nearest, "_ranked", lambda df, *a: met.append(df.count()) or ranked(df, *a))
    for n in (2_000, 8_000):
        t = spark.range(n).selectExpr("0 AS pair", "id AS m", "rand(1) * 100 AS tx", "rand(2) * 100 AS ty")
        p = spark.range(500).selectExpr("0 AS pair", "id AS pt", "rand(3) * 100 AS x", "rand(4) * 100 AS y")
        met.clear()
        assert nearest.nearest_k(p, t, 4).count() == 2_000
        assert sum(met) < 500 * 4 * 60


def test_empty_sides(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0)], "pair int, pt int, x double, y double")
    t = spark.createDataFrame([(1, 1, 0.0, 0.0)], "pair int, m int, tx double, ty double")
    assert nearest.nearest_k(p.limit(0), t, 2).count() == 0 and nearest.nearest_k(p, t.limit(0), 2).count() == 0
