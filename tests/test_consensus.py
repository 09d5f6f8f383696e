"""Consensus fits against a plain twin, and full Fréchet distances by blocks."""

import hashlib
import math
import random

import numpy as np
import pytest

from framelake.operators import consensus, metrics

SCHEMA = "pair long, m int, x0 double, y0 double, x1 double, y1 double"


def twin(pair, rows, thresh, draws):
    """The most matches that one draw's matrix carries, match after match."""
    rows, best = sorted(rows), []
    for d in range(draws):
        digest = hashlib.md5(f"{pair}|{d}".encode()).hexdigest()
        at = [int(digest[8 * i: 8 * i + 8], 16) % len(rows) for i in range(4)]
        if len(set(at)) < 4:
            continue
        p, q = (np.array([rows[i][a: a + 2] for i in at]) for a in (1, 3))
        areas = [[abs(np.linalg.det(np.c_[z[list(t)], np.ones(3)])) for t in ((3, 1, 2), (0, 3, 2), (0, 1, 3), (0, 1, 2))] for z in (p, q)]
        if any(min(a) <= 1e-3 * max(a) for a in areas):
            continue
        system = [[x, y, 1, 0, 0, 0, -u * x, -u * y] for (x, y), (u, v) in zip(p, q)] + [[0, 0, 0, x, y, 1, -v * x, -v * y] for (x, y), (u, v) in zip(p, q)]
        h = np.append(np.linalg.solve(np.array(system), np.r_[q[:, 0], q[:, 1]]), 1).reshape(3, 3)
        z = np.array([h @ (r[1], r[2], 1) for r in rows])
        near = [r[0] for r, (a, b, c) in zip(rows, z) if math.hypot(a / c - r[3], b / c - r[4]) <= thresh]
        best = near if len(near) > len(best) else best
    return best


def test_agreeing_matches_are_those_of_a_plain_twin(spark):
    draw, pairs = random.Random(5), {}
    for pair in range(12):
        rows = []
        for m in range(draw.choice([4, 5, 12, 40])):
            x, y = draw.uniform(0, 200), draw.uniform(0, 200)
            strange = draw.random() < 0.3
            rows.append((m, x, y, draw.uniform(0, 200) if strange else 1.1 * x + 0.1 * y + 3 + draw.gauss(0, 0.3), draw.uniform(0, 200) if strange else y - 0.05 * x + draw.gauss(0, 0.3)))
        pairs[pair] = rows
    pairs[50] = [(m, float(m), 2.0 * m, float(m), 3.0) for m in range(9)]  # all in a line
    pairs[51] = [(m, 1.0 * m, 1.0, 2.0, 3.0) for m in range(3)]
    df = spark.createDataFrame([(p, *r) for p, rows in pairs.items() for r in rows], SCHEMA).repartition(4)
    got = {r.pair: r for r in consensus.consensus(df, 2.0, draws=150).collect()}
    for p, rows in pairs.items():
        want = twin(p, rows, 2.0, 150) if len(rows) >= 4 else []
        assert sorted(got[p].agree) == sorted(want) and got[p].inliers == len(want) and (got[p].h is None) == (len(want) < 4)
    kept = {(r.pair, r.m) for r in consensus.agreeing_matches(df, 2.0, draws=150).collect()}
    assert kept == {(p, m) for p in pairs for m in got[p].agree if len(got[p].agree) >= 4}
    assert consensus.consensus(df.limit(0)).count() == 0


def test_draws_end_when_enough(monkeypatch):
    asked, rng = [], np.random.default_rng(1)
    drawn = consensus.samples
    monkeypatch.setattr(consensus, "samples", lambda *a: asked.append(a) or drawn(*a))
    p = rng.uniform(0, 100, size=(30, 2))
    assert consensus.agreeing(1, p, p + 1, 0.5, 2_000, 0.99).all() and len(asked) == 1
    asked.clear()
    assert consensus.agreeing(1, p, rng.uniform(0, 100, size=(30, 2)), 1e-9, 2_000, 0.99).sum() <= 5 and len(asked) > 5


@pytest.mark.parametrize("d,n", [(600, 80), (2048, 30)])
def test_wide_vectors(spark, d, n):
    rng = np.random.default_rng(d)
    a, b = rng.normal(size=(n, d)) + 1e4, rng.normal(size=(n + 5, d)) * 1.5 + 1e4 + 0.1
    df = spark.createDataFrame([(0, x.tolist()) for x in a] + [(1, x.tolist()) for x in b], "set int, embedding array<double>").repartition(7)
    got = metrics.frechet_full(df).first().distance
    # The root of the product of two covariances of few rows, from the small side: its singular values are those of the rows' products.
    x, y = (z - z.mean(0) for z in (a, b))
    cross = np.linalg.svd(x @ y.T / math.sqrt((n - 1) * (n + 4)), compute_uv=False).sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + (x**2).sum() / (n - 1) + (y**2).sum() / (n + 4) - 2 * cross
    assert got == pytest.approx(want, rel=1e-6)


def test_sums_go_through_a_tree(spark):
    rows = spark.createDataFrame([(i % 2, [float(i), 1.0, i * 0.5]) for i in range(400)], "set int, embedding array<float>").repartition(150)
    blocks = metrics.gram(rows).collect()
    assert len(blocks) == 2 and all(np.frombuffer(r["values"]).reshape(4, 4)[3, 3] == 200 for r in blocks)


def test_a_root_that_is_not_finite_takes_eps():
    bad = np.array([[math.inf, 0], [0, 1.0]])
    assert math.isnan(metrics.frechet_distance(np.zeros(2), bad, np.zeros(2), np.eye(2)))
    flat = np.zeros((2, 2))
    assert metrics.frechet_distance(np.zeros(2), flat, np.ones(2), np.eye(2)) == pytest.approx(4)
