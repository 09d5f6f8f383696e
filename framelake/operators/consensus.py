"""Homographies by consensus: samples drawn by hash, exact matrices of four matches, and a least-squares fit to the matches that agree."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Draws after which it is asked whether more are needed.
CHUNK = 200
#: A draw is void if one of its triangles is smaller than this share of its largest.
FLAT = 1e-3


def samples(pair, n: int, first: int, count: int) -> np.ndarray:
    """Draws `first` and on of four places below `n`: the four numbers of eight hex digits in the MD5 of `pair|draw`, modulo n. Draws that
    name a place twice are left out; the column behind the places is the draw's number."""
    digests = (hashlib.md5(f"{pair}|{d}".encode()).hexdigest() for d in range(first, first + count))
    drawn = np.array([[int(h[i: i + 8], 16) % n for i in (0, 8, 16, 24)] for h in digests])
    drawn = np.c_[drawn, np.arange(first, first + count)]
    return drawn[[len(set(row[:4])) == 4 for row in drawn]]


def _areas(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Twice the areas of four triangles: 4 2 3, 1 4 3, 1 2 4 and 1 2 3."""
    def area(a: int, b: int, c: int) -> np.ndarray:
        return (x[:, b] - x[:, a]) * (y[:, c] - y[:, a]) - (x[:, c] - x[:, a]) * (y[:, b] - y[:, a])

    return [area(3, 1, 2), area(0, 3, 2), area(0, 1, 3), area(0, 1, 2)]


def matrices(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matrices that carry each four points p to q, of shape (draws, 4, 2), and which of them aren't void: three points of either side
    nearly in a line fix no matrix."""
    x, y, u, v = p[..., 0], p[..., 1], q[..., 0], q[..., 1]
    a, b = _areas(x, y), _areas(u, v)
    good = [np.min(np.abs(s), axis=0) > FLAT * np.max(np.abs(s), axis=0) for s in (a, b)]
    with np.errstate(divide="ignore", invalid="ignore"):
        r = [b[i] / a[i] for i in range(3)]
        cross = [(y[:, j] - y[:, k], x[:, k] - x[:, j], x[:, j] * y[:, k] - x[:, k] * y[:, j]) for j, k in ((1, 2), (2, 0), (0, 1))]
        image = [(u[:, i], v[:, i], np.ones(len(u))) for i in range(3)]
        h = [[r[0] * image[0][s] * cross[0][t] + r[1] * image[1][s] * cross[1][t] + r[2] * image[2][s] * cross[2][t] for t in range(3)] for s in range(3)]
    return np.moveaxis(np.array(h), -1, 0), good[0] & good[1]


def error(h: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How far each matrix of `h` carries each point of p from its q; infinite where it goes nowhere."""
    x, y = p[:, 0], p[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v, w = (h[:, s, 0, None] * x + h[:, s, 1, None] * y + h[:, s, 2, None] for s in range(3))
        dx, dy = u / w - q[:, 0], v / w - q[:, 1]
        return np.nan_to_num(np.sqrt(dx * dx + dy * dy), nan=np.inf)


def least_squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """One matrix by direct linear transform of all points, on coordinates moved and scaled to a mean of 0 and a mean size of 1."""
    def even(z: np.ndarray) -> np.ndarray:
        mean, size = z.mean(axis=0), np.abs(z - z.mean(axis=0)).mean() or 1.0
        return np.array([[1 / size, 0, -mean[0] / size], [0, 1 / size, -mean[1] / size], [0, 0, 1]])

    s, t = even(p), even(q)
    (x, y), (u, v) = ((z @ m[:2, :2].T + m[:2, 2]).T for z, m in ((p, s), (q, t)))
    one, zero = np.ones(len(x)), np.zeros(len(x))
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], -1)])
    h = np.linalg.inv(t) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ s
    return h / np.abs(h).max()


def agreeing(pair, p: np.ndarray, q: np.ndarray, thresh: float, draws: int, confidence: float) -> np.ndarray:
    """Which matches the best draw's matrix carries within `thresh`: that with most of them, the first of equals. None under four matches. Draws
    go on, CHUNK at a time, until one of agreeing matches alone is among them with `confidence`, or `draws` at most."""
    best, done, wanted = np.zeros(len(p), dtype=bool), 0, draws
    if len(p) < 4:
        return best
    while done < wanted:
        picks = samples(pair, len(p), done, min(CHUNK, draws - done))
        done += CHUNK
        if len(picks):
            h, good = matrices(p[picks[:, :4]], q[picks[:, :4]])
            near = (error(h, p, q) <= thresh) & good[:, None]
            if near.sum(axis=1).max() > best.sum():
                best = near[near.sum(axis=1).argmax()]
        share = min(best.mean() ** 4, 1 - 1e-9)
        wanted = draws if share <= 0 else min(draws, math.log(1 - confidence) / math.log(1 - share))
    return best


def consensus(matches: DataFrame, thresh: float = 3.0, draws: int = 2_000, confidence: float = 0.99) -> DataFrame:
    """(pair, inliers, h, agree) of every pair: the number of agreeing matches, the matrix fitted to them (null under four) and their `m`, from matches
    (pair, m, x0, y0, x1, y1). A pair is one group, of as many rows as its frames have matches; draws depend on the pair's name and the order of `m`
    alone, so any engine finds the same."""
    kind = dict(matches.dtypes)["m"]

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("m")
        p, q, pair = g[["x0", "y0"]].to_numpy(), g[["x1", "y1"]].to_numpy(), g["pair"].iloc[0]
        best = agreeing(pair, p, q, thresh, draws, confidence)
        h = least_squares(p[best], q[best]).ravel().tolist() if best.sum() >= 4 else None
        return pd.DataFrame({"pair": [pair], "inliers": [int(best.sum())], "h": [h], "agree": [g["m"].to_numpy()[best].tolist()]})

    return matches.groupBy("pair").applyInPandas(fit, f"pair {dict(matches.dtypes)['pair']}, inliers int, h array<double>, agree array<{kind}>")


def agreeing_matches(matches: DataFrame, thresh: float = 3.0, draws: int = 2_000, confidence: float = 0.99) -> DataFrame:
    """(pair, m) of the agreeing matches of pairs with at least four."""
    found = consensus(matches, thresh, draws, confidence).where("inliers >= 4")
    return found.select("pair", F.explode("agree").alias("m"))
