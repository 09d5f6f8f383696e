"""Segments walked in whole numbers, against a plain walk; far ends make no more steps than the canvas has."""

import random

import pytest

from framelake.operators import geometry


def plain(segs, width, height, scale, ends):
    out = set()
    for f, *c in segs:
        if any(v is None or v != v for v in c):
            continue
        c = [max(-1e6, min(1e6, v * scale)) for v in c]
        if ends == "truncated":
            x1, y1, x2, y2 = (int(v) for v in c)
        else:
            x1, x2 = (min(width - 1, max(0, round(c[i]))) for i in (0, 2))
            y1, y2 = (min(height - 1, max(0, round(c[i]))) for i in (1, 3))
        dx, dy = x2 - x1, y2 - y1
        n = max(abs(dx), abs(dy))
        for i in range(n + 1):
            if abs(dx) >= abs(dy):
                x, y = x1 + (i if dx > 0 else -i), y1 + (2 * dy * i + n) // max(1, 2 * n)
            else:
                x, y = x1 + (2 * dx * i + n) // (2 * n), y1 + (i if dy > 0 else -i)
            if 0 <= x < width and 0 <= y < height:
                out.add((f, y, x))
    return sorted(out)


@pytest.mark.parametrize("ends", ["truncated", "clipped"])
@pytest.mark.parametrize("scale", [1.0, 0.25])
def test_pixels_are_those_of_a_plain_walk(spark, ends, scale):
    draw = random.Random(3)
    whole = lambda: float(draw.randrange(-30, 70))
    segs = [(i % 9, *(draw.uniform(-60, 100) for _ in range(4))) for i in range(400)] + [(i % 9, *(whole() for _ in range(4))) for i in range(400)]
    segs += [(20, 5.0, 5.0, 5.0, 5.0), (21, -5.0, 5.0, -5.0, 5.0), (22, 0.5, 1.5, 2.5, 3.5), (23, None, 1.0, 2.0, 3.0), (24, float("nan"), 1.0, 2.0, 3.0),
             (25, -1.0, -9.0, -1.0, 90.0), (26, 3.0, -9.0, 3.0, 90.0), (27, 90.0, 4.0, -90.0, 4.0), (28, -1e5, -1e5, 1e5, 1e5), (29, 1e300, 0.0, 0.0, 10.0)]
    df = spark.createDataFrame(segs, "frame int, x1 double, y1 double, x2 double, y2 double")
    got = geometry.raster_lines(df.union(df), width=40, height=25, scale=scale, ends=ends)
    assert sorted(map(tuple, got.collect())) == plain(segs, 40, 25, scale, ends)
    assert geometry.raster_lines(df.limit(0), ends=ends).count() == 0


def test_unknown_ends(spark):
    with pytest.raises(ValueError):
        geometry.raster_lines(spark.createDataFrame([], "frame int, x1 double, y1 double, x2 double, y2 double"), ends="other")
