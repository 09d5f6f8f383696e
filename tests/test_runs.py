"""Kernels and components on runs of pixels, against brute force on pixels."""

import random

import pytest

from framelake.operators import grids


def frame_of(spark, pixels):
    return spark.createDataFrame(sorted(pixels), "frame int, row int, col int").repartition(3)


def noise(frame, height, width, share, seed):
    draw = random.Random(seed)
    return {(frame, r, c) for r in range(height) for c in range(width) if draw.random() < share}


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("shape", ["ellipse", "disc"])
@pytest.mark.parametrize("radius", [0, 1, 3])
def test_kernels_are_those_of_pixels(spark, shape, radius):
    height, width = 11, 14
    mask = noise(1, height, width, 0.8, radius) | noise(2, height, width, 0.1, 9) | {(3, r, c) for r in range(height) for c in range(width)} | {(4, 0, 0)}
    spots = grids.kernel(radius, shape)
    on = lambda r, c: 0 <= r < height and 0 <= c < width
    grown = sorted({(f, r + a, c + b) for f, r, c in mask for a, b in spots if on(r + a, c + b)})
    left = sorted((f, r, c) for f, r, c in mask if all((f, r + a, c + b) in mask for a, b in spots if on(r + a, c + b)))
    df = frame_of(spark, mask)
    assert got(grids.dilate(df.union(df), radius, height, width, shape)) == grown
    assert got(grids.erode(df, radius, height, width, shape)) == left
    assert grids.erode(df.limit(0), radius, height, width, shape).count() == 0


def test_a_wide_kernel_on_a_large_frame(spark):
    pixels = {(0, r, c) for r in range(0, 512, 64) for c in range(0, 512, 64)}
    grown = grids.dilate(frame_of(spark, pixels), 15, 512, 512, "ellipse")
    want = {(0, r + a, c + b) for _, r, c in pixels for a, b in grids.kernel(15, "ellipse") if 0 <= r + a < 512 and 0 <= c + b < 512}
    assert set(got(grown)) == want
    assert set(got(grids.erode(grown, 15, 512, 512, "ellipse"))) >= pixels


def flood(pixels, width):
    out, left = {}, set(pixels)
    for start in sorted(pixels):
        if start not in left:
            continue
        left.discard(start)
        todo, whole = [start], []
        while todo:
            f, r, c = todo.pop()
            whole.append((f, r, c))
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if (f, r + a, c + b) in left:
                        left.discard((f, r + a, c + b))
                        todo.append((f, r + a, c + b))
        name = min(r * width + c for _, r, c in whole)
        out |= {p: name for p in whole}
    return sorted((*p, n) for p, n in out.items())


def test_components_are_those_of_a_flood(spark):
    spiral, r, c, step = set(), 0, 0, (0, 1)
    for n in [40, 40, 40, 38, 38, 36, 36, 34, 34, 32, 32]:
        for _ in range(n):
            spiral.add((9, r, c))
            r, c = r + step[0], c + step[1]
        step = (step[1], -step[0])
    pixels = spiral | {(9, 10, 10 + i) for i in range(3)} | {(5, 3, 3), (5, 4, 4), (5, 5, 3), (5, 0, 9), (6, 0, 0), (6, 0, 2)}
    pixels |= noise(1, 120, 120, 0.45, 1) | noise(2, 60, 200, 0.3, 2) | {(3, r, c) for r in range(0, 80, 2) for c in range(80)} | {(3, r, 79 if r % 4 else 0) for r in range(79)}
    df = frame_of(spark, pixels)
    assert got(grids.component_labels(df.union(df.limit(50)), 200)) == flood(pixels, 200)
    areas = {}
    for f, _, _, n in flood(pixels, 200):
        areas[f, n] = areas.get((f, n), 0) + 1
    assert got(grids.component_areas(df, 4, 200, 200)) == sorted((f, n, a) for (f, n), a in areas.items() if a >= 4)
    assert grids.component_labels(df.limit(0), 200).count() == 0
