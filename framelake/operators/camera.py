"""Cameras and poses as tables: intrinsics, points in space, depth at points, and pixels carried from one view to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators import grids, metrics
from framelake.operators.geometry import quat_to_rot

K = ("fx", "fy", "cx", "cy")


def intrinsics(cameras: DataFrame, target: int | None = None, unknown: str = "params") -> DataFrame:
    """Adds fx, fy, cx, cy to (model, width, height, params), scaled to a `target` x `target` image if given. Models of one focal length
    hold it first, then the centre. `unknown`: other models' first four parameters, or (`centre`) the first one and half the size.
    Too few parameters: null."""
    at = lambda i: F.get("params", F.lit(i))
    single, double = F.col("model").isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL"), F.col("model").isin("PINHOLE", "OPENCV")
    rest = [at(i) for i in range(4)] if unknown == "params" else [at(0), at(0), F.col("width") / 2, F.col("height") / 2]
    scale = [F.lit(1.0)] * 2 if target is None else [target / F.col("width"), target / F.col("height")]
    values = [F.when(single, at(s)).when(double, at(d)).otherwise(r) for s, d, r in zip((0, 0, 1, 2), range(4), rest)]
    return cameras.withColumns({k: v * scale[i % 2] for i, (k, v) in enumerate(zip(K, values))})


def back_project(x: Column, y: Column, z: Column, k: list[Column]) -> list[Column]:
    """Camera coordinates of pixels with depth; k: fx, fy, cx, cy."""
    return [(x - k[2]) * z / k[0], (y - k[3]) * z / k[1], z]


def project(p: list[Column], k: list[Column]) -> list[Column]:
    """Pixel coordinates of a point in camera coordinates; null at depth 0."""
    return [F.try_divide(p[0] * k[0], p[2]) + k[2], F.try_divide(p[1] * k[1], p[2]) + k[3]]


def to_camera(p: list[Column], r: list[Column], t: list[Column]) -> list[Column]:
    """World to camera: R p + t, with R's nine entries row by row."""
    return [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3)]


def to_world(p: list[Column], r: list[Column], t: list[Column]) -> list[Column]:
    """Camera to world, by the transposed rotation: R' (p - t)."""
    d = [a - b for a, b in zip(p, t)]
    return [r[i] * d[0] + r[3 + i] * d[1] + r[6 + i] * d[2] for i in range(3)]


def sample_on_segment(segs: DataFrame, keep: list[str], n: int = 16) -> DataFrame:
    """(keep, i, x, y): n evenly spaced points of each segment, both ends included; one point is the first end."""
    at = segs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = F.col("i") / max(n - 1, 1)
    return at.select(*keep, "i", (F.col("x1") + (F.col("x2") - F.col("x1")) * t).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * t).alias("y"))


def sample_nearest(points: DataFrame, depth: DataFrame, target: int, height: int, width: int, eps: float = 1e-8) -> DataFrame:
    """Adds z to points (frame, x, y) on a `target` x `target` canvas: the depth (frame, row, col, z) at the nearest pixel, halves to even,
    clipped to the map; 0 where it is missing, NaN or under `eps`."""
    spot = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(F.col(c) * (n / target)).cast("int")))
    met = points.withColumns({"row": spot("y", height), "col": spot("x", width)}).join(depth.select("frame", "row", "col", "z"), ["frame", "row", "col"], "left")
    return met.withColumn("z", F.when(F.isnan("z") | (F.col("z") < eps), 0.0).otherwise(F.coalesce("z", F.lit(0.0)))).drop("row", "col")


def reproject(edges: DataFrame, depth: DataFrame, views: DataFrame, height: int, width: int, least: float = 1e-3) -> DataFrame:
    """(pair, row, col): a reference view's edge pixels (pair, row, col) seen from the current view, once each. Pixels of depth up to `least`,
    behind the camera or off the canvas are dropped. views: pair and, for v in (ref, cur), v_fx, v_fy, v_cx, v_cy, v_qw, v_qx, v_qy, v_qz,
    v_tx, v_ty, v_tz; a pair without a view has no pixels. Canvases may be exploded from few rows, which Spark's estimate misses, so tables are
    sorted and merged, never broadcast."""
    part = lambda v, names: [F.col(f"{v}_{n}") for n in names]
    turn, shift = [f"r{i}" for i in range(9)], ("tx", "ty", "tz")
    # each step is a projection of its own, so that no expression holds the ones before it more than once
    turned = views.select("pair", *[c for v in ("ref", "cur") for c in part(v, K) + part(v, shift)],
                          *[c.alias(f"{v}_{n}") for v in ("ref", "cur") for n, c in zip(turn, quat_to_rot(part(v, ("qw", "qx", "qy", "qz"))))])
    seen = edges.select(*metrics.SPOT).join(depth.where(F.col("z") > least).select(*metrics.SPOT, "z").hint("merge"), metrics.SPOT).join(turned.hint("merge"), "pair")
    own = [c.alias(n) for n, c in zip("XYZ", back_project(F.col("col"), F.col("row"), F.col("z"), part("ref", K)))]
    point, cur = [F.col(n) for n in "XYZ"], part("cur", K) + part("cur", shift) + part("cur", turn)
    world = seen.select("pair", *cur, *part("ref", shift), *part("ref", turn), *own)
    world = world.select("pair", *cur, *[c.alias(n) for n, c in zip("XYZ", to_world(point, part("ref", turn), part("ref", shift)))])
    moved = world.select("pair", *part("cur", K), *[c.alias(n) for n, c in zip("XYZ", to_camera(point, part("cur", turn), part("cur", shift)))]).where("Z > 0")
    u, v = project(point, part("cur", K))
    out = moved.select("pair", F.rint(v).cast("int").alias("row"), F.rint(u).cast("int").alias("col"))
    return out.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).distinct()


def reprojection_prf(pred: DataFrame, edges: DataFrame, depth: DataFrame, views: DataFrame, height: int, width: int, tol: float = 3.0) -> DataFrame:
    """(pair, precision, recall, f1) of predicted pixels against the reprojected ones, widened by a pixel."""
    warped = reproject(edges, depth, views, height, width).withColumnRenamed("pair", "frame")
    return metrics.prf_tolerant(pred, grids.dilate(warped, 1, height, width).withColumnRenamed("frame", "pair"), tol)
