"""Masks and grids as tables of pixels: (frame, row, col[, v])."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.operators.runs import component_runs, pixels_of, runs_of, shrunk, spread

PIXEL = ["frame", "row", "col"]


def threshold_mask(grid: DataFrame, th: float) -> DataFrame:
    return grid.where(F.col("v") > th).select(*PIXEL)


def kernel(radius: int, shape: str = "square") -> list[tuple[int, int]]:
    """Offsets (row, col) of a kernel of side 2 * radius + 1: a square, a disc of the radius, or the ellipse whose rows reach as far as
    the rounded half chord."""
    spots = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1)]
    if shape == "disc":
        return [(r, c) for r, c in spots if r * r + c * c <= radius * radius]
    if shape == "ellipse":
        reach = {r: round(math.sqrt(radius * radius - r * r)) for r in range(-radius, radius + 1)}
        return [(r, c) for r, c in spots if abs(c) <= reach[r]]
    return spots


def kernel_radius(height: int, width: int, share: float) -> int:
    """The radius of an odd kernel whose side is about that share of the shorter side of the image."""
    return max(0, int(min(height, width) * share) // 2)


def _along(rows: DataFrame, axis: str, radius: int, size: int) -> DataFrame:
    """Every row repeated at the places up to `radius` away along one axis of the canvas."""
    shift = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    return rows.withColumn("~s", shift).withColumn(axis, F.col(axis) + F.col("~s")).drop("~s").where(F.col(axis).between(0, size - 1))


def reaches(radius: int, shape: str) -> dict[int, int]:
    """How many columns each row of a kernel reaches to both sides."""
    return {r: max(c for q, c in kernel(radius, shape) if q == r) for r in range(-radius, radius + 1)}


def dilate(mask: DataFrame, radius: int, height: int, width: int, shape: str = "square") -> DataFrame:
    """A square grows along the rows and then along the columns; other kernels widen runs of pixels, a kernel row at a time."""
    mask = mask.select(*PIXEL)
    if shape == "square":
        return _along(_along(mask, "row", radius, height).distinct(), "col", radius, width).distinct()
    return pixels_of(spread(runs_of(mask), reaches(radius, shape), height, width))


def erode(mask: DataFrame, radius: int, height: int, width: int, shape: str = "square") -> DataFrame:
    """Pixels whose whole neighbourhood on the canvas is set."""
    mask = mask.select(*PIXEL).distinct()
    row, col = F.col("row"), F.col("col")
    if shape == "square":
        strips = _along(mask, "row", radius, height).groupBy(*PIXEL).agg(F.count("*").alias("n"))
        counted = _along(strips, "col", radius, width).groupBy(*PIXEL).agg(F.sum("n").alias("n"))
        rows = F.least(row + radius, F.lit(height - 1)) - F.greatest(row - radius, F.lit(0)) + 1
        cols = F.least(col + radius, F.lit(width - 1)) - F.greatest(col - radius, F.lit(0)) + 1
        return counted.where(F.col("n") == rows * cols).select(*PIXEL)
    return pixels_of(shrunk(runs_of(mask), reaches(radius, shape), height, width))


def close(mask: DataFrame, radius: int, height: int, width: int, shape: str = "square") -> DataFrame:
    return erode(dilate(mask, radius, height, width, shape), radius, height, width, shape)


def max_pool(grid: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """(frame, row, col, v): the largest value within `radius` along both axes."""
    for axis, size in (("row", height), ("col", width)):
        grid = _along(grid.select(*PIXEL, "v"), axis, radius, size).groupBy(*PIXEL).agg(F.max("v").alias("v"))
    return grid


def component_labels(mask: DataFrame, width: int) -> DataFrame:
    """(frame, row, col, component): 8-connected components, each named by its smallest row * width + col."""
    return component_runs(mask, width).select("frame", "row", F.explode(F.sequence("c0", "c1")).alias("col"), "component")


def component_areas(mask: DataFrame, min_area: int, height: int, width: int) -> DataFrame:
    """(frame, component, area) of the components of at least `min_area` pixels, from their runs."""
    area = F.sum(F.col("c1") - F.col("c0") + 1).alias("area")
    return component_runs(mask, width).groupBy("frame", "component").agg(area).where(F.col("area") >= min_area)


def specular_mask(rgb: DataFrame, height: int, width: int, v_th: float = 0.95, s_th: float = 0.2, radius: int = 5, min_area: int = 500) -> DataFrame:
    """(frame, row, col): bright pixels of little colour in (frame, row, col, r, g, b) of 0 to 1, closed by an ellipse, in components of at least
    `min_area` pixels. Black has no saturation."""
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    bright = rgb.where((top > v_th) & (F.coalesce(F.try_divide(top - low, top), F.lit(0.0)) < s_th)).select(*PIXEL)
    found = component_runs(close(bright, radius, height, width, "ellipse"), width)
    area = F.sum(F.col("c1") - F.col("c0") + 1).over(Window.partitionBy("frame", "component"))
    return pixels_of(found.withColumn("area", area).where(F.col("area") >= min_area))


def channel_color(color: str) -> list[int]:
    """The three channels of a colour given as `#rrggbb` or `r,g,b`."""
    if color.startswith("#"):
        return [int(color[i: i + 2], 16) for i in (1, 3, 5)]
    return [int(x) for x in color.split(",")]


def blend(grid: DataFrame, mask: DataFrame, alpha: float, color: float) -> DataFrame:
    """(frame, row, col, v): (1 - a) v + a color inside the mask, rounded half up to 0-255; outside v as it is."""
    inside = mask.select(*PIXEL, F.lit(True).alias("m"))
    return grid.join(inside, PIXEL, "left").select(*PIXEL, F.when(F.col("m"), _mixed(F.col("v"), alpha, F.lit(float(color)))).otherwise(F.col("v")).alias("v"))


def _mixed(v: Column, alpha: float, color: Column) -> Column:
    alpha = min(1.0, max(0.0, alpha))
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((1 - alpha) * v + alpha * color + 0.5).cast("double")))


def blend_rgb(image: DataFrame, mask: DataFrame, alpha: float, color: str, threshold: float = 127) -> DataFrame:
    """(frame, row, col, r, g, b) with each channel blended as by `blend` where the mask (frame, row, col, v) is over `threshold`; frames
    without such a pixel stay as they are."""
    inside = mask.where(F.col("v") > threshold).select(*PIXEL, F.lit(True).alias("m")).distinct()
    channels = zip("rgb", channel_color(color), strict=True)
    return image.join(inside, PIXEL, "left").select(*PIXEL, *[F.when(F.col("m"), _mixed(F.col(c), alpha, F.lit(float(x)))).otherwise(F.col(c)).alias(c) for c, x in channels])


def merge_known(pred: DataFrame, gt: DataFrame, mask: DataFrame) -> DataFrame:
    """Predicted values in the mask, true ones outside."""
    met = pred.withColumnRenamed("v", "p").join(gt.withColumnRenamed("v", "g"), PIXEL).join(mask.select(*PIXEL, F.lit(1).alias("m")), PIXEL, "left")
    return met.select(*PIXEL, F.when(F.col("m") == 1, F.col("p")).otherwise(F.col("g")).alias("v"))


def hole_rings(hole: DataFrame, height: int, width: int, bins: int = 128) -> DataFrame:
    """(frame, row, col, ring, bin, up_left, down_left, up_right, down_right): for each distinct hole pixel its Chebyshev distance to the
    known area (null without any), this in `bins` steps of half the canvas's height, and whether the area nearer to the known one
    reaches it from each quadrant (its two sides and the corner between; the canvas is mirrored at its border). A frame's hole is one
    row of pixels, and rings grow from the known area inwards."""
    met = hole.groupBy("frame").agg(F.collect_set(F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))).alias("spots"))
    corners = {"up_left": (-1, -1), "down_left": (1, -1), "up_right": (-1, 1), "down_right": (1, 1)}

    def rings(mask: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        known, ring = ~mask, np.where(mask, -1, 0)
        if not known.any():
            return ring, [np.zeros_like(mask)] * 4
        while not known.all():
            wide = np.pad(known, 1)
            grown = np.any([wide[1 + r: 1 + r + height, 1 + c: 1 + c + width] for r in (-1, 0, 1) for c in (-1, 0, 1)], axis=0)
            ring[grown & ~known] = ring.max() + 1
            known = grown
        wide = np.pad(ring, 1, mode="reflect") if min(height, width) > 1 else np.pad(ring, 1, mode="edge")
        at = lambda r, c: wide[1 + r: 1 + r + height, 1 + c: 1 + c + width]
        return ring, [mask & (np.minimum(np.minimum(at(r, 0), at(0, c)), at(r, c)) < ring) for r, c in corners.values()]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for spots in b.column("spots"):
                rows, cols = (spots.values.field(i).to_numpy() for i in (0, 1))
                mask = np.zeros((height, width), dtype=bool)
                mask[rows, cols] = True
                ring, flags = rings(mask)
                found.append([{"ring": int(x) if x >= 0 else None} | dict(zip(corners, f, strict=True)) for x, f in zip(
                    ring[rows, cols], np.stack([f[rows, cols] for f in flags], axis=1).tolist(), strict=True)])
            kind = pa.list_(pa.struct([("ring", pa.int32()), *((c, pa.bool_()) for c in corners)]))
            yield pa.RecordBatch.from_arrays([b.column("frame"), b.column("spots"), pa.array(found, kind)], names=["frame", "spots", "found"])

    inner = T.StructType.fromDDL("ring int, " + ", ".join(f"{c} boolean" for c in corners))
    schema = T.StructType([met.schema["frame"], met.schema["spots"], T.StructField("found", T.ArrayType(inner))])
    each = met.mapInArrow(measure, schema).select("frame", F.explode(F.arrays_zip("spots", "found")).alias("x")).select("frame", "x.spots.*", "x.found.*")
    step = F.floor(F.col("ring") * bins / (height / 2.0))
    return each.select("frame", "row", "col", "ring", F.least(F.lit(bins - 1), step).cast("int").alias("bin"), *corners)


def rect_mask(frames: DataFrame, w: int, h: int, height: int, width: int, seed: int = 0) -> DataFrame:
    """A w x h rectangle at a seeded position in each frame."""
    draw = lambda n, s: (F.conv(F.substring(F.md5(F.concat(F.col("frame").cast("string"), F.lit(f"|{s}|{seed}")).cast("binary")), 1, 6), 16, 10).cast("long") % n).cast("int")
    at = frames.select("frame", draw(height - h + 1, "r").alias("r"), draw(width - w + 1, "c").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))).alias("p"))
    return at.select("frame", (F.col("r") + F.floor(F.col("p") / w)).cast("int").alias("row"), (F.col("c") + F.col("p") % w).cast("int").alias("col"))


def flip_ud(mask: DataFrame, height: int) -> DataFrame:
    return mask.withColumn("row", height - 1 - F.col("row"))


def local_max_topk(grid: DataFrame, k: int, th: float, height: int, width: int) -> DataFrame:
    """(frame, row, col, v, rank): 3x3 local maxima over `th`, the k largest of each frame."""
    top = max_pool(grid, 1, height, width).withColumnRenamed("v", "top")
    peaks = grid.join(top, PIXEL).where((F.col("v") == F.col("top")) & (F.col("v") > th))
    w = Window.partitionBy("frame").orderBy(F.col("v").desc(), "row", "col")
    return peaks.select(*PIXEL, "v", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def sub_pixel(peaks: DataFrame, offset: DataFrame) -> DataFrame:
    """`peaks` with x and y: their pixel, moved by the offset grid (frame, row, col, dx, dy) there, and half a pixel."""
    return peaks.join(offset, PIXEL, "left").select(
        *peaks.columns, *[(F.col(c) + F.coalesce(d, F.lit(0.0)) + 0.5).alias(n) for n, c, d in (("x", "col", "dx"), ("y", "row", "dy"))])


def sharpen_prob(p: Column, shift: float = 0.2, steepness: float = 4.0) -> Column:
    """The sigmoid of (p + shift) * steepness."""
    return 1 / (1 + F.exp(-(p + shift) * steepness))


def min_max_normalize(grid: DataFrame) -> DataFrame:
    w = Window.partitionBy("frame")
    lo, hi = F.min("v").over(w), F.max("v").over(w)
    return grid.select(*PIXEL, F.when(hi > lo, (F.col("v") - lo) / (hi - lo)).otherwise(0.0).alias("v"))


def label_colors(classes: DataFrame, palette: DataFrame) -> DataFrame:
    return classes.join(palette, "class_id", "left")
