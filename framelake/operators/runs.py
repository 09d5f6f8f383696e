"""Masks as runs of pixels: (frame, row, c0, c1), c0 to c1 the set columns of a row; kernels and components work on runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec


def _line() -> WindowSpec:
    return Window.partitionBy("frame", "row")


def runs_of(mask: DataFrame) -> DataFrame:
    """The runs of a mask's pixels (frame, row, col); repeated pixels count once."""
    pixels = mask.select("frame", "row", "col").distinct()
    island = pixels.withColumn("~i", F.col("col") - F.row_number().over(_line().orderBy("col")))
    return island.groupBy("frame", "row", "~i").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("~i")


def pixels_of(runs: DataFrame) -> DataFrame:
    return runs.select("frame", "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def joined(runs: DataFrame) -> DataFrame:
    """Overlapping and touching runs of a row as one."""
    before = F.max("c1").over(_line().orderBy("c0", "c1").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.withColumn("~s", F.when(F.col("c0") <= before + 1, 0).otherwise(1))
    island = starts.withColumn("~i", F.sum("~s").over(_line().orderBy("c0", "c1").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy("frame", "row", "~i").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("~i")


def spread(runs: DataFrame, reach: dict[int, int], height: int, width: int) -> DataFrame:
    """Dilation on a canvas by a kernel whose row `r` reaches `reach[r]` columns to both sides: a run gives one wider run a kernel row."""
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in reach.items()])).alias("k")
    wide = runs.select("frame", "row", "c0", "c1", rows).select(
        "frame", (F.col("row") + F.col("k.r")).alias("row"), F.greatest(F.lit(0), F.col("c0") - F.col("k.c")).alias("c0"),
        F.least(F.lit(width - 1), F.col("c1") + F.col("k.c")).alias("c1"))
    return joined(wide.where(F.col("row").between(0, height - 1) & (F.col("c0") <= F.col("c1"))))


def complement(runs: DataFrame, frames: DataFrame, height: int, width: int) -> DataFrame:
    """The runs of the pixels of the canvas of each of `frames` (frame) that `runs`, which don't touch, leave out."""
    lines = frames.select("frame", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("row"))
    held = runs.where(F.col("row").between(0, height - 1))
    # A run ends the gap before it; a mark behind the last column ends the last gap.
    marks = held.select("frame", "row", "c0", "c1").unionByName(lines.withColumns({"c0": F.lit(width), "c1": F.lit(width)}))
    before = F.coalesce(F.lag("c1").over(_line().orderBy("c0")), F.lit(-1))
    gaps = marks.select("frame", "row", (before + 1).alias("g0"), (F.col("c0") - 1).alias("g1"))
    return gaps.where("g0 <= g1").select("frame", "row", F.col("g0").alias("c0"), F.col("g1").alias("c1"))


def shrunk(runs: DataFrame, reach: dict[int, int], height: int, width: int) -> DataFrame:
    """Erosion on a canvas by a kernel that is its own mirror image: what the complement, spread, leaves. Beyond the canvas all counts as set."""
    frames = runs.select("frame").distinct()
    inside = runs.where(F.col("row").between(0, height - 1) & (F.col("c1") >= 0) & (F.col("c0") < width)).withColumns(
        {"c0": F.greatest(F.lit(0), F.col("c0")), "c1": F.least(F.lit(width - 1), F.col("c1"))})
    return complement(spread(complement(inside, frames, height, width), reach, height, width), frames, height, width)


def united(frame: np.ndarray, row: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """For runs in order of (frame, row, c0), the place of the first run of each one's 8-connected component. Touching runs of
    neighbouring rows are found by two searches, then joined by hooking roots to smaller ones and halving paths."""
    root = np.arange(len(row))
    if not len(row):
        return root
    low, rows, wide = c0.min(), int(row.max() - row.min()) + 2, int(c1.max() - c0.min()) + 4
    line = (frame * rows + row - row.min()) * wide
    first, last = line + c0 - low + 1, line + c1 - low + 1
    lo = np.searchsorted(last, first + wide - 1, "left")
    hi = np.searchsorted(first, last + wide + 1, "right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.repeat(lo, n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    return root


def component_runs(mask: DataFrame, width: int) -> DataFrame:
    """(frame, row, c0, c1, component) of the 8-connected components of each frame's pixels, each named by its smallest row * width + col.
    A frame's runs are one row, which its canvas bounds; a task labels its frames' runs in one pass, so no further job is needed."""
    packed = runs_of(mask).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("row", "c0", "c1")]))).alias("runs"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            sizes = np.diff(runs.offsets.to_numpy())
            row, c0, c1 = (runs.flatten().field(i).to_numpy() for i in range(3))
            named = (row * width + c0)[united(np.repeat(np.arange(len(sizes)), sizes), row, c0, c1)]
            names = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(named))
            yield pa.RecordBatch.from_arrays([batch.column("frame"), runs, names], ["frame", "runs", "names"])

    schema = T.StructType([packed.schema["frame"], packed.schema["runs"], T.StructField("names", T.ArrayType(T.LongType()))])
    each = packed.mapInArrow(label, schema).select("frame", F.explode(F.arrays_zip("runs", "names")).alias("r"))
    kinds = dict(mask.dtypes)
    return each.select("frame", F.col("r.runs.row").cast(kinds["row"]).alias("row"), *[F.col(f"r.runs.{c}").cast(kinds["col"]).alias(c) for c in ("c0", "c1")],
                       F.col("r.names").alias("component"))
