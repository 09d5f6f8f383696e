"""Metrics between predictions and truth. Masks are (pair, row, col), grids (pair, row, col, v)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.operators import flow as flows
from framelake.operators import gates, geometry, grids

SPOT = ["pair", "row", "col"]


def counts(pred: DataFrame, gt: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(pair, tp, fp, fn) of every pair with a pixel on either side, or of every row of `pairs` (pair), zeros where both sides
    are empty."""
    p, g = pred.select(*SPOT, F.lit(1).alias("p")), gt.select(*SPOT, F.lit(1).alias("g"))
    met = p.join(g, SPOT, "full_outer")
    found = met.groupBy("pair").agg(F.count(F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fp"),
                                    F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))
    return found if pairs is None else pairs.select("pair").join(found, "pair", "left").na.fill(0, ["tp", "fp", "fn"])


def prf(pred: DataFrame, gt: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(pair, tp, fp, fn, precision, recall, f1): 0 where undefined, so also of two empty masks."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return counts(pred, gt, pairs).select("pair", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def mask_iou(pred: DataFrame, gt: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(pair, iou): 0 of two empty masks."""
    return counts(pred, gt, pairs).select("pair", F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("iou"))


def edge_accuracy(pred: DataFrame, gt: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(pair, precision, recall, f1) in percent; all three are 1, not 100, where both masks are empty."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    empty = tp + fp + fn == 0
    p, r = tp / (tp + fp + 1e-8), tp / (tp + fn + 1e-8)
    f1 = 2 * p * r / (p + r + 1e-8)
    return counts(pred, gt, pairs).select("pair", *[F.when(empty, 1.0).otherwise(x * 100).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f1, "f1"))])


def edge_accuracy_means(maps: DataFrame, kind: str) -> DataFrame:
    """One row (kind, maps, precision, recall, f1): the means over the maps of one kind (`edge`, `line`)."""
    return maps.agg(F.count("*").alias("maps"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")]).select(F.lit(kind).alias("kind"), "*")


def average_f1(kinds: DataFrame) -> DataFrame:
    """The rows of several kinds of maps and one more, `average`, with the mean of their f1."""
    return kinds.unionByName(kinds.agg(F.avg("f1").alias("f1")).withColumn("kind", F.lit("average")), allowMissingColumns=True)


def nearest(rows: np.ndarray, cols: np.ndarray, to_rows: np.ndarray, to_cols: np.ndarray) -> np.ndarray:
    """The exact Euclidean distance of each pixel to the nearest of the others, infinite without any: nearest set pixel in each
    column first, then the best column of each pixel's row, so a frame costs pixels times its width."""
    if not len(to_rows) or not len(rows):
        return np.full(len(rows), np.inf)
    top, left = min(rows.min(), to_rows.min()), min(cols.min(), to_cols.min())
    height, width = max(rows.max(), to_rows.max()) - top + 1, max(cols.max(), to_cols.max()) - left + 1
    far, at = 1e9, np.arange(height)[:, None]
    there = np.zeros((height, width), dtype=bool)
    there[to_rows - top, to_cols - left] = True
    above = np.maximum.accumulate(np.where(there, at, -far), axis=0)
    below = np.minimum.accumulate(np.where(there, at, far)[::-1], axis=0)[::-1]
    column = np.minimum(at - above, below - at) ** 2
    out, across = np.empty(len(rows)), (np.arange(width)[None, :] - np.arange(width)[:, None]) ** 2.0
    for a in range(0, len(rows), 4096):
        r, c = rows[a: a + 4096] - top, cols[a: a + 4096] - left
        out[a: a + 4096] = np.sqrt((column[r] + across[c]).min(axis=1))
    return out


def _packed(mask: DataFrame, name: str) -> DataFrame:
    """(pair, name): each pair's distinct pixels as one array; a frame bounds it."""
    return mask.groupBy("pair").agg(F.collect_set(F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))).alias(name))


def _pixels(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for spots in column:
        values = spots.values
        yield (np.zeros(0, np.int64),) * 2 if values is None else tuple(values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))


def nearest_distance(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(pair, row, col, d): the Euclidean distance of each distinct source pixel to the nearest target pixel; null without one.
    Both masks of a pair meet as arrays in one row, and a batch of pairs is measured at a time."""
    met = _packed(src, "src").join(_packed(dst, "dst"), "pair", "left").select("pair", "src", "dst")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [nearest(*s, *t) for s, t in zip(_pixels(b.column("src")), _pixels(b.column("dst")), strict=True)]
            ds = pa.array([np.where(np.isinf(d), None, d).tolist() for d in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("pair"), b.column("src"), ds], names=["pair", "src", "d"])

    schema = T.StructType([met.schema["pair"], met.schema["src"], T.StructField("d", T.ArrayType(T.DoubleType()))])
    spots = met.mapInArrow(measure, schema).select("pair", F.explode(F.arrays_zip("src", "d")).alias("x"))
    return spots.select("pair", F.col("x.src.row").alias("row"), F.col("x.src.col").alias("col"), F.col("x.d").alias("d"))


def both_ways(pred: DataFrame, gt: DataFrame, tol: float = 2.0) -> DataFrame:
    """(pair, p_all, g_all, p_mean, g_mean, p_hit, g_hit) of every pair with a pixel on either side: each side's pixels, their
    mean distance to the other side (null where that is empty), and how many are within `tol` of it."""
    met = _packed(pred, "p").join(_packed(gt, "g"), "pair", "full_outer").select("pair", "p", "g")
    fields = ["p_all", "g_all", "p_mean", "g_mean", "p_hit", "g_hit"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, g in zip(_pixels(b.column("p")), _pixels(b.column("g")), strict=True):
                d = nearest(*p, *g), nearest(*g, *p)
                there = len(p[0]) > 0 and len(g[0]) > 0
                out.append([len(p[0]), len(g[0]), *(float(x.mean()) if there else None for x in d), *(int((x <= tol).sum()) for x in d)])
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("pair"), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=["pair", *fields])

    schema = T.StructType([met.schema["pair"]] + T.StructType.fromDDL("p_all long, g_all long, p_mean double, g_mean double, p_hit long, g_hit long").fields)
    return met.mapInArrow(measure, schema)


def chamfer(pred: DataFrame, gt: DataFrame, empty_value: float = 1e6, pairs: DataFrame | None = None) -> DataFrame:
    """(pair, chamfer): half the sum of both mean distances; `empty_value` where one side is empty, 0 where both are, which
    only `pairs` (pair) can tell."""
    found = both_ways(pred, gt).select("pair", F.coalesce((F.col("p_mean") + F.col("g_mean")) / 2, F.lit(float(empty_value))).alias("chamfer"))
    return found if pairs is None else pairs.select("pair").join(found, "pair", "left").na.fill(0.0, ["chamfer"])


def prf_tolerant(pred: DataFrame, gt: DataFrame, tol: float = 2.0, pairs: DataFrame | None = None, region: DataFrame | None = None) -> DataFrame:
    """(pair, precision, recall, f1): pixels within `tol` of the other side. All are 0 where one side is empty, and 1 where both
    are, which only `pairs` (pair) can tell. `region` (pair, row, col) leaves only its own pixels to both sides; it may hold whole canvases, of a size
    that Spark's estimate misses where they are exploded, so it's sorted and merged, never broadcast."""
    if region is not None:
        pred, gt = (m.join(region.select(*SPOT).hint("merge"), SPOT, "left_semi") for m in (pred, gt))
    p, r = F.col("p_hit") / (F.col("p_all") + 1e-6), F.col("g_hit") / (F.col("g_all") + 1e-6)
    found = both_ways(pred, gt, tol).select("pair", p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + 1e-6)).alias("f1"))
    return found if pairs is None else pairs.select("pair").join(found, "pair", "left").na.fill(1.0, ["precision", "recall", "f1"])


def image_errors(a: DataFrame, b: DataFrame, kind: str = "standard") -> DataFrame:
    """(pair, mse, mae, psnr) of grids with values in 0 to 1; `legacy` psnr is 1 - 10 log10(mse + 1e-7)."""
    met = a.withColumnRenamed("v", "p").join(b.withColumnRenamed("v", "g"), SPOT)
    diff = F.col("p") - F.col("g")
    sums = met.groupBy("pair").agg(F.avg(diff * diff).alias("mse"), F.avg(F.abs(diff)).alias("mae"))
    psnr = 1.0 - 10 * F.log10(F.col("mse") + 1e-7) if kind == "legacy" else F.when(F.col("mse") <= 1e-12, 99.0).otherwise(-10 * F.log10("mse"))
    return sums.withColumn("psnr", psnr)


def psnr_hole(a: DataFrame, b: DataFrame, hole: DataFrame) -> DataFrame:
    """PSNR over the hole's pixels; null without a hole, 99 where they are equal."""
    met = a.withColumnRenamed("v", "p").join(b.withColumnRenamed("v", "g"), SPOT).join(hole.select(*SPOT, F.lit(1).alias("m")), SPOT, "left")
    mse = F.avg(F.when(F.col("m") == 1, (F.col("p") - F.col("g")) ** 2))
    return met.groupBy("pair").agg(mse.alias("mse")).select("pair", F.when(F.col("mse") <= 1e-12, 99.0).otherwise(-10 * F.log10("mse")).alias("psnr"))


def mask_bbox(mask: DataFrame, pad: int, height: int, width: int) -> DataFrame:
    return mask.groupBy("pair").agg(F.greatest(F.min("row") - pad, F.lit(0)).alias("top"), F.greatest(F.min("col") - pad, F.lit(0)).alias("left"),
                                    F.least(F.max("row") + pad, F.lit(height - 1)).alias("bottom"), F.least(F.max("col") + pad, F.lit(width - 1)).alias("right"))


def ssim(a: DataFrame, b: DataFrame, window: int = 7, c1: float = 0.01**2, c2: float = 0.03**2) -> DataFrame:
    """(pair, ssim): mean over all full windows. Window sums run along the rows and then along the columns, so a pixel counts
    twice the window's side instead of its area."""
    met = a.withColumnRenamed("v", "p").join(b.withColumnRenamed("v", "g"), SPOT)
    sums = met.select(*SPOT, F.lit(1).alias("n"), "p", "g", (F.col("p") * F.col("p")).alias("pp"), (F.col("g") * F.col("g")).alias("gg"), (F.col("p") * F.col("g")).alias("pg"))
    shifts = F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("shift")
    for axis in ("row", "col"):
        moved = sums.select("*", shifts).withColumn(axis, F.col(axis) - F.col("shift"))
        sums = moved.groupBy(*SPOT).agg(*[F.sum(c).alias(c) for c in ("n", "p", "g", "pp", "gg", "pg")])
    n = window * window
    mp, mg = F.col("p") / n, F.col("g") / n
    vp, vg, c = ((F.col(x) - n * y * z) / (n - 1) for x, y, z in (("pp", mp, mp), ("gg", mg, mg), ("pg", mp, mg)))
    value = (2 * mp * mg + c1) * (2 * c + c2) / ((mp * mp + mg * mg + c1) * (vp + vg + c2))
    return sums.where(F.col("n") == n).groupBy("pair").agg(F.avg(value).alias("ssim"))


def ssim_hole_bbox(a: DataFrame, b: DataFrame, hole: DataFrame, height: int, width: int, pad: int = 8, window: int = 7) -> DataFrame:
    """(pair, ssim) inside the hole's bounding box, padded by `pad` and cut at the canvas; pairs without a hole have no row, nor
    have those whose box is smaller than a window."""
    box = mask_bbox(hole, pad, height, width)
    inside = F.col("row").between(F.col("top"), F.col("bottom")) & F.col("col").between(F.col("left"), F.col("right"))
    cut = lambda g: g.join(box, "pair").where(inside).select(*SPOT, "v")
    return ssim(cut(a), cut(b), window)


def warp_error(now: DataFrame, warped: DataFrame, valid: DataFrame) -> DataFrame:
    """(pair, error): mean squared difference over valid pixels; pairs of at most one are left out."""
    met = now.withColumnRenamed("v", "p").join(warped.withColumnRenamed("v", "g"), SPOT).join(valid.select(*SPOT), SPOT, "left_semi")
    return met.groupBy("pair").agg(F.avg((F.col("p") - F.col("g")) ** 2).alias("error"), F.count("*").alias("n")).where("n > 1").drop("n")


def sequence_warp_error(frames: DataFrame, grid: DataFrame, flow: DataFrame, hole: DataFrame, height: int, width: int) -> DataFrame:
    """(seq_id, steps, ewarp_all, ewarp_hole) of frames (seq_id, frame, frame_no): how far each frame is from the next one, sampled
    where the flow of the frame (frame, row, col, fx, fy) leads, as the mean squared difference over the pixels that stay on the
    canvas, and over those in the frame's hole; a step of at most one such pixel is skipped, the means are over steps. Null
    where no step is left. grid: (frame, row, col, v)."""
    steps = frames.select("seq_id", F.col("frame").alias("pair"), F.lead("frame").over(Window.partitionBy("seq_id").orderBy("frame_no")).alias("next")).where("next IS NOT NULL")
    aim = flow.withColumnRenamed("frame", "pair").select(*SPOT, (F.col("col") + F.col("fx")).alias("x"), (F.col("row") + F.col("fy")).alias("y"))
    aim = aim.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).join(steps.select("pair"), "pair", "left_semi")
    after = steps.select("pair", F.col("next").alias("frame")).join(grid, "frame").select(*SPOT, "v")
    warped = flows.sample(after, aim.withColumn("pt", F.col("row") * width + F.col("col")), height, width).select(
        "pair", F.floor(F.col("pt") / width).cast("int").alias("row"), (F.col("pt") % width).cast("int").alias("col"), F.col("v").alias("g"))
    here = grid.select(F.col("frame").alias("pair"), "row", "col", F.col("v").alias("p"))
    marked = hole.select(F.col("frame").alias("pair"), "row", "col", F.lit(1).alias("m"))
    gap = (F.col("p") - F.col("g")) ** 2
    each = warped.join(here, SPOT).join(marked, SPOT, "left").groupBy("pair").agg(
        F.avg(gap).alias("all"), F.count("*").alias("n"), F.avg(F.when(F.col("m") == 1, gap)).alias("hole"), F.count("m").alias("m"))
    return steps.join(each, "pair", "left").groupBy("seq_id").agg(
        F.count(F.when(F.col("n") > 1, 1)).alias("steps"), F.avg(F.when(F.col("n") > 1, F.col("all"))).alias("ewarp_all"), F.avg(F.when(F.col("m") > 1, F.col("hole"))).alias("ewarp_hole"))


def scored_losses(rows: DataFrame, item: str, alpha: float = 0.75, gamma: float = 2.0, a: float = 0.7, b: float = 0.3) -> DataFrame:
    """(item, focal, tversky, bce, l1) of (item, p, y): prediction p in (0, 1), truth y 0 or 1."""
    p, y = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("p"))), F.col("y")
    pt, w = F.when(y == 1, p).otherwise(1 - p), F.when(y == 1, alpha).otherwise(1 - alpha)
    tp, fp, fn = F.sum(p * y), F.sum(p * (1 - y)), F.sum((1 - p) * y)
    return rows.groupBy(item).agg(F.avg(-w * F.pow(1 - pt, F.lit(gamma)) * F.log(pt)).alias("focal"), (1 - (tp + 1) / (tp + a * fp + b * fn + 1)).alias("tversky"),
                                  F.avg(-F.log(pt)).alias("bce"), F.avg(F.abs(p - y)).alias("l1"))


def masked_losses(a: DataFrame, b: DataFrame, mask: DataFrame, known: float = 1.0, missing: float = 1.0) -> DataFrame:
    """(pair, l1, l2, bce): mean absolute and squared difference with weight `missing` inside the mask and `known` outside, and the
    cross entropy of prediction `a` against truth `b` over the mask alone (null without one)."""
    inside = mask.select(*SPOT, F.lit(1).alias("m")).distinct()
    met = a.withColumnRenamed("v", "p").join(b.withColumnRenamed("v", "g"), SPOT).join(inside, SPOT, "left")
    w, gap = F.when(F.col("m") == 1, missing).otherwise(known), F.col("p") - F.col("g")
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("p")))
    entropy = -(F.col("g") * F.log(p) + (1 - F.col("g")) * F.log(1 - p))
    return met.groupBy("pair").agg(F.avg(w * F.abs(gap)).alias("l1"), F.avg(w * gap * gap).alias("l2"), F.avg(F.when(F.col("m") == 1, entropy)).alias("bce"))


def color_shift(gen: DataFrame, ref: DataFrame, mask: DataFrame, height: int, width: int, least: int = 100, radius: int = 5, top: float = 255.0) -> DataFrame:
    """(pair, channel, row, col, v): add each channel's mean difference over the background (outside `mask` grown by `radius`) to the
    generated grid (pair, channel, row, col, v), clipped to 0..top, if the background has more than `least` pixels."""
    key = ["pair", "channel", "row", "col"]
    grown = grids.dilate(mask.withColumnRenamed("pair", "frame"), radius, height, width).withColumnRenamed("frame", "pair")
    met = gen.select(*key, F.col("v").alias("p")).join(ref.select(*key, F.col("v").alias("g")), key)
    shift = met.join(grown, SPOT, "left_anti").groupBy("pair", "channel").agg((F.avg("g") - F.avg("p")).alias("s"), F.count("*").alias("n")).where(F.col("n") > least)
    moved = met.join(shift, ["pair", "channel"], "left")
    return moved.select(*key, F.least(F.lit(top), F.greatest(F.lit(0.0), F.col("p") + F.coalesce("s", F.lit(0.0)))).alias("v"))


def frechet_diag(features: DataFrame) -> DataFrame:
    """Fréchet distance of two sets (set 0, 1; embedding) with diagonal covariances."""
    at = features.select("set", F.posexplode("embedding").alias("i", "x")).select("set", "i", F.col("x").cast("double").alias("x"))
    m = at.groupBy("i").agg(*[f(F.when(F.col("set") == s, F.col("x"))).alias(f"{n}{s}") for s in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp))])
    return m.agg(F.sum((F.col("m0") - F.col("m1")) ** 2 + F.col("v0") + F.col("v1") - 2 * F.sqrt(F.col("v0") * F.col("v1"))).alias("distance"))


#: Columns of a block of a Gram matrix, and numbers of blocks that one task adds up at most on the first level.
BLOCK, FAN = 256, 64


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, values) as one row a key with the sums of their values, arrays of numbers as bytes; one sum is held at a time."""
    key, total = None, None
    for batch in batches:
        done = []
        for k, values in zip(batch.column("key").to_pylist(), batch.column("values").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, total.tobytes()))
                key, total = k, np.frombuffer(values, "<f8").copy()
            else:
                total += np.frombuffer(values, "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([v for _, v in done], pa.binary())], ["key", "values"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([total.tobytes()])], ["key", "values"])


def _summed(parts: DataFrame) -> DataFrame:
    """(key, values): sums of arrays of numbers, in two levels: those of up to FAN tasks first, then those sums."""
    level = lambda df, *by: df.repartition(*by).sortWithinPartitions(*by).select("key", "values").mapInArrow(_added, "key string, values binary")
    return level(level(parts, "key", "salt"), "key")


def gram(features: DataFrame) -> DataFrame:
    """(set, bi, bj, values) of features (set, embedding): the bytes of the blocks, BLOCK columns wide, of the upper half of each set's matrix of
    moments: of the vectors, less the mean of both sets, with a one behind them, so that the last row holds sums and the count. A task adds up
    its own vectors, and sends blocks, which are added in a tree; nowhere do all blocks meet. Vectors with other lengths than the first are an error."""
    rows = features.where("set IN (0, 1) AND embedding IS NOT NULL").select(F.col("set").cast("int").alias("set"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.array(batch.column("e").to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            own = np.append(x.sum(axis=0), len(x))
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(["all"]), pa.array([total.tobytes()])], ["key", "values"])

    salt = (F.spark_partition_id() / FAN).cast("int").alias("salt")
    first = _summed(rows.select("e").mapInArrow(sums, "key string, values binary").select("key", "values", salt)).first()  # one vector of d + 1 numbers
    whole = np.frombuffer(first[1], "<f8") if first else np.ones(1)
    shift = whole[:-1] / whole[-1]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.array(batch.column("e").to_pylist(), dtype=float).reshape(batch.num_rows, -1) - shift
            x, of = np.c_[x, np.ones(len(x))], batch.column("set").to_numpy()
            for s in np.unique(of):
                own = x[of == s].T @ x[of == s]
                found[int(s)] = found[int(s)] + own if int(s) in found else own
        for s, m in found.items():
            for i in range(0, len(m), BLOCK):
                keys = [f"{s} {i} {j}" for j in range(i, len(m), BLOCK)]
                values = [np.ascontiguousarray(m[i: i + BLOCK, j: j + BLOCK]).tobytes() for j in range(i, len(m), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values)], ["key", "values"])

    added = _summed(rows.mapInArrow(blocks, "key string, values binary").select("key", "values", salt))
    part = F.split("key", " ")
    return added.select(*[part[i].cast("int").alias(c) for i, c in enumerate(("set", "bi", "bj"))], "values")


def frechet_distance(m0: np.ndarray, c0: np.ndarray, m1: np.ndarray, c1: np.ndarray, eps: float = 1e-6) -> float:
    """The distance of two normal distributions: squared distance of means, and traces of both covariances less twice that of the root of
    their product. The root's trace is that of the symmetric matrix root(c0) c1 root(c0); where that isn't finite, `eps` is added to both diagonals."""
    def root_trace(a: np.ndarray, b: np.ndarray) -> float:
        try:
            w, v = np.linalg.eigh(a)
            half = (v * np.sqrt(np.clip(w, 0, None))) @ v.T
            return float(np.sqrt(np.clip(np.linalg.eigvalsh(half @ b @ half), 0, None)).sum())
        except np.linalg.LinAlgError:
            return math.nan

    cross = root_trace(c0, c1)
    if not math.isfinite(cross):
        cross = root_trace(c0 + eps * np.eye(len(c0)), c1 + eps * np.eye(len(c1)))
    return float(((m0 - m1) ** 2).sum() + np.trace(c0) + np.trace(c1) - 2 * cross)


def frechet_full(features: DataFrame) -> DataFrame:
    """Fréchet distance of two sets (set 0, 1; embedding) with full sample covariances: moments are sums of blocks (see `gram`), the root is of one
    d x d matrix on the driver, which gets two such matrices whatever the number of rows. NaN where a set has fewer than two vectors."""
    spark = features.sparkSession
    moments: dict[int, dict] = {}
    for r in gram(features).toLocalIterator():  # half of two matrices of (d + 1) x (d + 1)
        moments.setdefault(r.set, {})[r.bi, r.bj] = np.frombuffer(r["values"], "<f8")
    both = []
    for s in (0, 1):
        own = moments.get(s)
        if not own:
            return spark.createDataFrame([(math.nan,)], "distance double")
        last = max(j for _, j in own)
        size = last + math.isqrt(len(own[last, last]))
        m = np.zeros((size, size))
        for (i, j), values in own.items():
            block = values.reshape(min(BLOCK, size - i), min(BLOCK, size - j))
            m[i: i + BLOCK, j: j + BLOCK] = block
            m[j: j + BLOCK, i: i + BLOCK] = block.T
        n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
        if n < 2:
            return spark.createDataFrame([(math.nan,)], "distance double")
        both += [mean, (m[:-1, :-1] - n * np.outer(mean, mean)) / (n - 1)]
    return spark.createDataFrame([(frechet_distance(*both),)], "distance double")


def endpoint_error(a: DataFrame, b: DataFrame, pixels_a: DataFrame, pixels_b: DataFrame, height: int, width: int) -> DataFrame:
    """(pair, endpoint_err): mean distance of each side's segment ends (halves to even, clipped) to the other side's pixels, averaged over
    both sides. Pairs where either side has no segment or no pixel aren't returned."""
    spot = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(c).cast("int")))
    both = []
    for segs, pixels, name in ((a, pixels_b, "da"), (b, pixels_a, "db")):
        ends = segs.select("pair", F.explode(F.array(*[F.struct(spot(F.col(f"y{i}"), height).alias("row"), spot(F.col(f"x{i}"), width).alias("col")) for i in (1, 2)])).alias("e")).select("pair", "e.*")
        both.append(ends.join(nearest_distance(ends.distinct(), pixels), SPOT).groupBy("pair").agg(F.avg("d").alias(name)))
    return both[0].join(both[1], "pair").where("da IS NOT NULL AND db IS NOT NULL").select("pair", ((F.col("da") + F.col("db")) / 2).alias("endpoint_err"))


def pair_alignment(pairs: DataFrame, warped: DataFrame, segs: DataFrame, height: int, width: int, least: float = 0.05) -> DataFrame:
    """(pair, iou, precision, recall, endpoint_err, score, valid) of every row of `pairs`: the previous frame's warped segments against the
    current ones, (pair, x1, y1, x2, y2). A pair without segments or pixels on either side gets zeros, an error of 1e6, and isn't valid."""
    a, b = (geometry.rasterize(s, "pair", width, height) for s in (warped, segs))
    n = counts(a, b)
    met = pairs.select("pair").join(n, "pair", "left").join(endpoint_error(warped, segs, a, b, height, width), "pair", "left")
    tp, fp, fn, there = F.col("tp"), F.col("fp"), F.col("fn"), F.col("endpoint_err").isNotNull()
    share = lambda under: F.when(there, F.coalesce(F.try_divide(tp, under), F.lit(0.0))).otherwise(0.0)
    shares = met.select("pair", share(tp + fp + fn).alias("iou"), share(tp + fp).alias("precision"), share(tp + fn).alias("recall"), F.coalesce("endpoint_err", F.lit(1e6)).alias("endpoint_err"))
    score = F.when(F.col("endpoint_err") < 1e6, gates.reliability(F.col("precision"), F.col("recall"), F.col("endpoint_err"))).otherwise(0.0)
    return shares.withColumn("score", score).withColumn("valid", F.col("score") > least)


def reference_consistency(refs: DataFrame, pixels: DataFrame) -> DataFrame:
    """(frame, cd_global, cd_local): Chamfer distance of each frame of refs (frame, global, local) to its two references' pixels
    (frame, row, col); 0 if both sides are empty, infinite if one is or a reference is missing."""
    out = refs.select("frame")
    for kind in ("global", "local"):
        near = refs.select(F.col("frame").alias("pair"), F.col(kind).alias("frame"))
        a = near.join(pixels, "frame").select(*SPOT)
        b = refs.select("frame").join(pixels, "frame").select(F.col("frame").alias("pair"), "row", "col")
        d = chamfer(a, b, float("inf")).select(F.col("pair").alias("frame"), F.col("chamfer").alias("cd"))
        lone = near.where("frame IS NULL").select(F.col("pair").alias("frame"), F.lit(True).alias("lone"))
        empty = F.when(F.col("lone"), float("inf")).otherwise(0.0)
        out = out.join(d, "frame", "left").join(lone, "frame", "left").withColumn(f"cd_{kind}", F.coalesce("cd", empty)).drop("cd", "lone")
    return out


def finite_means(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of rows, and each column's mean over finite values, infinite where there is none."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    return rows.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(finite(c)), F.lit(float("inf"))).alias(c) for c in columns])


def clip_features(features: DataFrame, length: int = 16, stride: int = 8) -> DataFrame:
    """(set, seq_id, clip, embedding): the mean vector of every full clip of features (set, seq_id, frame_no from 0 without gaps, embedding)."""
    last = F.floor(F.col("frame_no") / stride).cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col("frame_no") - length + 1) / stride).cast("int"))
    at = features.where(first <= last).withColumn("clip", F.explode(F.sequence(first, last))).select("set", "seq_id", "clip", F.posexplode("embedding").alias("i", "x"))
    means = at.groupBy("set", "seq_id", "clip", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n")).where(F.col("n") == length)
    return means.groupBy("set", "seq_id", "clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))


def frechet_clips(features: DataFrame, length: int = 16, stride: int = 8) -> DataFrame:
    """Fréchet distance (full covariances) of two sets' clip features; NaN if a set has fewer than two clips."""
    return frechet_full(clip_features(features, length, stride))
