"""Flow fields as tables of pixels, (pair, row, col, fx, fy): sampling, shrinking and warping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPOT = ["pair", "row", "col"]


def _clip(x: Column, top: int) -> Column:
    return F.least(F.lit(top), F.greatest(F.lit(0), x))


def _on_canvas(row: Column, col: Column, height: int, width: int) -> Column:
    return row.between(0, height - 1) & col.between(0, width - 1)


def bilinear_sample(flow: DataFrame, points: DataFrame, height: int, width: int) -> DataFrame:
    """(pair, pt, fx, fy): the flow at points (pair, pt, x, y), clipped to the canvas, from the four pixels around, one equi-join row each.
    The right and lower neighbours are clipped as well, so all weights vanish on the last row and column, and the sample is 0 there."""
    at = points.select("pair", "pt", _clip(F.col("x"), width - 1).alias("x"), _clip(F.col("y"), height - 1).alias("y"))
    x0, y0 = F.floor("x"), F.floor("y")
    x1, y1 = F.least(x0 + 1, F.lit(width - 1)), F.least(y0 + 1, F.lit(height - 1))
    corners = [F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"), (wr * wc).alias("w"))
               for r, wr in ((y0, y1 - F.col("y")), (y1, F.col("y") - y0)) for c, wc in ((x0, x1 - F.col("x")), (x1, F.col("x") - x0))]
    met = at.select("pair", "pt", F.explode(F.array(*corners)).alias("c")).select("pair", "pt", "c.*").join(flow, SPOT, "left")
    return met.groupBy("pair", "pt").agg(*[F.coalesce(F.sum(F.col("w") * F.col(f)), F.lit(0.0)).alias(f) for f in ("fx", "fy")])


def sample(grid: DataFrame, points: DataFrame, height: int, width: int) -> DataFrame:
    """(pair, pt, v): the grid (pair, row, col, v) at points on the canvas (pair, pt, x, y), bilinear between the four pixels around."""
    x0, y0 = F.floor("x"), F.floor("y")
    dx, dy = F.col("x") - x0, F.col("y") - y0
    corners = [F.struct(_clip(y0 + i, height - 1).cast("int").alias("row"), _clip(x0 + j, width - 1).cast("int").alias("col"), (wy * wx).alias("w"))
               for i, wy in ((0, 1 - dy), (1, dy)) for j, wx in ((0, 1 - dx), (1, dx))]
    met = points.select("pair", "pt", F.explode(F.filter(F.array(*corners), lambda c: c["w"] > 0)).alias("c")).select("pair", "pt", "c.*").join(grid.select(*SPOT, "v"), SPOT)
    return met.groupBy("pair", "pt").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def warp_points(flow: DataFrame, points: DataFrame, height: int, width: int) -> DataFrame:
    """(pair, pt, wx, wy): each point moved by the flow sampled at it."""
    moved = points.join(bilinear_sample(flow, points, height, width), ["pair", "pt"])
    return moved.select("pair", "pt", (F.col("x") + F.col("fx")).alias("wx"), (F.col("y") + F.col("fy")).alias("wy"))


def downsample_flow(flow: DataFrame, ds: int) -> DataFrame:
    """Means of ds x ds blocks, with the vectors divided by ds; exact where both sides divide by ds."""
    block = [F.floor(F.col(c) / ds).cast("int").alias(c) for c in ("row", "col")]
    return flow.groupBy("pair", *block).agg(*[(F.avg(f) / ds).alias(f) for f in ("fx", "fy")])


def warp_forward(grid: DataFrame, flow: DataFrame, height: int, width: int) -> DataFrame:
    """(pair, row, col, v): values scattered to the nearest pixel that the flow points to, clipped to the canvas; of several the largest stays."""
    row, col = (_clip(F.floor(F.col(p) + F.col(f) + 0.5), n - 1).cast("int").alias(p) for p, f, n in (("row", "fy", height), ("col", "fx", width)))
    return grid.join(flow, SPOT).select("pair", row, col, "v").groupBy(*SPOT).agg(F.max("v").alias("v"))


def warp_backward(grid: DataFrame, flow: DataFrame, height: int, width: int, outside: float = 0.0) -> DataFrame:
    """(pair, row, col, v): each pixel takes the value that the flow, or its negative, points to; a pair uses the sign that keeps more of its
    pixels on the canvas, the positive one of equal ones. Pixels that point off the canvas get `outside`."""
    to = {s: (F.floor(F.col("row") + s * F.col("fy") + 0.5), F.floor(F.col("col") + s * F.col("fx") + 0.5)) for s in (1, -1)}
    share = flow.groupBy("pair").agg(*[F.sum(_on_canvas(*to[s], height, width).cast("int")).alias(n) for s, n in ((1, "plus"), (-1, "minus"))])
    sign = share.select("pair", (F.col("plus") >= F.col("minus")).alias("forward"))
    aim = flow.join(sign, "pair").select("pair", F.col("row").alias("r"), F.col("col").alias("c"),
                                         *[F.when(F.col("forward"), to[1][i]).otherwise(to[-1][i]).cast("int").alias(n) for i, n in enumerate(("row", "col"))])
    return aim.join(grid.select(*SPOT, "v"), SPOT, "left").select("pair", F.col("r").alias("row"), F.col("c").alias("col"), F.coalesce("v", F.lit(outside)).alias("v"))
