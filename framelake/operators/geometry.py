"""Line segments: transforms, features, raster pixels and nearest joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.consensus import agreeing_matches, consensus
from framelake.operators.nearest import nearest_k

ENDS = ("x1", "y1", "x2", "y2")


def rotate_flip(segs: DataFrame) -> DataFrame:
    """(x, y) -> (1 - y, 1 - x) on both ends."""
    return segs.withColumns({"x1": 1 - F.col("y1"), "y1": 1 - F.col("x1"), "x2": 1 - F.col("y2"), "y2": 1 - F.col("x2")})


def swap_xy(segs: DataFrame) -> DataFrame:
    return segs.withColumns({"x1": F.col("y1"), "y1": F.col("x1"), "x2": F.col("y2"), "y2": F.col("x2")})


def denormalize(segs: DataFrame, size: float = 1.0, record: str = "frame", scope: str = "record", threshold: float = 1.5, form: str = "size",
                width: float | None = None, height: float | None = None) -> DataFrame:
    """Scale coordinates that look normalised: all of a record's (or, `scope="line"`, a segment's) are at most `threshold` in size. `form`:
    `size`; `last`, the last pixel size - 1; `sides`, x by the width and y by the height; `observed`, whatever the threshold to `size` by the
    record's largest coordinate and one."""
    top = F.greatest(*[F.abs(F.col(c)) for c in ENDS])
    top = F.max(top).over(Window.partitionBy(record)) if scope == "record" else top
    rows = segs.withColumn("~t", top)
    if form == "observed":
        return rows.withColumns({c: F.col(c) * size / (F.col("~t") + 1) for c in ENDS}).drop("~t")
    by = {"size": (size, size), "last": (size - 1, size - 1), "sides": (width or size, height or size)}[form]
    scaled = {c: F.when(F.col("~t") <= threshold, F.col(c) * by[c[0] == "y"]).otherwise(F.col(c)) for c in ENDS}
    return rows.withColumns(scaled).drop("~t")


def score_filter(segs: DataFrame, th: float) -> DataFrame:
    return segs.where(F.coalesce("score", F.lit(1.0)) > th)


def segment_features(segs: DataFrame, keep: list[str]) -> DataFrame:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = F.sqrt(dx * dx + dy * dy)
    return segs.select(*keep, ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"),
                       (dx / (length + 1e-8)).alias("ux"), (dy / (length + 1e-8)).alias("uy"), length.alias("length"))


def rasterize(segs: DataFrame, frame: str = "frame", width: int = 64, height: int = 64, scale: float = 1.0) -> DataFrame:
    """(frame, row, col): one pixel per step along each segment's longer axis, rounded half up; pixels off the canvas are left out."""
    x1, y1, x2, y2 = (F.col(c) * scale for c in ENDS)
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(x2 - x1), F.abs(y2 - y1)))).cast("int")
    steps = segs.select(frame, x1.alias("x"), y1.alias("y"), (x2 - x1).alias("dx"), (y2 - y1).alias("dy"), n.alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    cell = steps.select(frame, F.floor(F.col("y") + F.col("dy") * F.col("i") / F.col("n") + 0.5).cast("int").alias("row"),
                        F.floor(F.col("x") + F.col("dx") * F.col("i") / F.col("n") + 0.5).cast("int").alias("col"))
    return cell.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).distinct()


#: Ends are taken as whole numbers within so many pixels of the origin.
FARTHEST = 1_000_000


def raster_lines(segs: DataFrame, frame: str = "frame", width: int = 64, height: int = 64, scale: float = 1.0, ends: str = "truncated") -> DataFrame:
    """(frame, row, col): the pixels of segments whose ends are pixels, walked in whole numbers along the longer axis (the column's where both are
    alike), the other axis rounded half up. `ends`: `truncated` cuts the fraction off scaled ends, and the line is clipped to the canvas by its
    parameter, so steps beyond it are never made; `clipped` rounds ends half to even and moves them onto the canvas, which may turn the line.
    Ends beyond FARTHEST count as there; segments with an end that is no number are left out."""
    if ends not in ("truncated", "clipped"):
        raise ValueError(ends)
    size = {"x": width, "y": height}
    known = segs
    for c in ENDS:
        known = known.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    near = lambda c: F.least(F.lit(float(FARTHEST)), F.greatest(F.lit(float(-FARTHEST)), F.col(c).cast("double") * scale))
    if ends == "truncated":
        spot = {c: near(c).cast("long") for c in ENDS}
    else:
        spot = {c: F.least(F.lit(size[c[0]] - 1), F.greatest(F.lit(0), F.rint(near(c)).cast("long"))).cast("long") for c in ENDS}
    whole = known.select(frame, *[v.alias(c) for c, v in spot.items()])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    flat = F.abs(dx) >= F.abs(dy)
    pick = lambda x, y: F.when(F.col("flat"), x).otherwise(y)
    walk = whole.withColumn("flat", flat).select(
        frame, "flat", pick(F.col("x1"), F.col("y1")).alias("a"), pick(F.col("y1"), F.col("x1")).alias("b"), F.greatest(F.abs(dx), F.abs(dy)).alias("n"),
        F.signum(pick(dx, dy)).cast("long").alias("s"), pick(dy, dx).alias("d"), pick(F.lit(width), F.lit(height)).alias("la"), pick(F.lit(height), F.lit(width)).alias("lb"))
    # Steps i of 0 to n that stay on the canvas: along the walk by a + s i, across it by b + floor((2 d i + n) / 2n).
    up = lambda p, q: -F.floor(-p / q)
    span = F.greatest(F.lit(1), 2 * F.abs(F.col("d")))
    low = F.when(F.col("s") >= 0, -F.col("a")).otherwise(F.col("a") - F.col("la") + 1)
    high = F.when(F.col("s") >= 0, F.col("la") - 1 - F.col("a")).otherwise(F.col("a"))
    n, b, lb = F.col("n"), F.col("b"), F.col("lb")
    low2 = F.when(F.col("d") > 0, up(-2 * n * b - n, span)).when(F.col("d") < 0, F.floor((n - 2 * n * (lb - b)) / span) + 1).otherwise(0)
    high2 = F.when(F.col("d") > 0, up(2 * n * (lb - b) - n, span) - 1).when(F.col("d") < 0, F.floor((2 * n * b + n) / span)).otherwise(n)
    walk = walk.withColumns({"i0": F.greatest(F.lit(0), low, low2), "i1": F.least(n, high, high2)})
    inside = (F.col("i0") <= F.col("i1")) & F.when(n == 0, F.col("a").between(0, F.col("la") - 1)).otherwise(True) & F.when(F.col("d") == 0, b.between(0, lb - 1)).otherwise(True)
    steps = walk.where(inside).withColumn("i", F.explode(F.sequence("i0", "i1")))
    along = F.col("a") + F.col("s") * F.col("i")
    across = b + F.floor((2 * F.col("d") * F.col("i") + n) / F.greatest(F.lit(1), 2 * n))
    return steps.select(frame, pick(across, along).cast("int").alias("row"), pick(along, across).cast("int").alias("col")).distinct()


def rasterize_aa(segs: DataFrame, frame: str = "frame", width: int = 64, height: int = 64) -> DataFrame:
    """(frame, row, col, v): like rasterize, with the two pixels across the minor axis weighted by coverage; the largest value of all segments stands."""
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(x2 - x1), F.abs(y2 - y1)))).cast("int")
    steps = segs.select(frame, *ENDS, n.alias("n"), (F.abs(x2 - x1) >= F.abs(y2 - y1)).alias("flat")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    x, y = x1 + (x2 - x1) * F.col("i") / F.col("n"), y1 + (y2 - y1) * F.col("i") / F.col("n")
    minor = F.when(F.col("flat"), y).otherwise(x)
    major = F.floor(F.when(F.col("flat"), x).otherwise(y) + 0.5)
    low = F.floor(minor)
    both = steps.select(frame, "flat", major.alias("major"), F.explode(F.array(F.struct(low.alias("m"), (1 - (minor - low)).alias("v")), F.struct((low + 1).alias("m"), (minor - low).alias("v")))).alias("p"))
    cell = both.select(frame, F.when(F.col("flat"), F.col("p.m")).otherwise(F.col("major")).cast("int").alias("row"),
                       F.when(F.col("flat"), F.col("major")).otherwise(F.col("p.m")).cast("int").alias("col"), F.col("p.v").alias("v"))
    return cell.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1) & (F.col("v") > 0)).groupBy(frame, "row", "col").agg(F.max("v").alias("v"))


def coarse_match(a: DataFrame, b: DataFrame, dist: float, angle: float, undirected: bool = False) -> DataFrame:
    """(pair, ka, kb): segments of a pair whose centres are within `dist` and directions within `angle` radians. Inputs: features with (pair, k).
    Centres meet by cells of `dist` and the eight around, never all against all."""
    cell = lambda c: F.floor(F.col(c) / dist)
    left = a.select("pair", F.col("k").alias("ka"), *[F.col(c).alias(c + "a") for c in ("cx", "cy", "ux", "uy")])
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    left = left.withColumn("gx", F.explode(F.transform(around, lambda i: i + cell("cxa")))).withColumn("gy", F.explode(F.transform(around, lambda i: i + cell("cya"))))
    right = b.select("pair", F.col("k").alias("kb"), *[F.col(c).alias(c + "b") for c in ("cx", "cy", "ux", "uy")]).withColumn("gx", cell("cxb")).withColumn("gy", cell("cyb"))
    dot = F.col("uxa") * F.col("uxb") + F.col("uya") * F.col("uyb")
    dot = F.abs(dot) if undirected else dot
    met = left.join(right, ["pair", "gx", "gy"])
    near = (F.col("cxa") - F.col("cxb")) ** 2 + (F.col("cya") - F.col("cyb")) ** 2 <= dist * dist
    return met.where(near & (F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))) <= angle)).select("pair", "ka", "kb")


def idw_warp(points: DataFrame, matches: DataFrame, k: int = 4) -> DataFrame:
    """(pair, pt, wx, wy): each point moved by the inverse-distance mean of its k nearest matches' displacement.
    points: (pair, pt, x, y); matches: (pair, m, x0, y0, x1, y1)."""
    near = nearest_k(points, matches.withColumns({"tx": F.col("x0"), "ty": F.col("y0")}), k)
    w = 1 / (F.col("d") + 1e-6)
    return near.groupBy("pair", "pt").agg((F.first("x") + F.sum(w * (F.col("x1") - F.col("x0"))) / F.sum(w)).alias("wx"),
                                          (F.first("y") + F.sum(w * (F.col("y1") - F.col("y0"))) / F.sum(w)).alias("wy"))


def snap_to_junctions(segs: DataFrame, junctions: DataFrame) -> DataFrame:
    """(frame, j1, j2): both ends to their nearest junction, kept if these differ, once per unordered pair. junctions: (frame, j, jx, jy)."""
    ends = segs.select("frame", "k", F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.col(x).alias("x"), F.col(y).alias("y")) for e, x, y in ((1, "x1", "y1"), (2, "x2", "y2"))])).alias("p"))
    spots = junctions.select("frame", "j", F.col("jx").alias("tx"), F.col("jy").alias("ty"))
    near = nearest_k(ends.select("frame", "k", "p.e", "p.x", "p.y"), spots, 1, "frame", ("k", "e"), "j", squared=True)
    both = near.groupBy("frame", "k").agg(F.min("j").alias("j1"), F.max("j").alias("j2"))
    return both.where("j1 != j2").select("frame", "j1", "j2").distinct()


def warp_homography(points: DataFrame, h: list[float], width: int, height: int) -> DataFrame:
    """Points (frame, k, x, y) by a 3x3 matrix, to the nearest pixel; those off the canvas or at infinity are dropped."""
    x, y = F.col("x"), F.col("y")
    w = h[6] * x + h[7] * y + h[8]
    out = points.where(F.abs(w) > 1e-12).select("frame", "k", F.floor((h[0] * x + h[1] * y + h[2]) / w + 0.5).cast("int").alias("col"),
                                                F.floor((h[3] * x + h[4] * y + h[5]) / w + 0.5).cast("int").alias("row"))
    return out.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))


def fit_homography(matches: DataFrame, thresh: float = 3.0, draws: int = 2_000, confidence: float = 0.99) -> DataFrame:
    """(pair, inliers, h): the matrix fitted to a pair's agreeing matches (see consensus); null under four. matches: (pair, m, x0, y0, x1, y1)."""
    return consensus(matches, thresh, draws, confidence).select("pair", "inliers", "h")


def three_frame_match(triples: DataFrame, segs: DataFrame, dist: float, angle: float, thresh: float = 3.0, draws: int = 2_000) -> DataFrame:
    """(frame, k): the current frame's segments that match those of the next frame which match the previous one's, each once. All segments
    stand where a step has under four inliers, and in first and last frames. triples: (frame, prev, next); segs: (frame, k, x1, y1, x2, y2)."""
    f = segment_features(segs, ["frame", "k"])
    own = triples.where("prev IS NOT NULL AND next IS NOT NULL").withColumn("here", F.col("frame"))
    side = {c: own.select(F.col("frame").alias("pair"), F.col(c).alias("frame")).join(f, "frame").drop("frame") for c in ("prev", "next", "here")}

    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        met = coarse_match(a, b, dist, angle).withColumn("m", F.col("ka").cast("long") * F.lit(2**31) + F.col("kb"))
        ends = [x.select("pair", F.col("k").alias(k), F.col("cx").alias(f"x{i}"), F.col("cy").alias(f"y{i}")) for i, (x, k) in enumerate(((a, "ka"), (b, "kb")))]
        m = met.join(ends[0], ["pair", "ka"]).join(ends[1], ["pair", "kb"])
        return m.join(agreeing_matches(m.select("pair", "m", "x0", "y0", "x1", "y1"), thresh, draws), ["pair", "m"])

    kept = step(side["prev"], side["next"]).select("pair", F.col("kb").alias("k")).distinct()
    found = step(side["next"].join(kept, ["pair", "k"], "left_semi"), side["here"]).select(F.col("pair").alias("frame"), F.col("kb").alias("k")).distinct()
    rest = triples.select("frame").join(found, "frame", "left_anti").join(segs.select("frame", "k"), "frame")
    return found.unionByName(rest)


def quat_to_rot(q: list[Column], normalize: bool = True) -> list[Column]:
    """Nine entries, row by row, of the rotation of a quaternion (w, x, y, z); of one that isn't of length one as it stands, where
    `normalize` is off."""
    n = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0])) if normalize else F.lit(1.0)
    w, x, y, z = (c / n for c in q)
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
            2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]
