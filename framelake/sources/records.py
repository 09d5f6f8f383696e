"""Records in binary and text files of cameras, segments, alignments and depth: parsed in tasks, one file a row.

The parsers take a table of files (path, content), as Spark's `binaryFile` reader gives; unreadable files give what the docstrings say.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.sources.text import number_lines, split_lines

#: What a pickled record may be built of: NumPy arrays and numbers; anything else makes the file unreadable.
ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"),
           ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"), ("numpy.core.numeric", "_frombuffer"), ("numpy._core.numeric", "_frombuffer")}


class _Numbers(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) not in ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} isn't allowed")
        return super().find_class(module.replace("numpy.core", "numpy._core"), name)


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content) of files, or of all files below folders."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "content")


def _segments_of(content: bytes) -> tuple[list[list[float]], list | None]:
    record = _Numbers(io.BytesIO(content)).load()
    scores = None
    if isinstance(record, dict):
        lines, scores = record.get("lines", record.get("lines_pred")), record.get("scores", record.get("score"))
    else:
        lines = record
    rows = [np.asarray(x, dtype=float).ravel().tolist() for x in lines] if isinstance(lines, list | tuple | np.ndarray) else []
    return rows, None if scores is None else np.asarray(scores, dtype=float).ravel().tolist()


def parse_segments(files: DataFrame) -> DataFrame:
    """(path, seg_no, c1, c2, c3, c4, score) of pickled records: the key `lines`, else `lines_pred`, else a bare list. Rows that don't have
    four numbers are dropped and keep their number, so that scores stay with their rows; a missing score is null. An unreadable file, or
    one that would build other objects than arrays and numbers, has no segments."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows, scores = _segments_of(content)
                except Exception:  # whatever a broken file does, it has no segments
                    continue
                out += [(path, i, *r, scores[i] if scores is not None and i < len(scores) else None) for i, r in enumerate(rows) if len(r) == 4]
            yield pd.DataFrame(out, columns=["path", "seg_no", "c1", "c2", "c3", "c4", "score"])

    return files.select("path", "content").mapInPandas(parse, "path string, seg_no int, c1 double, c2 double, c3 double, c4 double, score double")


def parse_alignments(files: DataFrame) -> DataFrame:
    """(path, npz_ok, valid, confidence_iou, homography) of NumPy archives: `valid` false and `confidence_iou` 0 where the key is absent, the
    matrix of nine numbers null; an unreadable archive, or one with pickled objects, has npz_ok false and these defaults."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        h = z["homography"].astype(float).ravel().tolist() if "homography" in z else None
                        out.append((path, True, bool(z["valid"]) if "valid" in z else False, float(z["confidence_iou"]) if "confidence_iou" in z else 0.0, h))
                except Exception:  # whatever a broken file does, it gives the defaults
                    out.append((path, False, False, 0.0, None))
            yield pd.DataFrame(out, columns=["path", "npz_ok", "valid", "confidence_iou", "homography"])

    return files.select("path", "content").mapInPandas(parse, "path string, npz_ok boolean, valid boolean, confidence_iou double, homography array<double>")


def parse_depth(files: DataFrame) -> DataFrame:
    """(path, row, col, z): the positive depths of maps with a header `width&height&channels&` and float32 values row by row; of several
    channels the first. A file without a whole header or of another size is an error, as half a map is no map."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                head = content.split(b"&", 3)
                if len(head) < 4:
                    raise ValueError(f"{path}: no header of three numbers")
                width, height, channels = (int(x) for x in head[:3])
                if len(head[3]) < 4 * width * height * channels:
                    raise ValueError(f"{path}: {len(head[3])} bytes for {width} x {height} x {channels} values")
                z = np.frombuffer(head[3], "<f4", width * height * channels).reshape(height, width, channels)[:, :, 0].astype(float)
                row, col = np.nonzero(z > 0)
                yield pd.DataFrame({"path": path, "row": row, "col": col, "z": z[row, col]})

    return files.select("path", "content").mapInPandas(parse, "path string, row int, col int, z double")


def _tokens(spark: SparkSession, path: str | list[str]) -> DataFrame:
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.split(line, r"\s+").alias("t"))


def read_cameras(spark: SparkSession, path: str | list[str], target: float | None = None) -> DataFrame:
    """(camera_id, model, width, height, fx, fy, cx, cy) of a camera list: one focal length in the models SIMPLE_PINHOLE, SIMPLE_RADIAL and
    RADIAL, two in all others; scaled to a square of side `target` where given. Blank lines and comments are skipped."""
    at = lambda i: F.get("t", F.lit(i))
    one = at(1).isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL")
    p = [at(4 + i).cast("double") for i in range(4)]
    width, height = at(2).cast("int"), at(3).cast("int")
    sx, sy = (F.lit(1.0),) * 2 if target is None else (F.lit(float(target)) / width, F.lit(float(target)) / height)
    k = {"fx": p[0] * sx, "fy": F.when(one, p[0]).otherwise(p[1]) * sy, "cx": F.when(one, p[1]).otherwise(p[2]) * sx, "cy": F.when(one, p[2]).otherwise(p[3]) * sy}
    return _tokens(spark, path).select(at(0).cast("int").alias("camera_id"), at(1).alias("model"), width.alias("width"), height.alias("height"), *[c.alias(n) for n, c in k.items()])


def _image_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, pos, line, points) of the image lines of image lists: an image takes two lines, its pose and its points, and the second may be blank.
    A blank line or a comment in place of a pose is skipped, so after one a pose follows: poses stand at the even places of a run of other lines.
    The last blank line or comment before a split, one number a split, is carried over, so a file's splits are worked on apart."""
    lines = number_lines(split_lines(spark, path)).withColumn("skip", (F.col("line") == "") | F.col("line").startswith("#"))
    split = Window.partitionBy("file", "block").orderBy("pos")
    lines = lines.withColumn("last", F.max(F.when(F.col("skip"), F.col("pos"))).over(split.rowsBetween(Window.unboundedPreceding, -1)))
    lines = lines.withColumn("next", F.lead("line").over(split))
    splits = lines.groupBy("file", "block").agg(F.max(F.when(F.col("skip"), F.col("pos"))).alias("skipped"), F.max("pos").alias("end"),
                                                F.min_by("line", "pos").alias("head"))
    whole = Window.partitionBy("file").orderBy("block")
    carried = splits.select("file", "block", "end", F.max("skipped").over(whole.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                            F.lead("head").over(whole).alias("following"))
    lines = lines.join(carried, ["file", "block"])
    place = F.col("pos") - F.coalesce("last", "before", F.lit(-1)) - 1
    points = F.when(F.col("pos") == F.col("end"), F.col("following")).otherwise(F.col("next"))
    return lines.where(~F.col("skip") & (place % 2 == 0)).select("file", "pos", "line", F.coalesce(points, F.lit("")).alias("points"))


def read_poses(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(image_id, qw, qx, qy, qz, tx, ty, tz, camera_id, name) of image lists, whose every other line is a pose (see _image_lines). A pose of fewer
    than ten words or whose id is no whole number is skipped, as a broken line; its points go with it."""
    t, at = F.split("line", r"\s+"), lambda i: F.get("t", F.lit(i))
    rows = _image_lines(spark, path).select(t.alias("t")).where(at(0).rlike(r"^[+-]?\d+$") & (F.size("t") >= 10))
    numbers = [at(i + 1).cast("double").alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"))]
    return rows.select(at(0).cast("int").alias("image_id"), *numbers, at(8).cast("int").alias("camera_id"), at(9).alias("name"))


def read_points(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(image_id, point_no, x, y, point3d_id) of image lists: the numbers of the line after each pose, three a point; -1 is a point that belongs
    to no point in space. Images of a blank line have no points."""
    rows = _image_lines(spark, path).select(F.get(F.split("line", r"\s+"), F.lit(0)).alias("id"), F.split("points", r"\s+").alias("p"))
    rows = rows.where(F.col("id").rlike(r"^[+-]?\d+$"))
    many = F.floor(F.size("p") / 3)
    each = rows.where(F.size("p") >= 3).select("id", "p", F.explode(F.sequence(F.lit(0), many - 1)).alias("k"))
    at = lambda i: F.get("p", (F.col("k") * 3 + i).cast("int"))
    return each.select(F.col("id").cast("int").alias("image_id"), F.col("k").cast("int").alias("point_no"), at(0).cast("double").alias("x"),
                       at(1).cast("double").alias("y"), at(2).cast("long").alias("point3d_id"))


def frame_name(name: Column) -> Column:
    """An image's name without folder and ending."""
    return F.regexp_replace(F.substring_index(name, "/", -1), r"(.)\.[^.]*$", "$1")


def camera_model(cameras: DataFrame, poses: DataFrame) -> DataFrame:
    """Every pose with its camera's numbers, as (frame_name, image_id, ...); a pose of an unknown camera is an error."""
    met = poses.join(cameras, "camera_id", "left").withColumn("frame_name", frame_name(F.col("name")))
    known = F.when(F.col("model").isNull(), F.raise_error(F.concat(F.lit("unknown camera "), F.col("camera_id")))).otherwise(F.col("model"))
    return met.withColumn("model", known)
