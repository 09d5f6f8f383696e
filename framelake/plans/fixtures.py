"""Tables of frames, segments, pixels and grids, derived from the given tables by formulas that SQL can state too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("seq_id"), (F.row_number().over(w) - 1).alias("frame_no"), F.col("value").alias("conf"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("line_count"), (F.col("event_type") != "error").alias("valid"),
        F.col("event_id").alias("pos"), F.concat(F.lit("/d/u"), F.col("user_id")).alias("dir"))


FRAMES = """frames AS (SELECT user_id AS seq_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame_no, value AS conf,
  regexp_extract(props, '[0-9]+')::INT AS line_count, event_type <> 'error' AS valid, event_id AS pos, '/d/u' || user_id AS dir FROM events)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", "/"), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


PATHS = "paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') AS path FROM pages)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq_id"), F.col("turn").cast("int").alias("frame_no"),
                                                        F.length("text").alias("payload"), F.col("role").alias("dataset"))


TURNS = "turns AS (SELECT conv_id AS seq_id, turn::INT AS frame_no, length(text)::INT AS payload, role AS dataset FROM conversations)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("seq_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    at = lambda i: F.element_at("embedding", F.col("k") * 4 + i).cast("double")
    return e.select("frame", "seq_id", "k", *[(32 + 64 * at(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"), 1)], (0.5 + F.abs(at(1)) * 3).alias("score"))


SEGMENTS = """segments AS (SELECT vec_id AS frame, label AS seq_id, k::INT AS k, 32 + 64 * embedding[4 * k + 1]::DOUBLE AS x1, 32 + 64 *
  embedding[4 * k + 2]::DOUBLE AS y1,
  32 + 64 * embedding[4 * k + 3]::DOUBLE AS x2, 32 + 64 * embedding[4 * k + 4]::DOUBLE AS y2, 0.5 + abs(embedding[4 * k + 1]::DOUBLE) * 3 AS score
  FROM embeddings, (SELECT unnest(range(16)) AS k))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, prev): consecutive frames of a label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.lag("vec_id").over(w).alias("prev")).where("prev IS NOT NULL")


PAIRS = """pairs AS (SELECT * FROM (SELECT vec_id AS frame, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings) WHERE prev IS NOT NULL)"""

RASTER = """steps AS (SELECT frame, x1, y1, x2, y2, greatest(1, ceil(greatest(abs(x2 - x1), abs(y2 - y1))))::INT AS n FROM segments),
raster AS (SELECT DISTINCT frame, floor(y1 + (y2 - y1) * i / n + 0.5)::INT AS row, floor(x1 + (x2 - x1) * i / n + 0.5)::INT AS col
  FROM steps, LATERAL (SELECT unnest(range(n + 1)) AS i)),
pixels AS (SELECT * FROM raster WHERE row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63)"""


def grid8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("seq_id"), F.posexplode("embedding").alias("p", "e"))
    return e.select("frame", "seq_id", F.floor(F.col("p") / 8).cast("int").alias("row"), (F.col("p") % 8).alias("col"), (F.col("e").cast("double") + 0.5).alias("v"))


GRID8 = """grid8 AS (SELECT vec_id AS frame, label AS seq_id, (p // 8)::INT AS row, (p % 8)::INT AS col, embedding[p + 1]::DOUBLE + 0.5 AS v
  FROM embeddings, (SELECT unnest(range(64)) AS p))"""
