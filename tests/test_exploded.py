"""Tables that explode to far more rows than Spark's estimate says aren't sent whole to the driver."""

from pyspark.sql import functions as F

from framelake.operators import camera, metrics


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def canvas(spark, pairs, side):
    """(pair, row, col): every pixel of the pairs' canvases, estimated at the size of the pairs alone."""
    each = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    return spark.range(pairs).select(F.col("id").alias("pair"), each.alias("row")).select("pair", "row", each.alias("col"))


def test_a_region_of_whole_canvases_is_not_broadcast(spark):
    all_pixels = canvas(spark, 3, 8)
    pred, gt = all_pixels.where("row = 2"), all_pixels.where("row = 3 OR row = 7")
    region = all_pixels.where("row < 4 AND col < 6 AND pair < 2")
    found = metrics.prf_tolerant(pred, gt, region=region.union(region))
    assert "Broadcast" not in plan(found)
    assert {r.pair: round(r.f1, 4) for r in found.collect()} == {0: 1.0, 1: 1.0}


def views_of(spark, pairs):
    """(edges, depth, views) of pairs that see the same from both sides."""
    pixels, pose = canvas(spark, pairs, 8), {"fx": 10.0, "fy": 10.0, "cx": 4.0, "cy": 4.0, "qw": 1.0, "qx": 0.2, "qy": 0.1, "qz": 0.0, "tx": 0.5, "ty": 0.0, "tz": 0.1}
    views = spark.range(pairs).select(F.col("id").alias("pair"), *[F.lit(x).alias(f"{v}_{n}") for v in ("ref", "cur") for n, x in pose.items()])
    return pixels.where("(row + col) % 4 = 0"), pixels.withColumn("z", F.when(F.col("row") < 6, 2.0).otherwise(0.0)), views


def test_canvases_are_not_broadcast_to_be_reprojected(spark):
    found = camera.reproject(*views_of(spark, 3), 8, 8)
    assert "Broadcast" not in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [(p, r, c) for p in range(3) for r in range(6) for c in range(8) if (r + c) % 4 == 0]


def test_reprojected_canvases_are_compared_without_a_broadcast(spark):
    edges, depth, views = views_of(spark, 3)
    found = camera.reprojection_prf(edges.where("row < 6"), edges, depth, views, 8, 8)
    assert "Broadcast" not in plan(found)
    assert {r.pair: (round(r.precision, 4), round(r.recall, 4)) for r in found.collect()} == {p: (1.0, 1.0) for p in range(3)}
