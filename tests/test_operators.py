"""Quirks and edge cases on tiny hand-made frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import paths as P
from framelake.operators import camera, gates, geometry, grids, matching, metrics, sequences


def masks(spark, pred, gt):
    return tuple(spark.createDataFrame(x, "pair int, row int, col int") for x in (pred, gt))


def test_one_empty_side_keeps_its_pair(spark):
    pred, gt = masks(spark, [(1, 0, 0), (2, 3, 4)], [(1, 0, 0)])
    assert {r.pair: r.chamfer for r in metrics.chamfer(pred, gt, 1e6).collect()} == {1: 0.0, 2: 1e6}
    assert {r.pair: r.f1 for r in metrics.prf(pred, gt).collect()} == {1: 1.0, 2: 0.0}


def test_far_pixels_meet_all_cells(spark):
    pred, gt = masks(spark, [(1, 0, 0)], [(1, 60, 0), (1, 0, 50)])
    assert metrics.nearest_distance(pred, gt).first().d == 50.0


def test_metrics_are_symmetric(spark):
    a, b = masks(spark, [(1, 0, 0), (1, 2, 2)], [(1, 0, 1), (1, 5, 5), (1, 2, 2)])
    for f in (metrics.mask_iou, metrics.chamfer):
        assert f(a, b).first()[1] == pytest.approx(f(b, a).first()[1])
    assert metrics.chamfer(a, a).first().chamfer == 0.0


def test_dilation_contains_erosion(spark):
    m = spark.createDataFrame([(1, r, c) for r in range(2, 6) for c in range(2, 6)], "frame int, row int, col int")
    rows = lambda d: {tuple(r) for r in d.select("frame", "row", "col").collect()}
    assert rows(grids.erode(m, 1, 8, 8)) < rows(m) < rows(grids.dilate(m, 1, 8, 8))
    assert rows(grids.close(m, 1, 8, 8)) == rows(m)


def test_single_frame_sequence_counts_its_metric(spark):
    f = spark.createDataFrame([(1, 0, 50, 3.0), (2, 0, 50, 9.0), (2, 1, 50, 1.0)], "seq_id int, frame_no int, line_count int, conf double")
    assert {r.seq_id: r.mean_metric for r in gates.sequence_stats(f).collect()} == {1: 3.0, 2: 1.0}


def test_missing_metric_is_rejected(spark):
    f = spark.createDataFrame([(1, 0, 50, None), (1, 1, 50, None)], "seq_id int, frame_no int, line_count int, conf double")
    assert gates.gate_sequences(f).first().reason == "bad_chamfer"


def test_match_pairs_leaves_ambiguous_stems(spark):
    rows = lambda x: spark.createDataFrame(x, "path string, rel string, stem string")
    pred, gt = rows([("a", "d/1", "1"), ("b", "e/2", "2"), ("c", "f/2", "2"), ("d", "g/3", "3")]), rows([("x", "d/1", "1"), ("y", "h/2", "2"), ("z", "h/3", "3")])
    assert {tuple(r) for r in matching.match_pairs(pred, gt).collect()} == {("a", "x", 1), ("d", "z", 2)}
    assert {tuple(r) for r in matching.match_unmatched(pred, gt).collect()} == {("pred", "b"), ("pred", "c"), ("gt", "y")}


def test_unequal_lists_are_an_error(spark):
    a = spark.createDataFrame([(0, "x")], "pos long, img string")
    with pytest.raises(ValueError):
        matching.zip_manifests(a, spark.createDataFrame([], "pos long, pkl string"))


def test_ranks_are_padded_to_one_length(spark):
    f = spark.createDataFrame([(i,) for i in range(10)], "seq_id int")
    assert {r["count"] for r in sequences.balanced_ranks(f, 4).groupBy("rank").count().collect()} == {3}


def test_result_is_the_same_for_any_partitioning(spark):
    f = spark.range(2000).select(F.col("id").alias("pos"), (F.col("id") % 7).alias("seq_id"), F.floor(F.col("id") / 7).alias("frame_no"))
    want = sorted(map(tuple, sequences.frame_refs(f).collect()))
    for n in (1, 7, 64):
        assert sorted(map(tuple, sequences.frame_refs(f.repartition(n)).collect())) == want


def test_paths(spark):
    one = spark.createDataFrame([("/r/a_imgs/short/longseq/f_2.JPG",)], "p string")
    r = one.select(P.seq_id_marker(F.col("p")).alias("m"), P.stem(F.col("p")).alias("s"), P.extension(F.col("p")).alias("e"), P.last_number(F.col("p")).alias("n"),
                   P.norm_path(F.lit("/a//b/./../c/")).alias("n2")).first()
    assert (r.m, r.s, r.e, r.n, r.n2) == ("longseq", "f_2", ".jpg", 2.0, "/a/c")
    names = spark.createDataFrame([("a10b1",), ("a2b10",), ("a2b9",)], "n string")
    assert [r.n for r in names.orderBy(P.natural_key(F.col("n"))).collect()] == ["a2b9", "a2b10", "a10b1"]


def test_reversed_segment_matches_only_undirected(spark):
    f = spark.createDataFrame([(1, 0, 5.0, 5.0, 1.0, 0.0)], "pair int, k int, cx double, cy double, ux double, uy double")
    g = f.withColumn("ux", -F.col("ux"))
    assert geometry.coarse_match(f, g, 2.0, 0.1).count() == 0
    assert geometry.coarse_match(f, g, 2.0, 0.1, undirected=True).count() == 1


def test_homography_needs_four_matches(spark):
    rows = [(1, i, float(x), float(y), x + 2.0, y - 1.0) for i, (x, y) in enumerate([(0, 0), (9, 1), (2, 8), (7, 7), (4, 3)])] + [(2, 0, 0.0, 0.0, 1.0, 1.0)]
    got = {r.pair: r for r in geometry.fit_homography(spark.createDataFrame(rows, "pair long, m int, x0 double, y0 double, x1 double, y1 double")).collect()}
    assert got[1].inliers == 5 and got[2].h is None


def test_specular_mask_keeps_large_bright_components(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    square = [(1, r, c, 1.0, 1.0, 0.98) for r in range(2) for c in range(2)]
    rows = square + [(1, 6, 6, 1.0, 1.0, 1.0), (1, 0, 6, 1.0, 0.2, 0.2), (1, 7, 0, 0.0, 0.0, 0.0)]
    rgb = spark.createDataFrame(rows, "frame int, row int, col int, r double, g double, b double")
    got = grids.specular_mask(rgb, 8, 8, radius=0, min_area=3).collect()
    assert sorted((r.row, r.col) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert grids.specular_mask(rgb.limit(0), 8, 8).count() == 0


def test_three_frames_keep_what_all_share(spark):
    where = [(5.0, 5.0), (40.0, 8.0), (10.0, 45.0), (50.0, 50.0), (25.0, 30.0)]
    segs = [(f, k, x + f, y, x + f + 6, y + 2) for f in (0, 1, 2) for k, (x, y) in enumerate(where)] + [(1, 9, 60.0, 20.0, 60.0, 30.0), (7, 0, 1.0, 1.0, 2.0, 2.0)]
    s = spark.createDataFrame(segs, "frame int, k int, x1 double, y1 double, x2 double, y2 double")
    triples = spark.createDataFrame([(0, None, 1), (1, 0, 2), (2, 1, None), (7, None, None)], "frame int, prev int, next int")
    got = {}
    for r in geometry.three_frame_match(triples, s, 4.0, 0.5).collect():
        got.setdefault(r.frame, []).append(r.k)
    assert {f: sorted(k) for f, k in got.items()} == {0: [0, 1, 2, 3, 4], 1: [0, 1, 2, 3, 4], 2: [0, 1, 2, 3, 4], 7: [0]}


def test_clips_need_all_their_frames(spark):
    rows = [(s, s, i, [float(i), float(s)]) for s in (0, 1) for i in range(6)]
    f = spark.createDataFrame(rows, "set int, seq_id int, frame_no int, embedding array<double>")
    got = sorted((r.set, r.clip, list(r.embedding)) for r in metrics.clip_features(f, 4, 2).collect())
    assert got == [(0, 0, [1.5, 0.0]), (0, 1, [3.5, 0.0]), (1, 0, [1.5, 1.0]), (1, 1, [3.5, 1.0])]
    assert abs(metrics.frechet_clips(f, 4, 2).first()[0] - 1.0) < 1e-9
    assert math.isnan(metrics.frechet_clips(f, 6, 2).first()[0])


def test_missing_sides_of_alignment_and_references(spark):
    seg = "pair int, x1 double, y1 double, x2 double, y2 double"
    pairs = spark.createDataFrame([(1,), (2,)], "pair int")
    both = spark.createDataFrame([(1, 1.0, 1.0, 5.0, 1.0)], seg)
    got = {r.pair: (r.iou, r.endpoint_err, r.valid) for r in metrics.pair_alignment(pairs, both, both, 8, 8).collect()}
    assert got == {1: (1.0, 0.0, True), 2: (0.0, 1e6, False)}
    refs = spark.createDataFrame([(1, 1, None), (2, 1, 3), (3, 4, 4)], "frame int, global int, local int")
    px = spark.createDataFrame([(1, 0, 0), (2, 0, 3)], "frame int, row int, col int")
    cd = {r.frame: (r.cd_global, r.cd_local) for r in metrics.reference_consistency(refs, px).collect()}
    assert cd == {1: (0.0, math.inf), 2: (3.0, math.inf), 3: (0.0, 0.0)}


def test_identical_views_reproject_onto_themselves(spark):
    names = [f"{v}_{n}" for v in ("ref", "cur") for n in ("fx", "fy", "cx", "cy", "qw", "qx", "qy", "qz", "tx", "ty", "tz")]
    pose = [10.0, 10.0, 4.0, 4.0, 1.0, 0.2, 0.1, 0.0, 0.5, 0.0, 0.1]
    views = spark.createDataFrame([[1, *pose, *pose]], "pair int, " + ", ".join(f"{n} double" for n in names))
    edges = spark.createDataFrame([(1, 2, 3), (1, 5, 5), (1, 6, 6), (2, 0, 0)], "pair int, row int, col int")
    depth = spark.createDataFrame([(1, 2, 3, 2.0), (1, 5, 5, 3.0), (1, 6, 6, 0.0), (2, 0, 0, 1.0)], "pair int, row int, col int, z double")
    assert sorted(tuple(r) for r in camera.reproject(edges, depth, views, 8, 8).collect()) == [(1, 2, 3), (1, 5, 5)]


def test_pairs_of_two_empty_masks_have_their_rules(spark):
    pred, gt = masks(spark, [(1, 0, 0)], [(2, 0, 0)])
    pairs = spark.createDataFrame([(1,), (2,), (3,)], "pair int")
    one = lambda df: {r.pair: tuple(r[1:]) for r in df.collect()}
    assert one(metrics.chamfer(pred, gt, pairs=pairs)) == {1: (1e6,), 2: (1e6,), 3: (0.0,)}
    assert one(metrics.prf_tolerant(pred, gt, pairs=pairs)) == {1: (0.0,) * 3, 2: (0.0,) * 3, 3: (1.0,) * 3}
    assert one(metrics.edge_accuracy(pred, gt, pairs))[3] == (1.0, 1.0, 1.0) and one(metrics.edge_accuracy(pred, gt, pairs))[1] == (0.0, 0.0, 0.0)
    assert one(metrics.prf(pred, gt, pairs))[3] == (0, 0, 0, 0.0, 0.0, 0.0) and one(metrics.mask_iou(pred, gt, pairs))[3] == (0.0,)


def test_nearest_is_that_of_all_pixels():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = (rng.integers(-5, 30, size=(rng.integers(1, 40), 2)) for _ in range(2))
        want = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)).min(axis=1)
        assert metrics.nearest(a[:, 0], a[:, 1], b[:, 0], b[:, 1]) == pytest.approx(want)
    assert np.isinf(metrics.nearest(a[:, 0], a[:, 1], a[:0, 0], a[:0, 1])).all()


def test_gate_counts_missing_metrics_as_the_worst(spark):
    f = spark.createDataFrame([(1, 0, 50, None), (1, 1, 50, None), (2, 0, 50, 0.9), (2, 1, None, 0.9)], "seq_id int, frame_no int, line_count int, conf double")
    got = {r.seq_id: (r.verdict, r.reason, r.detail) for r in gates.gate_sequences(f, kind="iou", metric_th=0.4).collect()}
    assert got == {1: ("reject", "bad_iou", "mean iou 0.0000 < 0.4"), 2: ("reject", "few_lines", "mean lines 25.0000 < 40")}
    assert gates.gate_sequences(f, kind="chamfer", line_th=0).where("seq_id = 1").first().reason == "bad_chamfer"


def test_reliability_is_clipped(spark):
    r = lambda p, r, e: gates.reliability(*[F.lit(float(x)) for x in (p, r, e)])
    row = spark.range(1).select(r(1.5, 2, -3).alias("a"), r(1, 1, 0).alias("b"), r(-1, 0, 0).alias("c"), r(0, 0, 0).alias("d")).first()
    assert row.a == row.b and row.c == row.d


def test_masks_follow_the_order_of_frames(spark):
    frames = spark.createDataFrame([(s, i, 10 * s + i) for s in (1, 2, 3) for i in range(3)], "seq_id int, frame_no int, pos int")
    m = spark.createDataFrame([("own1", 1, 1, None), ("part1", 2, None, 1), ("p2b", 4, None, 2), ("p2a", 3, None, 2), ("free1", 5, None, None), ("free2", 6, None, None), ("free3", 7, None, None), ("free4", 8, None, None)],
                              "mask string, key int, dir_seq int, part_seq int")
    got = {(r.seq_id, r.frame_no): (r.mask, r.tier) for r in matching.masks_tiered(frames, m).collect()}
    assert got == {(1, 0): ("own1", 1), (1, 1): (None, 1), (1, 2): (None, 1), (2, 0): ("p2a", 2), (2, 1): ("p2b", 2), (2, 2): (None, 2), (3, 0): ("free1", 3), (3, 1): ("free2", 3), (3, 2): ("free3", 3)}


def test_numbers_run_over_ranges(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)], "k long, v string").repartition(7)
    assert sorted((r.n, r.k) for r in sequences.numbered(rows, "k").collect()) == [(i, i) for i in range(1000)]
    assert sequences.numbered(rows.limit(0), "k").count() == 0


def test_splits_batches_and_draws(spark):
    rows = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "k long, w double")
    parts = sequences.random_split(rows, [5, 0, 25], "k", 1).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {0: 5, 2: 25}
    with pytest.raises(ValueError):
        sequences.random_split(rows, [5], "k", 1)
    order = sequences.permuted(rows, "k", 2)
    assert sequences.batches(order, 8, drop_last=True).count() == 24 and sequences.batches(order, 8).count() == 30
    drawn = sequences.weighted_draws(rows, 300, 3, "k", "w").collect()
    assert len(drawn) == 300 and {r.draw for r in drawn} == set(range(300)) and all(r.k % 3 for r in drawn)
    assert 1.5 < sum(r.k % 3 == 2 for r in drawn) / sum(r.k % 3 == 1 for r in drawn) < 2.7
    assert sequences.weighted_draws(rows.limit(0), 5, 3, "k", "w").count() == 0


def test_full_frechet_distance_is_that_of_plain_arrays(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(60, 4)), rng.normal(size=(50, 4)) * [1, 2, 1, 0.5] + 1
    rows = spark.createDataFrame([(0, x.tolist()) for x in a] + [(1, x.tolist()) for x in b], "set int, embedding array<double>").repartition(5)
    c, d = np.cov(a.T), np.cov(b.T)
    w, v = np.linalg.eig(c @ d)
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(c) + np.trace(d) - 2 * np.sqrt(w.real.clip(0)).sum()
    assert metrics.frechet_full(rows).first().distance == pytest.approx(want)
    assert math.isnan(metrics.frechet_full(rows.where("set = 0")).first().distance) and math.isnan(metrics.frechet_full(rows.limit(0)).first().distance)
    clips = spark.createDataFrame([(s, q, i, x[q * 20 + i].tolist()) for s, x in ((0, a), (1, b)) for q in (0, 1) for i in range(20)], "set int, seq_id int, frame_no int, embedding array<double>")
    means = [np.array([x[q * 20 + i: q * 20 + i + 4].mean(0) for q in (0, 1) for i in range(0, 17, 4)]) for x in (a, b)]
    c, d = np.cov(means[0].T), np.cov(means[1].T)
    want = ((means[0].mean(0) - means[1].mean(0)) ** 2).sum() + np.trace(c) + np.trace(d) - 2 * np.sqrt(np.linalg.eigvals(c @ d).real.clip(0)).sum()
    assert metrics.frechet_clips(clips, 4, 4).first().distance == pytest.approx(want)


def test_homography_survives_strangers(spark):
    rng, h = np.random.default_rng(2), np.array([[1.1, 0.1, 3], [-0.05, 0.95, 2], [1e-4, 2e-4, 1]])
    p = rng.uniform(0, 200, size=(60, 2))
    z = np.c_[p, np.ones(60)] @ h.T
    q = z[:, :2] / z[:, 2:]
    q[:20] = rng.uniform(0, 200, size=(20, 2))
    rows = spark.createDataFrame([(1, i, *map(float, (*p[i], *q[i]))) for i in range(60)], "pair long, m int, x0 double, y0 double, x1 double, y1 double")
    fit = geometry.fit_homography(rows, 0.5).first()
    got = np.array(fit.h).reshape(3, 3)
    assert 40 <= fit.inliers <= 42 and got / got[2, 2] == pytest.approx(h, rel=1e-3, abs=1e-4)


def test_grids_of_odd_kernels(spark):
    assert len(grids.kernel(1, "ellipse")) == 5 and len(grids.kernel(2, "disc")) == 13 and len(grids.kernel(2)) == 25
    assert grids.kernel(5, "ellipse").count((5, 0)) == 1 and (4, 3) in grids.kernel(5, "ellipse") and (4, 4) not in grids.kernel(5, "ellipse")
    m = spark.createDataFrame([(1, 2, 2)], "frame int, row int, col int")
    assert sorted((r.row, r.col) for r in grids.dilate(m, 1, 5, 5, "ellipse").collect()) == [(1, 2), (2, 1), (2, 2), (2, 3), (3, 2)]
    hole = spark.createDataFrame([(1, r, c) for r in range(4) for c in range(4)] + [(2, 0, 0)], "frame int, row int, col int")
    got = {(r.frame, r.row, r.col): r for r in grids.hole_rings(hole, 4, 4).collect()}
    assert got[1, 0, 0].ring is None and got[2, 0, 0].ring == 1 and got[2, 0, 0].down_right
    assert grids.channel_color("#ff8000") == grids.channel_color("255,128,0") == [255, 128, 0]


def test_small_boxes_have_no_ssim(spark):
    g = spark.createDataFrame([(1, r, c, float(r + c)) for r in range(9) for c in range(9)], "pair int, row int, col int, v double")
    spot = spark.createDataFrame([(1, 4, 4)], "pair int, row int, col int")
    assert metrics.ssim_hole_bbox(g, g, spot, 9, 9, pad=2).count() == 0
    assert metrics.ssim_hole_bbox(g, g, spot, 9, 9, pad=3).first().ssim == pytest.approx(1.0)
    assert metrics.ssim_hole_bbox(g, g, spot.limit(0), 9, 9).count() == 0
