"""Records in files that the tests write."""

import pickle
import random

import numpy as np
import pytest

from framelake.operators import gates
from framelake.sources import records, text


def files(tmp_path, named):
    for name, content in named.items():
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


class Bad:
    def __reduce__(self):
        return (print, ("never",))


def test_segments(spark, tmp_path):
    at = files(tmp_path, {"a.pkl": pickle.dumps({"lines": np.eye(4)[:2], "scores": np.array([0.5, 0.7])}), "b.pkl": pickle.dumps({"lines_pred": [[1, 2, 3, 4], [1, 2]]}),
                          "c.pkl": pickle.dumps([np.arange(4.0)]), "d.pkl": b"nothing", "e.pkl": pickle.dumps({"lines": [Bad()]}), "f.pkl": pickle.dumps({"other": 1})})
    listed = records.read_files(spark, at)
    got = sorted((r.path[-5:], r.seg_no, r.c1, r.score) for r in records.parse_segments(listed).collect())
    assert got == [("a.pkl", 0, 1.0, 0.5), ("a.pkl", 1, 0.0, 0.7), ("b.pkl", 0, 1.0, None), ("c.pkl", 0, 0.0, None)]
    counts = {r.path[-5:]: r.line_count for r in gates.line_count(listed, records.parse_segments(listed), "path").collect()}
    assert counts == {"a.pkl": 2, "b.pkl": 1, "c.pkl": 1, "d.pkl": 0, "e.pkl": 0, "f.pkl": 0}


def test_alignments_and_depth(spark, tmp_path):
    np.savez(tmp_path / "a.npz", homography=np.eye(3), valid=True, confidence_iou=0.75)
    np.savez(tmp_path / "b.npz", other=1)
    (tmp_path / "c.npz").write_bytes(b"PK")
    got = {r.path[-5:]: (r.npz_ok, r.valid, r.confidence_iou, r.homography and r.homography[8]) for r in records.parse_alignments(records.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.npz": (True, True, 0.75, 1.0), "b.npz": (True, False, 0.0, None), "c.npz": (False, False, 0.0, None)}
    deep = tmp_path / "deep"
    deep.mkdir()
    (deep / "m.bin").write_bytes(b"3&2&1&" + np.array([[0, 1, 2], [-1, 3, 0]], "<f4").tobytes())
    assert sorted((r.row, r.col, r.z) for r in records.parse_depth(records.read_files(spark, str(deep))).collect()) == [(0, 1, 1.0), (0, 2, 2.0), (1, 1, 3.0)]
    (deep / "m.bin").write_bytes(b"3&2&1&1234")
    with pytest.raises(Exception, match="4 bytes for 3 x 2 x 1"):
        records.parse_depth(records.read_files(spark, str(deep))).collect()


def test_cameras(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n\n1 PINHOLE 512 256 100 110 50 60\n2 RADIAL 256 256 90 10 20 0 0\n")
    (tmp_path / "images.txt").write_text("# i\n7 1 0 0 0 1 2 3 1 a/b.c.png\n1.5 2 3 4 5 6 7 8 9 10 11\n8 1 0 0 0 1 2 3 2 d.png\n\n9 1 0\n")
    cameras, poses = records.read_cameras(spark, str(tmp_path / "cameras.txt"), 256), records.read_poses(spark, str(tmp_path / "images.txt"))
    got = {r.frame_name: (r.image_id, r.fx, r.fy, r.cx, r.cy) for r in records.camera_model(cameras, poses).collect()}
    assert got == {"b.c": (7, 50.0, 110.0, 25.0, 60.0), "d": (8, 90.0, 90.0, 10.0, 20.0)}
    with pytest.raises(Exception, match="unknown camera 2"):
        records.camera_model(cameras.where("camera_id = 1"), poses).collect()


def test_absent_lists_are_left_out(spark, tmp_path):
    (tmp_path / "a").write_text("x\ny\n")
    got = text.concat_lists(spark, [str(tmp_path / "a"), str(tmp_path / "none"), str(tmp_path / "a")])
    assert sorted(map(tuple, got.collect())) == [(0, 0, "x"), (0, 1, "y"), (2, 0, "x"), (2, 1, "y")]
    assert text.concat_lists(spark, [str(tmp_path / "none")]).count() == 0


def plain_images(content):
    """Poses and their points, read line by line."""
    lines, at, out = content.split("\n"), 0, []
    while at < len(lines):
        if not lines[at].strip() or lines[at].strip().startswith("#"):
            at += 1
            continue
        points = lines[at + 1].split() if at + 1 < len(lines) else []
        out.append((int(lines[at].split()[0]), lines[at].split()[9], [float(x) for x in points]))
        at += 2
    return out


@pytest.mark.parametrize("size", ["1k", "700", "128m"])
def test_poses_and_points_over_many_splits(spark, tmp_path, size):
    draw, lines = random.Random(size), ["# images"]
    for i in range(1500):
        lines += [""] * draw.choice([0, 0, 0, 1, 2]) + ["# note"] * draw.choice([0, 0, 0, 1])
        lines.append(f"{i} 1 0 0 0 1 2 3 4 a/{i}.png")
        points = [f"{draw.randrange(100)} {draw.choice([1, 2.5])} {draw.choice([-1, 7])}" for _ in range(draw.choice([0, 1, 4, 9]))]
        lines.append(draw.choice(["", "#"]) if not points else " ".join(points))
    content = "\n".join(lines)
    (tmp_path / "images.txt").write_text(content)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        poses = sorted((r.image_id, r.name) for r in records.read_poses(spark, str(tmp_path / "images.txt")).collect())
        points = sorted((r.image_id, r.point_no, r.x, r.y, r.point3d_id) for r in records.read_points(spark, str(tmp_path / "images.txt")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = plain_images(content.replace("\n#\n", "\n\n"))
    assert poses == sorted((i, n) for i, n, _ in want) and len(poses) == 1500
    assert points == sorted((i, k, *p[3 * k: 3 * k + 3]) for i, _, p in want for k in range(len(p) // 3))
