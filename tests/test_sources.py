"""Text sources and sinks on small files."""

import io
import random
import time

import pytest

from framelake.sources import text


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_manifest_dialects(spark, tmp_path):
    f = tmp_path / "list.txt"
    f.write_text("a.jpg \n\n# no\n\"b c.jpg\"\n")
    assert rows(text.read_manifest(spark, str(f), comment="#", strip_quotes=True).select("pos", "line")) == [(0, "a.jpg"), (1, "b c.jpg")]
    assert rows(text.read_manifest(spark, str(f), keep_blank=True).select("pos", "line")) == [(0, "a.jpg"), (1, ""), (2, "# no"), (3, '"b c.jpg"')]


def test_discover_and_missing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("d/a.JPG", "d/b.txt", "c.jpg"):
        (tmp_path / n).write_text("x")
    found = text.discover_files(spark, [str(tmp_path), str(tmp_path / "d")], [".jpg"])
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.JPG", "c.jpg"]
    listed = spark.createDataFrame([("x",), ("y",)], "path string")
    assert rows(text.missing_files(listed, listed.where("path = 'x'"))) == [("y",)]


def test_logs_and_blacklist(spark, tmp_path):
    (tmp_path / "blocks").write_text("head\n\npath: /a b\nreason: too small\n\npath: /c\nreason: too small\n")
    (tmp_path / "lines").write_text("/d : broken : twice\n")
    log = text.read_failure_log(spark, [str(tmp_path / "blocks"), str(tmp_path / "lines")])
    assert rows(log) == [("/a b", "too small"), ("/c", "too small"), ("/d", "broken : twice")]
    assert rows(text.failure_summary(log)) == [("broken : twice", 1), ("too small", 2)]
    (tmp_path / "black").write_text("# c\n/a//b | why\n\n/a/b\n")
    assert rows(text.read_blacklist(spark, str(tmp_path / "black"))) == [("/a/b",)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "q"), (1, "a", "p")], "pos int, img string, pkl string")
    text.write_manifests(df, str(tmp_path / "m"), ["img", "pkl"])
    assert [r.value for r in spark.read.text(str(tmp_path / "m/img")).collect()] == ["a", "b"]
    v = spark.createDataFrame([(1, "reject", "few_lines"), (2, "keep", None)], "seq_id int, verdict string, reason string")
    text.write_reject_report(v, str(tmp_path / "r"), ["rejected"])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ["# rejected", "1 | few_lines"]
    text.write_metrics(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double"), str(tmp_path / "c"), "k", ["v"])
    assert rows(spark.read.csv(str(tmp_path / "c"), header=True)) == [("__MEAN__", "1.5"), ("a", "1.0"), ("b", "2.0")]
    assert text.read_class_table(spark, str(tmp_path / "c")).columns == ["Idx", "Ratio", "Train", "Val", "Stuff", "Name"]


def small_splits(spark, size="64k"):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")


def usual_splits(spark):
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def plain_reader(content, keep_blank, strip_quotes, comment):
    lines = [x.strip() for x in io.StringIO(content)]
    lines = [x for x in lines if (keep_blank or x) and not (comment and x.startswith(comment))]
    return [x.strip('"').strip("'") for x in lines] if strip_quotes else lines


@pytest.mark.parametrize("dialect", [{}, {"keep_blank": True}, {"comment": "#", "strip_quotes": True}, {"strip_quotes": True}])
def test_order_over_many_splits_is_that_of_a_plain_reader(spark, tmp_path, dialect):
    draw = random.Random(1)
    shapes = ["/data/{}.jpg", " \t/a b/{}.png \r", "", "# {}", '"/q/{}"', "'/s {}'", '""', "/é/{}", "\"'{}'\"", "'\"{}", "   "]
    content = "\n".join(draw.choice(shapes).format(i) for i in range(30_000)) + draw.choice(["", "\n"])
    (tmp_path / "list").write_text(content)
    (tmp_path / "other").write_text("lone")
    small_splits(spark, "20k")
    try:
        found = text.read_manifest(spark, [str(tmp_path / "list"), str(tmp_path / "other")], **dialect)
        assert text.split_lines(spark, str(tmp_path / "list")).select("block").distinct().count() > 10
        got = sorted((r.file.endswith("other"), r.pos, r.line) for r in found.collect())
    finally:
        usual_splits(spark)
    full = {"keep_blank": False, "strip_quotes": False, "comment": None} | dialect
    assert got == [(False, i, x) for i, x in enumerate(plain_reader(content, **full))] + [(True, 0, "lone")]


def test_a_long_list_is_read_fast(spark, tmp_path):
    (tmp_path / "long").write_text("".join(f"/data/scene_{i % 1000}/frame_{i}.jpg\n" for i in range(670_000)))
    began = time.time()
    small_splits(spark, "4m")
    try:
        rows = text.read_manifest(spark, str(tmp_path / "long"))
        assert rows.where("line != concat('/data/scene_', pos % 1000, '/frame_', pos, '.jpg')").count() == 0 and rows.count() == 670_000
    finally:
        usual_splits(spark)
    assert time.time() - began < 60  # seconds, on a machine beside other work


def test_folders_are_numbered_through(spark, tmp_path):
    df = spark.range(5000).selectExpr("id AS pos", "concat('x', id) AS img").repartition(7)
    text.write_manifests(df, str(tmp_path / "m"), ["img"])
    (tmp_path / "with space").write_text("one\n\ntwo")
    folder, file = str(tmp_path / "m/img"), str(tmp_path / "with space")
    got = sorted(map(tuple, text.concat_lists(spark, [file, folder, folder + "/none", folder]).collect()))
    assert got == [(0, 0, "one"), (0, 1, "two")] + [(n, i, f"x{i}") for n in (1, 3) for i in range(5000)]


def test_missing_report(spark):
    lists = spark.createDataFrame([(n, i, f"p{i}") for n in (0, 1) for i in range(10 * n, 20)] + [(2, 0, "p1")], "list_no int, pos int, path string")
    listed = spark.createDataFrame([(f"p{i}",) for i in (0, 1, 1, 12, 19)], "path string")
    got = {r.list_no: (r.n, r.n_missing, list(r.examples), r.more) for r in text.missing_report(lists, listed).collect()}
    assert got == {0: (20, 16, ["p2", "p3", "p4", "p5", "p6"], 11), 1: (10, 8, ["p10", "p11", "p13", "p14", "p15"], 3), 2: (1, 0, [], 0)}
    quick = {r.list_no: (r.n, r.n_missing) for r in text.missing_report(lists, listed, first=2).collect()}
    assert quick == {0: (2, 0), 2: (1, 0)}
    assert text.missing_report(lists.limit(0), listed).count() == 0
