"""Registered queries of records in files, samplers, aligned references and the further forms of operators."""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import paths as P
from framelake.operators import gates, geometry, grids, matching, metrics, sequences
from framelake.plans import fixtures as X
from framelake.plans.queries import GRIDS, MASK8, grids_of, mask8, query, rounded, sizes_of
from framelake.shared import own_folder
from framelake.sources import records, text


def written(spark: SparkSession, put: Callable[[str], None]) -> str:
    """A new folder below the shared one, filled by `put`."""
    at = own_folder(spark, "files")
    put(at)
    return at


def as_files(rows: DataFrame, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(path, content) made of rows (path, numbers array<double>) by the tasks that hold them."""
    @F.pandas_udf("binary")
    def content(numbers: pd.Series) -> pd.Series:
        return pd.Series([encode(np.asarray(x, dtype=float)) for x in numbers], index=numbers.index, dtype=object)

    return rows.select("path", content("numbers").alias("content"))


def vectors_as_files(spark, sf_dir, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    e = X.table(spark, sf_dir, "embeddings")
    return as_files(e.select(F.concat(F.lit("/r/"), "vec_id").alias("path"), F.transform("embedding", lambda x: x.cast("double")).alias("numbers")), encode)


# --- records ---


def pickled(x: np.ndarray) -> bytes:
    """One of four shapes of a record, by the first number: lines with scores, lines_pred, a bare list with one short row, a broken file."""
    kind, lines = int(abs(x[0]) * 1e6) % 4, x.reshape(16, 4)
    if kind == 0:
        return pickle.dumps({"lines": lines, "scores": np.abs(lines[:, 0])})
    if kind == 1:
        return pickle.dumps({"lines_pred": lines.tolist()})
    return pickle.dumps([lines[0].tolist(), [1.0, 2.0], lines[2].tolist()]) if kind == 2 else b"broken"


PICKLED = """r AS (SELECT vec_id, embedding AS e, floor(abs(embedding[1]::DOUBLE) * 1e6)::BIGINT % 4 AS kind FROM embeddings),
segs AS (SELECT '/r/' || vec_id AS path, k::INT AS seg_no, e[4 * k + 1]::DOUBLE AS c1, e[4 * k + 2]::DOUBLE AS c2, e[4 * k + 3]::DOUBLE AS
  c3, e[4 * k + 4]::DOUBLE AS c4,
 CASE WHEN kind = 0 THEN abs(e[4 * k + 1]::DOUBLE) END AS score FROM r, (SELECT unnest(range(16)) AS k) WHERE kind < 2 OR kind = 2 AND k IN
  (0, 2))"""


@query(f"""WITH {PICKLED} SELECT path, seg_no, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3, round(c4, 6) AS c4, round(score,
  6) AS score FROM segs""")
def read_segments(spark, sf_dir):
    return rounded(records.parse_segments(vectors_as_files(spark, sf_dir, pickled)))


@query(f"""WITH {PICKLED}, f AS (SELECT '/r/' || vec_id AS path FROM embeddings) SELECT path, count(seg_no) AS line_count FROM f LEFT JOIN
  segs USING (path) GROUP BY path""")
def line_count(spark, sf_dir):
    files = vectors_as_files(spark, sf_dir, pickled)
    return gates.line_count(files, records.parse_segments(files), "path")


def archived(x: np.ndarray) -> bytes:
    """An alignment archive: with all keys, with some, or broken."""
    kind, out = int(abs(x[0]) * 1e6) % 3, io.BytesIO()
    if kind == 2:
        return b"PK broken"
    keys = {"homography": x[:9].reshape(3, 3)} | ({"valid": np.array(x[1] > 0), "confidence_iou": np.array(abs(x[2]))} if kind == 0 else {})
    np.savez(out, **keys)
    return out.getvalue()


@query("""WITH r AS (SELECT vec_id, embedding AS e, floor(abs(embedding[1]::DOUBLE) * 1e6)::BIGINT % 3 AS kind FROM embeddings)
SELECT '/r/' || vec_id AS path, kind < 2 AS npz_ok, kind = 0 AND e[2] > 0 AS valid, round(CASE WHEN kind = 0 THEN abs(e[3]::DOUBLE) ELSE 0
  END, 6) AS confidence_iou,
  CASE WHEN kind < 2 THEN round(e[1]::DOUBLE + e[9]::DOUBLE, 6) END AS corners FROM r""")
def read_alignment(spark, sf_dir):
    found = records.parse_alignments(vectors_as_files(spark, sf_dir, archived))
    return rounded(found.select("path", "npz_ok", "valid", "confidence_iou", (F.get("homography", F.lit(0)) + F.get("homography", F.lit(8))).alias("corners")))


@query("""SELECT '/r/' || vec_id AS path, (p // 8)::INT AS row, (p % 8)::INT AS col, round(embedding[p + 1]::DOUBLE, 6) AS z
FROM embeddings, (SELECT unnest(range(64)) AS p) WHERE embedding[p + 1] > 0""")
def read_depth(spark, sf_dir):
    return rounded(records.parse_depth(vectors_as_files(spark, sf_dir, lambda x: b"8&8&1&" + x.astype("<f4").tobytes())))


@query("""WITH c AS (SELECT n_nationkey AS id, n_nationkey % 3 = 0 AS one, 640 + n_nationkey AS w, 480 AS h FROM nation), p AS (SELECT *
  FROM supplier)
SELECT 'img_' || s_suppkey AS frame_name, s_suppkey::INT AS image_id, id::INT AS camera_id, CASE WHEN one THEN 'SIMPLE_RADIAL' ELSE
  'PINHOLE' END AS model,
  round(500.0 * 256 / w, 6) AS fx, round((CASE WHEN one THEN 500.0 ELSE 510.0 END) * 256 / h, 6) AS fy, round(320.0 * 256 / w, 6) AS cx,
  round(240.0 * 256 / h, 6) AS cy, round(s_acctbal, 6) AS tz
FROM p JOIN c ON id = s_nationkey""")
def camera_model(spark, sf_dir):
    one, word = F.col("n_nationkey") % 3 == 0, lambda *cs: F.concat_ws(" ", *cs)
    params = F.when(one, "500.0 320.0 240.0 0.01").otherwise("500.0 510.0 320.0 240.0")
    line = word("n_nationkey", F.when(one, "SIMPLE_RADIAL").otherwise("PINHOLE"), 640 + F.col("n_nationkey"), F.lit("480"), params)
    at = written(spark, lambda d: X.table(spark, sf_dir, "nation").select(F.concat_ws("\n", F.lit("# cameras"), line)).write.text(d))
    found = records.camera_model(records.read_cameras(spark, at, 256), records.read_poses(spark, image_list(spark, sf_dir)))
    return rounded(found.select("frame_name", "image_id", "camera_id", "model", "fx", "fy", "cx", "cy", "tz"))


def image_list(spark, sf_dir) -> str:
    """An image list: points that read like poses, blank lines in place of points, and comments between images."""
    s, words = X.table(spark, sf_dir, "supplier"), lambda *cs: F.concat_ws(" ", *cs)
    pose = words("s_suppkey", F.lit("1.0 0.0 0.0 0.0 0.5 0.25"), "s_acctbal", "s_nationkey", F.concat(F.lit("a/img_"), "s_suppkey", F.lit(".png")))
    pts = F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(words("s_suppkey", F.lit("3.5 -1 40.5 3.5 8 7.5 1.5 4 9.0 9.0 9")))
    note = F.when(F.col("s_suppkey") % 3 == 0, F.lit("# next"))
    return written(spark, lambda d: s.select(F.concat_ws("\n", pose, pts, note)).write.text(d))


@query("""WITH p AS (SELECT s_suppkey::INT AS image_id, s_suppkey::DOUBLE AS x0 FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT image_id, 0 AS point_no, x0 AS x, 3.5::DOUBLE AS y, -1::BIGINT AS point3d_id FROM p UNION ALL SELECT image_id, 1, 40.5, 3.5, 8 FROM p
UNION ALL SELECT image_id, 2, 7.5, 1.5, 4 FROM p UNION ALL SELECT image_id, 3, 9, 9, 9 FROM p""")
def image_points(spark, sf_dir):
    return records.read_points(spark, image_list(spark, sf_dir))


# --- lists ---


def supplier_list(spark, sf_dir) -> str:
    """A list in one file: a name a line in order, quoted ones, comments and blank lines between."""
    s = X.table(spark, sf_dir, "supplier").orderBy("s_suppkey")
    line = F.when(F.col("s_suppkey") % 5 == 0, "# note").when(F.col("s_suppkey") % 7 == 0, "").when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('"'), "s_name", F.lit('"'))).otherwise(F.col("s_name"))
    return written(spark, lambda d: s.coalesce(1).sortWithinPartitions("s_suppkey").select(line).write.text(d))


KEPT = """kept AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_name AS line FROM supplier WHERE s_suppkey % 5 <> 0
  AND s_suppkey % 7 <> 0)"""


@query(f"WITH {KEPT} SELECT * FROM kept")
def read_manifest(spark, sf_dir):
    return text.read_manifest(spark, supplier_list(spark, sf_dir), strip_quotes=True, comment="#").select("pos", "line")


@query(f"WITH {KEPT} SELECT 0 AS list_no, pos, line FROM kept UNION ALL SELECT 2, pos, line FROM kept")
def concat_lists(spark, sf_dir):
    at = supplier_list(spark, sf_dir)
    return text.concat_lists(spark, [at, f"{at}/absent", at], strip_quotes=True, comment="#")


@query(f"WITH {KEPT} SELECT pos, line AS left_line, upper(line) AS right_line FROM kept")
def zip_manifests(spark, sf_dir):
    left = text.read_manifest(spark, supplier_list(spark, sf_dir), strip_quotes=True, comment="#").select("pos", F.col("line").alias("left_line"))
    return matching.zip_manifests(left, left.select("pos", F.upper("left_line").alias("right_line")))


@query(f"WITH {X.PATHS} SELECT page_id, path FROM paths WHERE path IN (SELECT path FROM paths WHERE page_id % 3 <> 0)")
def existing_files(spark, sf_dir):
    p = X.paths(spark, sf_dir)
    return text.existing_files(p, p.where("page_id % 3 != 0")).select("page_id", "path")


@query("SELECT reason, count(*) AS n FROM (SELECT 'nation ' || s_nationkey AS reason FROM supplier) GROUP BY 1")
def failure_summary(spark, sf_dir):
    block = F.format_string("path: /s/%d\nreason: nation %d\n", "s_suppkey", "s_nationkey")
    at = written(spark, lambda d: X.table(spark, sf_dir, "supplier").select(block).write.text(d))
    return text.failure_summary(text.read_failure_log(spark, at))


@query("SELECT DISTINCT '/s/' || s_nationkey AS path FROM supplier WHERE s_suppkey % 4 <> 0")
def read_blacklist(spark, sf_dir):
    line = F.when(F.col("s_suppkey") % 4 == 0, F.format_string("# /s/x%d", "s_suppkey")).otherwise(F.format_string("/s//./%d/ | because", "s_nationkey"))
    return text.read_blacklist(spark, written(spark, lambda d: X.table(spark, sf_dir, "supplier").select(line).write.text(d)))


@query("""SELECT n_nationkey::INT AS Idx, n_nationkey / 100.0 AS Ratio, 1 AS Train, 2 AS Val, (n_nationkey % 2)::INT AS Stuff, n_name ||
  ';other' AS Name FROM nation""")
def read_class_table(spark, sf_dir):
    n = X.table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey") / 100, F.lit(1), F.lit(2), F.col("n_nationkey") % 2, F.concat("n_name", F.lit(";other")))
    return text.read_class_table(spark, written(spark, lambda d: n.write.csv(d, header=True)))


@query("SELECT s_name AS img, s_suppkey::VARCHAR AS pkl, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier")
def write_manifests(spark, sf_dir):
    """Two lists are written in order, as folders of sorted part files, and read back together."""
    rows = X.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("img"), F.col("s_suppkey").cast("string").alias("pkl"), F.col("s_suppkey").alias("pos")).repartition(4)
    at = written(spark, lambda d: text.write_manifests(rows, d, ["img", "pkl"]))
    both = [text.concat_lists(spark, [f"{at}/{c}"]).select("pos", F.col("line").alias(c)) for c in ("img", "pkl")]
    return both[0].join(both[1], "pos")


@query("""WITH m AS (SELECT n_name AS key, avg(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT key, round(v, 3) AS v FROM m UNION ALL SELECT '__MEAN__', round(avg(v), 3) FROM m""")
def write_metrics(spark, sf_dir):
    s, n = X.table(spark, sf_dir, "supplier"), X.table(spark, sf_dir, "nation")
    means = s.join(n, s["s_nationkey"] == n["n_nationkey"]).groupBy(F.col("n_name").alias("key")).agg(F.avg("s_acctbal").alias("v"))
    at = written(spark, lambda d: text.write_metrics(means, d, "key", ["v"], 3))
    return spark.read.csv(at, header=True, schema="key string, v double")


@query("""WITH m AS (SELECT n_name AS key, avg(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT key, round(v, 3) AS v FROM m UNION ALL SELECT '__MEAN__', round(avg(v), 3) FROM m""")
def write_metrics_json(spark, sf_dir):
    s, n = X.table(spark, sf_dir, "supplier"), X.table(spark, sf_dir, "nation")
    means = s.join(n, s["s_nationkey"] == n["n_nationkey"]).groupBy(F.col("n_name").alias("key")).agg(F.avg("s_acctbal").alias("v"))
    at = written(spark, lambda d: text.write_metrics(means, d, "key", ["v"], 3, "json"))
    return spark.read.schema("key string, v double").json(at)


@query("SELECT '/s/' || s_suppkey AS path, 'nation ' || s_nationkey || ' : far' AS reason FROM supplier WHERE s_suppkey % 3 <> 0")
def failure_lines(spark, sf_dir):
    """A log of `path : reason` lines, with comments between."""
    line = F.when(F.col("s_suppkey") % 3 == 0, F.lit("# skipped : not read")).otherwise(F.format_string("/s/%d : nation %d : far", "s_suppkey", "s_nationkey"))
    return text.read_failure_log(spark, written(spark, lambda d: X.table(spark, sf_dir, "supplier").select(line).write.text(d)))


@query("SELECT DISTINCT 's' || (s_suppkey % 3) AS folder, '.txt' AS ending FROM supplier")
def discover_files(spark, sf_dir):
    s = X.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey") % 3).alias("g"), "s_name")
    at = written(spark, lambda d: s.repartition(1).write.partitionBy("g").text(d))
    found = text.discover_files(spark, [at], [".TXT"])
    return found.select(F.regexp_extract("path", r"g=([^/]*)/", 1).alias("folder"), F.regexp_extract("path", r"(\.[^.]*)$", 1).alias("ending")).distinct()


# --- paths ---


@query(f"""WITH {X.PATHS} SELECT page_id, coalesce(list_filter(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), lambda x:
  length(x) > 15)[1], regexp_extract(path, '^(.*)/[^/]*$', 1)) AS seq_id FROM paths""")
def seq_id_dirname(spark, sf_dir):
    return X.paths(spark, sf_dir).select("page_id", P.seq_id_long15(F.col("path"), "dirname").alias("seq_id"))


@query(f"""WITH {X.PATHS}, b AS (SELECT page_id, path, regexp_extract(path, '[^/]*$') AS name FROM paths)
SELECT page_id, substr(sha1(path), 1, 10) || '_' || regexp_replace(name, '(.)\\.[^.]*$', '\\1') || lower(regexp_extract(name,
  '.(\\.[^.]*)$', 1)) AS name FROM b""")
def staged_name(spark, sf_dir):
    return X.paths(spark, sf_dir).select("page_id", P.staged_name(F.col("path")).alias("name"))


@query("""WITH n AS (SELECT s_suppkey, '/f' || (s_suppkey % 7) AS folder FROM supplier), r AS (SELECT *, row_number() OVER w - 1 AS i,
  length(count(*) OVER (PARTITION BY folder)::VARCHAR) AS k FROM n WINDOW w AS (PARTITION BY folder ORDER BY s_suppkey))
SELECT folder || '/img' || s_suppkey || '.JPG' AS path, lpad(i::VARCHAR, k::INT, '0') || '.jpg' AS new_name FROM r""")
def numbered_names(spark, sf_dir):
    folder = F.concat(F.lit("/f"), F.col("s_suppkey") % 7)
    rows = X.table(spark, sf_dir, "supplier").select(folder.alias("folder"), F.concat(folder, F.lit("/img"), "s_suppkey", F.lit(".JPG")).alias("path"))
    return P.numbered_names(rows, "folder").select("path", "new_name")


@query("""WITH s AS (SELECT p_partkey, 100 + p_size * 20 AS w, 100 + p_partkey % 700 AS h FROM part), p AS (SELECT *, floor(w * (256.0 /
  greatest(w, h)) + 0.5)::BIGINT AS pw, floor(h * (256.0 / greatest(w, h)) + 0.5)::BIGINT AS ph FROM s)
SELECT p_partkey, pw, ph, floor((pw - 256) / 2)::BIGINT AS left, floor((ph - 256) / 2)::BIGINT AS top, least(w, h)::BIGINT AS side, floor((w
  - least(w, h)) / 2)::BIGINT AS square_left FROM p""")
def fit_other(spark, sf_dir):
    pad, square = (P.fit_box(F.col("w"), F.col("h"), m, 256) for m in ("pad", "square"))
    return sizes_of(spark, sf_dir).select("p_partkey", pad[0].alias("pw"), pad[1].alias("ph"), pad[2], pad[3], square[0].cast("long").alias("side"), square[2].cast("long").alias("square_left"))


# --- references and samplers ---


@query(f"""WITH {X.FRAMES}, r AS (SELECT seq_id, frame_no, line_count AS current, first(line_count) OVER w AS global_ref, lag('m' || pos)
  OVER w AS pm, row_number() OVER w > 1 AS later FROM frames WINDOW w AS (PARTITION BY seq_id ORDER BY frame_no)),
a AS (SELECT seq_id, frame_no, true AS ok, CASE WHEN pos % 5 <> 0 THEN valid END AS valid, CASE WHEN pos % 7 <> 0 THEN conf ELSE 0 END AS c,
  line_count + 1000 AS warped FROM frames WHERE pos % 3 <> 0),
m AS (SELECT r.*, later AND coalesce(ok, false) AS ok, later AND coalesce(ok, false) AND coalesce(valid, false) AS good, CASE WHEN later AND
  coalesce(ok, false) THEN coalesce(c, 0) ELSE 0 END AS conf, warped FROM r LEFT JOIN a USING (seq_id, frame_no))
SELECT seq_id, frame_no, current, global_ref, CASE WHEN good AND conf > 0 THEN warped ELSE 0 END AS local_ref, CASE WHEN good AND conf > 0
  THEN pm ELSE 'hole' END AS local_mask, ok::INT AS npz_ok, good::INT AS warp_valid,
  round(conf, 6) AS conf, (good AND conf > 0)::INT AS local_used FROM m""")
def aligned_refs(spark, sf_dir):
    f = X.frames(spark, sf_dir)
    records_ = f.where("pos % 3 != 0").select("seq_id", "frame_no", F.when(F.col("pos") % 5 != 0, F.col("valid")).alias("valid"),
                                              F.when(F.col("pos") % 7 != 0, F.col("conf")).alias("confidence_iou"), (F.col("line_count") + 1000).alias("warped"))
    own = f.select("seq_id", "frame_no", F.col("line_count").alias("payload"), F.concat(F.lit("m"), "pos").alias("mask"))
    return rounded(matching.aligned_refs(own, records_))


UNIFORM = "(('0x' || substr(md5({} || '|{}'), 1, 8))::BIGINT + 1) / 4294967297.0"


@query(f"""WITH w AS (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey) AS hi, p_size AS w FROM part), d AS (SELECT i AS draw,
  {UNIFORM.format('i', 3)} * (SELECT sum(p_size) FROM part) AS x FROM (SELECT unnest(range(500)) AS i))
SELECT draw, p_partkey FROM d JOIN w ON x >= hi - w AND x < hi""")
def weighted_draws(spark, sf_dir):
    return sequences.weighted_draws(X.table(spark, sf_dir, "part"), 500, 3, "p_partkey", "p_size")


@query("""WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY md5(p_partkey || '|4'), p_partkey) - 1 AS n FROM part WHERE p_size > 10)
SELECT p_partkey, n, n // 64 AS batch FROM o WHERE n // 64 < (SELECT count(*) FROM o) // 64""")
def subset_batches(spark, sf_dir):
    """A random permutation of a subset, in whole batches."""
    return sequences.batches(sequences.permuted(X.table(spark, sf_dir, "part").where("p_size > 10"), "p_partkey", 4), 64, drop_last=True)


@query("""WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey || '|6'), c_custkey) - 1 AS n FROM customer), t AS (SELECT
  count(*) AS t FROM customer)
SELECT c_custkey, CASE WHEN n < t // 2 THEN 0 WHEN n < t // 2 + t // 5 THEN 1 ELSE 2 END AS part FROM o, t""")
def random_split(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer")
    t = c.count()
    return sequences.random_split(c, [t // 2, t // 5, t - t // 2 - t // 5], "c_custkey", 6)


# --- segments and grids ---


@query(f"WITH {X.SEGMENTS} SELECT frame, k, round(y1, 6) AS x1, round(x1, 6) AS y1, round(y2, 6) AS x2, round(x2, 6) AS y2 FROM segments")
def swap_xy(spark, sf_dir):
    return rounded(geometry.swap_xy(X.segments(spark, sf_dir)).select("frame", "k", *geometry.ENDS))


@query(f"""WITH {X.SEGMENTS}, t AS (SELECT frame, k, x1, y1, greatest(abs(x1), abs(y1), abs(x2), abs(y2)) AS own, max(greatest(abs(x1),
  abs(y1), abs(x2), abs(y2))) OVER (PARTITION BY frame) AS top FROM segments)
SELECT frame, k, round(CASE WHEN own <= 40 THEN x1 * 63 ELSE x1 END, 6) AS last_x1, round(CASE WHEN top <= 55 THEN x1 * 80 ELSE x1 END, 6)
  AS sides_x1, round(CASE WHEN top <= 55 THEN y1 * 60 ELSE y1 END, 6) AS sides_y1,
  round(x1 * 64 / (top + 1), 6) AS observed_x1 FROM t""")
def denormalize_forms(spark, sf_dir):
    s = X.segments(spark, sf_dir)
    last = geometry.denormalize(s, 64, scope="line", threshold=40, form="last").select("frame", "k", F.col("x1").alias("last_x1"))
    sides = geometry.denormalize(s, threshold=55, form="sides", width=80, height=60).select("frame", "k", F.col("x1").alias("sides_x1"), F.col("y1").alias("sides_y1"))
    observed = geometry.denormalize(s, 64, form="observed").select("frame", "k", F.col("x1").alias("observed_x1"))
    return rounded(last.join(sides, ["frame", "k"]).join(observed, ["frame", "k"]))


@query(f"WITH {GRIDS} SELECT pair, round(1 - 10 * log10(avg((p - g) ** 2) + 1e-7), 6) AS psnr FROM m GROUP BY pair")
def psnr_legacy(spark, sf_dir):
    return rounded(metrics.image_errors(*grids_of(spark, sf_dir), kind="legacy").select("pair", "psnr"))


@query(f"""WITH {MASK8} SELECT g.frame, g.row, g.col, round(max(x.v), 6) AS v FROM grid8 g JOIN grid8 x ON x.frame = g.frame AND abs(x.row -
  g.row) <= 2 AND abs(x.col - g.col) <= 2 GROUP BY g.frame, g.row, g.col""")
def max_pool(spark, sf_dir):
    return rounded(grids.max_pool(X.grid8(spark, sf_dir), 2, 8, 8))


ELLIPSE = """e(dr, dc) AS (SELECT a, b FROM (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b) WHERE abs(b) <=
  round(sqrt(4 - a * a)))"""


@query(f"""WITH {MASK8}, {ELLIPSE}, canvas AS (SELECT DISTINCT frame, row, col FROM grid8), dil AS (SELECT DISTINCT frame, row + dr AS row,
  col + dc AS col FROM mask, e WHERE row + dr BETWEEN 0 AND 7 AND col + dc BETWEEN 0 AND 7),
near AS (SELECT c.frame, c.row, c.col, count(*) AS need, count(d.row) AS have FROM canvas c JOIN e ON c.row + dr BETWEEN 0 AND 7 AND c.col +
  dc BETWEEN 0 AND 7
 LEFT JOIN dil d ON d.frame = c.frame AND d.row = c.row + dr AND d.col = c.col + dc GROUP BY ALL) SELECT frame, row::INT AS row, col::INT AS
  col FROM near WHERE need = have""")
def close_ellipse(spark, sf_dir):
    return grids.close(mask8(spark, sf_dir), 2, 8, 8, "ellipse")


@query(f"""WITH {MASK8} SELECT frame, row, col, round(CASE WHEN v > 0.6 THEN least(255, greatest(0, floor(0.25 * v * 200 + 0.75 * 255 +
  0.5))) ELSE v * 200 END, 6) AS r,
 round(CASE WHEN v > 0.6 THEN least(255, greatest(0, floor(0.25 * v * 100 + 0.75 * 128 + 0.5))) ELSE v * 100 END, 6) AS g, round(CASE WHEN v
  > 0.6 THEN least(255, greatest(0, floor(0.25 * v * 50 + 0.5))) ELSE v * 50 END, 6) AS b FROM grid8""")
def blend_rgb(spark, sf_dir):
    g = X.grid8(spark, sf_dir)
    image = g.select("frame", "row", "col", *[(F.col("v") * s).alias(c) for c, s in (("r", 200), ("g", 100), ("b", 50))])
    return rounded(grids.blend_rgb(image, g, 0.75, "#ff8000", 0.6))


@query(f"""WITH {MASK8}, t AS (SELECT g.frame, g.row, g.col, any_value(g.v) AS v, max(x.v) AS top FROM grid8 g JOIN grid8 x ON x.frame =
  g.frame AND abs(x.row - g.row) <= 1 AND abs(x.col - g.col) <= 1 GROUP BY g.frame, g.row, g.col),
p AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY v DESC, row, col) AS rank FROM t WHERE v = top AND v > 0.5)
SELECT frame, row, col, rank::INT AS rank, round(col + v / 4 + 0.5, 6) AS x, round(row - v / 8 + 0.5, 6) AS y FROM p WHERE rank <= 5""")
def junctions(spark, sf_dir):
    g = X.grid8(spark, sf_dir)
    offset = g.select("frame", "row", "col", (F.col("v") / 4).alias("dx"), (-F.col("v") / 8).alias("dy"))
    return rounded(grids.sub_pixel(grids.local_max_topk(g, 5, 0.5, 8, 8), offset).drop("v"))


@query("""SELECT frame, (p // 8)::INT AS row, (p % 8)::INT AS col FROM (SELECT vec_id AS frame, unnest(range(64)) AS p, embedding FROM
  embeddings) WHERE floor(embedding[p + 1]::DOUBLE * 20)::INT IN (-1, 0, 3)""")
def class_set_mask(spark, sf_dir):
    labels = X.grid8(spark, sf_dir).select("frame", "row", "col", F.floor((F.col("v") - 0.5) * 20).cast("int").alias("class_id"))
    return gates.class_set_mask(labels, [-1, 0, 3])


RECURSIVE_SPECULAR = f"""WITH RECURSIVE {X.GRID8}, e(dr, dc) AS (SELECT a, b FROM (SELECT unnest(range(-1, 2)) AS a), (SELECT
  unnest(range(-1, 2)) AS b) WHERE abs(b) <= round(sqrt(1 - a * a))),
rgb AS (SELECT frame, row, col, v AS r, 0.9 * v AS g, 0.85 * v + 0.05 AS b FROM grid8),
mask AS (SELECT frame, row, col FROM rgb WHERE greatest(r, g, b) > 0.55 AND coalesce((greatest(r, g, b) - least(r, g, b)) /
  nullif(greatest(r, g, b), 0), 0) < 0.2),
dil AS (SELECT DISTINCT frame, row + dr AS row, col + dc AS col FROM mask, e WHERE row + dr BETWEEN 0 AND 7 AND col + dc BETWEEN 0 AND 7),
near AS (SELECT c.frame, c.row, c.col, count(*) AS need, count(d.row) AS have FROM grid8 c JOIN e ON c.row + dr BETWEEN 0 AND 7 AND c.col +
  dc BETWEEN 0 AND 7
  LEFT JOIN dil d ON d.frame = c.frame AND d.row = c.row + dr AND d.col = c.col + dc GROUP BY c.frame, c.row, c.col), m AS (SELECT frame,
  row, col FROM near WHERE need = have),
reach(frame, row, col, root) AS (SELECT frame, row, col, row * 8 + col FROM m UNION SELECT m.frame, m.row, m.col, r.root FROM reach r JOIN m
  ON m.frame = r.frame AND abs(m.row - r.row) <= 1 AND abs(m.col - r.col) <= 1),
l AS (SELECT frame, row, col, min(root) AS c FROM reach GROUP BY ALL), big AS (SELECT frame, c FROM l GROUP BY ALL HAVING count(*) >= 6)
SELECT frame, row, col FROM l SEMI JOIN big USING (frame, c)"""


@query(RECURSIVE_SPECULAR)
def specular_areas(spark, sf_dir):
    rgb = X.grid8(spark, sf_dir).select("frame", "row", "col", F.col("v").alias("r"), (F.col("v") * 0.9).alias("g"), (F.col("v") * 0.85 + 0.05).alias("b"))
    return grids.specular_mask(rgb, 8, 8, v_th=0.55, s_th=0.2, radius=1, min_area=6)
