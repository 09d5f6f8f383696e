"""The registered queries of the frame operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import paths as P
from framelake.operators import camera
from framelake.operators import flow as flows
from framelake.operators import gates, geometry, grids, matching, metrics, sequences
from framelake.plans import fixtures as X
from framelake.sources import text
from framelake.streaming import pairs as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- gates ---

def stats_sql(conf: str = "conf") -> str:
    return f"""{X.FRAMES},
stats AS (SELECT seq_id, count(*) AS n, avg(line_count) AS mean_lines, avg(CASE WHEN frame_no > 0 OR m = 1 THEN {conf} END) AS mean_metric
  FROM (SELECT *, count(*) OVER (PARTITION BY seq_id) AS m FROM frames) GROUP BY seq_id)"""


STATS = stats_sql()


def gate_sql(kind: str, bad: str, conf: str = "conf") -> str:
    return f"""{stats_sql(conf)}, verdicts AS (SELECT seq_id, n, mean_lines, mean_metric,
 CASE WHEN seq_id % 17 = 0 OR seq_id % 23 = 0 THEN 'blacklist' WHEN mean_lines < 48 THEN 'few_lines' WHEN {bad} THEN 'bad_{kind}' END AS
  reason FROM stats)"""


def gated(spark: SparkSession, sf_dir: str, kind: str, th: float, metric: Column | None = None) -> DataFrame:
    frames = X.frames(spark, sf_dir)
    frames = frames if metric is None else frames.withColumn("conf", metric)
    seqs = frames.select("seq_id", F.col("dir").alias("seq_path")).distinct()
    listed = seqs.where("seq_id % 17 = 0").select(F.col("seq_path").alias("path")).union(seqs.where("seq_id % 23 = 0").select(F.concat(F.lit("/old/"), "seq_id").alias("path")))
    found = gates.gate_sequences(frames, matching.blacklisted(seqs, listed, invert=True), kind, 48, th)
    # As SQL rounds a double, by its product; F.round takes the shortest decimal, and differs where that is near a half.
    return found.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in ("mean_lines", "mean_metric")})


def verdict_sql(kind: str, sign: str, th: float) -> str:
    return f"""SELECT seq_id, n, round(mean_lines, 6) AS mean_lines, round(mean_metric, 6) AS mean_metric, CASE WHEN reason IS NULL THEN 'keep' ELSE 'reject' END AS verdict, reason,
  CASE reason WHEN 'blacklist' THEN 'blacklist' WHEN 'few_lines' THEN printf('mean lines %.4f < 48', mean_lines)
  WHEN 'bad_{kind}' THEN printf('mean {kind} %.4f {sign} {th}', mean_metric) END AS detail FROM verdicts"""


@query(f"WITH {gate_sql('chamfer', 'mean_metric > 52')} {verdict_sql('chamfer', '>', 52)}")
def seq_gate_quality(spark, sf_dir):
    return gated(spark, sf_dir, "chamfer", 52)


@query(f"WITH {gate_sql('iou', 'mean_metric < 50', 'CASE WHEN valid THEN conf ELSE 0 END')} {verdict_sql('iou', '<', 50)}")
def seq_gate_iou(spark, sf_dir):
    """Frames that aren't valid lack the metric here."""
    return gated(spark, sf_dir, "iou", 50, F.when(F.col("valid"), F.col("conf")))


@query(f"WITH {gate_sql('line', 'false')} {verdict_sql('line', '>', 0)}")
def seq_gate_lines(spark, sf_dir):
    return gated(spark, sf_dir, "line", 0)


@query(f"""WITH {gate_sql('chamfer', 'mean_metric > 52')} SELECT coalesce(r, 'total') AS reason, sequences, round(sequences / (SELECT
  count(*) FROM verdicts), 6) AS share
FROM (SELECT coalesce(reason, 'keep') AS r, count(*) AS sequences FROM verdicts GROUP BY ROLLUP (coalesce(reason, 'keep')))""")
def seq_gate_summary(spark, sf_dir):
    return rounded(gates.gate_summary(gated(spark, sf_dir, "chamfer", 52)))


@query(f"WITH {gate_sql('chamfer', 'mean_metric > 52')} SELECT seq_id || ' | ' || reason AS line FROM verdicts WHERE reason IS NOT NULL")
def reject_report(spark, sf_dir):
    return gates.reject_report(gated(spark, sf_dir, "chamfer", 52))


@query(f"""WITH {X.FRAMES}, f AS (SELECT *, frame_no > 0 AS later, conf > 20 AS npz_ok, valid AND conf > 50 AS local_used, line_count *
  valid::INT AS local_lines FROM frames)
SELECT pos // 64 AS batch, round(count(*) FILTER (later AND npz_ok) / greatest(1, count(*) FILTER (later)), 6) AS npz_ok_ratio,
  round(count(*) FILTER (later AND valid) / greatest(1, count(*) FILTER (later)), 6) AS valid_ratio,
  round(count(*) FILTER (later AND local_used) / greatest(1, count(*) FILTER (later)), 6) AS local_used_ratio,
  round(coalesce(sum(conf) FILTER (later), 0) / greatest(1, count(*) FILTER (later)), 6) AS mean_conf, round(min(conf), 6) AS min_conf,
  round(max(conf), 6) AS max_conf, round(avg((line_count = 0)::INT), 6) AS empty_ratio, round(avg((local_lines = 0)::INT), 6) AS empty_local_lines
FROM f GROUP BY 1""")
def batch_diagnostics(spark, sf_dir):
    f = X.frames(spark, sf_dir).withColumns({"npz_ok": F.col("conf") > 20, "local_used": F.col("valid") & (F.col("conf") > 50),
                                             "local_lines": F.col("line_count") * F.col("valid").cast("int")})
    return rounded(gates.batch_diagnostics(f, flags=("npz_ok", "valid", "local_used"), empties=("line_count", "local_lines")))


@query("""SELECT p_size % 2 AS stuff, count(DISTINCT p_size) AS classes, count(*) AS pixels, round(count(*) / (SELECT count(*) FROM part),
  6) AS share FROM part GROUP BY 1""")
def class_weights(spark, sf_dir):
    part = X.table(spark, sf_dir, "part")
    counted = part.groupBy(F.col("p_size").alias("class_id"), "p_brand").agg(F.count("*").alias("n"))
    classes = part.select(F.col("p_size").alias("class_id"), (F.col("p_size") % 2).alias("stuff")).distinct()
    return rounded(gates.class_weights(classes, counted))


@query(f"WITH {X.PATHS} SELECT regexp_extract(path, '[^/]*$') AS name, count(*) AS n FROM paths GROUP BY 1 HAVING count(*) > 1")
def dup_names(spark, sf_dir):
    return gates.dup_names(X.paths(spark, sf_dir).select(P.basename(F.col("path")).alias("name")), "name")


@query(f"WITH {STATS} SELECT seq_id::VARCHAR AS seq_id, round(mean_lines, 6) AS mean_lines, round(mean_metric, 6) AS mean_metric FROM stats UNION ALL"
       " SELECT '__MEAN__', round(avg(mean_lines), 6), round(avg(mean_metric), 6) FROM stats")
def detail_plus_mean(spark, sf_dir):
    return rounded(gates.detail_plus_mean(gates.sequence_stats(X.frames(spark, sf_dir)), "seq_id", ["mean_lines", "mean_metric"]))


@query(f"""WITH {X.FRAMES}, c AS (SELECT *, least(1.0, greatest(0.0, conf / 50 - 0.5)) AS p, least(1.0, line_count / 50.0) AS r, greatest(0,
  conf / 100 - 0.5) AS e FROM frames)
SELECT seq_id, pos, round(1 / (1 + exp(-(p - 0.5) / 0.1)) / (1 + exp(-(r - 0.5) / 0.1)) * exp(-e / 2.5), 6) AS score FROM c""")
def reliability(spark, sf_dir):
    f, conf = X.frames(spark, sf_dir), F.col("conf")
    return rounded(f.select("seq_id", "pos", gates.reliability(conf / 50 - 0.5, F.col("line_count") / 50, conf / 100 - 0.5).alias("score")))


# --- sequences ---


@query(f"""WITH {X.FRAMES} SELECT pos, seq_id, frame_no, frame_no = 0 AS is_first, lag(pos) OVER w AS prev_pos, first(pos) OVER w AS
  global_pos FROM frames WINDOW w AS (PARTITION BY seq_id ORDER BY frame_no)""")
def frame_refs(spark, sf_dir):
    return sequences.frame_refs(X.frames(spark, sf_dir))


@query(f"WITH {X.FRAMES} SELECT pos, dir, coalesce(lag(dir) OVER (ORDER BY pos) <> dir, true) AS is_first FROM frames")
def run_boundary(spark, sf_dir):
    return sequences.run_boundary(X.frames(spark, sf_dir), block=1024)


ARGMAX = f"""{X.FRAMES}, refs AS (SELECT *, lag(pos) OVER (PARTITION BY seq_id ORDER BY frame_no) AS prev_pos FROM frames),
best AS (SELECT * FROM refs QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY line_count DESC, frame_no) = 1)"""


@query(f"WITH {ARGMAX} SELECT seq_id, pos, frame_no, line_count, prev_pos FROM best")
def argmax_frame(spark, sf_dir):
    return sequences.argmax_frame(X.frames(spark, sf_dir))


@query(f"""WITH {X.FRAMES} SELECT seq_id, (start // 8)::INT AS clip, start::INT AS start FROM (SELECT seq_id, unnest(range(0, count(*) - 15,
  8)) AS start FROM frames GROUP BY seq_id)""")
def sliding_clips(spark, sf_dir):
    return sequences.sliding_clips(X.frames(spark, sf_dir))


@query(f"""WITH {X.FRAMES} SELECT seq_id, (frame_no // 16)::BIGINT AS chunk, count(*) AS n, arg_min(pos, frame_no) AS style_pos FROM frames
  GROUP BY ALL HAVING count(*) > 1""")
def chunks(spark, sf_dir):
    return sequences.chunks(X.frames(spark, sf_dir))


@query(f"""WITH {X.FRAMES} SELECT * FROM (SELECT seq_id, pos AS cur_pos, lead(pos) OVER (PARTITION BY seq_id ORDER BY frame_no) AS next_pos
  FROM frames) WHERE next_pos IS NOT NULL""")
def consecutive_pairs(spark, sf_dir):
    return sequences.consecutive_pairs(X.frames(spark, sf_dir))


@query(f"""WITH {X.FRAMES} SELECT *, CASE WHEN left_pos IS NULL OR right_pos IS NULL THEN 'edge' ELSE 'ok' END AS status FROM (SELECT pos,
  lag(pos) OVER w AS left_pos, lead(pos) OVER w AS right_pos"""
       " FROM frames WINDOW w AS (PARTITION BY seq_id ORDER BY frame_no))")
def neighbors(spark, sf_dir):
    return sequences.neighbors(X.frames(spark, sf_dir))


@query(f"WITH {X.FRAMES} SELECT pos, seq_id, frame_no FROM frames WHERE frame_no % 5 = 0")
def stride_sample(spark, sf_dir):
    return sequences.stride_sample(X.frames(spark, sf_dir), 5).select("pos", "seq_id", "frame_no")


@query(f"""WITH {X.FRAMES}, r AS (SELECT *, lag(pos) OVER w AS prev_pos, first(pos) OVER w AS global_pos, count(*) OVER (PARTITION BY
  seq_id) AS n FROM frames WINDOW w AS (PARTITION BY seq_id ORDER BY frame_no))"""
       " SELECT seq_id, pos, prev_pos, global_pos FROM r WHERE frame_no = n // 2")
def pick_position(spark, sf_dir):
    return sequences.pick_position(X.frames(spark, sf_dir), "middle")


@query(f"WITH {X.FRAMES}, r AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n FROM frames)"
       " SELECT pos, seq_id FROM r WHERE n <= 10 OR list_contains(list_transform(range(10), lambda i: i * (n - 1) // 9), frame_no)")
def even_sample(spark, sf_dir):
    return sequences.even_sample(X.frames(spark, sf_dir), 10).select("pos", "seq_id")


@query("SELECT event_id AS pos FROM events WHERE event_id % 50 = 0 UNION (SELECT event_id FROM events ORDER BY md5(event_id || '|7') LIMIT 40)")
def periodic_sample(spark, sf_dir):
    return sequences.periodic_or_random(X.frames(spark, sf_dir), 50, 40, 7)


DRAWN = f"""{X.FRAMES}, ids AS (SELECT DISTINCT seq_id FROM frames), ranked AS (SELECT seq_id, row_number() OVER (ORDER BY md5(seq_id ||
  '|3'), seq_id) AS r FROM ids)"""


@query(f"WITH {DRAWN} SELECT pos, seq_id FROM frames JOIN ranked USING (seq_id) WHERE r <= greatest(1, floor((SELECT count(*) FROM ids) * 0.2))")
def sample_sequences(spark, sf_dir):
    return sequences.sample_sequences(X.frames(spark, sf_dir), 0.2, 3).select("pos", "seq_id")


@query(f"""WITH {DRAWN}, refs AS (SELECT *, lag(pos) OVER w AS prev_pos, first(pos) OVER w AS global_pos FROM frames WINDOW w AS (PARTITION
  BY seq_id ORDER BY frame_no))"""
       """ SELECT seq_id, global_pos, pos AS target_pos, prev_pos FROM refs JOIN ranked USING (seq_id) WHERE r <= 15 QUALIFY row_number()
  OVER (PARTITION BY seq_id ORDER BY line_count DESC, frame_no) = 1""")
def fixed_validation(spark, sf_dir):
    return sequences.fixed_validation(X.frames(spark, sf_dir), 15, 3)


@query(f"WITH {DRAWN} SELECT seq_id, CASE WHEN r <= floor((SELECT count(*) FROM ids) * 0.95) THEN 'train' ELSE 'val' END AS split FROM ranked")
def train_val_split(spark, sf_dir):
    return sequences.train_val_split(X.frames(spark, sf_dir), 0.95, 3)


@query("SELECT event_id AS pos, event_id // ceil((SELECT count(*) FROM events) / 7)::BIGINT AS shard FROM events")
def shard(spark, sf_dir):
    return sequences.shard(X.frames(spark, sf_dir).select("pos"), 7)


@query(f"""WITH {X.TURNS}, ids AS (SELECT seq_id, row_number() OVER (ORDER BY seq_id) - 1 AS n FROM (SELECT DISTINCT seq_id FROM turns)),
  own AS (SELECT seq_id, (n % 7)::INT AS rank, n // 7 AS slot FROM ids),"""
       """ sizes AS (SELECT rank, count(*) AS size FROM own GROUP BY rank) SELECT rank, a AS slot, o.seq_id FROM (SELECT rank, size,
  unnest(range((SELECT max(size) FROM sizes))) AS a FROM sizes) s"""
       " JOIN own o USING (rank) WHERE o.slot = a % size")
def balanced_ranks(spark, sf_dir):
    return sequences.balanced_ranks(X.turns(spark, sf_dir), 7)


@query(f"""WITH {X.TURNS}, o AS (SELECT seq_id, row_number() OVER (ORDER BY md5(seq_id || '|2'), seq_id) - 1 AS n FROM (SELECT DISTINCT
  seq_id FROM turns)), t AS (SELECT count(*) AS t, ceil(count(*) / 7)::BIGINT AS z FROM o)"""
       " SELECT n // z AS rank, seq_id FROM (SELECT seq_id, n FROM o UNION ALL SELECT seq_id, n + t FROM o, t WHERE n < z * 7 - t), t")
def replica_split(spark, sf_dir):
    return sequences.replica_split(X.turns(spark, sf_dir), 7, 2)


@query("""SELECT p_partkey FROM part ORDER BY ln((('0x' || substr(md5(p_partkey || '|5'), 1, 8))::BIGINT + 1) / 4294967297.0) / p_size
  DESC, p_partkey LIMIT 50""")
def weighted_sample(spark, sf_dir):
    return sequences.weighted_sample(X.table(spark, sf_dir, "part"), 50, 5, "p_partkey", "p_size").select("p_partkey")


@query("""SELECT batch, (floor((512 - 256 * (CASE WHEN batch % 32 < 16 THEN batch % 32 ELSE 32 - batch % 32 END) / 16.0) / 8) * 8)::INT AS
  size FROM (SELECT DISTINCT event_id // 64 AS batch FROM events)""")
def size_schedule(spark, sf_dir):
    return sequences.size_schedule(X.frames(spark, sf_dir).select(F.floor(F.col("pos") / 64).alias("batch")).distinct())


@query("""SELECT row_number() OVER (ORDER BY role, conv_id, turn) - 1 AS global_index, role AS dataset, row_number() OVER (PARTITION BY
  role ORDER BY conv_id, turn) - 1 AS local_index FROM conversations""")
def concat_index(spark, sf_dir):
    return sequences.concat_index(X.turns(spark, sf_dir).withColumn("pos", F.struct("seq_id", "frame_no")))


@query(f"""WITH {X.TURNS} SELECT seq_id, frame_no, payload, 'a' AS dataset, NULL::INT AS npz FROM turns WHERE dataset = 'user' UNION ALL
  SELECT seq_id, frame_no, payload, 'b', payload FROM turns WHERE dataset <> 'user'""")
def combine_datasets(spark, sf_dir):
    t = X.turns(spark, sf_dir)
    return sequences.combine_datasets([("a", None, t.where("dataset = 'user'").drop("dataset")), ("b", None, t.where("dataset != 'user'").drop("dataset").withColumn("npz", F.col("payload")))])


@query(f"""WITH {X.FRAMES} SELECT seq_id, frame_no::BIGINT AS frame_no, pos, lag(pos) OVER (PARTITION BY seq_id ORDER BY frame_no) AS
  prev_pos, frame_no = 0 AS is_first, false AS late FROM frames""")
def stream_frame_pairs(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), "ts")
    return streaming.pairs_of_table(spark, X.frames(spark, sf_dir).join(e, "pos"))


# --- paths ---

LISTS = f"{X.PATHS}, marked AS (SELECT page_id, '/root/x_imgs' || path AS path FROM paths)"


def marked(spark, sf_dir):
    return X.paths(spark, sf_dir).select("page_id", F.concat(F.lit("/root/x_imgs"), "path").alias("path"))


@query(f"""WITH {LISTS} SELECT page_id, coalesce(list_filter(string_split(path, '/')[4:], lambda x: length(x) > 5)[1], string_split(path,
  '/')[-2]) AS seq_id FROM marked""")
def seq_id_marker(spark, sf_dir):
    return marked(spark, sf_dir).select("page_id", P.seq_id_marker(F.col("path")).alias("seq_id"))


@query(f"WITH {LISTS}, d AS (SELECT page_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM marked)"
       " SELECT page_id, coalesce(list_filter(string_split(dir, '/'), lambda x: length(x) > 15)[1], string_split(dir, '/')[-1]) AS seq_id FROM d")
def seq_id_long15(spark, sf_dir):
    return marked(spark, sf_dir).select("page_id", P.seq_id_long15(F.col("path")).alias("seq_id"))


@query(f"""WITH {LISTS}, d AS (SELECT page_id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM marked), c AS (SELECT *,
  string_split(dir, '/')[-1] AS child, string_split(dir, '/')[-2] AS parent FROM d),"""
       """ n AS (SELECT child, count(DISTINCT dir) AS k FROM c GROUP BY child) SELECT page_id, CASE WHEN k > 1 THEN parent ELSE child END
  AS seq_id FROM c JOIN n USING (child)""")
def seq_id_child(spark, sf_dir):
    return P.with_seq_id_child(marked(spark, sf_dir)).select("page_id", "seq_id")


@query(f"WITH {LISTS} SELECT page_id, array_to_string(string_split(path, '/')[1:4], '/') AS seq_path FROM marked")
def seq_path(spark, sf_dir):
    return marked(spark, sf_dir).select("page_id", P.seq_path(F.col("path"), P.parts(F.col("path"))[3]).alias("seq_path"))


@query(f"""WITH {X.PATHS} SELECT page_id, array_to_string(list_transform(regexp_extract_all(lower(path), '[0-9]+|[^0-9]+'), lambda r: CASE
  WHEN regexp_matches(r, '^[0-9]') THEN lpad(r, 20, '0') ELSE r END), '') AS key FROM paths""")
def natural_sort(spark, sf_dir):
    return X.paths(spark, sf_dir).select("page_id", P.natural_key(F.col("path")).alias("key")).orderBy("key")


@query(f"""WITH {LISTS}, s AS (SELECT string_split(path, '/') AS p FROM marked), e AS (SELECT min(p) AS a, max(p) AS b FROM s)
SELECT array_to_string(a[1:coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1,
  least(len(a), len(b)))], '/') AS root FROM e""")
def common_root(spark, sf_dir):
    return P.common_root(marked(spark, sf_dir))


@query(f"WITH {X.PATHS} SELECT page_id, rtrim(path, '/') AS path FROM paths")
def norm_path(spark, sf_dir):
    return X.paths(spark, sf_dir).select("page_id", P.norm_path(F.concat(F.lit("//tmp/./x/../.."), "path", F.lit("//"))).alias("path"))


@query(f"WITH {X.PATHS} SELECT page_id, '/out' || regexp_replace(path, '\\.[^./]*$', '') || '.npz' AS out_path FROM paths")
def derived_path(spark, sf_dir):
    return marked(spark, sf_dir).select("page_id", P.derived_path(F.col("path"), "/root/x_imgs", "/out", ".npz").alias("out_path"))


@query(f"""WITH {X.PATHS}, s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM paths),
n AS (SELECT page_id, concat_ws('_', p[-2], p[-1]) AS parent_name, concat_ws('_', CASE WHEN len(p) > 1 THEN p[1] END, CASE WHEN len(p) > 2
  THEN p[2] END, p[-1]) AS dirs_name,
  concat_ws('_', p[-3], p[-2], regexp_replace(p[-1], '(.)\\.[^.]*$', '\\1')) AS stem_name FROM s)
SELECT *, count(*) OVER (PARTITION BY stem_name) > 1 AS collides FROM n""")
def rename_plan(spark, sf_dir):
    names = {f"{form}_name": P.joined_name(F.col("path"), form) for form in ("parent", "dirs", "stem")}
    return P.with_collisions(X.paths(spark, sf_dir).select("page_id", *[c.alias(n) for n, c in names.items()]), "stem_name")


SIZES = "sizes AS (SELECT p_partkey, 100 + p_size * 20 AS w, 100 + p_partkey % 700 AS h FROM part)"
STATUS = "CASE WHEN w < 130 OR h < 130 THEN 'ERROR' WHEN w = 260 AND h = 260 THEN 'SKIPPED' ELSE 'SUCCESS' END"


def sizes_of(spark, sf_dir):
    return X.table(spark, sf_dir, "part").select("p_partkey", (100 + F.col("p_size") * 20).alias("w"), (100 + F.col("p_partkey") % 700).alias("h"))


@query(f"""WITH {SIZES} SELECT p_partkey, {STATUS} AS status, floor(w * (256.0 / least(w, h)) + 0.5)::BIGINT AS new_w, floor(h * (256.0 /
  least(w, h)) + 0.5)::BIGINT AS new_h,
  floor((floor(w * (256.0 / least(w, h)) + 0.5) - 256) / 2)::BIGINT AS left FROM sizes""")
def fit_plan(spark, sf_dir):
    box = P.fit_box(F.col("w"), F.col("h"), "crop", 256)
    return gates.status_report(sizes_of(spark, sf_dir), target=260, least=130).select("p_partkey", "status", *box[:3])


@query(f"WITH {SIZES} SELECT {STATUS} AS status, count(*) AS n FROM sizes GROUP BY 1")
def status_counts(spark, sf_dir):
    return gates.status_counts(gates.status_report(sizes_of(spark, sf_dir), target=260, least=130))


# --- matching ---

RECORDS = f"""{X.PATHS}, pred AS (SELECT page_id, path AS rel, regexp_extract(path, '[^/]*$') AS stem FROM paths), gt AS (SELECT page_id,
  CASE WHEN page_id % 5 = 0 THEN '/other' || rel ELSE rel END AS rel, stem FROM pred WHERE page_id % 3 <> 0)"""


def sides(spark, sf_dir):
    pred = X.paths(spark, sf_dir).select("page_id", F.col("path").alias("rel"), P.basename(F.col("path")).alias("stem"), F.col("page_id").cast("string").alias("path"))
    gt = pred.where("page_id % 3 != 0").withColumn("rel", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/other"), "rel")).otherwise(F.col("rel")))
    return pred, gt


PAIRED = """one AS (SELECT p.page_id AS pred, g.page_id AS gt, p.stem FROM pred p JOIN gt g USING (rel)), lp AS (SELECT stem, min(page_id)
  AS pred FROM pred WHERE page_id NOT IN (SELECT pred FROM one) GROUP BY stem HAVING count(*) = 1),
lg AS (SELECT stem, min(page_id) AS gt FROM gt WHERE page_id NOT IN (SELECT gt FROM one) GROUP BY stem HAVING count(*) = 1),
matched AS (SELECT pred, gt, 1 AS stage FROM one UNION ALL SELECT pred, gt, 2 FROM lp JOIN lg USING (stem))"""


@query(f"WITH {RECORDS}, {PAIRED} SELECT pred::VARCHAR AS pred, gt::VARCHAR AS gt, stage FROM matched")
def match_pairs(spark, sf_dir):
    return matching.match_pairs(*sides(spark, sf_dir))


@query(f"""WITH {RECORDS}, {PAIRED}, a AS (SELECT stem, count(*) AS n_pred FROM pred WHERE page_id NOT IN (SELECT pred FROM one) GROUP BY stem),
b AS (SELECT stem, count(*) AS n_gt FROM gt WHERE page_id NOT IN (SELECT gt FROM one) GROUP BY stem)
SELECT stem, n_pred, n_gt FROM a JOIN b USING (stem) WHERE n_pred > 1 OR n_gt > 1""")
def match_ambiguous(spark, sf_dir):
    return matching.match_ambiguous(*sides(spark, sf_dir))


@query(f"""WITH {RECORDS}, {PAIRED} SELECT 'pred' AS side, page_id::VARCHAR AS path FROM pred WHERE page_id NOT IN (SELECT pred FROM
  matched) UNION ALL SELECT 'gt', page_id::VARCHAR FROM gt WHERE page_id NOT IN (SELECT gt FROM matched)""")
def match_unmatched(spark, sf_dir):
    return matching.match_unmatched(*sides(spark, sf_dir))


@query(f"""WITH {X.TURNS}, a AS (SELECT seq_id, payload AS left_item, row_number() OVER (PARTITION BY seq_id ORDER BY frame_no)::INT AS rank
  FROM turns WHERE dataset = 'user'),"""
       """ b AS (SELECT seq_id, payload AS right_item, row_number() OVER (PARTITION BY seq_id ORDER BY frame_no)::INT AS rank FROM turns
  WHERE dataset <> 'user') SELECT * FROM a JOIN b USING (seq_id, rank)""")
def align_by_order(spark, sf_dir):
    t = X.turns(spark, sf_dir).withColumnRenamed("payload", "item")
    return matching.align_by_order(t.where("dataset = 'user'"), t.where("dataset != 'user'"), "seq_id", "frame_no")


@query(f"""WITH {X.FRAMES} SELECT pos, seq_id, s_name AS mask FROM frames JOIN supplier ON pos % (SELECT count(*) FROM supplier) = s_suppkey
  - (SELECT min(s_suppkey) FROM supplier)""")
def mask_cyclic(spark, sf_dir):
    s = X.table(spark, sf_dir, "supplier")
    n, low = s.agg(F.count("*"), F.min("s_suppkey")).first()
    return matching.masks_cyclic(X.frames(spark, sf_dir), s.select((F.col("s_suppkey") - low).alias("mask_no"), F.col("s_name").alias("mask")), n)


@query(f"""WITH {X.FRAMES}, m AS (SELECT s_suppkey AS mask, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey // 6 END AS d, CASE WHEN s_suppkey %
  3 = 1 THEN s_suppkey // 6 + 1 END AS p FROM supplier),
own AS (SELECT d AS seq_id, mask, 1 AS tier FROM m WHERE d IS NOT NULL UNION ALL SELECT p, mask, 2 FROM m WHERE p IS NOT NULL),
best AS (SELECT seq_id, min(tier) AS tier FROM own GROUP BY seq_id),
listed AS (SELECT seq_id, mask, row_number() OVER (PARTITION BY seq_id ORDER BY mask) AS rank FROM own JOIN best USING (seq_id, tier)),
free AS (SELECT mask AS free, row_number() OVER (ORDER BY mask) AS rank FROM m WHERE d IS NULL AND p IS NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY frame_no) AS rank FROM frames)
SELECT seq_id, frame_no, pos, CASE WHEN tier IS NULL THEN free ELSE mask END AS mask, coalesce(tier, 3)::INT AS tier
FROM f LEFT JOIN best USING (seq_id) LEFT JOIN listed USING (seq_id, rank) LEFT JOIN free USING (rank)""")
def mask_tiered(spark, sf_dir):
    m = X.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS mask", "s_suppkey AS key", "CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey DIV 6 END AS dir_seq",
                                                      "CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey DIV 6 + 1 END AS part_seq")
    return matching.masks_tiered(X.frames(spark, sf_dir), m)


DRAWN = f"""{X.FRAMES}, h AS (SELECT pos, ('0x' || substr(md5(pos || '|0'), 1, 6))::BIGINT % 10 AS h, ('0x' || substr(md5(pos || '|a|0'), 1,
  6))::BIGINT AS ha, ('0x' || substr(md5(pos || '|b|0'), 1, 6))::BIGINT AS hb FROM frames),
assigned AS (SELECT pos, CASE WHEN h < 4 THEN 'a' WHEN h < 8 THEN 'b' ELSE 'both' END AS source, CASE WHEN h < 4 OR h > 7 THEN (SELECT
  list(s_suppkey ORDER BY s_suppkey) FROM supplier)[ha % (SELECT count(*) FROM supplier) + 1] END AS mask_a,
  CASE WHEN h > 3 THEN (SELECT list(n_nationkey ORDER BY n_nationkey) FROM nation)[hb % (SELECT count(*) FROM nation) + 1] END AS mask_b FROM h)"""


def mixed_masks(spark, sf_dir):
    """Two lists of masks: suppliers and nations, numbered in order."""
    return [sequences.numbered(X.table(spark, sf_dir, t).select(F.col(c).alias("mask")), "mask").withColumnRenamed("n", "mask_no")
            for t, c in (("supplier", "s_suppkey"), ("nation", "n_nationkey"))]


@query(f"WITH {DRAWN} SELECT * FROM assigned")
def mask_mixed(spark, sf_dir):
    return matching.assign_masks_mixed(X.frames(spark, sf_dir), *mixed_masks(spark, sf_dir))


@query(f"""WITH {DRAWN}, px AS (SELECT pos, mask_a % 8 + i AS row, mask_a % 5 AS col FROM assigned, (SELECT unnest(range(3)) AS i) WHERE
  mask_a IS NOT NULL
UNION SELECT pos, mask_b % 8, mask_b % 5 + i FROM assigned, (SELECT unnest(range(3)) AS i) WHERE mask_b IS NOT NULL) SELECT pos, count(*) AS
  area, sum(row)::BIGINT AS rows, sum(col)::BIGINT AS cols FROM px GROUP BY pos""")
def mask_union(spark, sf_dir):
    a, b = mixed_masks(spark, sf_dir)
    three = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")
    px_a = a.select("mask", three).select("mask", (F.col("mask") % 8 + F.col("i")).alias("row"), (F.col("mask") % 5).alias("col"))
    px_b = b.select("mask", three).select("mask", (F.col("mask") % 8).cast("long").alias("row"), (F.col("mask") % 5 + F.col("i")).cast("long").alias("col"))
    px = matching.mixed_mask_pixels(matching.assign_masks_mixed(X.frames(spark, sf_dir), a, b), px_a, px_b)
    return px.groupBy("pos").agg(F.count("*").alias("area"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


@query(f"""WITH {X.FRAMES} SELECT f.pos, r.pos AS record FROM frames f LEFT JOIN frames r ON r.seq_id = f.seq_id AND r.frame_no = f.frame_no
  AND r.valid""")
def attach_segments(spark, sf_dir):
    f = X.frames(spark, sf_dir).withColumn("stem", F.format_string("frame_%05d", "frame_no"))
    return matching.attach_segments(f.select("pos", "seq_id", "stem"), f.where("valid").select("seq_id", "stem", F.col("pos").alias("record")))


@query("SELECT event_id AS pos FROM events WHERE event_type NOT IN ('click', 'view')")
def resume(spark, sf_dir):
    f = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), "event_type", F.concat(F.lit("/out/"), "event_id").alias("out_path"))
    return matching.resume(f, f.where("event_type IN ('click', 'view')").select("out_path")).select("pos")


@query(f"""WITH {X.FRAMES}, a AS (SELECT pos, conf AS sa FROM frames WHERE valid), b AS (SELECT pos, line_count::DOUBLE AS sb FROM frames
  WHERE NOT valid OR line_count % 2 = 0),
m AS (SELECT pos, coalesce(sa, -1) AS x, coalesce(sb, -1) AS y FROM a FULL JOIN b USING (pos))
SELECT pos, CASE WHEN greatest(x, y) <= 20 THEN 'none' WHEN x >= y THEN 'homography' ELSE 'flow' END AS source, CASE WHEN greatest(x, y) >
  20 THEN greatest(x, y) ELSE 0 END AS score FROM m""")
def select_alignment(spark, sf_dir):
    f = X.frames(spark, sf_dir)
    one = f.where("valid").select("pos", F.col("conf").alias("score"))
    return matching.select_alignment(one, f.where("NOT valid OR line_count % 2 = 0").select("pos", F.col("line_count").cast("double").alias("score")), 20.0)


@query(f"""WITH {X.TURNS}, r AS (SELECT seq_id, frame_no, payload AS current, first(payload) OVER w AS global_ref, lag(payload) OVER w AS l
  FROM turns WINDOW w AS (PARTITION BY seq_id ORDER BY frame_no))"""
       " SELECT seq_id, frame_no, current, global_ref, coalesce(l, 0) AS local_ref, (l IS NOT NULL)::INT AS local_used FROM r")
def assemble_refs(spark, sf_dir):
    return matching.assemble_refs(X.turns(spark, sf_dir))


@query(f"""WITH {X.TURNS} SELECT seq_id, frame_no, payload AS current, first(payload) OVER w AS global_ref, 0 AS local_ref, 0 AS local_used
  FROM turns WINDOW w AS (PARTITION BY seq_id ORDER BY frame_no)""")
def assemble_refs_none(spark, sf_dir):
    return matching.assemble_refs(X.turns(spark, sf_dir), local="none")


@query(f"""WITH {X.TURNS} SELECT seq_id, frame_no, payload AS current, first(payload) OVER w AS global_ref, coalesce(payload, 0) AS local_ref,
  (payload IS NOT NULL)::INT AS local_used FROM turns WINDOW w AS (PARTITION BY seq_id ORDER BY frame_no)""")
def assemble_refs_gt(spark, sf_dir):
    return matching.assemble_refs(X.turns(spark, sf_dir), local="gt")


# --- segments ---


@query(f"WITH {X.SEGMENTS}, d AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS l FROM segments)"
       """ SELECT frame, k, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(dx / (l + 1e-8), 6) AS ux, round(dy / (l +
  1e-8), 6) AS uy, round(l, 6) AS length FROM d""")
def segment_features(spark, sf_dir):
    return rounded(geometry.segment_features(X.segments(spark, sf_dir), ["frame", "k"]))


@query(f"""WITH {X.SEGMENTS} SELECT frame, k, round(1 - y1, 6) AS x1, round(1 - x1, 6) AS y1, round(1 - y2, 6) AS x2, round(1 - x2, 6) AS y2
  FROM segments""")
def rotate_flip(spark, sf_dir):
    return rounded(geometry.rotate_flip(X.segments(spark, sf_dir)).select("frame", "k", *geometry.ENDS))


@query(f"WITH {X.SEGMENTS}, t AS (SELECT *, max(greatest(abs(x1), abs(y1), abs(x2), abs(y2))) OVER (PARTITION BY frame) <= 55 AS s FROM segments)"
       " SELECT frame, k, " + ", ".join(f"round(CASE WHEN s THEN {c} * 64 ELSE {c} END, 6) AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM t")
def denormalize(spark, sf_dir):
    return rounded(geometry.denormalize(X.segments(spark, sf_dir), 64, threshold=55).select("frame", "k", *geometry.ENDS))


@query(f"WITH {X.SEGMENTS} SELECT frame, k, round(score, 6) AS score FROM segments WHERE score > 0.8")
def score_filter(spark, sf_dir):
    return rounded(geometry.score_filter(X.segments(spark, sf_dir), 0.8).select("frame", "k", "score"))


@query(f"WITH {X.SEGMENTS}, {X.RASTER} SELECT frame, row, col FROM pixels")
def rasterize(spark, sf_dir):
    return geometry.rasterize(X.segments(spark, sf_dir))


def line_sql(spot: Callable[[str, int], str], source: str) -> str:
    """Every step of every segment between whole ends, those on the canvas kept."""
    return f"""ends AS (SELECT frame, {spot('x1', 64)} AS x1, {spot('y1', 64)} AS y1, {spot('x2', 64)} AS x2, {spot('y2', 64)} AS y2 FROM {source}),
w AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy, greatest(abs(x2 - x1), abs(y2 - y1)) AS n FROM ends),
p AS (SELECT frame, CASE WHEN abs(dx) >= abs(dy) THEN x1 + sign(dx) * i ELSE x1 + floor(dx::DOUBLE * i / n + 0.5) END AS col,
  CASE WHEN abs(dx) >= abs(dy) THEN y1 + floor(dy::DOUBLE * i / greatest(n, 1) + 0.5) ELSE y1 + sign(dy) * i END AS row
  FROM w, LATERAL (SELECT unnest(range(n + 1)) AS i))
SELECT DISTINCT frame, row::INT AS row, col::INT AS col FROM p WHERE row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63"""


@query(f"WITH {X.SEGMENTS}, far AS (SELECT frame, x1 * 3 - 40 AS x1, y1 * 2 AS y1, x2 * 3 - 40 AS x2, y2 * 2 AS y2 FROM segments),"
       f" {line_sql(lambda c, n: f'trunc({c} * 0.5)::BIGINT', 'far')}")
def raster_truncated(spark, sf_dir):
    """Segments that reach beyond the canvas on all sides, at half scale."""
    wide = {c: F.col(c) * (3 if c[0] == "x" else 2) - (40 if c[0] == "x" else 0) for c in geometry.ENDS}
    return geometry.raster_lines(X.segments(spark, sf_dir).withColumns(wide), scale=0.5)


@query(f"WITH {X.SEGMENTS}, far AS (SELECT frame, x1 * 2 - 30 AS x1, y1, x2 * 2 - 30 AS x2, y2 FROM segments),"
       f" {line_sql(lambda c, n: f'least({n - 1}, greatest(0, round_even({c}, 0)))::BIGINT', 'far')}")
def raster_clipped(spark, sf_dir):
    return geometry.raster_lines(X.segments(spark, sf_dir).withColumns({c: F.col(c) * 2 - 30 for c in ("x1", "x2")}), ends="clipped")


@query("""WITH q AS (SELECT vec_id, embedding[1]::DOUBLE AS w, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS z FROM embeddings)
SELECT vec_id, round(1 - 2 * y ** 2 - 2 * z ** 2, 9) AS r0, round(2 * x * y - 2 * w * z, 9) AS r1, round(2 * z * x + 2 * w * y, 9) AS r2,
  round(2 * x * y + 2 * w * z, 9) AS r3, round(1 - 2 * x ** 2 - 2 * z ** 2, 9) AS r4, round(2 * y * z - 2 * w * x, 9) AS r5,
  round(2 * z * x - 2 * w * y, 9) AS r6, round(2 * y * z + 2 * w * x, 9) AS r7, round(1 - 2 * x ** 2 - 2 * y ** 2, 9) AS r8 FROM q""")
def quat_raw(spark, sf_dir):
    """Rotations of quaternions as they stand, whatever their length."""
    r = geometry.quat_to_rot([F.get("embedding", F.lit(i)).cast("double") for i in range(4)], normalize=False)
    return rounded(X.table(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(f"r{i}") for i, c in enumerate(r)]), 9)


FEATURES = """f AS (SELECT frame, k, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) / (sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) + 1e-8)
  AS ux, (y2 - y1) / (sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) + 1e-8) AS uy FROM segments)"""


@query(f"""WITH {X.SEGMENTS}, {X.PAIRS}, {FEATURES} SELECT p.frame AS pair, a.k AS ka, b.k AS kb FROM pairs p JOIN f a ON a.frame = p.prev
  JOIN f b ON b.frame = p.frame"""
       " WHERE (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 <= 36 AND acos(least(1.0, greatest(-1.0, a.ux * b.ux + a.uy * b.uy))) <= 0.5")
def coarse_match(spark, sf_dir):
    f, p = geometry.segment_features(X.segments(spark, sf_dir), ["frame", "k"]), X.pairs(spark, sf_dir)
    a = p.join(f.withColumnRenamed("frame", "prev"), "prev").withColumnRenamed("frame", "pair")
    return geometry.coarse_match(a, f.withColumnRenamed("frame", "pair"), 6.0, 0.5)


@query(f"""WITH {X.SEGMENTS}, {X.PAIRS}, m AS (SELECT p.frame AS pair, a.k AS m, a.x1 AS x0, a.y1 AS y0, b.x1 AS x1, b.y1 AS y1 FROM pairs p
  JOIN segments a ON a.frame = p.prev JOIN segments b ON b.frame = p.frame AND b.k = a.k),"""
       """ pts AS (SELECT p.frame AS pair, s.k AS pt, s.x2 AS x, s.y2 AS y FROM pairs p JOIN segments s ON s.frame = p.prev), d AS (SELECT
  pts.*, m.*, sqrt((x - x0) ** 2 + (y - y0) ** 2) AS d FROM pts JOIN m USING (pair)),"""
       " n AS (SELECT *, 1 / (d + 1e-6) AS w FROM d QUALIFY row_number() OVER (PARTITION BY pair, pt ORDER BY d, m) <= 4)"
       """ SELECT pair, pt, round(any_value(x) + sum(w * (x1 - x0)) / sum(w), 5) AS wx, round(any_value(y) + sum(w * (y1 - y0)) / sum(w),
  5) AS wy FROM n GROUP BY pair, pt""")
def idw_warp(spark, sf_dir):
    s, p = X.segments(spark, sf_dir), X.pairs(spark, sf_dir)
    before = p.join(s.withColumnRenamed("frame", "prev"), "prev")
    after = s.select("frame", "k", F.col("x1").alias("nx"), F.col("y1").alias("ny"))
    m = before.join(after, ["frame", "k"]).select(F.col("frame").alias("pair"), F.col("k").alias("m"), F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("nx").alias("x1"), F.col("ny").alias("y1"))
    pts = before.select(F.col("frame").alias("pair"), F.col("k").alias("pt"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    return rounded(geometry.idw_warp(pts, m), 5)


@query(f"""WITH {X.SEGMENTS}, j AS (SELECT frame, k AS j, x1 AS jx, y1 AS jy FROM segments WHERE k % 2 = 0), e AS (SELECT frame, k, 1 AS e,
  x1 AS x, y1 AS y FROM segments UNION ALL SELECT frame, k, 2, x2, y2 FROM segments),"""
       """ n AS (SELECT frame, k, e, arg_min(j, ((x - jx) * (x - jx) + (y - jy) * (y - jy), j)) AS j FROM e JOIN j USING (frame) GROUP BY
  ALL) SELECT DISTINCT frame, j1, j2 FROM (SELECT frame, k, min(j) AS j1, max(j) AS j2 FROM n GROUP BY ALL) WHERE j1 <> j2""")
def snap_junctions(spark, sf_dir):
    s = X.segments(spark, sf_dir)
    return geometry.snap_to_junctions(s, s.where("k % 2 = 0").select("frame", F.col("k").alias("j"), F.col("x1").alias("jx"), F.col("y1").alias("jy")))


@query(f"""WITH {X.SEGMENTS}, t AS (SELECT seq_id AS pair, frame * 16 + k AS m, x1 AS x0, y1 AS y0, x2 AS x1, y2 AS y1 FROM segments),
pts AS (SELECT seq_id AS pair, frame * 16 + k AS pt, x2 AS x, y2 AS y FROM segments WHERE k < 4),
d AS (SELECT pts.*, t.*, sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) AS d FROM pts JOIN t USING (pair)),
n AS (SELECT *, 1 / (d + 1e-6) AS w FROM d QUALIFY row_number() OVER (PARTITION BY pair, pt ORDER BY d, m) <= 4)
SELECT pair, pt, round(any_value(x) + sum(w * (x1 - x0)) / sum(w), 5) AS wx, round(any_value(y) + sum(w * (y1 - y0)) / sum(w), 5) AS wy
FROM n GROUP BY pair, pt""")
def idw_warp_dense(spark, sf_dir):
    """All segments of a label as matches of one group, so that points search cells."""
    s = X.segments(spark, sf_dir).withColumn("id", F.col("frame") * 16 + F.col("k")).withColumnRenamed("seq_id", "pair")
    m = s.select("pair", F.col("id").alias("m"), F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x2").alias("x1"), F.col("y2").alias("y1"))
    return rounded(geometry.idw_warp(s.where("k < 4").select("pair", F.col("id").alias("pt"), F.col("x2").alias("x"), F.col("y2").alias("y")), m), 5)


@query(f"""WITH {X.SEGMENTS}, j AS (SELECT seq_id AS frame, frame * 16 + k AS j, x1 AS jx, y1 AS jy FROM segments WHERE k % 4 = 0),
e AS (SELECT seq_id AS frame, frame * 16 + k AS k, 1 AS e, x1 + 0.5 AS x, y1 AS y FROM segments WHERE k % 4 = 1
  UNION ALL SELECT seq_id, frame * 16 + k, 2, x2, y2 FROM segments WHERE k % 4 = 1),
n AS (SELECT frame, k, e, arg_min(j, ((x - jx) * (x - jx) + (y - jy) * (y - jy), j)) AS j FROM e JOIN j USING (frame) GROUP BY ALL)
SELECT DISTINCT frame, j1, j2 FROM (SELECT frame, k, min(j) AS j1, max(j) AS j2 FROM n GROUP BY ALL) WHERE j1 <> j2""")
def snap_junctions_dense(spark, sf_dir):
    """All segments of a label in one frame."""
    s = X.segments(spark, sf_dir).withColumn("id", F.col("frame") * 16 + F.col("k")).drop("frame").withColumnRenamed("seq_id", "frame")
    ends = s.where("k % 4 = 1").select("frame", F.col("id").alias("k"), (F.col("x1") + 0.5).alias("x1"), "y1", "x2", "y2")
    return geometry.snap_to_junctions(ends, s.where("k % 4 = 0").select("frame", F.col("id").alias("j"), F.col("x1").alias("jx"), F.col("y1").alias("jy")))


H = [0.9, 0.1, 2.0, -0.05, 1.1, 1.0, 0.001, 0.002, 1.0]


@query(f"""WITH {X.SEGMENTS}, w AS (SELECT frame, k, floor((0.9 * x1 + 0.1 * y1 + 2.0) / (0.001 * x1 + 0.002 * y1 + 1.0) + 0.5)::INT AS col,
  floor((-0.05 * x1 + 1.1 * y1 + 1.0) / (0.001 * x1 + 0.002 * y1 + 1.0) + 0.5)::INT AS row FROM segments)"""
       " SELECT * FROM w WHERE row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63")
def homography_warp(spark, sf_dir):
    return geometry.warp_homography(X.segments(spark, sf_dir).select("frame", "k", F.col("x1").alias("x"), F.col("y1").alias("y")), H, 64, 64)


def consensus_sql(name: str, matches: str, draws: int, thresh: float) -> str:
    """Tables {name}_e (pair, d, m), the matches that a draw's matrix carries, {name}_b (pair, d, inliers), the best draw, and {name}_c
    (pair, m), its matches, from a table of matches (pair, m, x0, y0, x1, y1)."""
    def area(x: str, y: str, a: int, b: int, c: int) -> str:
        return f"({x}{b} - {x}{a}) * ({y}{c} - {y}{a}) - ({x}{c} - {x}{a}) * ({y}{b} - {y}{a})"

    areas = [(4, 2, 3), (1, 4, 3), (1, 2, 4), (1, 2, 3)]
    columns = ", ".join(f"{area(x, y, *t)} AS {z}{i}" for z, x, y in (("l", "x", "y"), ("k", "u", "v")) for i, t in enumerate(areas, 1))
    solid = " AND ".join(f"least({c}) > 1e-3 * greatest({c})" for c in (", ".join(f"abs({z}{i})" for i in range(1, 5)) for z in "lk"))
    cross = [(f"(y{j} - y{k})", f"(x{k} - x{j})", f"(x{j} * y{k} - x{k} * y{j})") for j, k in ((2, 3), (3, 1), (1, 2))]
    h = ", ".join(" + ".join(f"k{i} / l{i} * {(f'u{i}', f'v{i}', '1.0::DOUBLE')[s]} * {cross[i - 1][t]}" for i in (1, 2, 3)) + f" AS h{s}{t}" for s in range(3) for t in range(3))
    u, v, w = (f"(h{s}0 * m.x0 + h{s}1 * m.y0 + h{s}2)" for s in range(3))
    points = ", ".join(f"l{c}[i{i} + 1] AS {c}{i}" for i in (1, 2, 3, 4) for c in "xyuv")
    places = ", ".join(f"('0x' || substr(h, {8 * i - 7}, 8))::BIGINT % n AS i{i}" for i in (1, 2, 3, 4))
    return f"""{name}_l AS MATERIALIZED (SELECT pair, count(*) AS n, list(x0 ORDER BY m) AS lx, list(y0 ORDER BY m) AS ly, list(x1 ORDER BY m) AS lu,
  list(y1 ORDER BY m) AS lv FROM {matches} GROUP BY pair HAVING count(*) >= 4),
{name}_d AS (SELECT pair, d, n, md5(pair || '|' || d) AS h FROM {name}_l, (SELECT unnest(range({draws})) AS d)),
{name}_s AS (SELECT pair, d, {places} FROM {name}_d),
{name}_p AS (SELECT pair, d, {points} FROM {name}_s JOIN {name}_l USING (pair)
  WHERE i1 <> i2 AND i1 <> i3 AND i1 <> i4 AND i2 <> i3 AND i2 <> i4 AND i3 <> i4),
{name}_a AS (SELECT *, {columns} FROM {name}_p),
{name}_h AS (SELECT pair, d, {h} FROM {name}_a WHERE {solid}),
{name}_e AS MATERIALIZED (SELECT h.pair, h.d, m.m FROM {name}_h h JOIN {matches} m ON m.pair = h.pair
  WHERE {w} <> 0 AND sqrt(({u} / {w} - m.x1) * ({u} / {w} - m.x1) + ({v} / {w} - m.y1) * ({v} / {w} - m.y1)) <= {thresh}),
{name}_b AS MATERIALIZED (SELECT pair, d, count(*) AS inliers FROM {name}_e GROUP BY pair, d QUALIFY row_number() OVER (PARTITION BY pair ORDER BY count(*) DESC, d) = 1),
{name}_c AS (SELECT e.pair, e.m FROM {name}_b b JOIN {name}_e e ON e.pair = b.pair AND e.d = b.d WHERE inliers >= 4)"""


def end_matches(spark, sf_dir):
    """First ends of segments of one number in consecutive frames."""
    s, p = X.segments(spark, sf_dir), X.pairs(spark, sf_dir)
    m = p.join(s.select(F.col("frame").alias("prev"), "k", F.col("x1").alias("x0"), F.col("y1").alias("y0")), "prev").join(s.select("frame", "k", "x1", "y1"), ["frame", "k"])
    return m.select(F.col("frame").alias("pair"), F.col("k").alias("m"), "x0", "y0", "x1", "y1")


END_MATCHES = f"""{X.SEGMENTS}, {X.PAIRS}, ms AS (SELECT p.frame AS pair, a.k AS m, a.x1 AS x0, a.y1 AS y0, b.x1 AS x1, b.y1 AS y1
  FROM pairs p JOIN segments a ON a.frame = p.prev JOIN segments b ON b.frame = p.frame AND b.k = a.k)"""


@query(f"""WITH {END_MATCHES}, {consensus_sql('c', 'ms', 200, 3.0)} SELECT pair, coalesce(inliers, 0)::INT AS inliers, coalesce(inliers, 0) >= 4 AS fitted
FROM (SELECT DISTINCT pair FROM ms) LEFT JOIN c_b USING (pair)""")
def homography_fit(spark, sf_dir):
    fit = geometry.fit_homography(end_matches(spark, sf_dir), draws=200)
    return fit.select("pair", "inliers", F.col("h").isNotNull().alias("fitted"))


@query()
def homography_matrix(spark, sf_dir):
    return geometry.fit_homography(end_matches(spark, sf_dir), draws=200)


@query(f"""WITH {X.SEGMENTS}, s AS (SELECT frame, x1, y1, x2, y2, greatest(1, ceil(greatest(abs(x2 - x1), abs(y2 - y1))))::INT AS n, abs(x2
  - x1) >= abs(y2 - y1) AS flat FROM segments),
p AS (SELECT frame, flat, x1 + (x2 - x1) * i / n AS x, y1 + (y2 - y1) * i / n AS y FROM s, LATERAL (SELECT unnest(range(n + 1)) AS i)),
a AS (SELECT frame, flat, CASE WHEN flat THEN y ELSE x END AS minor, floor((CASE WHEN flat THEN x ELSE y END) + 0.5)::INT AS major FROM p),
b AS (SELECT frame, flat, major, floor(minor)::INT + k AS m, CASE WHEN k = 0 THEN 1 - (minor - floor(minor)) ELSE minor - floor(minor) END
  AS v FROM a, (SELECT unnest(range(2)) AS k)),
c AS (SELECT frame, CASE WHEN flat THEN m ELSE major END AS row, CASE WHEN flat THEN major ELSE m END AS col, v FROM b)
SELECT frame, row, col, round(max(v), 6) AS v FROM c WHERE row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63 AND v > 0 GROUP BY ALL""")
def raster_aa(spark, sf_dir):
    return rounded(geometry.rasterize_aa(X.segments(spark, sf_dir)))


# --- masks and metrics ---


def mask_sides(spark, sf_dir):
    """(pair, pf, gf): the frames whose pixels are a pair's prediction and truth, the previous and the current one. By negative numbers come further
    pairs with an empty mask on one side or on both."""
    p = X.pairs(spark, sf_dir)
    tens, frame = F.col("frame") % 10, F.col("frame")
    lone = p.where(tens <= 2).select((-1 - frame).alias("pair"), F.when(tens == 0, F.col("prev")).alias("pf"), F.when(tens == 1, frame).alias("gf"))
    return p.select(frame.alias("pair"), F.col("prev").alias("pf"), frame.alias("gf")).unionByName(lone)


def pair_keys(spark, sf_dir):
    return mask_sides(spark, sf_dir).select("pair")


def masks(spark, sf_dir):
    """(prediction, truth): pixels of the pairs' frames."""
    px, m = geometry.rasterize(X.segments(spark, sf_dir)), mask_sides(spark, sf_dir)
    return tuple(m.join(px.withColumnRenamed("frame", c), c).select("pair", "row", "col") for c in ("pf", "gf"))


MASKS = f"""{X.SEGMENTS}, {X.RASTER}, {X.PAIRS},
mask_sides AS (SELECT frame AS pair, prev AS pf, frame AS gf FROM pairs UNION ALL SELECT -1 - frame, CASE WHEN frame % 10 = 0 THEN prev END,
  CASE WHEN frame % 10 = 1 THEN frame END FROM pairs WHERE frame % 10 <= 2),
pred AS (SELECT pair, row, col FROM mask_sides JOIN pixels ON frame = pf), gt AS (SELECT pair, row, col FROM mask_sides JOIN pixels ON frame = gf),
c AS (SELECT pair, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND g IS NULL) AS fp, count(*) FILTER (g AND p IS NULL) AS fn
  FROM (SELECT *, true AS p FROM pred) FULL JOIN (SELECT *, true AS g FROM gt) USING (pair, row, col) GROUP BY pair),
all_pairs AS (SELECT pair FROM mask_sides), counted AS (SELECT pair, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn
  FROM all_pairs LEFT JOIN c USING (pair))"""


@query(f"""WITH {MASKS}, q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM counted)
SELECT pair, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6)
  AS f1 FROM q""")
def prf(spark, sf_dir):
    return rounded(metrics.prf(*masks(spark, sf_dir), pair_keys(spark, sf_dir)))


@query(f"WITH {MASKS} SELECT pair, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) AS iou FROM counted")
def mask_iou(spark, sf_dir):
    return rounded(metrics.mask_iou(*masks(spark, sf_dir), pair_keys(spark, sf_dir)))


EDGES = f"""{MASKS}, q AS (SELECT *, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r, tp + fp + fn = 0 AS none FROM counted),
edges AS (SELECT pair, CASE WHEN none THEN 1 ELSE p * 100 END AS precision, CASE WHEN none THEN 1 ELSE r * 100 END AS recall, CASE WHEN none
  THEN 1 ELSE 200 * p * r / (p + r + 1e-8) END AS f1 FROM q)"""


@query(f"WITH {EDGES} SELECT pair, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM edges")
def edge_accuracy(spark, sf_dir):
    return rounded(metrics.edge_accuracy(*masks(spark, sf_dir), pair_keys(spark, sf_dir)))


@query(f"""WITH {EDGES}, k AS (SELECT CASE WHEN pair % 2 = 0 THEN 'edge' ELSE 'line' END AS kind, count(*) AS maps, avg(precision) AS
  precision, avg(recall) AS recall, avg(f1) AS f1 FROM edges GROUP BY 1)
SELECT kind, maps, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM k UNION ALL SELECT 'average', NULL,
  NULL, NULL, round(avg(f1), 6) FROM k""")
def edge_report(spark, sf_dir):
    maps = metrics.edge_accuracy(*masks(spark, sf_dir), pair_keys(spark, sf_dir))
    kinds = [metrics.edge_accuracy_means(maps.where(F.abs("pair") % 2 == i), kind) for i, kind in enumerate(("edge", "line"))]
    return rounded(metrics.average_f1(kinds[0].unionByName(kinds[1])))


# Column by column first: the nearest pixel of a row, then of all rows.
NEAREST = f"""{MASKS}, near_column AS (SELECT pair, side, r, c, min(abs(c - col)) AS dc FROM (SELECT pair, 'p' AS side, row AS r, col FROM gt
  UNION ALL SELECT pair, 'g', row, col FROM pred) t, (SELECT unnest(range(64)) AS c) GROUP BY ALL),
near AS (SELECT s.pair, s.row, s.col, s.side, min(sqrt(((s.row - n.r) ** 2 + n.dc ** 2)::DOUBLE)) AS d FROM (SELECT pair, row, col, 'p' AS side FROM pred
  UNION ALL SELECT pair, row, col, 'g' FROM gt) s JOIN near_column n ON n.pair = s.pair AND n.side = s.side AND n.c = s.col GROUP BY ALL)"""


@query(f"""WITH {NEAREST} SELECT a.pair, a.row, a.col, round(d, 6) AS d FROM pred a LEFT JOIN (SELECT * FROM near WHERE side = 'p') USING
  (pair, row, col)""")
def nearest_distance(spark, sf_dir):
    return rounded(metrics.nearest_distance(*masks(spark, sf_dir)))


@query(f"""WITH {NEAREST}, m AS (SELECT pair, (avg(d) FILTER (side = 'p') + avg(d) FILTER (side = 'g')) / 2 AS v FROM near GROUP BY pair)
SELECT pair, CASE WHEN tp + fp + fn = 0 THEN 0 WHEN tp + fp = 0 OR tp + fn = 0 THEN 1e6 ELSE round(v, 6) END AS chamfer FROM counted LEFT
  JOIN m USING (pair)""")
def chamfer(spark, sf_dir):
    return rounded(metrics.chamfer(*masks(spark, sf_dir), pairs=pair_keys(spark, sf_dir)))


def tolerant_sql(near: str, counted: str) -> str:
    return f"""h AS (SELECT pair, sum((d <= 2)::INT) FILTER (side = 'p') AS ph, count(*) FILTER (side = 'p') AS pn, sum((d <= 2)::INT)
  FILTER (side = 'g') AS gh, count(*) FILTER (side = 'g') AS gn FROM {near} GROUP BY pair),
q AS (SELECT c.pair, c.n = 0 AS none, coalesce(ph / (pn + 1e-6), 0) AS p, coalesce(gh / (gn + 1e-6), 0) AS r FROM {counted} c LEFT JOIN h
  USING (pair))
SELECT pair, CASE WHEN none THEN 1 ELSE round(p, 6) END AS precision, CASE WHEN none THEN 1 ELSE round(r, 6) END AS recall, CASE WHEN none
  THEN 1 ELSE round(2 * p * r / (p + r + 1e-6), 6) END AS f1 FROM q"""


@query(f"WITH {NEAREST}, {tolerant_sql('near', '(SELECT pair, tp + fp + fn AS n FROM counted)')}")
def prf_tolerant(spark, sf_dir):
    return rounded(metrics.prf_tolerant(*masks(spark, sf_dir), pairs=pair_keys(spark, sf_dir)))


@query(f"""WITH {MASKS}, a AS (SELECT * FROM pred WHERE row + col < 50), b AS (SELECT * FROM gt WHERE row + col < 50),
near AS (SELECT a.pair, a.row, a.col, 'p' AS side, min(sqrt(((a.row - b.row) ** 2 + (a.col - b.col) ** 2)::DOUBLE)) AS d FROM a JOIN b USING
  (pair) GROUP BY ALL UNION ALL
  SELECT b.pair, b.row, b.col, 'g', min(sqrt(((a.row - b.row) ** 2 + (a.col - b.col) ** 2)::DOUBLE)) FROM a JOIN b USING (pair) GROUP BY ALL),
sizes AS (SELECT pair, (SELECT count(*) FROM a WHERE a.pair = k.pair) + (SELECT count(*) FROM b WHERE b.pair = k.pair) AS n FROM all_pairs
  k), {tolerant_sql('near', 'sizes')}""")
def prf_tolerant_region(spark, sf_dir):
    """Only pixels of the corner above the line row + col = 50 count."""
    side = F.explode(F.sequence(F.lit(0), F.lit(63)))
    corner = pair_keys(spark, sf_dir).select("pair", side.alias("row")).select("pair", "row", side.alias("col")).where("row + col < 50")
    return rounded(metrics.prf_tolerant(*masks(spark, sf_dir), pairs=pair_keys(spark, sf_dir), region=corner))


@query(f"""WITH {MASKS} SELECT pair, greatest(min(row) - 8, 0) AS top, greatest(min(col) - 8, 0) AS left, least(max(row) + 8, 63) AS bottom,
  least(max(col) + 8, 63) AS right FROM gt GROUP BY pair""")
def mask_bbox(spark, sf_dir):
    return metrics.mask_bbox(masks(spark, sf_dir)[1], 8, 64, 64)


GRIDS = f"""{X.GRID8}, {X.PAIRS}, m AS (SELECT p.frame AS pair, a.row, a.col, a.v AS p, b.v AS g FROM pairs p JOIN grid8 a ON a.frame =
  p.prev JOIN grid8 b ON b.frame = p.frame AND b.row = a.row AND b.col = a.col)"""


def grids_of(spark, sf_dir):
    g, p = X.grid8(spark, sf_dir), X.pairs(spark, sf_dir)
    return p.join(g.withColumnRenamed("frame", "prev"), "prev").select(F.col("frame").alias("pair"), "row", "col", "v"), p.select("frame").join(g, "frame").select(F.col("frame").alias("pair"), "row", "col", "v")


@query(f"""WITH {GRIDS} SELECT pair, round(avg((p - g) ** 2), 6) AS mse, round(avg(abs(p - g)), 6) AS mae, round(-10 * log10(avg((p - g) **
  2)), 6) AS psnr FROM m GROUP BY pair""")
def image_errors(spark, sf_dir):
    return rounded(metrics.image_errors(*grids_of(spark, sf_dir)))


@query(f"WITH {GRIDS} SELECT pair, round(-10 * log10(avg((p - g) ** 2) FILTER (g > 0.55)), 6) AS psnr FROM m GROUP BY pair")
def psnr_hole(spark, sf_dir):
    a, b = grids_of(spark, sf_dir)
    return rounded(metrics.psnr_hole(a, b, b.where("v > 0.55")))


def ssim_sql(m: str) -> str:
    return f"""o AS (SELECT unnest(range(7)) AS i), w AS (SELECT pair, row - a.i AS r, col - b.i AS c, count(*) AS n, avg(p) AS mp, avg(g)
  AS mg, var_samp(p) AS vp, var_samp(g) AS vg, covar_samp(p, g) AS cv
 FROM {m}, o a, o b GROUP BY ALL) SELECT pair, round(avg((2 * mp * mg + 0.0001) * (2 * cv + 0.0009) / ((mp ** 2 + mg ** 2 + 0.0001) * (vp +
  vg + 0.0009))), 6) AS ssim FROM w WHERE n = 49 GROUP BY pair"""


@query(f"WITH {GRIDS}, {ssim_sql('m')}")
def ssim(spark, sf_dir):
    return rounded(metrics.ssim(*grids_of(spark, sf_dir)))


@query(f"""WITH {GRIDS}, box AS (SELECT pair, greatest(min(row) - 2, 0) AS t, least(max(row) + 2, 7) AS b, greatest(min(col) - 2, 0) AS l,
  least(max(col) + 2, 7) AS r FROM m WHERE g > 0.75 GROUP BY pair),
cut AS (SELECT m.* FROM m JOIN box USING (pair) WHERE row BETWEEN t AND b AND col BETWEEN l AND r), {ssim_sql('cut')}""")
def ssim_hole_bbox(spark, sf_dir):
    a, b = grids_of(spark, sf_dir)
    return rounded(metrics.ssim_hole_bbox(a, b, b.where("v > 0.75"), 8, 8, 2))


@query(f"WITH {GRIDS} SELECT pair, round(avg((p - g) ** 2), 6) AS error FROM m WHERE p > 0.4 GROUP BY pair HAVING count(*) > 1")
def warp_error(spark, sf_dir):
    a, b = grids_of(spark, sf_dir)
    return rounded(metrics.warp_error(a, b, a.where("v > 0.4")))


@query(f"""WITH {X.GRID8}, steps AS (SELECT vec_id AS frame, label AS seq_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt
  FROM embeddings),
aim AS (SELECT g.frame, g.row, g.col, g.v, nxt, g.col + (v - 0.5) * 4 AS x, g.row - (v - 0.5) * 2 AS y FROM grid8 g JOIN steps USING (frame)
  WHERE nxt IS NOT NULL),
valid AS (SELECT * FROM aim WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7),
w AS (SELECT a.frame, a.row, a.col, any_value(a.v) AS p, sum(n.v * (1 - abs(n.col - a.x)) * (1 - abs(n.row - a.y))) AS g
  FROM valid a JOIN grid8 n ON n.frame = a.nxt AND abs(n.col - a.x) < 1 AND abs(n.row - a.y) < 1 GROUP BY a.frame, a.row, a.col),
e AS (SELECT frame, avg((p - g) ** 2) AS al, count(*) AS n, avg((p - g) ** 2) FILTER (p > 0.55) AS ho, count(*) FILTER (p > 0.55) AS m FROM
  w GROUP BY frame)
SELECT seq_id, count(*) FILTER (n > 1) AS steps, round(avg(al) FILTER (n > 1), 6) AS ewarp_all, round(avg(ho) FILTER (m > 1), 6) AS ewarp_hole
FROM steps LEFT JOIN e USING (frame) WHERE nxt IS NOT NULL GROUP BY seq_id""")
def sequence_warp_error(spark, sf_dir):
    g = X.grid8(spark, sf_dir)
    frames = X.table(spark, sf_dir, "embeddings").select(F.col("label").alias("seq_id"), F.col("vec_id").alias("frame"), F.col("vec_id").alias("frame_no"))
    flow = g.select("frame", "row", "col", ((F.col("v") - 0.5) * 4).alias("fx"), ((0.5 - F.col("v")) * 2).alias("fy"))
    return rounded(metrics.sequence_warp_error(frames, g, flow, g.where("v > 0.55"), 8, 8))


@query(f"""WITH {GRIDS}, hole AS (SELECT pair, row, col FROM m WHERE g > 0.75), grown AS (SELECT DISTINCT pair, row + a AS row, col + b AS
  col FROM hole, (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b)),
ch AS (SELECT pair, row, col, c AS channel, p * (100 + 20 * c) AS p, g * (120 - 10 * c) AS g FROM m, (SELECT unnest(range(3)) AS c)),
s AS (SELECT pair, channel, avg(g) - avg(p) AS s FROM ch ANTI JOIN grown USING (pair, row, col) GROUP BY ALL HAVING count(*) > 20)
SELECT pair, channel::INT AS channel, row, col, round(least(255.0, greatest(0.0, p + coalesce(s, 0))), 6) AS v FROM ch LEFT JOIN s USING
  (pair, channel)""")
def color_shift(spark, sf_dir):
    a, b = grids_of(spark, sf_dir)
    channel = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("channel")
    gen = a.select("*", channel).withColumn("v", F.col("v") * (100 + 20 * F.col("channel")))
    ref = b.select("*", channel).withColumn("v", F.col("v") * (120 - 10 * F.col("channel")))
    return rounded(metrics.color_shift(gen, ref, b.where("v > 0.75").select("pair", "row", "col"), 8, 8, least=20, radius=1))


@query(f"""WITH {GRIDS}, x AS (SELECT pair, greatest(1e-7, least(1 - 1e-7, p)) AS q, p, g, g > 0.55 AS h, CASE WHEN g > 0.55 THEN 6 ELSE 1
  END AS w FROM m)
SELECT pair, round(avg(w * abs(p - g)), 6) AS l1, round(avg(w * (p - g) ** 2), 6) AS l2, round(avg(-(g * ln(q) + (1 - g) * ln(1 - q)))
  FILTER (h), 6) AS bce FROM x GROUP BY pair""")
def masked_losses(spark, sf_dir):
    a, b = grids_of(spark, sf_dir)
    return rounded(metrics.masked_losses(a, b, b.where("v > 0.55"), 1.0, 6.0))


@query(f"""WITH {GRIDS}, x AS (SELECT pair, greatest(1e-7, least(1 - 1e-7, p)) AS p, (g > 0.5)::INT AS y FROM m), t AS (SELECT *, CASE WHEN
  y = 1 THEN p ELSE 1 - p END AS pt, CASE WHEN y = 1 THEN 0.75 ELSE 0.25 END AS w FROM x)"""
       """ SELECT pair, round(avg(-w * (1 - pt) ** 2 * ln(pt)), 6) AS focal, round(1 - (sum(p * y) + 1) / (sum(p * y) + 0.7 * sum(p * (1 -
  y)) + 0.3 * sum((1 - p) * y) + 1), 6) AS tversky, round(avg(-ln(pt)), 6) AS bce, round(avg(abs(p - y)), 6) AS l1 FROM t GROUP BY pair""")
def losses(spark, sf_dir):
    a, b = grids_of(spark, sf_dir)
    met = a.withColumnRenamed("v", "p").join(b, ["pair", "row", "col"]).select("pair", "p", (F.col("v") > 0.5).cast("int").alias("y"))
    return rounded(metrics.scored_losses(met, "pair"))


@query("""WITH x AS (SELECT vec_id % 2 AS s, i, embedding[i + 1]::DOUBLE AS e FROM embeddings, (SELECT unnest(range(64)) AS i)), m AS
  (SELECT i, avg(e) FILTER (s = 0) AS m0, avg(e) FILTER (s = 1) AS m1, var_samp(e) FILTER (s = 0) AS v0, var_samp(e) FILTER (s = 1) AS v1
  FROM x GROUP BY i)"""
       " SELECT round(sum((m0 - m1) ** 2 + v0 + v1 - 2 * sqrt(v0 * v1)), 6) AS distance FROM m")
def frechet_diag(spark, sf_dir):
    return rounded(metrics.frechet_diag(X.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).alias("set"), "embedding")))


def frechet_sql(vectors: str) -> str:
    """The distance from `vectors` (s, e): means and covariances as lists, and the trace of the root of their product by the coupled iteration
    Y <- Y (3 - Z Y) / 2, Z <- (3 - Z Y) Z / 2, which ends at the root of a matrix whose eigenvalues are between 0 and 1."""
    product = lambda a, b: f"list_transform({a}, lambda r: list_transform({b}, lambda c: list_dot_product(r, c)))"
    turned = lambda a: f"list_transform(range(1, len({a}) + 1), lambda j: list_transform({a}, lambda r: r[j]))"
    return f"""{vectors}, vr AS (SELECT s, e, row_number() OVER () AS row FROM v),
xs AS (SELECT s, i, row, e[i]::DOUBLE AS x FROM vr, LATERAL unnest(range(1, len(e) + 1)) AS u(i)),
mean AS (SELECT s, i, avg(x) AS m FROM xs GROUP BY ALL),
c AS (SELECT xs.s, xs.row, list(x - m ORDER BY xs.i) AS e FROM xs JOIN mean USING (s, i) GROUP BY ALL),
cv AS (SELECT c.s, i, j, sum(e[i] * e[j]) / (count(*) - 1) AS v FROM c, LATERAL unnest(range(1, len(e) + 1)) AS a(i), LATERAL unnest(range(1, len(e) + 1)) AS b(j) GROUP BY ALL),
cr AS (SELECT s, i, list(v ORDER BY j) AS r FROM cv GROUP BY ALL), cm AS (SELECT s, list(r ORDER BY i) AS m FROM cr GROUP BY ALL),
two AS (SELECT (SELECT m FROM cm WHERE s = 0) AS a, (SELECT m FROM cm WHERE s = 1) AS b),
p0 AS (SELECT {product('a', 'b')} AS p FROM two),
scaled AS (SELECT sqrt(list_sum(list_transform(p, lambda r: list_dot_product(r, r)))) AS f, p FROM p0),
step(k, y, z, f) AS (SELECT 0, list_transform(p, lambda r: list_transform(r, lambda x: x / f)),
   list_transform(range(1, len(p) + 1), lambda i: list_transform(range(1, len(p) + 1), lambda j: (i = j)::INT::DOUBLE)), f FROM scaled
 UNION ALL SELECT k + 1, {product('y', turned('t'))}, {product('t', turned('z'))}, f FROM (
   SELECT k, y, z, f, list_transform({product('z', turned('y'))}, lambda r, i: list_transform(r, lambda x, j: ((CASE WHEN i = j THEN 3 ELSE 0 END) - x) / 2)) AS t
   FROM step WHERE k < 45) q)
SELECT round((SELECT sum((p.m - q.m) ** 2) FROM mean p JOIN mean q USING (i) WHERE p.s = 0 AND q.s = 1) + (SELECT sum(v) FROM cv WHERE i = j)
  - 2 * sqrt(f) * list_sum(list_transform(range(1, len(y) + 1), lambda i: y[i][i])), 4) AS distance FROM step WHERE k = 45"""


@query(f"WITH RECURSIVE {frechet_sql('v AS (SELECT vec_id % 2 AS s, embedding AS e FROM embeddings)')}")
def frechet_full(spark, sf_dir):
    return rounded(metrics.frechet_full(X.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).alias("set"), "embedding")), 4)


# --- flow ---

FLOW = f"{GRIDS}, flow AS (SELECT pair, row, col, p AS v, (g - p) * 4 AS fx, (p - g) * 2 AS fy FROM m)"
POINTS = f"""{FLOW}, {X.SEGMENTS}, pts AS (SELECT pairs.frame AS pair, k AS pt, x1 / 8 AS x, y1 / 8 AS y FROM pairs JOIN segments USING
  (frame)), c AS (SELECT *, least(7, greatest(0, x)) AS cx, least(7, greatest(0, y)) AS cy FROM pts),""" \
         """ s AS (SELECT c.pair, pt, any_value(x) AS x, any_value(y) AS y, sum(fx * w) AS fx, sum(fy * w) AS fy FROM (SELECT c.*, f.fx,
  f.fy, (CASE WHEN f.col = floor(cx) THEN least(floor(cx) + 1, 7) - cx ELSE cx - floor(cx) END)""" \
         """ * (CASE WHEN f.row = floor(cy) THEN least(floor(cy) + 1, 7) - cy ELSE cy - floor(cy) END) AS w FROM c JOIN flow f ON f.pair =
  c.pair AND f.row BETWEEN floor(cy) AND floor(cy) + 1 AND f.col BETWEEN floor(cx) AND floor(cx) + 1) c GROUP BY c.pair, pt)"""


def flow_of(spark, sf_dir):
    """(grid, flow): the previous frame's values, and a flow derived from the difference to the current frame."""
    a, b = grids_of(spark, sf_dir)
    both = a.withColumnRenamed("v", "p").join(b, ["pair", "row", "col"])
    return a, both.select("pair", "row", "col", ((F.col("v") - F.col("p")) * 4).alias("fx"), ((F.col("p") - F.col("v")) * 2).alias("fy"))


def flow_points(spark, sf_dir):
    s = X.segments(spark, sf_dir).select("frame", F.col("k").alias("pt"), (F.col("x1") / 8).alias("x"), (F.col("y1") / 8).alias("y"))
    return X.pairs(spark, sf_dir).select("frame").join(s, "frame").withColumnRenamed("frame", "pair")


@query(f"WITH {POINTS} SELECT pair, pt, round(fx, 6) AS fx, round(fy, 6) AS fy FROM s")
def bilinear_sample(spark, sf_dir):
    return rounded(flows.bilinear_sample(flow_of(spark, sf_dir)[1], flow_points(spark, sf_dir), 8, 8))


@query(f"WITH {POINTS} SELECT pair, pt, round(x + fx, 6) AS wx, round(y + fy, 6) AS wy FROM s")
def flow_warp_points(spark, sf_dir):
    return rounded(flows.warp_points(flow_of(spark, sf_dir)[1], flow_points(spark, sf_dir), 8, 8))


@query(f"""WITH {FLOW} SELECT pair, (row // 2)::INT AS row, (col // 2)::INT AS col, round(avg(fx) / 2, 6) AS fx, round(avg(fy) / 2, 6) AS fy
  FROM flow GROUP BY ALL""")
def downsample_flow(spark, sf_dir):
    return rounded(flows.downsample_flow(flow_of(spark, sf_dir)[1], 2))


@query(f"""WITH {FLOW} SELECT pair, least(7, greatest(0, floor(row + fy + 0.5)))::INT AS row, least(7, greatest(0, floor(col + fx +
  0.5)))::INT AS col, round(max(v), 6) AS v FROM flow GROUP BY ALL""")
def flow_warp_forward(spark, sf_dir):
    return rounded(flows.warp_forward(*flow_of(spark, sf_dir), 8, 8))


@query(f"""WITH {FLOW}, t AS (SELECT *, floor(row + fy + 0.5) AS rp, floor(col + fx + 0.5) AS cp, floor(row - fy + 0.5) AS rm, floor(col -
  fx + 0.5) AS cm FROM flow),"""
       """ s AS (SELECT pair, count(*) FILTER (rp BETWEEN 0 AND 7 AND cp BETWEEN 0 AND 7) >= count(*) FILTER (rm BETWEEN 0 AND 7 AND cm
  BETWEEN 0 AND 7) AS plus FROM t GROUP BY pair)"""
       """ SELECT t.pair, t.row, t.col, round(coalesce(g.v, 0), 6) AS v FROM t JOIN s USING (pair) LEFT JOIN flow g ON g.pair = t.pair AND
  g.row = CASE WHEN plus THEN rp ELSE rm END AND g.col = CASE WHEN plus THEN cp ELSE cm END""")
def flow_warp_backward(spark, sf_dir):
    return rounded(flows.warp_backward(*flow_of(spark, sf_dir), 8, 8))


@query(f"WITH {X.PATHS} SELECT page_id, path FROM paths WHERE path NOT IN (SELECT path FROM paths WHERE page_id % 3 <> 0)")
def missing_files(spark, sf_dir):
    p = X.paths(spark, sf_dir)
    return text.missing_files(p, p.where("page_id % 3 != 0")).select("page_id", "path")


def report_sql(where: str) -> str:
    return f"""WITH {X.PATHS}, p AS (SELECT page_id % 4 AS list_no, page_id AS pos, path, path NOT IN (SELECT path FROM paths WHERE page_id % 3 <> 0) AS gone FROM paths
  {where}), r AS (SELECT *, row_number() OVER (PARTITION BY list_no ORDER BY pos) AS rn FROM p WHERE gone)
SELECT list_no, count(*) AS n, count(*) FILTER (gone) AS n_missing, coalesce((SELECT string_agg(path, ' ' ORDER BY pos) FROM r WHERE r.list_no = p.list_no AND rn <= 5), '')
  AS examples, greatest(0, count(*) FILTER (gone) - 5) AS more FROM p GROUP BY list_no"""


def missing_of(spark, sf_dir, first=None):
    p = X.paths(spark, sf_dir)
    lists = p.select((F.col("page_id") % 4).alias("list_no"), F.col("page_id").alias("pos"), "path")
    report = text.missing_report(lists, p.where("page_id % 3 != 0"), first=first)
    return report.withColumn("examples", F.array_join("examples", " "))


@query(report_sql(""))
def missing_report(spark, sf_dir):
    """Four lists, looked at whole."""
    return missing_of(spark, sf_dir)


@query(report_sql("WHERE page_id < 100"))
def missing_quick(spark, sf_dir):
    """The quick check of the lists' first positions, which is what this report is."""
    return missing_of(spark, sf_dir, first=100)


# --- grids and reports ---


MASK8 = f"{X.GRID8}, mask AS (SELECT frame, row, col FROM grid8 WHERE v > 0.6), o AS (SELECT unnest(range(-1, 2)) AS d)"


def mask8(spark, sf_dir):
    return grids.threshold_mask(X.grid8(spark, sf_dir), 0.6)


@query(f"WITH {MASK8} SELECT * FROM mask")
def threshold_mask(spark, sf_dir):
    return mask8(spark, sf_dir)


DILATED = f"""{MASK8}, dil AS (SELECT DISTINCT frame, row + a.d AS row, col + b.d AS col FROM mask, o a, o b WHERE row + a.d BETWEEN 0 AND 7
  AND col + b.d BETWEEN 0 AND 7)"""


@query(f"WITH {DILATED} SELECT frame, row::INT AS row, col::INT AS col FROM dil")
def dilate(spark, sf_dir):
    return grids.dilate(mask8(spark, sf_dir), 1, 8, 8)


AROUND = "SELECT {s}.frame, {s}.row + a.d AS row, {s}.col + b.d AS col, count(*) AS n FROM {s}, o a, o b GROUP BY ALL"


def erode_sql(s: str) -> str:
    room = "(least(row + 1, 7) - greatest(row - 1, 0) + 1) * (least(col + 1, 7) - greatest(col - 1, 0) + 1)"
    return f"""SELECT frame, row::INT AS row, col::INT AS col FROM ({AROUND.format(s=s)}) WHERE row BETWEEN 0 AND 7 AND col BETWEEN 0 AND 7
  AND n = {room}"""


@query(f"WITH {DILATED} {erode_sql('mask')}")
def erode(spark, sf_dir):
    return grids.erode(mask8(spark, sf_dir), 1, 8, 8)


@query(f"WITH {DILATED} {erode_sql('dil')}")
def close(spark, sf_dir):
    return grids.close(mask8(spark, sf_dir), 1, 8, 8)


@query(f"""WITH RECURSIVE {MASK8}, reach(frame, row, col, root) AS (SELECT frame, row, col, row * 8 + col FROM mask UNION SELECT m.frame,
  m.row, m.col, r.root FROM reach r JOIN mask m ON m.frame = r.frame AND abs(m.row - r.row) <= 1 AND abs(m.col - r.col) <= 1),"""
       """ l AS (SELECT frame, row, col, min(root) AS component FROM reach GROUP BY ALL) SELECT frame, component::INT AS component,
  count(*) AS area FROM l GROUP BY ALL HAVING count(*) >= 3""")
def components(spark, sf_dir):
    return grids.component_areas(mask8(spark, sf_dir), 3, 8, 8)


@query(f"""WITH {MASK8} SELECT frame, row, col, CASE WHEN v > 0.6 THEN least(255.0, greatest(0.0, floor(0.4 * (v * 200) + 0.6 * 255 + 0.5)))
  ELSE round(v * 200, 6) END AS v FROM grid8""")
def blend(spark, sf_dir):
    g = X.grid8(spark, sf_dir).withColumn("v", F.col("v") * 200)
    return rounded(grids.blend(g, mask8(spark, sf_dir), 0.6, 255.0))


@query(f"WITH {GRIDS} SELECT pair AS frame, row, col, round(CASE WHEN g > 0.55 THEN p ELSE g END, 6) AS v FROM m")
def merge_known(spark, sf_dir):
    a, b = (x.withColumnRenamed("pair", "frame") for x in grids_of(spark, sf_dir))
    return rounded(grids.merge_known(a, b, b.where("v > 0.55")))


@query(f"""WITH {MASK8}, known AS (SELECT frame, row, col FROM grid8 WHERE NOT v > 0.6), r AS (SELECT m.frame, m.row, m.col,
  min(greatest(abs(m.row - k.row), abs(m.col - k.col)))::INT AS ring FROM mask m LEFT JOIN known k USING (frame) GROUP BY ALL),
lvl AS (SELECT frame, row, col, 0 AS ring FROM known UNION ALL SELECT * FROM r),
q AS (SELECT r.*, i, CASE WHEN row + dr < 0 THEN 1 WHEN row + dr > 7 THEN 6 ELSE row + dr END AS nr, CASE WHEN col + dc < 0 THEN 1 WHEN col
  + dc > 7 THEN 6 ELSE col + dc END AS nc FROM r,
  (VALUES (0, -1, 0), (0, 0, -1), (0, -1, -1), (1, 1, 0), (1, 0, -1), (1, 1, -1), (2, -1, 0), (2, 0, 1), (2, -1, 1), (3, 1, 0), (3, 0, 1),
  (3, 1, 1)) d(i, dr, dc))
SELECT q.frame, q.row, q.col, q.ring, least(127, floor(q.ring * 128 / 4.0))::INT AS bin, bool_or(i = 0 AND l.ring < q.ring) AS up_left,
  bool_or(i = 1 AND l.ring < q.ring) AS down_left,
 bool_or(i = 2 AND l.ring < q.ring) AS up_right, bool_or(i = 3 AND l.ring < q.ring) AS down_right FROM q LEFT JOIN lvl l ON l.frame =
  q.frame AND l.row = q.nr AND l.col = q.nc GROUP BY ALL""")
def hole_rings(spark, sf_dir):
    return grids.hole_rings(mask8(spark, sf_dir), 8, 8)


@query("""WITH r AS (SELECT vec_id AS frame, ('0x' || substr(md5(vec_id || '|r|0'), 1, 6))::BIGINT % 6 AS r, ('0x' || substr(md5(vec_id ||
  '|c|0'), 1, 6))::BIGINT % 5 AS c FROM embeddings)"""
       " SELECT frame, (r + p // 4)::INT AS row, (c + p % 4)::INT AS col FROM r, (SELECT unnest(range(12)) AS p)")
def rect_mask(spark, sf_dir):
    return grids.rect_mask(X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame")), 4, 3, 8, 8)


@query(f"WITH {MASK8} SELECT frame, 7 - row AS row, col FROM mask")
def flip_ud(spark, sf_dir):
    return grids.flip_ud(mask8(spark, sf_dir), 8)


@query(f"""WITH {MASK8}, t AS (SELECT g.frame, g.row, g.col, any_value(g.v) AS v, max(x.v) AS top FROM grid8 g JOIN grid8 x ON x.frame =
  g.frame AND abs(x.row - g.row) <= 1 AND abs(x.col - g.col) <= 1 GROUP BY g.frame, g.row, g.col)"""
       """ SELECT frame, row, col, round(v, 6) AS v, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY v
  DESC, row, col) AS rank FROM t WHERE v = top AND v > 0.5) WHERE rank <= 5""")
def local_max_topk(spark, sf_dir):
    return rounded(grids.local_max_topk(X.grid8(spark, sf_dir), 5, 0.5, 8, 8))


@query(f"""WITH {MASK8} SELECT frame, row, col, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS v FROM grid8 WINDOW w AS
  (PARTITION BY frame)""")
def min_max_normalize(spark, sf_dir):
    return rounded(grids.min_max_normalize(X.grid8(spark, sf_dir)))


@query(f"WITH {MASK8} SELECT frame, row, col, round(1 / (1 + exp(-(v + 0.2) * 4)), 6) AS p FROM grid8")
def sharpen_prob(spark, sf_dir):
    return rounded(X.grid8(spark, sf_dir).select("frame", "row", "col", grids.sharpen_prob(F.col("v")).alias("p")))


@query("SELECT p_partkey, n_name AS color FROM part LEFT JOIN nation ON n_nationkey = p_size")
def label_colors(spark, sf_dir):
    palette = X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("color"))
    return grids.label_colors(X.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("class_id")), palette).select("p_partkey", "color")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 100")
def limit_items(spark, sf_dir):
    return sequences.limit_items(X.table(spark, sf_dir, "events").select("event_id", F.struct("ts", "event_id").alias("pos")), 100).select("event_id")


@query("SELECT round(avg(value), 6) AS value, round(avg(event_id), 6) AS event_id FROM events")
def distributed_mean(spark, sf_dir):
    return rounded(gates.distributed_mean(X.table(spark, sf_dir, "events"), F.col("user_id") % 7, ["value", "event_id"]))


@query(f"WITH {X.GRID8} SELECT seq_id, frame // 50 AS bucket, round(avg(v), 6) AS v FROM grid8 GROUP BY ROLLUP (seq_id, frame // 50)")
def metric_report(spark, sf_dir):
    return rounded(gates.metric_report(X.grid8(spark, sf_dir), ["seq_id", F.floor(F.col("frame") / 50).alias("bucket")], ["v"]))


# --- alignment, references and clips ---

@query(f"""WITH {NEAREST},
ends AS (SELECT pair, 'p' AS side, x1, y1, x2, y2 FROM mask_sides JOIN segments ON frame = pf
  UNION ALL SELECT pair, 'g', x1, y1, x2, y2 FROM mask_sides JOIN segments ON frame = gf),
e AS (SELECT pair, side, least(63, greatest(0, round_even(y1, 0)))::INT AS row, least(63, greatest(0, round_even(x1, 0)))::INT AS col FROM ends
  UNION ALL SELECT pair, side, least(63, greatest(0, round_even(y2, 0)))::INT, least(63, greatest(0, round_even(x2, 0)))::INT FROM ends),
o AS (SELECT DISTINCT pair, side, row, col FROM e),
t AS (SELECT pair, 'p' AS side, row AS r, col AS c FROM gt UNION ALL SELECT pair, 'g', row, col FROM pred),
od AS (SELECT o.pair, side, row, col, min(sqrt(((row - r) ** 2 + (col - c) ** 2)::DOUBLE)) AS d FROM o JOIN t USING (pair, side) GROUP BY ALL),
err AS (SELECT pair, (avg(d) FILTER (side = 'p') + avg(d) FILTER (side = 'g')) / 2 AS err FROM e JOIN od USING (pair, side, row, col) GROUP BY pair),
q AS (SELECT pair, CASE WHEN err IS NULL THEN 0 ELSE tp / (tp + fp + fn) END AS iou, CASE WHEN err IS NULL THEN 0 ELSE tp / (tp + fp) END AS
  p, CASE WHEN err IS NULL THEN 0 ELSE tp / (tp + fn) END AS r, err
  FROM counted LEFT JOIN err USING (pair)),
z AS (SELECT *, CASE WHEN err IS NULL THEN 0 ELSE 1 / (1 + exp(-(p - 0.5) / 0.1)) * (1 / (1 + exp(-(r - 0.5) / 0.1))) * exp(-err / 2.5) END
  AS score FROM q)
SELECT pair, round(iou, 6) AS iou, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(err, 1e6), 6) AS endpoint_err,
  round(score, 6) AS score, score > 0.05 AS valid FROM z""")
def pair_alignment(spark, sf_dir):
    s, m = X.segments(spark, sf_dir).drop("seq_id"), mask_sides(spark, sf_dir)
    before, now = (m.join(s.withColumnRenamed("frame", c), c) for c in ("pf", "gf"))
    return rounded(metrics.pair_alignment(m, before, now, 64, 64))


REFERENCES = f"""{X.SEGMENTS}, {X.RASTER}, refs AS (SELECT vec_id AS frame, min(vec_id) OVER (PARTITION BY label) AS global, lag(vec_id)
  OVER (PARTITION BY label ORDER BY vec_id) AS local FROM embeddings),
l AS (SELECT frame, 'global' AS kind, global AS other FROM refs UNION ALL SELECT frame, 'local', local FROM refs WHERE local IS NOT NULL),
sides AS (SELECT l.frame, kind, 'a' AS side, x.row, x.col, min(sqrt(((x.row - y.row) ** 2 + (x.col - y.col) ** 2)::DOUBLE)) AS d FROM l JOIN
  pixels x ON x.frame = l.frame JOIN pixels y ON y.frame = l.other GROUP BY ALL UNION ALL
  SELECT l.frame, kind, 'b', y.row, y.col, min(sqrt(((x.row - y.row) ** 2 + (x.col - y.col) ** 2)::DOUBLE)) FROM l JOIN pixels x ON x.frame
  = l.frame JOIN pixels y ON y.frame = l.other GROUP BY ALL),
cd AS (SELECT frame, kind, (avg(d) FILTER (side = 'a') + avg(d) FILTER (side = 'b')) / 2 AS cd FROM sides GROUP BY ALL)"""


def references(spark, sf_dir):
    w = Window.partitionBy("label")
    refs = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.min("vec_id").over(w).alias("global"), F.lag("vec_id").over(w.orderBy("vec_id")).alias("local"))
    return metrics.reference_consistency(refs, geometry.rasterize(X.segments(spark, sf_dir)))


@query(f"""WITH {REFERENCES} SELECT frame, round(g.cd, 6) AS cd_global, round(coalesce(l.cd, 'inf'::DOUBLE), 6) AS cd_local FROM refs LEFT
  JOIN (SELECT frame, cd FROM cd WHERE kind = 'global') g USING (frame) LEFT JOIN (SELECT frame, cd FROM cd WHERE kind = 'local') l USING
  (frame)""")
def reference_consistency(spark, sf_dir):
    return rounded(references(spark, sf_dir))


@query(f"""WITH {REFERENCES} SELECT (SELECT count(*) FROM refs) AS n, round(avg(cd) FILTER (kind = 'global'), 6) AS cd_global, round(avg(cd)
  FILTER (kind = 'local'), 6) AS cd_local FROM cd""")
def reference_report(spark, sf_dir):
    return rounded(metrics.finite_means(references(spark, sf_dir), ["cd_global", "cd_local"]))


def clip_inputs(spark, sf_dir):
    w = Window.partitionBy("label").orderBy("vec_id")
    return X.table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("set"), F.col("label").alias("seq_id"), (F.row_number().over(w) - 1).alias("frame_no"), "embedding")


@query("""WITH f AS (SELECT label % 2 AS set, label AS seq_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, embedding
  FROM embeddings), x AS (SELECT set, seq_id, n, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM f),"""
       """ c AS (SELECT DISTINCT seq_id, n // 8 AS clip FROM f) SELECT set, seq_id, clip::INT AS clip, i::INT AS i, round(avg(x), 6) AS x
  FROM c JOIN x USING (seq_id) WHERE n BETWEEN clip * 8 AND clip * 8 + 15 GROUP BY ALL HAVING count(*) = 16""")
def clip_features(spark, sf_dir):
    clips = metrics.clip_features(clip_inputs(spark, sf_dir))
    return rounded(clips.select("set", "seq_id", "clip", F.posexplode("embedding").alias("i", "x")))


CLIP_VECTORS = """ef AS (SELECT label % 2 AS s, label AS seq_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n, embedding FROM embeddings),
ex AS (SELECT s, seq_id, n, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM ef), ec AS (SELECT DISTINCT seq_id, n // 8 AS clip FROM ef),
em AS (SELECT s, seq_id, clip, i, avg(x) AS x FROM ec JOIN ex USING (seq_id) WHERE n BETWEEN clip * 8 AND clip * 8 + 15 GROUP BY ALL HAVING count(*) = 16),
v AS (SELECT s, list(x ORDER BY i) AS e FROM em GROUP BY s, seq_id, clip)"""


@query(f"WITH RECURSIVE {frechet_sql(CLIP_VECTORS)}")
def frechet_clips(spark, sf_dir):
    return rounded(metrics.frechet_clips(clip_inputs(spark, sf_dir)), 4)


def matched_sql(name: str, left: str, right: str) -> str:
    """Matches (pair, m, ka, kb, x0, y0, x1, y1) of the centres of features `left` and `right` (pair, k, cx, cy, ux, uy) of a pair."""
    return f"""{name} AS MATERIALIZED (SELECT a.pair, a.k::BIGINT * 2147483648 + b.k AS m, a.k AS ka, b.k AS kb, a.cx AS x0, a.cy AS y0, b.cx AS x1, b.cy AS y1
  FROM {left} a JOIN {right} b USING (pair) WHERE (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 <= 144
  AND acos(least(1.0, greatest(-1.0, a.ux * b.ux + a.uy * b.uy))) <= 1.0)"""


def side_sql(name: str, frame: str) -> str:
    return f"{name} AS (SELECT t.frame AS pair, f.k, cx, cy, ux, uy FROM triples t JOIN f ON f.frame = t.{frame} WHERE prev IS NOT NULL AND next IS NOT NULL)"


@query(f"""WITH {X.SEGMENTS}, {FEATURES}, triples AS (SELECT vec_id AS frame, lag(vec_id) OVER w AS prev, lead(vec_id) OVER w AS next FROM embeddings
  WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
{side_sql('sp', 'prev')}, {side_sql('sn', 'next')}, {side_sql('sh', 'frame')}, {matched_sql('m1', 'sp', 'sn')}, {consensus_sql('c1', 'm1', 200, 3.0)},
kept AS MATERIALIZED (SELECT DISTINCT pair, kb AS k FROM m1 JOIN c1_c USING (pair, m)), sk AS (SELECT sn.* FROM sn JOIN kept USING (pair, k)),
{matched_sql('m2', 'sk', 'sh')}, {consensus_sql('c2', 'm2', 200, 3.0)},
found AS MATERIALIZED (SELECT DISTINCT pair AS frame, kb AS k FROM m2 JOIN c2_c USING (pair, m))
SELECT frame, k FROM found UNION ALL SELECT frame, k FROM segments WHERE frame NOT IN (SELECT frame FROM found)""")
def three_frame_match(spark, sf_dir):
    w = Window.partitionBy("label").orderBy("vec_id")
    triples = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.lag("vec_id").over(w).alias("prev"), F.lead("vec_id").over(w).alias("next"))
    return geometry.three_frame_match(triples, X.segments(spark, sf_dir), 12.0, 1.0, draws=200)


@query()
def specular_mask(spark, sf_dir):
    g = X.grid8(spark, sf_dir).select("frame", "row", "col", *[(F.col("v") + d).alias(c) for c, d in (("r", 0.05), ("g", 0.0), ("b", -0.02))])
    return grids.specular_mask(g, 8, 8, 0.6, 0.2, 1, 3)


# --- cameras ---

def cameras_of(spark, sf_dir):
    k = F.col("s_suppkey")
    model = F.when(k % 3 == 0, "PINHOLE").when(k % 3 == 1, "SIMPLE_RADIAL").otherwise("OTHER")
    params = F.when(k % 3 == 1, F.array(21.0 + k % 5, F.lit(16.0), F.lit(15.0), F.lit(0.1))).otherwise(F.array(20.0 + k % 5, F.lit(22.0), F.lit(16.0), F.lit(15.0)))
    return X.table(spark, sf_dir, "supplier").select(k.alias("pair"), model.alias("model"), F.lit(32).alias("width"), F.lit(32).alias("height"), params.alias("params"), "s_acctbal")


def poses(pair, balance):
    """Reference and current pose of a pair: quaternion and shift."""
    return {"ref": dict(qw=F.lit(1.0), qx=0.02 * F.sin(pair), qy=0.02 * F.cos(pair), qz=F.lit(0.0), tx=F.lit(0.0), ty=F.lit(0.0), tz=F.lit(0.1)),
            "cur": dict(qw=F.lit(1.0), qx=F.lit(0.0), qy=0.03 * F.sin(pair), qz=F.lit(0.01), tx=balance / 100000, ty=F.lit(0.05), tz=F.lit(0.0))}


CAMERAS = """cams AS (SELECT s_suppkey AS pair, s_acctbal, (CASE WHEN s_suppkey % 3 = 1 THEN 21.0 + s_suppkey % 5 ELSE 20.0 + s_suppkey % 5
  END)::DOUBLE * 0.5 AS fx,
  (CASE WHEN s_suppkey % 3 = 1 THEN 21.0 + s_suppkey % 5 ELSE 22.0 END)::DOUBLE * 0.5 AS fy, 8.0::DOUBLE AS cx, 7.5::DOUBLE AS cy FROM supplier),
q AS (SELECT *, 0.02::DOUBLE * sin(pair) AS ax, 0.02::DOUBLE * cos(pair) AS ay, 0.0::DOUBLE AS az, 0.0::DOUBLE AS bx, 0.03::DOUBLE *
  sin(pair) AS "by", 0.01::DOUBLE AS bz FROM cams),
n AS (SELECT *, sqrt(1 + ax * ax + ay * ay + az * az) AS an, sqrt(1 + bx * bx + "by" * "by" + bz * bz) AS bn FROM q),
u AS (SELECT pair, s_acctbal, fx, fy, cx, cy, 1 / an AS aw, ax / an AS ax, ay / an AS ay, az / an AS az, 1 / bn AS bw, bx / bn AS bx, "by" /
  bn AS bv, bz / bn AS bz FROM n)"""


def rotation_sql(w: str, x: str, y: str, z: str) -> list[str]:
    return [f"(1 - 2 * ({y} * {y} + {z} * {z}))", f"(2 * ({x} * {y} - {z} * {w}))", f"(2 * ({x} * {z} + {y} * {w}))", f"(2 * ({x} * {y} + {z} * {w}))", f"(1 - 2 * ({x} * {x} + {z} * {z}))",
            f"(2 * ({y} * {z} - {x} * {w}))", f"(2 * ({x} * {z} - {y} * {w}))", f"(2 * ({y} * {z} + {x} * {w}))", f"(1 - 2 * ({x} * {x} + {y} * {y}))"]


REF, CUR = rotation_sql("aw", "ax", "ay", "az"), rotation_sql("bw", "bx", "bv", "bz")


@query(f"WITH {CAMERAS} SELECT pair, fx, fy, cx, cy, " + ", ".join(f"round({r}, 9) AS r{i}" for i, r in enumerate(CUR)) + " FROM u")
def camera_intrinsics(spark, sf_dir):
    k = camera.intrinsics(cameras_of(spark, sf_dir), 16)
    turn = poses(F.col("pair"), F.col("s_acctbal"))["cur"]
    r = geometry.quat_to_rot([turn[c] for c in ("qw", "qx", "qy", "qz")])
    return rounded(k.select("pair", *camera.K, *[c.alias(f"r{i}") for i, c in enumerate(r)]), 9)


def views_of(spark, sf_dir):
    """(edges, depth, views) on a 16 x 16 canvas, one pair a supplier."""
    k = camera.intrinsics(cameras_of(spark, sf_dir), 16)
    turn = poses(F.col("pair"), F.col("s_acctbal"))
    views = k.select("pair", *[F.col(c).alias(f"{v}_{c}") for v in turn for c in camera.K], *[c.alias(f"{v}_{n}") for v in turn for n, c in turn[v].items()])
    canvas = k.select("pair", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("p")).select("pair", F.floor(F.col("p") / 16).cast("int").alias("row"), (F.col("p") % 16).alias("col"))
    depth = canvas.withColumn("z", F.when((F.col("row") + F.col("col") + F.col("pair")) % 11 == 0, 0.0).otherwise(1 + ((F.col("row") * 5 + F.col("col") * 3 + F.col("pair")) % 7) / 10))
    return canvas.where((F.col("row") * 3 + F.col("col") + F.col("pair")) % 4 == 0), depth, views


WORLD = ", ".join(f"{REF[i]} * x + {REF[3 + i]} * y + {REF[6 + i]} * (z - 0.1::DOUBLE) AS w{i}" for i in range(3))
SEEN = ", ".join(f"{CUR[3 * i]} * w0 + {CUR[3 * i + 1]} * w1 + {CUR[3 * i + 2]} * w2 + {t} AS c{i}" for i, t in enumerate(("s_acctbal / 100000", "0.05::DOUBLE", "0")))
REPROJECT = f"""{CAMERAS}, spots AS (SELECT u.*, (p // 16)::INT AS row, (p % 16)::INT AS col FROM u, (SELECT unnest(range(256)) AS p)),
zs AS (SELECT *, CASE WHEN (row + col + pair) % 11 = 0 THEN 0 ELSE 1 + ((row * 5 + col * 3 + pair) % 7) / 10 END AS z FROM spots WHERE (row
  * 3 + col + pair) % 4 = 0),
ws AS (SELECT *, {WORLD} FROM (SELECT *, (col - cx) * z / fx AS x, (row - cy) * z / fy AS y FROM zs WHERE z > 0.001)), cs AS (SELECT *,
  {SEEN} FROM ws),
seen AS (SELECT DISTINCT pair, round_even(c1 * fy / c2 + cy, 0)::INT AS row, round_even(c0 * fx / c2 + cx, 0)::INT AS col FROM cs WHERE c2 > 0)"""


@query(f"WITH {REPROJECT} SELECT * FROM seen WHERE row BETWEEN 0 AND 15 AND col BETWEEN 0 AND 15")
def reproject(spark, sf_dir):
    return camera.reproject(*views_of(spark, sf_dir), 16, 16)


@query(f"""WITH {REPROJECT}, gt AS (SELECT DISTINCT pair, row + dr AS row, col + dc AS col FROM seen, (SELECT unnest([-1, 0, 1]) AS dr),
  (SELECT unnest([-1, 0, 1]) AS dc) WHERE row BETWEEN 0 AND 15 AND col BETWEEN 0 AND 15 AND row + dr BETWEEN 0 AND 15 AND col + dc BETWEEN 0
  AND 15),"""
       """ pred AS (SELECT pair, row, col FROM spots WHERE (row * 3 + col + pair) % 4 = 0 AND col < 9), near AS (SELECT a.pair, a.row,
  a.col, 'p' AS side, min((a.row - b.row) ** 2 + (a.col - b.col) ** 2) AS d FROM pred a JOIN gt b USING (pair) GROUP BY ALL UNION ALL"""
       " SELECT b.pair, b.row, b.col, 'g', min((a.row - b.row) ** 2 + (a.col - b.col) ** 2) FROM pred a JOIN gt b USING (pair) GROUP BY ALL),"
       """ r AS (SELECT pair, sum((d <= 9)::INT) FILTER (side = 'p') / (count(*) FILTER (side = 'p') + 1e-6) AS p, sum((d <= 9)::INT)
  FILTER (side = 'g') / (count(*) FILTER (side = 'g') + 1e-6) AS r FROM near GROUP BY pair)"""
       " SELECT pair, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-6), 6) AS f1 FROM r")
def reprojection_prf(spark, sf_dir):
    edges, depth, views = views_of(spark, sf_dir)
    return rounded(camera.reprojection_prf(edges.where("col < 9"), edges, depth, views, 16, 16))


@query(f"""WITH {X.SEGMENTS}, {X.GRID8}, pts AS (SELECT frame, k, i::INT AS i, x1 + (x2 - x1) * (i / 4) AS x, y1 + (y2 - y1) * (i / 4) AS y
  FROM segments, (SELECT unnest(range(5)) AS i)),"""
       """ z AS (SELECT p.*, CASE WHEN v < 1e-8 THEN 0 ELSE v END AS z FROM pts p JOIN grid8 g ON g.frame = p.frame AND g.row = least(7,
  greatest(0, round_even(y * 0.125, 0))) AND g.col = least(7, greatest(0, round_even(x * 0.125, 0))))"""
       " SELECT frame, k, i, round((x - 32) * z / 40, 6) AS px, round((y - 32) * z / 50, 6) AS py, round(z, 6) AS pz FROM z WHERE z > 0")
def segment_points(spark, sf_dir):
    pts = camera.sample_on_segment(X.segments(spark, sf_dir), ["frame", "k"], 5)
    z = camera.sample_nearest(pts, X.grid8(spark, sf_dir).withColumnRenamed("v", "z"), 64, 8, 8).where("z > 0")
    p = camera.back_project(F.col("x"), F.col("y"), F.col("z"), [F.lit(40.0), F.lit(50.0), F.lit(32.0), F.lit(32.0)])
    return rounded(z.select("frame", "k", "i", *[c.alias(n) for n, c in zip(("px", "py", "pz"), p)]))
