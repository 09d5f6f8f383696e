"""Quality gates over whole sequences, and small reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence_stats(frames: DataFrame, metric: str = "conf") -> DataFrame:
    """Per sequence: frames, mean line count, and the mean metric without the first frame in list order (a lone frame counts)."""
    w = Window.partitionBy("seq_id")
    rows = frames.withColumn("~rn", F.row_number().over(w.orderBy("frame_no"))).withColumn("~n", F.count("*").over(w))
    return rows.groupBy("seq_id").agg(F.count("*").alias("n"), F.avg("line_count").alias("mean_lines"),
                                      F.avg(F.when((F.col("~rn") > 1) | (F.col("~n") == 1), F.col(metric))).alias("mean_metric"))


def figure(x: Column) -> Column:
    """Four decimals as C and SQL's printf write them: rounded from the exact value of the double, ties to even (below 10^11). `format_string`
    rounds the shortest decimal instead, halves up; `format_number` takes the double next to 0.00005, which is above it, for a tie."""
    special = F.when(x == 0.00005, "0.0001").when(x == -0.00005, "-0.0001")
    return special.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == -float("inf"), "-inf").otherwise(F.call_function("format_number", x, F.lit("0.0000")))


#: What a frame without the metric counts as: the worst value of each kind.
MISSING = {"iou": 0.0, "chamfer": 1e6, "line": 0.0}


def gate_sequences(frames: DataFrame, blacklist: DataFrame | None = None, kind: str = "chamfer", line_th: float = 40, metric_th: float = 4.0,
                   metric: str = "conf", missing_metric: float | None = None) -> DataFrame:
    """(seq_id, n, mean_lines, mean_metric, verdict, reason, detail): blacklist first, then lines, then the metric (`iou`: too
    small, `chamfer`: too large, `line`: none). A frame without the metric counts as the worst of the kind, or `missing_metric`;
    one without a line count has none. `detail` states the reason with its figures."""
    worst = MISSING[kind] if missing_metric is None else missing_metric
    rows = frames.withColumns({metric: F.coalesce(F.col(metric).cast("double"), F.lit(float(worst))), "line_count": F.coalesce("line_count", F.lit(0))})
    stats = sequence_stats(rows, metric)
    if blacklist is not None:
        stats = stats.join(blacklist.select("seq_id").distinct().withColumn("listed", F.lit(True)), "seq_id", "left")
    else:
        stats = stats.withColumn("listed", F.lit(None).cast("boolean"))
    bad: dict[str, Column] = {"iou": F.col("mean_metric") < metric_th, "chamfer": F.col("mean_metric") > metric_th, "line": F.lit(False)}
    reason = F.when(F.col("listed"), "blacklist").when(F.col("mean_lines") < line_th, "few_lines").when(bad[kind], f"bad_{kind}")
    sign = "<" if kind == "iou" else ">"
    figures = lambda c, s, th: F.concat(figure(F.col(c)), F.lit(f" {s} {th:g}"))
    detail = (F.when(F.col("reason") == "blacklist", "blacklist").when(F.col("reason") == "few_lines", F.concat(F.lit("mean lines "), figures("mean_lines", "<", line_th)))
              .when(F.col("reason").isNotNull(), F.concat(F.lit(f"mean {kind} "), figures("mean_metric", sign, metric_th))))
    return stats.withColumn("reason", reason).select(
        "seq_id", "n", "mean_lines", "mean_metric", F.when(F.col("reason").isNull(), "keep").otherwise("reject").alias("verdict"), "reason", detail.alias("detail"))


def gate_summary(verdicts: DataFrame) -> DataFrame:
    """(reason, sequences, share): how many were kept (reason `keep`) or rejected, and all in the row `total`."""
    counted = verdicts.select(F.coalesce("reason", F.lit("keep")).alias("reason")).rollup("reason").agg(F.count("*").alias("sequences"))
    total = verdicts.agg(F.count("*").alias("all"))
    return counted.crossJoin(F.broadcast(total)).select(F.coalesce("reason", F.lit("total")).alias("reason"), "sequences", (F.col("sequences") / F.col("all")).alias("share"))


def reject_report(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("verdict = 'reject'").select(F.concat_ws(" | ", F.col("seq_id").cast("string"), "reason").alias("line"))


def reliability(p: Column, r: Column, e: Column, p0: float = 0.5, slope: float = 0.1, tau: float = 2.5) -> Column:
    """Precision and recall through a sigmoid, the error through a decay; precision and recall are clipped to 0..1, the error
    to 0 and more."""
    def squash(x: Column) -> Column:
        return 1 / (1 + F.exp(-(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) - p0) / slope))
    return squash(p) * squash(r) * F.exp(-F.greatest(F.lit(0.0), e) / tau)


def detail_plus_mean(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The rows and one more, `__MEAN__`, of the finite values' means."""
    mean = rows.agg(*[F.avg(finite(F.col(v))).alias(v) for v in values]).select(F.lit("__MEAN__").alias(key), *values)
    return rows.select(F.col(key).cast("string").alias(key), *values).unionByName(mean)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def batch_diagnostics(frames: DataFrame, size: int = 64, flags: tuple[str, ...] = ("valid",), empties: tuple[str, ...] = ("line_count",)) -> DataFrame:
    """Per batch of positions: `<flag>_ratio` of each boolean flag and the mean confidence among frames that aren't their
    sequence's first (over at least one), the extremes of the confidence and the share of frames whose column of `empties` is 0
    over all frames."""
    later = F.col("frame_no") > 0
    n = F.greatest(F.sum(later.cast("int")), F.lit(1))
    ratios = [(F.sum((later & F.coalesce(F.col(f), F.lit(False))).cast("int")) / n).alias(f"{f}_ratio") for f in flags]
    empty = [F.avg((F.col(c) == 0).cast("int")).alias("empty_ratio" if c == "line_count" else f"empty_{c}") for c in empties]
    return frames.groupBy(F.floor(F.col("pos") / size).alias("batch")).agg(
        *ratios, (F.sum(F.when(later, F.col("conf")).otherwise(0.0)) / n).alias("mean_conf"), F.min("conf").alias("min_conf"), F.max("conf").alias("max_conf"), *empty)


def line_count(frames: DataFrame, segments: DataFrame, frame: str = "frame") -> DataFrame:
    """(frame, line_count): the segments of every frame of `frames`, 0 where its record has none or couldn't be read."""
    counted = segments.groupBy(frame).agg(F.count("*").alias("n"))
    return frames.select(frame).join(counted, frame, "left").select(frame, F.coalesce("n", F.lit(0)).cast("long").alias("line_count"))


def dup_names(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def class_weights(classes: DataFrame, pixels: DataFrame) -> DataFrame:
    """(stuff, classes, pixels, share): pixel counts of stuff and thing classes."""
    met = pixels.groupBy("class_id").agg(F.sum("n").alias("n")).join(classes, "class_id")
    sums = met.groupBy("stuff").agg(F.count("*").alias("classes"), F.sum("n").alias("pixels"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("pixels").alias("all")))).select("stuff", "classes", "pixels", (F.col("pixels") / F.col("all")).alias("share"))


def class_set_mask(labels: DataFrame, wanted: list[int], keys: tuple[str, ...] = ("frame", "row", "col")) -> DataFrame:
    """The pixels of `labels` (keys, class_id) whose class is one of `wanted`."""
    return labels.where(F.col("class_id").isin(wanted)).select(*keys)


def status_report(items: DataFrame, w: str = "w", h: str = "h", target: int = 256, least: int = 16) -> DataFrame:
    """`items` with `status`: SKIPPED if they have the target size already, ERROR without a size or below `least` pixels on a side,
    else SUCCESS."""
    w_, h_ = F.col(w), F.col(h)
    bad = w_.isNull() | h_.isNull() | (F.least(w_, h_) < least)
    return items.withColumn("status", F.when(bad, "ERROR").when((w_ == target) & (h_ == target), "SKIPPED").otherwise("SUCCESS"))


def status_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("status").agg(F.count("*").alias("n"))


def metric_report(rows: DataFrame, levels: list, values: list[str]) -> DataFrame:
    """Means of the finite values by all levels together, by the outer ones, and over all rows; a level that is left out is null."""
    return rows.rollup(*levels).agg(*[F.avg(finite(F.col(v))).alias(v) for v in values])


def distributed_mean(rows: DataFrame, rank: Column, values: list[str]) -> DataFrame:
    """One row of the means of all ranks' rows, from one partial sum and count a rank."""
    own = rows.groupBy(rank.alias("rank")).agg(*[f(v).alias(f"{n}_{v}") for v in values for f, n in ((F.sum, "s"), (F.count, "n"))])
    return own.agg(*[(F.sum(f"s_{v}") / F.sum(f"n_{v}")).alias(v) for v in values])
