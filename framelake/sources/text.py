"""Lists, logs and reports in text files: read and written by Spark, one DataFrame row a line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.paths import extension, norm_path
from framelake.operators.gates import detail_plus_mean
from framelake.shared import stored


#: What a line loses at both ends.
BLANKS = " \t\r\x0b\x0c"


def split_lines(spark: SparkSession, path: str | list[str], keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(file, block, at, line): trimmed lines, those for which `keep` holds; `block` is the byte that the line's split of the file begins
    at, and `at` ascends within the split without gaps. A large file is many splits, each read by a task of its own. Stored, as a second
    reading could cut the files elsewhere."""
    line = F.btrim("value", F.lit(BLANKS))
    lines = spark.read.text(path)
    lines = lines if keep is None else lines.where(keep(line))
    return stored(lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                               F.monotonically_increasing_id().alias("at"), line.alias("line")))


def number_lines(lines: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """The rows of `split_lines` with `pos`, their number from 0 in their file. Tasks have numbered the lines of a split; a running sum over the
    splits' counts, one row a split, gives the number that each split begins with. With `units` (unit, file, ...), a list of several
    files is numbered through, file after file in order of their names, and the columns of `units` come along."""
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    splits = splits.withColumn("unit", F.col("file")) if units is None else splits.join(units, "file")
    before = Window.partitionBy("unit").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return lines.join(starts, ["file", "block"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("before", "first")


def _dialect(keep_blank: bool, comment: str | None) -> Callable[[Column], Column]:
    def keep(line: Column) -> Column:
        kept = F.lit(True) if keep_blank else line != ""
        return kept & ~line.startswith(comment) if comment else kept

    return keep


def _unquoted(line: Column) -> Column:
    return F.btrim(F.btrim(line, F.lit('"')), F.lit("'"))


def read_manifest(spark: SparkSession, path: str | list[str], keep_blank: bool = False, strip_quotes: bool = False, comment: str | None = None) -> DataFrame:
    """(file, pos, line): trimmed lines with their position in the file from 0; blank lines and comments are left out unless kept, and
    positions count the lines that stay. Quotes are taken off after that, double ones first, so a line of quotes stays as an empty one. Files are
    cut into splits as Spark does, so a list of one file is many tasks."""
    numbered = number_lines(split_lines(spark, path, _dialect(keep_blank, comment)))
    return numbered.select("file", "pos", (_unquoted(F.col("line")) if strip_quotes else F.col("line")).alias("line"))


def concat_lists(spark: SparkSession, paths: list[str], keep_blank: bool = False, strip_quotes: bool = False, comment: str | None = None) -> DataFrame:
    """(list_no, pos, line): the lines of several lists one after the other (see read_manifest); lists that don't exist are left out, one that
    is named twice comes twice. A folder is a list too: its files in order of their names. All lists are one scan."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for i, p in enumerate(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        system = path.getFileSystem(conf)
        if system.exists(path):
            there.append((i, p, system.makeQualified(path).toUri().toString()))
    if not there:
        return spark.createDataFrame([], "list_no int, pos long, line string")
    lines = split_lines(spark, list(dict.fromkeys(p for _, p, _ in there)), _dialect(keep_blank, comment))
    # One form of a file's name, whichever number of slashes follows the scheme.
    plain = lambda c: F.regexp_replace(c, "^([^:/]+):/+", "$1:/")
    named = spark.createDataFrame([(i, u) for i, _, u in there], "unit int, name string").select("unit", plain("name").alias("name"))
    files = lines.select("file").distinct()
    held = files.select("file", F.explode(F.array(plain("file"), F.regexp_replace(plain("file"), "/[^/]*$", ""))).alias("name"))
    numbered = number_lines(lines, held.join(F.broadcast(named), "name").select("file", "unit").distinct())
    return numbered.select(F.col("unit").alias("list_no"), "pos", (_unquoted(F.col("line")) if strip_quotes else F.col("line")).alias("line"))


def discover_files(spark: SparkSession, roots: list[str], exts: list[str]) -> DataFrame:
    """(path, length) of the files below `roots` with one of the endings, in any case; a file under several roots once. No content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "length")
    return listed.where(extension(F.col("path")).isin([e.lower() for e in exts])).distinct()


def missing_files(manifest: DataFrame, listed: DataFrame) -> DataFrame:
    """The manifest's rows whose path isn't listed."""
    return manifest.join(listed.select("path").distinct(), "path", "left_anti")


def missing_report(manifest: DataFrame, listed: DataFrame, show: int = 5, first: int | None = None) -> DataFrame:
    """(list_no, n, n_missing, examples, more) of each list of a manifest (list_no, pos, path): how many paths there are, how many of them aren't
    listed, the first `show` of those in order, and how many more. With `first`, only the paths of a list at positions below it are looked at, as a
    quick check. Lists without a path give no row."""
    rows = manifest if first is None else manifest.where(F.col("pos") < first)
    met = rows.join(listed.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    gone = met.where("there IS NULL").select("list_no", "pos", "path")
    rank = F.row_number().over(Window.partitionBy("list_no").orderBy("pos"))
    shown = gone.withColumn("rn", rank).where(F.col("rn") <= show).groupBy("list_no").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("e"))
    counted = met.groupBy("list_no").agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("n_missing")).join(shown, "list_no", "left")
    return counted.select("list_no", "n", "n_missing", F.coalesce("e.path", F.array().cast("array<string>")).alias("examples"),
                          F.greatest(F.lit(0), F.col("n_missing") - show).alias("more"))


def existing_files(manifest: DataFrame, listed: DataFrame) -> DataFrame:
    """The manifest's rows whose path is listed: the dialect that skips files which don't exist."""
    return manifest.join(listed.select("path").distinct(), "path", "left_semi")


def read_failure_log(spark: SparkSession, path: str | list[str], path_label: str = "path", reason_label: str = "reason") -> DataFrame:
    """(path, reason) of a log in blocks (`path: ...` and `reason: ...` lines, a blank line between) or of `path : reason` lines."""
    blocks = spark.read.text(path, lineSep="\n\n").select(F.regexp_replace("value", "\r", "").alias("b"))
    found = blocks.select("b", *[F.regexp_extract("b", rf"(?m)^{label}: ?(.*)$", 1).alias(n) for n, label in (("path", path_label), ("reason", reason_label))])
    whole = found.where("path != ''").select("path", "reason")
    lines = found.where("path = ''").select(F.explode(F.split("b", "\n")).alias("l")).where(F.col("l").rlike(r"^[^#].* : "))
    return whole.union(lines.select(F.regexp_extract("l", r"^(.*?) : (.*)$", 1), F.regexp_extract("l", r"^(.*?) : (.*)$", 2)))


def failure_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("reason").agg(F.count("*").alias("n"))


def read_blacklist(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path): the text before `|` of each line that isn't blank or a comment, normalised, once."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(norm_path(F.trim(F.get(F.split(line, r"\|"), F.lit(0)))).alias("path")).distinct()


def read_class_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="Idx INT, Ratio DOUBLE, Train INT, Val INT, Stuff INT, Name STRING")


def write_manifests(rows: DataFrame, folder: str, columns: list[str], pos: str = "pos") -> None:
    """One text folder for each column, its part files in order of `pos`: sorted by range, so no task holds a whole list."""
    ordered = rows.orderBy(pos)
    for c in columns:
        ordered.select(F.col(c).cast("string")).write.mode("overwrite").text(f"{folder}/{c}")


def write_reject_report(verdicts: DataFrame, path: str, header: list[str]) -> None:
    """`# ...` lines, then `seq | reason` of each rejected sequence: a folder of text files, sorted by range, that read in order of their
    names give the report."""
    head = verdicts.sparkSession.createDataFrame([(0, i, f"# {h}") for i, h in enumerate(header)], "part int, at int, line string")
    body = verdicts.where("verdict = 'reject'").select(F.lit(1).alias("part"), F.lit(0).alias("at"), F.concat_ws(" | ", F.col("seq_id").cast("string"), "reason").alias("line"))
    head.union(body).orderBy("part", "at", "line").select("line").write.mode("overwrite").text(path)


def write_metrics(rows: DataFrame, path: str, key: str, values: list[str], digits: int = 6, kind: str = "csv") -> None:
    """The items and their `__MEAN__` row at a fixed precision, as CSV with a header or as JSON lines."""
    table = detail_plus_mean(rows, key, values).select(key, *[F.round(v, digits).alias(v) for v in values])
    writer = table.write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)
