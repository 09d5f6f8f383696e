"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.shared import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether an execution's shuffle files go when it ends; nothing reads them again once a table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Parquet looks at sizes after a hundred rows first, and counts what a row group takes compressed; where rows are wide, a whole file would be one
#: page, which the writer and each reader hold in memory several times. So pages are looked at after each row, and a group has few rows.
WIDE = {"parquet.block.row.count.limit": "4", "parquet.page.size.row.check.min": "1"}


def materialize(df: DataFrame, by: str | None = None, wide: bool = False) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors. With `by`, the rows of each value
    of that column lie in a folder of their own, which `discard` can delete alone. `wide` is for rows of some hundred KB: see WIDE."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/framelake-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.options(**WIDE) if wide else df.write
        (writer.partitionBy(by).option("compression", "zstd") if by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete what `materialize` wrote for these tables, or only the folder `part`, as `column=value`, of one written with `by`; whatever reads
    it must be written by then."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.endswith(part):
                _remove(df.sparkSession, path)


def stable(df: DataFrame) -> DataFrame:
    """`df`, where a task that is run again surely reads the same rows in the same order: as it is if it only reads, picks
    and filters files, else written and read back."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = set(re.findall(r"^[\s:+\-]*(\w+)", plan, re.MULTILINE))
    chance = re.search(r"\b(rand|randn|uuid|shuffle|monotonically_increasing_id|input_file_name)\(", plan)
    return df if nodes <= {"Project", "Filter", "Relation", "LocalRelation"} and not chance else materialize(df)


def _remove(spark: SparkSession, path: str) -> None:
    jsc = spark.sparkContext._jsc
    if jsc is not None and not jsc.sc().isStopped():
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the decimal text of `doc_id`, modulo `modulus`; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


#: Keys that a filter broadcasts at most (some 40 bytes each); beyond it both sides are shuffled.
BROADCAST_KEYS = 1_000_000


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of `df` whose `key` is not in `keys`, a one-column table of distinct values."""
    gone = materialize(keys)
    small = gone.count() <= BROADCAST_KEYS
    return df.join(F.broadcast(gone) if small else gone, key, "left_anti")


#: A key that more than one row in so many has is hot; so there are fewer hot keys than this.
HOT_SHARE = 1_000


def join_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """`left` with the columns of the row of `right` that has its `key` (null where there is none); `right` has a key once at
    most. Rows of hot keys meet a broadcast copy of fewer than HOT_SHARE rows of `right`, all others are shuffled, so no task
    gets all rows of a hot key. `left` is read three times."""
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count()
    hot = materialize(counts.where(F.col("count") * HOT_SHARE > left.count()).select(key, F.lit(True).alias("~hot")))
    marked = left.join(F.broadcast(hot), key, "left")
    few = right.join(F.broadcast(hot.select(key)), key, "left_semi")
    often = marked.where("`~hot`").join(F.broadcast(few), key, "left")
    return often.unionByName(marked.where("`~hot` IS NULL").join(right, key, "left")).drop("~hot")


def spread(df: DataFrame, at_least: int) -> int:
    """A power of two that grows with the number of input partitions: how many buckets to shuffle into."""
    want = max(at_least, 2 * df.rdd.getNumPartitions())
    return 1 << (want - 1).bit_length()


#: What Spark hands to a Python worker at once: its own bounds are 10,000 rows and 64 MB, so a split's texts are one batch, which both sides hold whole
#: and in buffers doubled while they grow. Narrow rows still come by the thousands.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Python stages get a few megabytes at once, if it has no bound of its own. Spark looks when a stage runs, not when it is
    planned, so the setting stays; only batches change, no rows."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)


#: Texts that are worked on together, so that no more results are held at once.
TOGETHER = 250


def map_texts(rows: DataFrame, text: str, fields: str, work: Callable[[], Callable[[list], list[pa.Array]]]) -> DataFrame:
    """The columns of `rows` but for `text`, and the columns `fields` (DDL) that a function makes of the texts, some hundred at a
    time; `work` gives that function, once a task. All other columns pass by as Arrow arrays that nobody looks into, so
    ids of any type keep every bit, also beside nulls."""
    keep = [c for c in rows.columns if c != text]
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([rows.schema[c] for c in keep] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = work()
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + make(part.column(text).to_pylist()),
                                                 names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)
