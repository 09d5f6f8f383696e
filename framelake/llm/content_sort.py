"""Exact duplicates by content sort: sampled splitters, a range shuffle, an external sort, and neighbours compared in full."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.common import materialize, stable, table

#: Leading characters of a text that splitters hold. Texts that agree so far are told apart by digest, equal ones by id.
HEAD = 64


def normalised(text: Column) -> Column:
    """`text` with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, sha, text) of one sorted partition, without their texts, as (id, sha, part, run, first, size, leads, last, edge):
    a run is a series of neighbours with equal texts, `first` its first id, `leads` marks its first row. `edge` is the
    text, on the first row of the partition's first and last run only. An open run waits as ids and digests, never as texts."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    number, waiting, opening = 0, [], None

    def rows(columns: list[pa.Array], starts: np.ndarray, last: bool, edge: str | None) -> pa.RecordBatch:
        nonlocal number
        n = len(columns[0])
        sizes = np.diff(np.append(starts, n))
        which = np.repeat(np.arange(len(starts)), sizes)
        leads = np.zeros(n, dtype=bool)
        leads[starts] = True
        out = [*columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(which + number), columns[0].take(pa.array(starts[which])),
               pa.array(sizes[which]), pa.array(leads), pa.array(np.full(n, last)), pa.array([edge] + [None] * (n - 1), pa.string())]
        number += len(starts)
        return pa.RecordBatch.from_arrays(out, ["id", "sha", "part", "run", "first", "size", "leads", "last", "edge"])

    def close(last: bool) -> pa.RecordBatch:
        joined = [pa.concat_arrays([w[i] for w in waiting]) for i in range(2)]
        return rows(joined, np.array([0]), last, opening if last or number == 0 else None)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, shas, texts = (batch.column(c) for c in ("id", "sha", "text"))
        differs = pc.not_equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(not waiting or texts[0].as_py() != opening, differs))
        if not len(starts):
            waiting.append([ids, shas])
            continue
        if waiting:
            waiting.append([ids.slice(0, starts[0]), shas.slice(0, starts[0])])
            yield close(False)
        at, end = int(starts[0]), int(starts[-1])
        if end > at:
            edge = texts[at].as_py() if number == 0 else None
            yield rows([ids.slice(at, end - at), shas.slice(at, end - at)], starts[:-1] - at, False, edge)
        waiting, opening = [[ids.slice(end), shas.slice(end)]], texts[end].as_py()
    if waiting:
        yield close(True)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, keep_id, group_size, kept, text_sha256), one for each input row. Texts are equal when their normalised
    forms are, which is found by comparing whole neighbours after sorting.

    Rows are dealt out by ranges of (first characters, digest, id), so partitions are even also where one text fills a third of
    the table: a run of equal texts may lie in several partitions, and the partitions' first and last runs, two rows each,
    are joined by comparing their texts. Spark samples the splitters, 100 a partition at most, of some 150 bytes each.

    Null and empty texts are equal to each other (and not to a text of white space, which is one space). The row with the smallest id stays; rows
    without an id stand behind all others, so keep_id is null only where no row of the group has one. Of repeated ids one
    row stays. An empty table gives an empty result; other columns aren't read.
    """
    body = normalised(F.col(text))
    rows = stable(docs.select(F.col(key).alias("id"), F.col(text).alias("text"))).select(
        "id", F.sha2(body, 256).alias("sha"), F.substring(body, 1, HEAD).alias("head"), body.alias("text"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    last = F.col("id").asc_nulls_last()
    ordered = rows.repartitionByRange(n, "head", "sha", last).sortWithinPartitions("head", "sha", "text", last).select("id", "sha", "text")
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("sha", T.StringType()), T.StructField("part", T.IntegerType()),
                           T.StructField("run", T.LongType()), T.StructField("first", kind), T.StructField("size", T.LongType()),
                           T.StructField("leads", T.BooleanType()), T.StructField("last", T.BooleanType()), T.StructField("edge", T.StringType())])
    placed = materialize(ordered.mapInArrow(_runs, schema))
    # Two rows a partition at most, in one task: an edge goes on where the first run of a partition repeats the edge before it.
    along = Window.orderBy("part", "run")
    edges = placed.where("edge IS NOT NULL").select("part", "run", "first", "size", "edge")
    edges = edges.withColumn("goes_on", F.coalesce((F.col("run") == 0) & (F.lag("edge").over(along) == F.col("edge")), F.lit(False))).drop("edge")
    edges = edges.withColumn("chain", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(along))
    whole = edges.groupBy("chain").agg(F.min(F.struct("part", "run", "first"))["first"].alias("keep"), F.sum("size").alias("total"))
    edges = edges.join(F.broadcast(whole), "chain").select("part", "run", "goes_on", "keep", "total")
    found = placed.select("id", "sha", "part", "run", "first", "size", "leads").join(F.broadcast(edges), ["part", "run"], "left")
    edge = F.col("goes_on").isNotNull()
    return found.select(
        F.col("id").alias(key), F.when(edge, F.col("keep")).otherwise(F.col("first")).alias("keep_id"),
        F.when(edge, F.col("total")).otherwise(F.col("size")).alias("group_size"),
        (F.col("leads") & ~F.coalesce("goes_on", F.lit(False))).alias("kept"), F.col("sha").alias("text_sha256"))


def op12_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
  sha256(body) AS text_sha256
FROM d WINDOW g AS (PARTITION BY body)
"""
