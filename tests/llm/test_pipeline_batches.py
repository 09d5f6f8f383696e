"""The pipeline's Python stages get their texts in bounded batches, whatever a split holds."""

import corpus_pipeline
import pyarrow as pa
from framelake.llm import common
from framelake.llm.language_id import ContextTrees, name_languages
from pyspark.sql import functions as F


def widest(rows):
    """(rows, largest batch in bytes, batches) of a table that passes Python."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64()), "size": pa.array([b.nbytes], pa.int64())})

    found = rows.mapInArrow(sizes, "n long, size long").agg(F.sum("n"), F.max("size"), F.count("*")).first()
    return tuple(found)


def test_wide_rows_come_in_small_batches_and_narrow_ones_do_not(spark, tmp_path):
    # 3,000 texts of 10,000 characters in one split: Spark alone makes one batch of 30 MB of them
    wide = spark.range(0, 3_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 157).alias("text"))
    narrow = spark.range(0, 20_000, 1, 1)
    before = spark.conf.get(common.BATCH, None)
    try:
        spark.conf.unset(common.BATCH)
        for stage in (corpus_pipeline.keep_one_of_each_group, corpus_pipeline.encode):
            spark.conf.unset(common.BATCH)
            stage(spark, wide.limit(1), str(tmp_path))
            n, size, _ = widest(wide)
            assert n == 3_000 and size < 6_000_000
        assert widest(narrow)[2] == 2
        spark.conf.set(common.BATCH, "1000000")  # a session's own bound stays
        common.bound_batches(spark)
        assert spark.conf.get(common.BATCH) == "1000000"
    finally:
        spark.conf.set(common.BATCH, before) if before else spark.conf.unset(common.BATCH)


def test_languages_are_the_same_however_many_bytes_are_coded_together():
    trees = ContextTrees({"a": [b"the cat sat on the mat " * 9], "b": [b"der hund lag auf dem bett " * 9]})
    texts = ["the mat", None, "dem hund", "", "sat on the cat", "auf dem bett"] * 20
    whole = name_languages(trees, texts)
    for together in (1, 40, 500):
        parts = name_languages(trees, texts, together)
        assert [x for x, _ in parts] == [x for x, _ in whole]
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(parts, whole, strict=True))
