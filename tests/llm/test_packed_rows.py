"""op9's packed batches lie in row groups and pages of a few MB, and keep every word's number."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from framelake.llm import suffix_tree as st


def test_row_groups_of_packed_batches_stay_small(spark):
    text = "a b c d e f g h " * 130_000  # more than a batch's characters, so each document is a batch
    docs = spark.createDataFrame([(i, text, True) for i in range(8)], "doc_id long, text string, train boolean").coalesce(1)
    encoded = st.encode(docs, {w.encode(): i for i, w in enumerate("abcdefg")} | {st.END: 7}, "train", "doc_id", "text")
    groups = [f.metadata.row_group(i) for f in map(pq.ParquetFile, (x.removeprefix("file://") for x in encoded.inputFiles())) for i in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 8 and max(g.num_rows for g in groups) <= 4


@pytest.mark.parametrize("size", [9, 1 << 15, (1 << 15) + 1])
def test_numbers_come_back(spark, size):
    known = {b"w%d" % i: i for i in range(size - 1)} | {st.END: size - 1}
    docs = spark.createDataFrame([(1, f"w{size - 2} w0 none", True), (2, "none", False), (None, None, True)], "doc_id long, text string, train boolean").coalesce(1)
    frame = st.encode(docs, known, "train", "doc_id", "text").select("keys", "n", "ids").toArrow().to_batches()[0]
    [(ids, n)] = st._training(frame, size)
    assert ids.dtype == np.int64 and ids.tolist() == [size - 2, 0, -1, size - 1, size - 1] and n.tolist() == [4, 1]
