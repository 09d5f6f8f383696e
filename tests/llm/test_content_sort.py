"""Content sort against brute force: hot texts over many partitions, long common heads, nulls, repeats, odd ids."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from framelake.llm import content_sort


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", t or "")].append(i)
    out = []
    for body, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        sha = hashlib.sha256(body.encode()).hexdigest()
        stays = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((str(i), str(keep), len(ids), stays, sha))
            stays = False
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in content_sort.exact_duplicates(df).collect())


ROWS = [(i, "hot  text") for i in range(300, 100, -1)] + [(i, "hot\ttext") for i in range(301, 350)]
ROWS += [(i, "head " * 200 + str(i % 7)) for i in range(400, 480)] + [(i, f"own {i}") for i in range(500, 600)]
ROWS += [(1, None), (2, ""), (3, " "), (4, "\n\t "), (5, " "), (None, "own 500"), (None, None), (7, "twice"), (7, "twice"), (8, "twice"), (None, "no id"), (None, "no id"),
         (2**53 + 1, "big"), (2**53, "big"), (9, "é" * 100_000), (10, "é" * 100_000), (11, "é" * 99_999), (12, "Hot text")]


@pytest.mark.parametrize("parts", [1, 5, 40])
@pytest.mark.parametrize("records", [7, 10_000])
def test_groups_are_those_of_brute_force(spark, parts, records):
    df = spark.createDataFrame([(i, t, "x", 1, "y", True) for i, t in ROWS], "doc_id long, text string, id string, part int, sha string, kept boolean").repartition(parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        assert found(df) == brute(ROWS)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_text_in_every_row_is_spread(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")).repartition(20)
    rows = content_sort.exact_duplicates(df).collect()
    assert {(r.keep_id, r.group_size) for r in rows} == {(0, 5000)} and [r.doc_id for r in rows if r.kept] == [0]


def test_text_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "doc_id string, text string")
    assert found(df) == brute([("b", "x"), ("a", "x"), (None, "x")])
    assert content_sort.exact_duplicates(df.limit(0)).count() == 0


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({content_sort.ORACLE_SQL})").fetchall()
    got = content_sort.op12_content_sort(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r.group_size > 1 for r in got)
