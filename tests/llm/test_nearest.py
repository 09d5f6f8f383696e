"""The permutation index at the registered settings, against brute force."""

import numpy as np
import pytest

from framelake.llm import permutation_index


def recall(found, vectors, k=20):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for q in range(0, len(vectors), 20):
        score = vectors @ vectors[q]
        score[q] = -np.inf
        shares.append(len(got[q] & set(np.argsort(-score)[:k].tolist())) / k)
    return float(np.mean(shares))


def given(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").collect()
    return np.concatenate([r.embedding for r in rows]).reshape(-1, 64)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_each_given_table_alone(spark, sf):
    found = permutation_index.op2_permutation_index(spark, f"/root/testdata/{sf}")
    assert recall(found, given(spark, sf)) >= 0.9


@pytest.mark.parametrize("sigma", [0.0, 0.5])
def test_recall_at_the_registered_settings(spark, sigma):
    rng = np.random.default_rng(7)
    vectors = np.concatenate([given(spark, "sf0.1"), rng.normal(size=(10_000, 64)) / 8])
    vectors = vectors * np.exp(rng.normal(size=(len(vectors), 1)) * sigma)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    assert recall(permutation_index.search(df, df.where("vec_id % 20 = 0")), vectors) >= 0.9
    assert permutation_index.SHARE <= 0.1


def test_many_vectors_of_one_id_hide_no_neighbour(spark):
    rng = np.random.default_rng(9)
    rows = [(0, v) for v in rng.normal(size=(25, 4)).tolist()] + [(i, v) for i, v in enumerate(rng.normal(size=(199, 4)).tolist(), 1)]
    df = spark.createDataFrame([(i, [9.0, *v[1:]] if i == 0 else v) for i, v in rows], "vec_id long, embedding array<double>")
    for share, least in ((1.0, 0), (0.06, 20), (0.06, 400)):
        got = permutation_index.search(df, df.where("vec_id = 0"), share=share, least=least).collect()
        assert sorted(r["rank"] for r in got) == list(range(1, 21)) and 0 not in {r.vec_id for r in got}


def test_a_vector_that_a_third_of_all_rows_have(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in permutation_index.search(df, df.where("vec_id IN (0, 60)"), k=5, block=500).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in (0, 60):
        want = sorted((-float(np.dot(v, rows[q][1])), i) for i, v in rows if i != q)[:5]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]


def test_repeated_and_long_ids(spark):
    big = 2**53 + 1
    rows = [(i, [float(i % 7 + 1), 1.0]) for i in range(50)] + [(big, [9.0, 1.0]), (big, [8.0, 1.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = permutation_index.search(df, df.where(f"vec_id IN (0, {big})"), k=8).collect()
    asked = {r.vec_id for r in got if r.query_id == 0}
    assert big in asked and sorted((r.score for r in got if r.query_id == 0), reverse=True)[:2] == [10.0, 9.0]
    assert {r.query_id for r in got} == {0, big} and all(r.vec_id != big for r in got if r.query_id == big)
    assert sorted(r.rank for r in got if r.query_id == big) == list(range(1, 9))
