"""Ids of any size and type, beside nulls and repeated, come out of every operator as they went in."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framelake.llm import bpe, decontamination, language_id, licenses, ngram_join, sharding, suffix_tree, toxicity, url_filter

BIG = 2**53 + 1
IDS = [BIG, None, -5, 7, 7, -(2**62) - 1, None]
TEXT = "the quick brown fox jumps over the lazy dog and runs away"


def table(spark, kind="long"):
    ids = IDS if kind == "long" else [None if i is None else f"id {i}" for i in IDS]
    rows = [(i, f"{TEXT} number{n}", "en", "web", f"http://a.example.com/en/{n}") for n, i in enumerate(ids)]
    return ids, spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string, url string").coalesce(1)


def operators(spark):
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    labels = spark.createDataFrame([(7, 1), (-5, 0)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    return {
        "bpe": lambda d: bpe.round_trip(d, ranks, public_tokenizers.PATTERN), "long_bpe": lambda d: bpe.encode(d, ranks, public_tokenizers.PATTERN, chunk=20, overlap=5),
        "join": ngram_join.join_documents, "language": language_id.predict, "lm": suffix_tree.predict,
        "toxic": lambda d: toxicity.predict(d, labels.select(F.col("doc_id").cast(d.schema["doc_id"].dataType), "toxic")),
        "shards": sharding.shard_documents, "windows": lambda d: decontamination.decontaminate(d, items),
        "urls": lambda d: url_filter.judge_urls(d, url_filter.RULES, key="doc_id"),
    }


@pytest.mark.parametrize("name", ["bpe", "long_bpe", "join", "language", "lm", "toxic", "shards", "windows", "urls"])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_ids_stay(spark, name, kind):
    ids, df = table(spark, kind)
    got = [r.doc_id for r in operators(spark)[name](df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, ids))


def test_licence_ids_stay(spark):
    ids, df = table(spark)
    assert sorted(str(r.doc_id) for r in licenses.scan_documents(df).collect()) == sorted(map(str, ids))


def test_links_reach_through_every_text_of_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (BIG, a), (None, b), (4, "alone here")]
    got = {(r.doc_id, r.component_id) for r in ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (BIG, 1), (None, None), (4, 4)}


def test_stages_keep_rows_and_columns(spark):
    _, df = table(spark)
    empty = df.limit(0)
    labels = spark.createDataFrame([(7, 1), (-5, 0)], "doc_id long, toxic int")
    field, trees = toxicity.fit(df, labels), language_id.fit(df)
    items = spark.createDataFrame([(1, "no such passage in any of these documents at all ever")], "item_id long, text string")
    odd = df.union(spark.createDataFrame([(50, None, "en", "web", ""), (51, "", None, "web", ""), (52, "the fox " * 40_000, "en", None, None)], df.schema))
    for stage in (lambda d: toxicity.drop_toxic(d, field), lambda d: language_id.keep_identified(d, trees), ngram_join.keep_one, lambda d: decontamination.drop_contaminated(d, items)):
        out = stage(odd)
        assert out.columns == df.columns and out.where("doc_id = 52").count() == 1
        assert stage(empty).count() == 0
