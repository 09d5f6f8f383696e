"""Operators with exact definitions, against brute force, with nulls, empty and long texts, repeats and clashing names."""

import hashlib
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from framelake.llm import bpe, decontamination, ngram_join, permutation_index, sharding, suffix_tree, url_filter

DOCS = "doc_id long, text string, body string, n long, score double"
END = b"\n"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in rows], DOCS)


@pytest.mark.parametrize("chunk,overlap", [(65536, 2048), (50, 5)])
def test_bpe_is_that_of_the_library(spark, chunk, overlap):
    rows = [(1, "It's  a\n\n test!!  "), (2, None), (3, ""), (4, "x'll" * 200 + " " * 300 + "é 日本" * 50), (4, "same"), (4, "same"), (None, "a" * 1000)]
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = docs(spark, rows)
    want = sorted((str(i), theirs.encode_ordinary(t or "")) for i, t in rows)
    encoded = bpe.encode(df, ranks, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    assert sorted((str(r.doc_id), list(r.ids)) for r in encoded.collect()) == want
    shas = sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    tripped = bpe.round_trip(df, ranks, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in tripped.collect()) == shas
    assert sorted(bytes(r.bytes).decode() for r in bpe.decode(encoded, ranks).collect()) == sorted(t or "" for _, t in rows)
    found = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in bpe.round_trip(df, ranks, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap).collect())
    assert found == sorted((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in want)
    assert bpe.encode(docs(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] * 8), (204, rows[20][1]), (205, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in permutation_index.search(df, df.where("vec_id % 20 = 0"), k=5, share=1.0, block=64).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, round(r.score, 9))
    good = [(i, np.array(v)) for i, v in rows if i < 200 or i == 204]
    for q, v in good:
        if q % 20 == 0:
            want = sorted((-round(float(w @ v), 9), i) for i, w in good if i != q)[:5]
            assert [got[q][k] for k in range(1, 6)] == [(i, -s) for s, i in want]
    assert set(got) == {q for q, _ in good if q % 20 == 0}
    assert permutation_index.search(df.limit(0), df.limit(0)).count() == 0


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def test_a_shingle_of_all_documents_is_sent_once_a_batch(spark):
    import pandas as pd
    import pyarrow as pa

    from framelake.llm.packing import batches

    n, bits = 3_000, 8
    texts = [f"all rows hold these words own{i} two{i} three{i} four{i} five{i}" + (f" pair{i // 2} of two rows here" if i % 3 else "") for i in range(n)]
    sent = []
    for part in (texts[:2_000], texts[2_000:]):
        frame = pa.RecordBatch.from_pydict({"key": [str(i) for i in range(len(part))], "body": part})
        (batch,) = batches(iter([frame]), "key", "body")
        batch.number = len(sent)
        sent.append(ngram_join.sent_rows(batch, 5, bits))
        assert max(len(r["h"]) // ngram_join.SENT for r in sent[-1] if r["bucket"] >= 0) < n // 10
    rows = pd.DataFrame([{"keys": None, "h": None, "doc": None, "n": None} | r for part in sent for r in part]).astype(object)
    counted = pd.concat([ngram_join.count_bucket(g, bits) for _, g in rows.groupby("bucket")])
    got, want = {}, {}
    for number, group in counted.groupby("batch"):
        t, doc, df = ngram_join.answers(group[group["keys"].isna()])
        for d in doc:
            got[d + 2_000 * number] = got.get(d + 2_000 * number, 0) + 1
        assert (df == n).sum() == (2_000, 1_000)[number] and set(df) <= {2, n}
    shingled = [{" ".join(w[i: i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    held = {}
    for s in shingled:
        for x in s:
            held[x] = held.get(x, 0) + 1
    want = {i: sum(held[x] > 1 for x in s) for i, s in enumerate(shingled)}
    assert got == want


def test_ngram_join(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join(base[:k] + ["NEW"] + base[k + 1:])
    rows = [(5, " ".join(base)), (3, near(1)), (9, near(58)), (8, near(30).upper()), (11, " ".join(base)), (12, "  \t"), (13, None), (14, ""), (15, "one two"), (16, "ONE  two"), (17, "one"),
            (20, " ".join(base[:50])), (21, " ".join(base[10:])), (22, "other " * 3000), (None, " ".join(base))]
    rows += [(100 + i, " ".join(base[:20] + [f"u{i}-{j}" for j in range(40)])) for i in range(30)]
    sets = shingle_sets([r for r in rows if r[0] is not None])
    parent = {i: i for i in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_documents(docs(spark, rows)).collect()}
    assert {i: g for i, g in got.items() if i is not None} == {i: (len(s), root(i)) for i, s in sets.items()}
    assert ngram_join.join_documents(docs(spark, [])).count() == 0
    twice = docs(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "x")])
    assert sorted(str(r.doc_id) for r in ngram_join.keep_one(twice).collect()) == ["1", "None"]


def test_places(spark):
    rows = [(i, "é" * (i % 5)) for i in range(3000)] + [(7, "again"), (None, None)]
    got = sharding.shard_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for s in range(40):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) > 0
    assert all(r.grown_shard in (r.shard, 40) for r in got) and any(r.grown_shard == 40 for r in got)
    one = next(r for r in got if r.doc_id == 4)
    assert (one.size, one.text_crc32) == (24, zlib.crc32(("é" * 4).encode()))
    assert next(r for r in got if r.doc_id is None).size == 16
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def test_a_weight_moves_rows_into_its_own_subtree_only(spark):
    df = docs(spark, [(i, "x") for i in range(6000)])
    weights = sharding.tree(40)
    weights[1][2][3] = 3.0
    before, after = ({r.doc_id: r.shard for r in sharding.shard_documents(df, 40, weights=w).collect()} for w in (None, weights))
    where = lambda s: (s // 20, s // 5)
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert len(moved) > 100 and all(where(b)[0] == 1 for _, b in moved)
    assert all(where(b)[1] == 6 for a, b in moved if where(a)[0] == 1) and all(b == 33 for a, b in moved if where(a)[1] == 6)
    sizes = Counter(before.values())
    assert len(sizes) == 40 and 100 < min(sizes.values()) and max(sizes.values()) < 210


@pytest.mark.parametrize("limits", [(20_000, 500_000), (0, 0)])
def test_benchmark_windows(spark, limits):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, item, 0), (2, "short one", 0), (10, "", 0), (11, None, 0), (12, item, 0)], "item_id long, text string, doc_id int")
    rows = [(1, f"x {item.upper()}! y"), (2, "a SHORT-one here, short one"), (3, None), (4, ""), (5, "kappa " + item[:40]), (6, item + " ; " + item), (6, item + " ; " + item), (None, "short one"),
            (8, "clean " * 5000), (9, "mu " + " ".join(reversed(item.split())) + " alpha")]
    (decontamination.INLINE_TERMS, decontamination.BROADCAST_ROWS), limits = limits, (decontamination.INLINE_TERMS, decontamination.BROADCAST_ROWS)
    got = {(r.doc_id, r.n_words): r for r in decontamination.decontaminate(docs(spark, rows), items).collect()}
    decontamination.INLINE_TERMS, decontamination.BROADCAST_ROWS = limits
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (got[1, 14].n_hit, got[1, 14].n_items, got[1, 14].items_sha256) == (12, 2, sha("1,12"))
    assert (got[2, 6].n_hit, got[2, 6].items_sha256) == (4, sha("2"))
    assert got[6, 24].n_hit == 24 and got[None, 2].n_hit == 2
    for k in ((3, 0), (4, 0), (8, 5000)):
        assert not got[k].contaminated and got[k].items_sha256 == sha("")
    assert not got[9, 14].contaminated and got[9, 14].n_near > 0
    assert decontamination.decontaminate(docs(spark, rows), items.limit(0)).where("contaminated").count() == 0
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs(spark, rows[:-3]), items).collect()) == [3, 4, 5]


def test_suffix_tree(spark):
    rows = [(i, "the cat sat on the mat " * 40 + f"w{i}") for i in range(60)] + [(60, None), (61, ""), (62, "Unseen words"), (62, "Unseen words"), (None, "the cat")]
    got = suffix_tree.predict(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [END]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    texts = dict(rows)
    for r in got:
        w = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), n, held(r.doc_id))
        assert r.base_score == pytest.approx(sum(log10((c[x] + 1) / (n + v + 1)) for x in w))
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert suffix_tree.predict(docs(spark, [])).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.COM/en/7817?x", "https://b.example.com/en/8", "http://com/en/", "http://xcom/en/", "x", None, "http://example.net/de/8#f", "http://a.net/de/9", "http://org/es", "http://h?/en/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for limit in (10, 0):
        url_filter.BROADCAST_RULES = limit
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, url_filter.RULES).collect()}
        assert got[0] == ("a.example.com", "/en/7817", "example.com/en/7", "allow")
        assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("com/en/", "block") and got[3][2:] == (None, "allow")
        assert got[4] == got[5] == ("", "", None, "allow")
        assert got[6][1:] == ("/de/8", "example.net/de/8", "block") and got[7][2] == "net/de/" and got[8][2] is None and got[9][:2] == ("h", "")
        twice = url_filter.judge_urls(df.union(df), url_filter.RULES)
        assert twice.count() == 2 * len(urls) and twice.distinct().count() == len(urls)
        assert url_filter.judge_urls(df.limit(0), url_filter.RULES).count() == 0
        # of two rules for one host and path the allowing one stands
        both = [("block", "h", "/"), ("allow", "h", "/")]
        assert url_filter.judge_urls(spark.createDataFrame([(1, "http://h/x")], "page_id long, url string"), both).first().verdict == "allow"
    url_filter.BROADCAST_RULES = 1_000_000


def test_slots_of_one_hot_id_are_gapless_and_cut(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_GROUP", 50)
    rows = [(None, f"text {i % 900}") for i in range(2_000)] + [(i, "same") for i in range(300)] + [(7, None), (7, "")]
    got = sharding.shard_documents(docs(spark, rows), 4).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1
