"""Collocations and their quotient filters against brute force."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelake.llm import collocations, quotient_filter


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(1, 2**40)), max_size=30), max_size=4), st.sampled_from([1, 4, 64, 2**17]), st.sampled_from([25, 40, 41, 64]))
def test_filters_lose_nothing(shards, ranges, width):
    want, found = Counter(), Counter()
    parts = defaultdict(list)
    for shard in shards:
        counted = Counter()
        for k, c in shard:
            counted[k % 2**width] += c
        want += counted
        keys = quotient_filter.permute(np.array(list(counted), dtype=np.uint64), width)
        order = np.argsort(keys)
        for r, packed in quotient_filter.split(keys[order], np.array(list(counted.values()), dtype=np.int64)[order], ranges, width):
            parts[r].append(quotient_filter.unpack(packed, r, ranges, width))
    for filters in parts.values():
        keys, counts, place = quotient_filter.merge(filters)
        assert (np.diff(keys.astype(object)) > 0).all() and (keys[place] == np.concatenate([k for k, _ in filters])).all()
        found.update(dict(zip(map(int, quotient_filter.restore(keys, width)), map(int, counts), strict=True)))
    assert found == want


def brute(rows, min_count, top, longest=5):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        body = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", body):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    often = {p: c for p, c in f.items() if c >= min_count and len(p[1]) > 1}
    out = defaultdict(list)
    covered = {(lang, w[i:j]) for (lang, w), c in often.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1)
               if j - i < len(w) and f[lang, w[i:j]] == c}
    for (lang, w), a in often.items():
        if (lang, w) not in covered:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), a, left, right, n[lang], score))
    return sorted((lang, rank, p.decode(), *rest) for lang, found in out.items() for rank, (_, _, p, *rest) in enumerate(sorted(found)[:top], 1))


def corpus(seed):
    draw = random.Random(seed)
    words = "the of New York a b ü Σ \x00 x-y 日本".split(" ")
    rows = []
    for i in range(300):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r", " ", "!?"]) for _ in range(draw.randrange(40)))
        rows.append((draw.choice(["en", "en", "de", None, ""]), text + draw.choice(["", "one two three four five six", "New York City"])))
    return rows + [("en", None), ("en", ""), ("de", "." * 50), ("de", "lone"), *[("fr", "hot line of every row")] * 400, ("en", "very long " * 30_000)]


@pytest.mark.parametrize("min_count,top,shard_chars,range_words", [(3, 50, 500, 100), (7, 2000, 16_000_000, 1 << 20), (40, 3, 5_000, 7)])
def test_phrases_are_those_of_brute_force(spark, min_count, top, shard_chars, range_words):
    rows = corpus(min_count)
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "lang string, text string, shard long, words string, n double").repartition(5)
    got = collocations.mine(df, min_count=min_count, top=top, shard_chars=shard_chars, range_words=range_words)
    assert sorted(map(tuple, got.collect())) == brute(rows, min_count, top)


def test_slices_end_between_words(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_CHARS", 5)
    text = b"Aa bbbbbbbb\tcc.dd e"
    assert b" ".join(collocations._slices(text)).split() == b"aa bbbbbbbb cc . dd e .".split()


def test_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    df = collocations.op13_collocations(spark, "/root/testdata/sf0.01")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({collocations.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) > 50
