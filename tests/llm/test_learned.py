"""Learned operators on held-out rows, and the pipeline against a plain version."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from framelake.llm import bpe, language_id, licenses, toxicity

SF = "/root/testdata/sf0.001"


def test_code_lengths_are_those_of_a_plain_model():
    texts = {"a": [b"abracadabra", b"abc"], "b": [b"xyzzy plugh"]}
    trees = language_id.ContextTrees(texts)
    rng = np.random.default_rng(0)
    for lang, probe in (("a", b"abracad"), ("b", b"zzy abq"), ("a", bytes(rng.integers(0, 256, 30).tolist()))):
        counts = {}
        for t in texts[lang]:
            s = [0, 0, 0, *trees.symbol[list(t)]]
            for i in range(3, len(s)):
                for k in range(4):
                    counts.setdefault(tuple(s[i - k: i]), {}).setdefault(s[i], 0)
                    counts[tuple(s[i - k: i])][s[i]] += 1
        bits, s = 0.0, [0, 0, 0, *trees.symbol[list(probe)]]
        for i in range(3, len(s)):
            for k in (3, 2, 1, 0, -1):
                if k < 0:
                    bits += np.log2(trees.alphabet)
                    break
                seen = counts.get(tuple(s[i - k: i]))
                if seen:
                    total = sum(seen.values()) + len(seen)
                    if s[i] in seen:
                        bits -= np.log2(seen[s[i]] / total)
                        break
                    bits -= np.log2(len(seen) / total)
        got = trees.code_lengths([b"", probe, b"other"])[1, trees.languages.index(lang)]
        assert got == pytest.approx(bits, rel=1e-5)


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.predict(docs).join(docs, "doc_id")
    held = found.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (4, "the thing", "en"), (4, "the thing", "en"), (None, "x" * 100_000, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(odd).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in ("en", "und")
    assert language_id.predict(odd.limit(0)).count() == 0


@pytest.mark.parametrize("first", [[1, 0, 2, 1], [0, 0, 2, 0], [3, 1, 0, 2]])
def test_marginals_are_those_of_all_paths(first):
    rng = np.random.default_rng(2)
    field = toxicity.Field({}, -1.0, rng.normal(size=(2, 2)), (1.0, 0.0))
    weights, gaps = np.array([1.5, -0.5, 2.0]), np.array(first)
    emit, at = [], []
    for g, w in zip(gaps, [*weights, None], strict=True):
        emit += [field.bias] * g
        if w is not None:
            at.append(len(emit))
            emit.append(field.bias + w)
    total, one = 0.0, np.zeros(len(at))
    for path in range(2 ** len(emit)):
        s = [(path >> i) & 1 for i in range(len(emit))]
        p = np.exp(sum(e for e, x in zip(emit, s, strict=True) if x) + sum(field.move[a, b] for a, b in zip(s, s[1:], strict=False)))
        total += p
        one += p * np.array([s[i] for i in at])
    assert field.marginals(weights, gaps) == pytest.approx(one / total, rel=1e-9)


def test_marginals_of_very_long_gaps():
    field = toxicity.Field({}, -2.0, np.array([[1.0, -1.0], [-0.5, 0.5]]), (1.0, 0.0))
    far, farther = (field.marginals(np.array([3.0, 3.0]), np.array([0, n, 0])) for n in (2_000, 5_000_000))
    assert far == pytest.approx(farther, rel=1e-9) and np.isfinite(farther).all()


def test_toxic_spans(spark):
    words = "river stone light garden window paper silver morning travel little".split()
    rng, rows = np.random.default_rng(3), []
    for i in range(400):
        text = rng.choice(words, 30).tolist()
        if i % 4 == 0:
            text[5], text[20] = "Grubnik,", rng.choice(["zorble", "grubnik"])
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    odd = [(1000, None), (1001, ""), (1002, "grubnik zorble " + "river " * 50_000), (1003, "river stone")]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(i, t, "x") for i, t in odd], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in toxicity.predict(docs, labels).collect()}
    assert all(got[i].predicted == y and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, y in rows)
    assert [got[i].predicted for i, _ in odd] == [0, 0, 1, 0]
    field = toxicity.fit(docs, labels)
    spans = toxicity.score_documents(docs, field).where("doc_id = 1002").first().spans
    assert [(s.start, s.end) for s in spans] == [(0, 7), (8, 14)]
    assert toxicity.predict(docs.limit(0), labels.limit(0)).count() == 0


def test_toxic_words_of_smaller_languages(spark):
    rng, rows, labels = np.random.default_rng(5), [], []
    main = "river stone light garden window paper silver morning travel little".split()
    other = "fluss stein licht garten fenster papier silber morgen reise klein".split()
    ends = ["al", "en", "or", "ist", "ung", "ap", "im", "ek", "ost", "uz"]
    for i in range(2400):
        few, toxic = i % 12 == 0, i % 5 == 0
        text = rng.choice(other if few else main, 30).tolist()
        if toxic:
            for at in (5, 20):
                text[at] = "zwackel" + "".join(rng.choice(ends, 2)) if few else rng.choice(["grubnik", "zorble"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.predict(docs, labels).join(labels, "doc_id").where("held_out").collect()
    few = [r for r in got if r.doc_id % 12 == 0]
    assert sum(r.toxic for r in few) >= 8 and all(r.predicted == r.toxic for r in got)
    assert all(r.n_spans == 2 * r.toxic for r in few)


def test_chain_learns_from_every_mark():
    assert toxicity.windows([3, 10, 90], 95) == [(0, 19), (82, 95)]
    assert toxicity.windows(list(range(0, 100)), 100) == [(0, 64), (64, 100)]
    filler = ["river stone light garden"] * 15
    toxic = [" ".join(["grubnik", *filler, "zorble", *filler]) for _ in range(30)]
    field = toxicity.learn(toxic, [" ".join(filler * 2)] * 60)
    assert [s[:2] for s in field.tag(toxic[0])[1]] == [(0, 7), (toxic[0].index("zorble"), toxic[0].index("zorble") + 6)]


def test_toxic_recall_of_each_language(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    marked = docs.join(labels, "doc_id")
    found = toxicity.predict(marked, labels).join(marked.select("doc_id", "lang", "toxic"), "doc_id").where("held_out").collect()
    for lang in ("en", "fr", "de", "es"):
        toxic, clean = ([r.predicted for r in found if r.lang == lang and r.toxic == y] for y in (1, 0))
        assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.06 * len(clean)


def test_licences(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    files = [("r/LICENSE", "Released under the MIT License."), ("r/a/b/f", "nothing here"), ("r/a/COPYING.txt", notice), ("r/g", f"code\n# {notice}\nmore"), ("s/h", None), ("s/h", ""), (None, notice), ("top", "x" * 100_000)]
    df = spark.createDataFrame([(p, t, "x") for p, t in files], "path string, text string, score string")
    got = {r.path: (r.license, r.basis, r.source) for r in licenses.scan(df).collect()}
    assert got["r/a/b/f"] == ("Apache-2.0", "inherited", "r/a/COPYING.txt") and got["r/g"] == ("Apache-2.0", "own", "r/g")
    assert got["r/LICENSE"][:2] == ("MIT", "own") and got["s/h"] == (None, "none", None) and got["top"][0] is None and len(got) == 6
    assert licenses.scan(df.limit(0)).count() == 0


def test_full_licence_texts(spark):
    texts = licenses.licence_texts()
    assert len(texts) >= 20
    files = [(f"{name}/COPYING", "Copyright (c) 1999 Some Body\n\n" + " ".join(text.split())) for name, text in texts.items()]
    files += [(f"{name}/code", "int main") for name in texts] + [("other/LICENSE", "words of no licence " * 80), ("other/b", None), ("other/c", "")]
    got = {r.path: (r.license, r.basis, r.score) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    for name in texts:
        assert got[f"{name}/COPYING"][:2] == (name, "own") and got[f"{name}/code"][:2] == (name, "inherited")
        assert got[f"{name}/COPYING"][2] > 0.95
    assert {got[f"other/{x}"] for x in ("LICENSE", "b", "c")} == {(None, "none", None)}
    # what has less than half or more than twice a licence's terms isn't that licence
    space = licenses.Space({"MIT": [texts["MIT"]]}, {}, 0.8)
    half, twice = (licenses.terms(x) for x in (texts["MIT"][: len(texts["MIT"]) // 3], texts["MIT"] * 3))
    assert space.best(half, {}, alike=True) == space.best(twice, {}, alike=True) == (0.0, "")


def test_wrapped_licences(spark):
    bsd = "/*\n * Redistribution and use in source and binary\n * forms, with or without\n *\n * modification, are permitted.\n */\nint main() {}\n"
    gpl = "# This work is licensed under\n# the GNU General\n# Public License,\n# version 3.\nimport os\nprint(os)\n"
    df = spark.createDataFrame([("a/x.c", bsd), ("a/y.py", gpl), ("a/z", "version 3\nof the public works\nis here")], "path string, text string")
    got = {r.path: (r.license, r.basis) for r in licenses.scan(df).collect()}
    assert got == {"a/x.c": ("BSD-3-Clause", "own"), "a/y.py": ("GPL-3.0", "own"), "a/z": (None, "none")}


def test_every_document_gets_a_licence_row(spark):
    notice = "Released under the MIT License."
    rows = [(1, notice, "s"), (1, "some other text", "s"), (1, "some other text", "s"), (None, "text", "s"), (None, None, None), (2, "", "s"), (9_007_199_254_740_993, "x" * 50_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = licenses.scan_documents(docs).collect()
    assert sorted((str(r.doc_id), str(r.license), r.basis) for r in got) == sorted([
        ("1", "MIT", "own"), ("1", "MIT", "inherited"), ("1", "MIT", "inherited"), ("2", "MIT", "inherited"), ("9007199254740993", "None", "none"), ("None", "None", "none"), ("None", "None", "none")])
    assert licenses.scan_documents(docs.limit(0)).count() == 0


def test_licences_are_those_of_a_plain_scan(spark):
    """Every run of lines of every text against every template, in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    paths = docs.select(licenses.document_paths(docs).alias("path"), "text").collect()
    files = {r.path: r.text or "" for r in paths}
    held = [set(licenses.terms(t)) for t in files.values()]
    share = lambda t: (sum(t in h for h in held) - 1) / len(held)
    shares = {}
    templates = [(name, licenses.terms(n)) for name in sorted(licenses.TEMPLATES) for n in licenses.TEMPLATES[name]]
    longest = max(t.total() for _, t in templates)

    def unit(counts):
        v = {t: n * licenses.idf(max(0.0, shares.setdefault(t, share(t)))) for t, n in counts.items()}
        size = sum(x * x for x in v.values()) ** 0.5
        return {t: x / size for t, x in v.items()}
    vectors = [(name, unit(t)) for name, t in templates]
    words = set().union(*(t for _, t in templates))
    own = {}
    for path, text in files.items():
        lines = [c for line in text.splitlines() if (c := licenses.terms(line))]
        for i in range(len(lines)):
            run, size = Counter(), 0
            for j in range(i, len(lines)):
                size += lines[j].total()
                if j > i and size > 2 * longest:
                    break
                run.update(lines[j])
                if 3 * sum(n for t, n in run.items() if t in words) < run.total():
                    continue  # far under the threshold
                v = unit(run)
                for name, tv in vectors:
                    s = sum(x * v.get(t, 0.0) for t, x in tv.items())
                    if s >= licenses.THRESHOLD - 1e-9 and (path not in own or s > own[path][0] + 1e-9):
                        own[path] = (s, name)
    got = {r.path: (r.license, r.score) for r in licenses.scan_documents(docs).where("basis = 'own'").collect()}
    assert set(got) == set(own) and len(own) > 0
    assert all(got[p][1] == pytest.approx(s, abs=1e-6) and got[p][0] == name for p, (s, name) in own.items())


def test_licence_scores_are_equal_over_corpus_sizes(spark):
    notice, scores = "Licensed under the Apache License, Version 2.0.", []
    for n in (200, 20_000):
        files = spark.range(n).select(F.concat(F.lit("d/"), "id").alias("path"), F.when(F.col("id") == 0, f"{notice} Wexelblat").when(
            F.col("id") == 1, f"{notice} common").when(F.col("id") % 50 == 2, notice).otherwise("the common words under that").alias("text"))
        got = {r.path: r.score for r in licenses.scan(files).where("path IN ('d/0', 'd/1')").collect()}
        scores.append((got["d/0"], got["d/1"]))
    assert scores[0] == pytest.approx(scores[1], abs=0.02) and scores[1][1] > scores[1][0] > 0.8


def test_pipeline_keeps_what_a_plain_version_keeps(spark):
    docs = {i: t for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = {r.doc_id for r in stages["toxicity"](spark, frame, SF).collect()}
    named = {r.doc_id for r in stages["language_id"](spark, frame.where(frame.doc_id.isin(list(clean))), SF).collect()}
    assert all(any(c.isalpha() for c in docs[i]) for i in named) and len(named) > 0.9 * len(docs) - 40
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i in named if (w := docs[i].encode().lower().split())}
    parent = {i: i for i in named}

    def root(i):
        return i if parent[i] == i else root(parent[i])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    single = {i for i in named if root(i) == i}
    import re
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    items = [words(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    windows = {tuple(w[k:k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    kept = {i for i in single if not any(tuple(w[k:k + n]) in windows for n in sizes for w in [words(docs[i])] for k in range(len(w) - n + 1))}
    got = corpus_pipeline.run(spark, SF).collect()
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id for r in got} == kept and all(list(r.ids) == theirs.encode_ordinary(docs[r.doc_id]) and r.n_tokens == len(r.ids) for r in got)
    marks = dict(duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{SF}/labels.parquet' GROUP BY 1").fetchall())
    assert sum(marks.get(i) == 0 for i in clean) >= 0.97 * sum(y == 0 for y in marks.values())


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, ids beyond 2^53 and a clashing column; and empty tables."""
    big, rng = 2**53 + 1, np.random.default_rng(6)
    plain = lambda n: " ".join(rng.choice("river stone light garden window paper silver morning travel little house tree".split(), n))
    rows = [(i, plain(60), "en", "web", 1) for i in range(60)]
    rows += [(big, plain(60), None, None, None), (None, plain(60), "en", "web", 1), (100, None, "en", "web", 0), (101, "", None, "web", 0), (102, plain(60_000), "en", "web", 1),
             (103, rows[0][1], "en", "web", 1), (104, rows[1][1], "en", "web", 1), (104, rows[1][1], "en", "web", 1), (105, "12 34 !?", "en", None, 0),
             (106, "one two three four five six seven eight nine ten eleven " + plain(30), "en", "web", 1)]
    frames = {"documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int"),
              "labels": spark.createDataFrame([(0, 0), (1, 1), (None, 1), (2, None)], "doc_id long, toxic int"),
              "benchmark": spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (None, "")], "item_id long, text string")}
    for name, f in frames.items():
        f.write.parquet(f"{tmp_path}/a/{name}.parquet")
        f.limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    got = sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, f"{tmp_path}/a").collect())
    assert got == sorted([str(i) for i in range(60)] + [str(big), "None", "102"])
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
