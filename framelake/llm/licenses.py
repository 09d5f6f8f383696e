"""License scan: TF-IDF cosine of notices and licence files to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import BROADCAST_KEYS, materialize, table

WORD = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]")
#: Notices by licence; fixed values.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted."],
    "CC-BY-4.0": ["This work is licensed under the Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Every licence is also known by its header line.
TEMPLATES = {name: [*notices, f"SPDX-License-Identifier: {name}"] for name, notices in TEMPLATES.items()}
THRESHOLD = 0.8
#: Licences whose full texts lie in `licence_texts`, one file a SPDX id.
TEXTS = ["0BSD", "Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3",
         "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0",
         "Unlicense", "Zlib"]
#: Terms that a smaller share of the other files holds weigh as those of this share.
RARE = 1e-3


def terms(line: str) -> Counter:
    return Counter(WORD.findall(line.lower()))


def idf(share: float) -> float:
    """The weight of a term by the share of the other files that hold it; a share, so that it is the same at all sizes."""
    return 1 - math.log(max(share, RARE))


def licence_texts() -> dict[str, str]:
    """The full licence texts by SPDX id."""
    return {name: pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode() for name in TEXTS}


class Space:
    """The templates in TF-IDF; `shares`: what share of the files, but for one, holds each term of theirs, and maybe others."""

    def __init__(self, templates: dict[str, list[str]], shares: dict[str, float], threshold: float):
        self.shares = shares
        counted = [(name, terms(n)) for name in sorted(templates) for n in templates[name]]
        self.templates = [(name, n.total(), self.vector(n, shares)) for name, n in counted]
        self.keys = sorted({k for _, _, v in self.templates for k in self._needed(v, threshold)})
        listed = sorted({t for _, _, v in self.templates for t in v})
        self.rows = {t: i for i, t in enumerate(listed)}
        self.squares = np.array([[v.get(t, 0.0) ** 2 for _, _, v in self.templates] for t in listed]).reshape(len(listed), len(self.templates))

    @staticmethod
    def vector(counts: dict[str, int], shares: dict[str, float]) -> dict[str, float]:
        raw = {t: n * idf(shares.get(t, 0.0)) for t, n in counts.items()}
        length = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        return {t: x / length for t, x in raw.items()}

    @staticmethod
    def _needed(vector: dict[str, float], threshold: float) -> list[str]:
        """Terms of which a line must hold one to come to the threshold: without them its cosine is at most the length
        of the template's other part."""
        out, rest = [], 1.0
        for t, x in sorted(vector.items(), key=lambda p: (-p[1], p[0])):
            if rest < threshold * threshold * 0.999:
                break
            out.append(t)
            rest -= x * x
        return out

    def best(self, counts: Counter, shares: dict[str, float], alike: bool = False, least: float = 0.0) -> tuple[float, str]:
        """The largest cosine of a line's terms, with the shares of those of no template, and its licence; ties go to the
        first name. With `alike`, only templates of at least half and at most twice as many terms are compared. With `least`, only
        those that can come to it: a cosine is at most the length of the template's part on the line's terms."""
        size = counts.total()
        near = [(i, name, tv) for i, (name, n, tv) in enumerate(self.templates) if not alike or n <= 2 * size <= 4 * n]
        if near and least > 0:
            part = self.squares[[self.rows[t] for t in counts if t in self.rows]].sum(axis=0)
            near = [x for x in near if part[x[0]] >= least * least * 0.999]
        if not near:
            return 0.0, ""
        v = self.vector(counts, {t: self.shares.get(t, shares.get(t, 0.0)) for t in counts})
        return max(((sum(x * v.get(t, 0.0) for t, x in tv.items()), name) for _, name, tv in near), key=lambda s: s[0])


def file_terms(text: str) -> Column:
    """The distinct terms of a file, as `terms` finds them."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD.pattern})"), F.lit(1)))


def document_shares(files: DataFrame, words: DataFrame, count: int) -> DataFrame:
    """(t, share): the share of the other files that holds each of `words` (t, distinct), counted over all files."""
    found = files.select(F.explode(file_terms("text")).alias("t")).join(words, "t", "left_semi").groupBy("t").agg(F.count("*").alias("n"))
    return found.select("t", ((F.col("n") - 1) / max(1, count)).alias("share"))


def runs(text: str, keys: set[str], longest: int) -> Iterator[Counter]:
    """The terms of a text's candidates: each line, each run of lines (without terms: skipped) of up to twice the terms of
    the longest template, as a wrapped notice or header block is, and so the whole text if it is that short. All hold one of
    `keys` as a term; comment signs are no terms."""
    lines = [(n, not keys.isdisjoint(n)) for x in re.split(r"\r?\n|\r", text) if (n := terms(x))]
    for i, (first, keyed) in enumerate(lines):
        if keyed:
            yield first
        run, size = Counter(first), first.total()
        for n, key in lines[i + 1:]:
            size, keyed = size + n.total(), keyed or key
            if size > 2 * longest:
                break
            run.update(n)
            if keyed:
                yield Counter(run)


def scan(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, list[str]] | None = None,
         threshold: float = THRESHOLD, texts: dict[str, str] | None = None) -> DataFrame:
    """Rows (path, license, score, basis, source), one for each distinct path: the licence of the file's own notice
    (`own`: the line, run of lines or short whole text nearest to a template, from `threshold` on, or the whole text as the
    nearest of the full licence texts `texts` that have at least half and at most twice its terms), else that of the nearest ancestor
    directory with a licence file (`inherited`; a licence file is named LICENSE, LICENCE or COPYING, with any ending), else
    null (`none`). `source` is the path that the licence comes from.

    Null paths are dropped, null and empty texts have no notice; every line and short run of lines of a text is compared, however long the text;
    of equal cosines the first licence name stands, of repeated paths the best notice; an empty table gives an empty
    result; other columns aren't read. Directories meet by equi-joins on path, one row an ancestor.
    """
    templates = templates or TEMPLATES
    texts = {name: [text] for name, text in (licence_texts() if texts is None else texts).items()}
    vocabulary = {t for notices in [*templates.values(), *texts.values()] for n in notices for t in terms(n)}
    rows = files.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.col("path").isNotNull())
    spark, count = files.sparkSession, rows.count()
    listed = spark.createDataFrame([(t,) for t in sorted(vocabulary)], "t string")
    shares = dict.fromkeys(vocabulary, 0.0) | {r.t: r.share for r in document_shares(rows, F.broadcast(listed), count).collect()}
    space = Space(templates, shares, threshold)
    shared = spark.sparkContext.broadcast((space, Space(texts, shares, threshold)))
    longest = max((terms(n).total() for notices in templates.values() for n in notices), default=0)

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        notices, wholes = shared.value
        keys = set(notices.keys)
        for b in batches:
            # with the least weight, 1, for other terms a cosine is an upper bound: what stays under the threshold then has no match
            out: dict = {}
            for p, t in zip(b["path"], b["text"], strict=True):
                whole = terms(t)  # a line's terms are among the text's, as no term holds a line end
                if not keys.isdisjoint(whole):
                    out |= {(p, " ".join(sorted(run.elements())), False): None for run in runs(t, keys, longest)
                            if notices.best(run, dict.fromkeys(run, 1.0), least=threshold)[0] >= threshold}
                if wholes.best(whole, dict.fromkeys(whole, 1.0), alike=True, least=threshold)[0] >= threshold:
                    out[p, " ".join(sorted(whole.elements())), True] = None
            yield pd.DataFrame(list(out), columns=["path", "bag", "whole"])

    bags = materialize(rows.mapInPandas(candidates, "path string, bag string, whole boolean"))
    # each distinct bag of terms meets the shares of its terms and is compared once
    held = bags.select("bag", "whole").distinct().select("bag", "whole", F.explode(F.array_distinct(F.split("bag", " "))).alias("t"))
    others = materialize(held.where(~F.col("t").isin(sorted(vocabulary))).select("t").distinct())
    few = others.count() <= BROADCAST_KEYS
    known = held.join(document_shares(rows, F.broadcast(others) if few else others, count), "t", "left").groupBy("bag", "whole").agg(
        F.collect_list("t").alias("t"), F.collect_list(F.coalesce("share", F.lit(0.0))).alias("share"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spaces = shared.value
        for b in batches:
            found = [spaces[whole].best(Counter(bag.split(" ")), dict(zip(t, x, strict=True)), alike=bool(whole))
                     for bag, whole, t, x in zip(b["bag"], b["whole"], b["t"], b["share"], strict=True)]
            b = b.assign(score=[s for s, _ in found], license=[n for _, n in found])
            yield b.loc[b["score"] >= threshold, ["bag", "whole", "score", "license"]]

    hits = bags.join(known.mapInPandas(match, "bag string, whole boolean, score double, license string"), ["bag", "whole"])
    # of a path's hits the highest score, then the first name
    best = hits.groupBy("path", "score").agg(F.min("license").alias("license")).groupBy("path").agg(F.max(F.struct("score", "license")).alias("b"))
    own = materialize(best.select("path", "b.score", "b.license"))
    folder = F.regexp_extract(F.col("path"), r"^(.*)/[^/]*$", 1)
    named = F.lower(F.regexp_extract(F.col("path"), r"([^/]*)$", 1)).rlike(r"^(license|licence|copying)(\..*)?$")
    granted = own.where(named).groupBy(folder.alias("folder")).agg(F.max(F.struct("score", F.col("path").alias("source"), "license")).alias("g"))
    paths = rows.select("path").distinct()
    lacking = paths.join(own, "path", "left_anti").select(folder.alias("home")).distinct()
    parts = F.split("home", "/")
    above = lacking.select("home", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(
        i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("folder")))).alias("a")).select("home", "a.depth", "a.folder")
    near = above.join(granted, "folder").groupBy("home").agg(F.max(F.struct("depth", "g")).alias("n")).select("home", "n.g.*")
    near = near.withColumnsRenamed({"score": "up_score", "license": "up_license"})
    whole = paths.join(own, "path", "left").withColumn("home", folder).join(near, "home", "left")
    has = F.col("license").isNotNull()
    return whole.select("path", F.coalesce("license", "up_license").alias("license"), F.when(has, F.col("score")).otherwise(F.col("up_score")).alias("score"),
                        F.when(has, "own").when(F.col("up_license").isNotNull(), "inherited").otherwise("none").alias("basis"),
                        F.when(has, F.col("path")).otherwise(F.col("source")).alias("source"))


def document_paths(docs: DataFrame) -> Column:
    """A path for each document: source, then thousands and hundreds of its id (none: `-`), then id and a hash of the text, so that
    rows that share an id but not the text are files of their own. Documents that consist of a notice after a few words stand as that
    directory's licence file."""
    body = F.coalesce("text", F.lit(""))
    at = lambda n: F.coalesce(F.floor(F.col("doc_id") / n).cast("string"), F.lit("-"))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), at(1000), at(100))
    notice = (F.length(body) < 400) & F.lower(body).rlike("licen[cs]e")
    name = F.concat(at(1), F.lit("-"), F.hex(F.xxhash64(body)))
    return F.concat(folder, F.when(notice, F.concat(F.lit("/LICENSE."), name)).otherwise(F.concat(F.lit("/"), name)))


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, path, license, score, basis, source), one for each row of `docs` (see `scan` and `document_paths`): rows without an id
    have files too, repeated rows each get their file's result, null and empty texts have no notice of their own."""
    files = docs.select("doc_id", document_paths(docs).alias("path"), "text")
    return files.select("doc_id", "path").join(scan(files.select("path", "text")), "path").select("doc_id", "path", "license", "score", "basis", "source")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))
