"""Language identification by prediction by partial matching over byte context trees, one tree for each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import BROADCAST_KEYS, map_texts, materialize, remainder, table

#: Longest context in bytes, and the bounded sample that the trees are fitted on: documents of each language (the first
#: by hash among those of up to so many characters; each is taken whole).
ORDER, SAMPLE_DOCS, SAMPLE_CHARS = 3, 1_500, 16_384
#: Bytes of texts that are coded together, and as many where the documents themselves pass by in the same worker; coding takes some 50 bytes each.
CODED, CODED_BESIDE = 2_000_000, 500_000
#: Bits a byte by which code lengths are compared in the score.
SHARPNESS = 40.0


def sample_by_language(docs: DataFrame, key: str, text: str, lang: str, per_language: int) -> DataFrame:
    """(lang, text) of the `per_language` first documents of each language by hash; only ids are ranked."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.length(text).between(1, SAMPLE_CHARS))
    known = known.select(F.col(lang).alias("lang"), F.xxhash64(key, text).alias("h"), F.col(text).alias("text"))
    # a language's count tells below which hash about twice as many rows lie as are wanted, so only those are ranked
    share = F.least(F.lit(1.0), 2.0 * (per_language + 50) / F.col("count"))
    marks = _small(known.groupBy("lang").count().select(F.col("lang").alias("l"), (share * 2.0**64 - 2.0**63).alias("mark")))
    near = known.select("lang", "h").join(marks, F.col("lang") == F.col("l")).where(F.col("h").cast("double") <= F.col("mark"))
    # rows of one hash are the same id and text again, and count once
    order = Window.partitionBy("lang").orderBy("h")
    chosen = near.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("lang", "h")
    return known.join(_small(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")


def _small(rows: DataFrame) -> DataFrame:
    """`rows`, written, and broadcast where they are as few as expected."""
    rows = materialize(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows


class ContextTrees:
    """Frozen code lengths. For each language and context length the trees hold the contexts met with the bits of an escape
    from them, and the (context, symbol) codes met with the bits of that symbol there; both in order, so what a tree takes
    grows with what its language's sample holds, not with languages times contexts times symbols.

    Escape method C: a context seen n times with d distinct symbols gives a symbol seen c times c / (n + d), and d / (n +
    d) to all others, which its suffix context then codes; below the empty context all symbols are alike."""

    #: Codes of ORDER bytes and one more that a task remembers with their bits in all languages.
    REMEMBERED = 300_000

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.languages, self.order = sorted(samples), order
        seen = np.zeros(256, dtype=bool)
        for texts in samples.values():
            for t in texts:
                seen[np.frombuffer(t, dtype=np.uint8)] = True
        # symbol 0 is the start of a text, 1 any byte never seen in training
        self.symbol = np.ones(256, dtype=np.int64)
        self.symbol[seen] = np.arange(2, 2 + seen.sum())
        a = self.alphabet = int(2 + seen.sum())
        self.trees = []
        for lang in self.languages:
            levels = []
            for codes, n in self._count(samples[lang]):
                contexts, first, kinds = np.unique(codes // a, return_index=True, return_counts=True)
                total = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
                own = np.log2(np.repeat(total + kinds, kinds) / n).astype(np.float32)
                levels.append((contexts, np.log2((total + kinds) / kinds).astype(np.float32), codes, own))
            self.trees.append(levels)
        self._forget()

    def _forget(self) -> None:
        self.codes, self.bits = np.zeros(0, np.int64), np.zeros((len(self.languages), 0), np.float32)

    def _bits(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last symbol of each code, (languages, codes): from the longest context met, with the escapes on the way."""
        out = np.zeros((len(self.languages), len(codes)), np.float32)
        for li, levels in enumerate(self.trees):
            open_ = np.ones(len(codes), dtype=bool)
            for k in range(self.order, -1, -1):
                contexts, escape, held, own = levels[k]
                code = codes % self.alphabet ** (k + 1)
                at, met = _find(held, code)
                met &= open_
                out[li, met] += own[at[met]]
                open_ &= ~met
                at, met = _find(contexts, code // self.alphabet)
                met &= open_
                out[li, met] += escape[at[met]]
            out[li, open_] += np.float32(np.log2(self.alphabet))
        return out

    def symbols(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts in a row, each after `order` start symbols, and where each text's own symbols begin."""
        pad = bytes(self.order)
        joined = np.frombuffer(pad + pad.join(texts), dtype=np.uint8) if texts else np.zeros(0, np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(sizes + self.order) - sizes
        symbols = self.symbol[joined]
        for k in range(1, self.order + 1):
            symbols[starts - k] = 0
        return symbols, starts

    def _count(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each context length: the (context, symbol) codes and how often they are met."""
        symbols, starts = self.symbols(texts)
        own = np.ones(len(symbols), dtype=bool)
        for k in range(1, self.order + 1):
            own[starts - k] = False
        at, out, code = np.flatnonzero(own), [], 0
        for k in range(self.order + 1):
            code = code + symbols[at - k] * self.alphabet**k
            out.append(np.unique(code, return_counts=True))
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language's tree: shape (texts, languages)."""
        symbols, starts = self.symbols(texts)
        o = self.order
        code = sum(symbols[o - k: len(symbols) - k] * self.alphabet**k for k in range(o + 1))
        number, kinds = pd.factorize(code)
        at, known = _find(self.codes, kinds)
        if not known.all():
            if len(self.codes) > self.REMEMBERED:
                self._forget()
                known[:] = False
            new = np.sort(kinds[~known])
            order = np.argsort(np.concatenate([self.codes, new]), kind="stable")
            self.bits = np.concatenate([self.bits, self._bits(new)], axis=1)[:, order]
            self.codes = np.concatenate([self.codes, new])[order]
            at, _ = _find(self.codes, kinds)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        for li in range(len(self.languages)):
            sums = np.concatenate([[0.0], np.cumsum(self.bits[li][at][number], dtype=np.float64)])
            out[:, li] = sums[starts - o + sizes] - sums[starts - o]
        return out


def _find(held: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each code stands in `held`, which is in order, and whether it does."""
    if not len(held):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), dtype=bool)
    at = np.minimum(np.searchsorted(held, codes), len(held) - 1)
    return at, held[at] == codes


def posteriors(bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shares of the languages by code length a byte; adds up to 1 for each text."""
    rate = bits / np.maximum(sizes, 1)[:, None]
    weight = np.exp2(-(rate - rate.min(axis=1, keepdims=True)) * SHARPNESS / 4)
    return weight / weight.sum(axis=1, keepdims=True)


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_DOCS) -> ContextTrees:
    """Trees of a bounded sample of labelled rows: at most `per_language` documents of each language, each
    whole and of at most SAMPLE_CHARS characters. The trees, and so their broadcast, are bounded by it."""
    samples: dict[str, list[bytes]] = {}
    for row in sample_by_language(train, key, text, lang, per_language).toLocalIterator():
        samples.setdefault(row.lang, []).append(row.text.encode("utf-8", "replace"))
    return ContextTrees({k: sorted(v) for k, v in samples.items()})


def identify(docs: DataFrame, trees: ContextTrees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` rows as (key, lang_pred, score): the language whose tree codes the whole text shortest (ties to the first
    name), and its share in 0 to 1 among the languages.

    Texts that are null, empty or without any letter, and all texts where nothing was learned, get `und` and 0. Very
    long texts are scored whole; repeated rows get repeated results; an empty table gives an empty result; no other
    column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    rows = docs.select(F.col(key).alias("key"), F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("body"))

    def start():
        def name(bodies: list) -> list[pa.Array]:
            found = name_languages(shared.value, bodies)
            return [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64()))]

        return name

    return map_texts(rows, "body", "lang_pred string, score double", start).withColumnRenamed("key", key)


def name_languages(trees: ContextTrees, bodies: list, together: int = CODED) -> list[tuple[str, float]]:
    """(lang_pred, score) of each text; null ones are undetermined. Coded about `together` bytes at a time."""
    out: list[tuple[str, float]] = []
    held, size = [], 0
    for i, body in enumerate(bodies):
        data = body.encode("utf-8", "replace") if body is not None and trees.languages else b""
        held.append(data)
        size += len(data)
        if size > together or i == len(bodies) - 1:
            bits = trees.code_lengths(held)
            share = posteriors(bits, np.array([len(t) for t in held])) if trees.languages else np.zeros((len(held), 1))
            out += [(trees.languages[int(s.argmax())], float(s.max())) if t else ("und", 0.0) for t, s in zip(held, share, strict=True)]
            held, size = [], 0
    return out


def keep_identified(docs: DataFrame, trees: ContextTrees, text: str = "text", least: float = 0.5) -> DataFrame:
    """`docs` without the rows that have no letter or whose best language's share is under `least`; all columns stay. So
    null and empty texts go; long ones are read whole, repeated rows fare alike, an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("lang_pred string, score double")
    def language(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in bodies:
            found = name_languages(shared.value, list(batch), CODED_BESIDE)
            yield pd.DataFrame(found, columns=["lang_pred", "score"]).astype({"lang_pred": object, "score": float})

    found = language(F.when(F.col(text).rlike(r"\p{L}"), F.col(text)))
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= least))


def predict(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trees learn from rows whose crc32 of the id modulo 4 isn't 2."""
    trees = fit(docs.where(remainder(key, 4) != 2), key, text, lang, per_language)
    found = identify(docs, trees, key, text)
    return found.select(key, (remainder(key, 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_context_tree_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))
