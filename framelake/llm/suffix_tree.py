"""Language-model scoring by a probabilistic suffix tree over words.

Contexts are sequences of up to DEPTH words. A context is counted if it is met often enough, and kept if its next-word
distribution diverges from that of its longest kept suffix. What is often enough grows with the root of the training
tokens: so the tree grows with the corpus, and still its size is bounded by a multiple of that root. Next words that are
frequent after a context have probabilities of their own there, all others take what is left in proportion to the suffix
context. The empty context has the add-one counts of all words, which stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import materialize, remainder, spread, stable, table
from framelake.llm.packing import Batch, batches, by_bucket

#: The longest context in words. How often a word, a context and a next word in a context must be met, as (least, multiple of the
#: root of the training tokens).
DEPTH = 4
WORD, CONTEXT, NEXT = (5, 0.1), (20, 1.0), (3, 0.03)
#: A context stays if its count times its divergence from its suffix (nats) is at least this; what its own
#: probabilities leave to all other words.
DIVERGENCE, DISCOUNT = 30.0, 0.05
#: The token after each document; no word can be it, as words have no white space.
END = b"\n"


def support(tokens: int, rule: tuple[int, float]) -> float:
    return max(rule[0], rule[1] * tokens**0.5)


@dataclass
class Level:
    """Contexts of one length in order of their codes: number of the context without its first word (0 at length 1) * F + that
    word, F being the number of the tree's words. `kept` marks the retained ones, `left` is log10 of the share that these leave to
    other words; `nexts` are the codes number * F + word in order, `log_next` their log10 probability."""

    codes: np.ndarray
    kept: np.ndarray
    left: np.ndarray
    nexts: np.ndarray
    log_next: np.ndarray


@dataclass
class Tree:
    """`ids`: the tree's words -> number; `counts`: their counts; `tokens` and `kinds` of the whole corpus."""

    ids: dict[bytes, int]
    counts: np.ndarray
    tokens: int
    kinds: int
    levels: list[Level]

    def logs(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 P(word | longest retained suffix) of each token of documents of `n` tokens each, but for the log10 (count + 1) of
        words that aren't the tree's, which are -1 in `ids`."""
        root = np.where(ids >= 0, np.log10(self.counts[ids] + 1.0), 0.0) - np.log10(self.tokens + self.kinds + 1.0)
        out, open_, size = np.zeros(len(ids)), np.ones(len(ids), dtype=bool), len(self.counts)
        for level, at in reversed(list(zip(self.levels, contexts([x.codes for x in self.levels], ids, n, size), strict=True))):
            held = open_ & (at >= 0) & level.kept[at] if len(level.codes) else np.zeros(len(ids), dtype=bool)
            spot, own = _find(level.nexts, np.where(held & (ids >= 0), at * size + ids, -1))
            own &= held & (ids >= 0)
            out[own] += level.log_next[spot[own]]
            open_ &= ~own
            rest = held & ~own
            out[rest] += level.left[at[rest]]
        return out + np.where(open_, root, 0.0)


def back(ids: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """The word k places before each token in its document, -1 where there is none."""
    age = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    return np.where(age >= k, np.concatenate([np.full(min(k, len(ids)), -1), ids[: max(0, len(ids) - k)]]), -1)


def contexts(codes: list[np.ndarray], ids: np.ndarray, n: np.ndarray, size: int) -> list[np.ndarray]:
    """For each length, the number of the context before each token among that length's codes, or -1."""
    out, at = [], np.zeros(len(ids), dtype=np.int64)
    for k, own in enumerate(codes, 1):
        word = back(ids, n, k)
        spot, met = _find(own, np.where((at >= 0) & (word >= 0), at * size + word, -1))
        at = np.where(met & (at >= 0) & (word >= 0), spot, -1)
        out.append(at)
    return out


def _find(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_codes, codes), max(0, len(sorted_codes) - 1))
    return at, (sorted_codes[at] == codes) if len(sorted_codes) else np.zeros(len(codes), dtype=bool)


def _send(rows: list[dict], **kinds: pa.DataType) -> pa.RecordBatch:
    """Rows of arrays and lists as one Arrow batch; arrays are packed to bytes, and what a row lacks is null."""
    packed = [{k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in r.items()} for r in rows]
    return pa.RecordBatch.from_pylist(packed, pa.schema(list(kinds.items())))


def count_words(train: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (tokens, kinds, words, counts): per bucket of word hashes, its training tokens and distinct words, and the
    words that can be in the tree with their counts. Each task sends one entry a distinct word of a batch."""
    bits = spread(train, 16).bit_length() - 1

    def local(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, key, text, END):
            h, n = b.hashes(), np.bincount(b.codes, minlength=len(b.words))
            heavy = np.array([len(w) for w in b.words])
            rows = [{"bucket": bucket, "h": h[at], "n": n[at].astype(np.int64), "size": heavy[at].astype(np.int32),
                     "w": b"".join(b.words[i] for i in at)} for bucket, at in by_bucket(h, bits)]
            yield _send(rows, bucket=pa.int64(), h=pa.binary(), n=pa.binary(), size=pa.binary(), w=pa.binary())

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, np.uint64) for x in group["h"]])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in group["n"]])
        size = np.concatenate([np.frombuffer(x, np.int32) for x in group["size"]]).astype(np.int64)
        text, ends = b"".join(group["w"]), np.cumsum(size)
        kinds, first, back = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(back, n, len(kinds)).astype(np.int64)
        # what can be in the tree at all, as a bucket has no more tokens than the corpus; the end token always is
        often = np.flatnonzero((total >= support(int(total.sum()), WORD)) | (kinds == xxhash.xxh3_64_intdigest(END)))
        words = [text[ends[i] - size[i]: ends[i]] for i in first[often]]
        return pd.DataFrame([{"tokens": int(total.sum()), "kinds": len(kinds), "words": words, "counts": total[often].tolist()}])

    counted = train.mapInArrow(local, "bucket long, h binary, n binary, size binary, w binary")
    return counted.groupBy("bucket").applyInPandas(merge, "tokens long, kinds long, words array<binary>, counts array<long>")


def tree_words(train: DataFrame, key: str, text: str) -> tuple[dict[bytes, int], np.ndarray, int, int]:
    """(ids, counts, tokens, kinds): the words of the tree, the commonest first, with their counts, and the corpus's tokens and distinct
    words. The driver gets the tree's words only."""
    counted = materialize(count_words(stable(train.select(F.lit("").alias("key"), F.col(text).alias("body"))), "key", "body"))
    tokens, kinds = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    frequent = counted.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts")
    frequent = frequent.where((F.col("counts") >= support(tokens, WORD)) | (F.col("words") == F.lit(END)))
    found = sorted(((int(r.counts), bytes(r.words)) for r in frequent.collect()), key=lambda x: (-x[0], x[1]))
    return {w: i for i, (_, w) in enumerate(found)}, np.array([n for n, _ in found], dtype=np.int64), int(tokens), int(kinds)


def number_type(size: int) -> np.dtype:
    """The narrower type that holds the numbers of `size` words and -1."""
    return np.dtype(np.int16 if size <= 1 << 15 else np.int32)


PACKED = dict(batch=pa.int64(), keys=pa.list_(pa.string())) | dict.fromkeys(["n", "ids", "doc", "times", "h"], pa.binary())


def encode(docs: DataFrame, ids: dict[bytes, int], train: str, key: str, text: str) -> DataFrame:
    """The written table (batch, keys, n, ids, doc, times, h) of packed batches: the documents' keys, each one's number of tokens, all
    their tokens as the tree's word numbers (-1: none), and of the other words document, times and hash. All later steps read this
    table and no text. A key is the row's mark as training document, whether it has an id, and its id as text, which no type harms."""
    name = F.concat(F.when(F.col(train), "1").otherwise("0"), F.when(F.col(key).isNull(), "-").otherwise("+"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def local(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches(frames, "key", "body", END):
            numbers = word_numbers(b, known)
            rare, width = numbers < 0, max(1, len(b.words))
            code, times = np.unique(b.docs()[rare] * width + b.codes[rare], return_counts=True)
            yield _send([{"batch": b.number, "keys": b.keys, "n": np.diff(b.starts).astype(np.int64), "ids": numbers.astype(number_type(len(known))), "doc": (code // width).astype(np.uint16),
                          "times": times.astype(np.int32), "h": b.hashes()[code % width] if len(b.words) else np.zeros(0, np.uint64)}], **PACKED)

    rows = docs.select(name.alias("key"), F.col(text).alias("body"))
    return materialize(rows.mapInArrow(local, "batch long, keys array<string>, n binary, ids binary, doc binary, times binary, h binary"), wide=True)


def word_numbers(b: Batch, known: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a batch in the tree, -1 for others."""
    return np.array([known.get(w, -1) for w in b.words], dtype=np.int64)[b.codes] if len(b.words) else np.zeros(0, np.int64)


def _training(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, n) of the training documents of packed batches, one batch at a time; `size` words have numbers."""
    for row in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
        n, ids = np.frombuffer(row["n"], np.int64), np.frombuffer(row["ids"], number_type(size)).astype(np.int64)
        own = np.array([k[0] == "1" for k in row["keys"]], dtype=bool)
        yield ids[np.repeat(own, n)], n[own]


def count_level(encoded: DataFrame, codes: list[np.ndarray], size: int, tokens: int) -> np.ndarray:
    """Rows (code, count) of what is met often enough after the contexts of the last of `codes`: number * size + next word, and, as
    ~code, number * size + the word before the context, which makes a context of the next length."""
    shared, bits = encoded.sparkSession.sparkContext.broadcast(codes), spread(encoded, 16).bit_length() - 1

    def local(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for frame in frames:
            for ids, n in _training(frame, size):
                at = contexts(codes, ids, n, size)[-1]
                before = back(ids, n, len(codes) + 1)
                code, times = np.unique(np.concatenate([(at * size + ids)[(at >= 0) & (ids >= 0)], ~(at * size + before)[(at >= 0) & (before >= 0)]]), return_counts=True)
                mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                yield _send([{"bucket": k, "code": code[i], "n": times[i].astype(np.int32)} for k, i in by_bucket(mixed, bits)], bucket=pa.int64(), code=pa.binary(), n=pa.binary())

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        code, back = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in group["code"]]), return_inverse=True)
        n = np.bincount(back, np.concatenate([np.frombuffer(x, np.int32) for x in group["n"]]), len(code)).astype(np.int64)
        often = n >= np.where(code < 0, support(tokens, CONTEXT), support(tokens, NEXT))
        return pd.DataFrame({"code": code[often], "n": n[often]})

    met = encoded.select("keys", "n", "ids").mapInArrow(local, "bucket long, code binary, n binary").groupBy("bucket").applyInPandas(merge, "code long, n long")
    return np.array(sorted((int(r.code), int(r.n)) for r in met.collect()), dtype=np.int64).reshape(-1, 2)


def grow_tree(encoded: DataFrame, ids: dict[bytes, int], counts: np.ndarray, tokens: int, kinds: int) -> Tree:
    """The tree of the training documents of `encoded`, a pass over it for each length of contexts, until no context is met often
    enough. The driver gets words, contexts and next words of the tree only."""
    size = len(ids)
    first = np.flatnonzero(counts >= support(tokens, CONTEXT))
    codes, totals, followed = [first[first != ids.get(END, -1)]], [], []
    totals.append(counts[codes[0]])
    while len(codes[-1]):
        got = count_level(encoded, codes, size, tokens)
        followed.append(got[got[:, 0] >= 0])
        longer = got[got[:, 0] < 0]
        if len(codes) == DEPTH or not len(longer):
            break
        order = np.argsort(~longer[:, 0])
        codes.append(~longer[order, 0])
        totals.append(longer[order, 1])
    return prune(ids, counts, tokens, kinds, codes[: len(followed)], totals, followed)


def prune(ids: dict, counts: np.ndarray, tokens: int, kinds: int, codes: list, totals: list, followed: list) -> Tree:
    """Keep the contexts that pass the divergence test, shorter ones first."""
    size, root = len(ids), (counts + 1.0) / (tokens + kinds + 1.0)
    levels: list[Level] = []
    own: list[list[dict[int, float] | None]] = []
    left: list[dict[int, float]] = []

    def parent(k: int, i: int) -> tuple[int, int] | None:
        """The longest kept context that is shorter than context i of length k + 1."""
        while k:
            k, i = k - 1, int(codes[k][i] // size)
            if own[k][i] is not None:
                return k, i
        return None

    def chance(word: int, at: tuple[int, int] | None) -> float:
        share = 1.0
        while at is not None:
            k, i = at
            if word in own[k][i]:
                return share * own[k][i][word]
            share, at = share * left[k][i], parent(k, i)
        return share * float(root[word])

    for k, (contexts_, total, got) in enumerate(zip(codes, totals, followed, strict=False)):
        nexts: list[dict[int, int]] = [{} for _ in contexts_]
        for code, n in got.tolist():
            nexts[code // size][code % size] = n
        own.append([None] * len(contexts_))
        left.append({})
        for i, met in enumerate(nexts):
            if not met:
                continue
            n, at = int(total[i]), parent(k, i)
            below = {w: chance(w, at) for w in met}
            rest, others = sum(below.values()), n - sum(met.values())
            gain = sum(c * np.log(c / n / below[w]) for w, c in met.items())
            if others > 0 and rest < 1:
                gain += others * np.log(max(others / n, 1e-12) / (1 - rest))
            if gain >= DIVERGENCE and rest < 1:
                own[k][i] = {w: c / n * (1 - DISCOUNT) for w, c in met.items()}
                left[k][i] = (1 - sum(own[k][i].values())) / (1 - rest)
        kept = np.array([x is not None for x in own[k]], dtype=bool)
        pairs = [(i * size + w, p) for i, ps in enumerate(own[k]) if ps for w, p in sorted(ps.items())]
        levels.append(Level(contexts_, kept, np.log10([left[k].get(i, 1.0) for i in range(len(contexts_))]), np.array([c for c, _ in pairs], dtype=np.int64), np.log10([p for _, p in pairs])))
    return Tree(ids, counts, tokens, kinds, levels)


def fit(train: DataFrame, key: str = "doc_id", text: str = "text") -> Tree:
    """The tree of all training documents; null texts count as empty ones."""
    ids, counts, tokens, kinds = tree_words(train, key, text)
    return grow_tree(encode(train.withColumn("~train", F.lit(True)), ids, "~train", key, text), ids, counts, tokens, kinds)


def score(docs: DataFrame, tree: Tree, train_col: str = "train", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, n_known, base_score, score), one for each row of `docs`; `train_col` marks the rows that the
    tree has counted.

    The tree's words are scored where they are read; the other words of each document go, packed by word hash, to the
    task that counts them, and their sums come back packed by batch.

    Null texts count as empty (the end token alone); very long texts are one document; repeated rows count and score each; null ids
    are kept; an empty table gives an empty result; other columns aren't read.
    """
    return score_encoded(encode(docs, tree.ids, train_col, key, text), tree).select(
        F.col("id").cast(docs.schema[key].dataType).alias(key), "n_tokens", "n_known", "base_score", "score")


def score_encoded(encoded: DataFrame, tree: Tree) -> DataFrame:
    """(id as text, n_tokens, n_known, base_score, score) of the documents of `encoded`."""
    shared = encoded.sparkSession.sparkContext.broadcast(tree)
    bits = spread(encoded, 16).bit_length() - 1
    fields = dict(bucket=pa.int64(), batch=pa.int64(), keys=pa.list_(pa.string())) | dict.fromkeys(["h", "doc", "n", "a", "b", "c"], pa.binary())
    schema = "bucket long, batch long, keys array<string>, h binary, doc binary, n binary, a binary, b binary, c binary"

    def local(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for frame in frames:
            for row in (r for at in range(frame.num_rows) for r in frame.slice(at, 1).to_pylist()):
                n, ids = np.frombuffer(row["n"], np.int64), np.frombuffer(row["ids"], number_type(len(tree.ids))).astype(np.int64)
                train, n_docs = np.array([k[0] == "1" for k in row["keys"]], dtype=bool), len(n)
                doc, hot = np.repeat(np.arange(n_docs), n), ids >= 0
                out = [{"bucket": -1 - row["batch"], "batch": row["batch"], "keys": row["keys"], "h": n, "a": np.bincount(doc, tree.logs(ids, n), n_docs),
                        "b": np.bincount(doc[hot], np.log10(tree.counts[ids[hot]] + 1.0), n_docs), "c": np.bincount(doc[hot], minlength=n_docs).astype(np.int64)}]
                where, times, h = (np.frombuffer(row[c], t) for c, t in (("doc", np.uint16), ("times", np.int32), ("h", np.uint64)))
                out += [{"bucket": bucket, "batch": row["batch"], "h": h[at], "doc": where[at], "n": times[at], "a": train[where[at]]} for bucket, at in by_bucket(h, bits)]
                yield _send(out, **fields)

    def count(group: pd.DataFrame) -> pd.DataFrame:
        if group["bucket"].iloc[0] < 0:
            return group[["batch", "keys", "h", "doc", "a", "b", "c"]]
        h, n, train = (np.concatenate([np.frombuffer(x, t) for x in group[c]]) for c, t in (("h", np.uint64), ("n", np.int32), ("a", bool)))
        kinds, back = np.unique(h, return_inverse=True)
        counts = np.bincount(back, n * train, len(kinds))[back]
        value, known = n * np.log10(counts + 1.0), n * (counts > 0)
        out, at = [], 0
        for batch, packed in zip(group["batch"], group["doc"], strict=True):
            doc = np.frombuffer(packed, np.uint16)
            own = slice(at, at + len(doc))
            at += len(doc)
            docs, back = np.unique(doc, return_inverse=True)
            out.append({"batch": batch, "keys": None, "h": None, "doc": docs.tobytes(), "a": None,
                        "b": np.bincount(back, value[own], len(docs)).tobytes(),
                        "c": np.bincount(back, known[own], len(docs)).astype(np.int64).tobytes()})
        return pd.DataFrame(out)

    total = float(np.log10(tree.tokens + tree.kinds + 1.0))

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group["h"].notna()].iloc[0]
        n = np.frombuffer(head["h"], np.int64)
        log, base, known = (np.frombuffer(head[c], t).copy() for c, t in (("a", float), ("b", float), ("c", np.int64)))
        order = group[group["h"].isna()].sort_values("doc")
        for doc, value, seen in zip(order["doc"], order["b"], order["c"], strict=True):
            doc, value = np.frombuffer(doc, np.uint16), np.frombuffer(value, float)
            base[doc] += value
            log[doc] += value
            known[doc] += np.frombuffer(seen, np.int64)
        return pd.DataFrame({"key": pd.Series(list(head["keys"]), dtype=object), "n_tokens": n, "n_known": known,
                             "base_score": base - n * total, "score": log})

    sums = encoded.mapInArrow(local, schema).groupBy("bucket").applyInPandas(
        count, "batch long, keys array<string>, h binary, doc binary, a binary, b binary, c binary")
    found = sums.groupBy("batch").applyInPandas(finish, "key string, n_tokens long, n_known long, base_score double, score double")
    return found.select(F.when(F.substring("key", 2, 1) == "+", F.expr("substring(key, 3)")).alias("id"), "n_tokens", "n_known", "base_score", "score")


def predict(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): learned from all documents whose crc32 of
    the id modulo 7 isn't 2."""
    marked = docs.select(F.col(key).alias(key), F.col(text).alias(text), (remainder(key, 7) != 2).alias("train"))
    ids, counts, tokens, kinds = tree_words(marked.where("train"), key, text)
    encoded = encode(marked, ids, "train", key, text)
    found = score_encoded(encoded, grow_tree(encoded, ids, counts, tokens, kinds)).withColumn(key, F.col("id").cast(docs.schema[key].dataType))
    return found.select(key, (remainder(key, 7) == 2).alias("held_out"), "n_tokens", "n_known",
                        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))
