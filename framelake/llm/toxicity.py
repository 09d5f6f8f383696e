"""Toxicity by a linear-chain conditional random field over tokens with the states clean and toxic.

Documents carry labels, tokens don't; so the words, stems and character n-grams that toxic documents have and clean ones
lack label the tokens of a bounded sample, and the field learns from these. Forward-backward marginals tag the toxic spans of every text; the
expected number of toxic tokens becomes the document's score.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import map_texts, remainder, table

WORD = re.compile(r"\w+")
#: The bounded sample: labelled documents of each class, the first by hash among those of up to so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 2_000, 16_384
#: Tokens on each side of a labelled one that the field sees in training, passes over the sample, and tokens of a piece.
CONTEXT, PASSES, RUN = 8, 100, 64
THRESHOLD = 0.7
#: Cells of the table of counts.
SUPPORTS = 1 << 25
#: Lengths of the features inside words; how much likelier in toxic documents a feature must be, and the nats of evidence
#: beyond the logarithm of the number of features tried.
GRAMS, LIKELIER, MARGIN = range(4, 9), 5.0, 0.0


def grams(word: str) -> set[str]:
    """What a word may be known by: itself and its runs of 4 to 8 characters, `<` and `>` standing at its ends; runs that
    start with `<` are its stems."""
    w = f"<{word}>"
    return {w} | {w[i: i + n] for n in GRAMS for i in range(len(w) - n + 1)}


def evidence(a: int, b: int, share: float) -> float:
    """Log likelihood ratio (nats) of `a` toxic and `b` clean documents against the share of toxic ones among all."""
    n = a + b
    return (a * math.log(a / n / share) if a else 0.0) + (b * math.log(b / n / (1 - share)) if b else 0.0)


def label_features(toxic: list[set[str]], clean: list[set[str]]) -> list[str]:
    """Features (see `grams`) that mark toxic tokens, the strongest first. Each is judged by its own documents only: those
    where it marks a word that no stronger feature marks must be likelier toxic than chance among all features would
    make them, however few of the toxic documents they are; so words of smaller languages stand beside those of larger."""
    docs: dict[str, tuple[list[int], list[int]]] = {}
    for side, group in enumerate((toxic, clean)):
        for i, d in enumerate(group):
            for w in d:
                docs.setdefault(w, ([], []))[side].append(i)
    # a feature of few toxic documents can't come to the evidence that is asked for, whatever the clean ones; most of these are told by
    # a table of counts by hash, without being kept
    least = max(3, len(toxic) // 250)
    counts = np.zeros(SUPPORTS, dtype=np.uint8)
    for w, (pos, _) in docs.items():
        if pos:
            at = np.fromiter((hash(g) % SUPPORTS for g in grams(w)), dtype=np.int64)
            counts[at] = np.minimum(200, counts[at]) + min(len(pos), 50)
    support: dict[str, int] = {}
    for w, (pos, _) in docs.items():
        if pos:
            for g in grams(w):
                if counts[hash(g) % SUPPORTS] >= min(least, 50):
                    support[g] = support.get(g, 0) + len(pos)
    held: dict[str, list[str]] = {g: [] for g, n in support.items() if n >= least}
    del support, counts
    for w in docs:
        for g in grams(w):
            if g in held:
                held[g].append(w)
    share, marked = len(toxic) / max(1, len(toxic) + len(clean)), set()

    def judge(g: str) -> float:
        words = [docs[w] for w in held[g] if w not in marked]
        a, b = (len(set().union(*(w[side] for w in words))) for side in (0, 1))
        return evidence(a, b, share) if a >= 3 and a * len(clean) >= LIKELIER * b * len(toxic) else 0.0

    queue = [(-judge(g), -len(g), g) for g in held]
    bar = math.log(max(1, sum(e < 0 for e, *_ in queue))) + MARGIN
    queue = [x for x in queue if -x[0] >= bar]
    heapq.heapify(queue)
    chosen = []
    while queue:
        _, size, g = heapq.heappop(queue)
        now = judge(g)
        if now < bar:
            continue
        if queue and (-now, size, g) > queue[0]:
            heapq.heappush(queue, (-now, size, g))
            continue
        chosen.append(g)
        marked.update(held[g])
    return chosen


def power(step: np.ndarray, times: int) -> np.ndarray:
    """The matrix power but for a factor, by squaring, kept in range however many times."""
    out, step = np.eye(2), step / step.max()
    while times:
        if times & 1:
            out = out @ step
            out = out / out.max()
        step = step @ step
        step, times = step / step.max(), times >> 1
    return out


@dataclass
class Field:
    """Weights of the chain: `word` adds to the toxic state's potential, by the first of its features that a word has (see
    `grams`), `bias` is that of all other words, `move[a, b]` the potential of going from state a to b; `scale` turns
    expected toxic tokens into a score."""

    word: dict[str, float]
    bias: float
    move: np.ndarray
    scale: tuple[float, float]

    def __post_init__(self) -> None:
        self.rank, self.finder = {g: i for i, g in enumerate(self.word)}, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"finder": None}

    def feature(self, word: str) -> str | None:
        """The first feature that the lower-cased word has."""
        return min((g for g in grams(word) if g in self.rank), key=self.rank.__getitem__, default=None)

    def marks(self, words: list[str]) -> dict[int, float]:
        """Places of the words that have a feature, with their weights. All features are runs of the words between `<` and `>`,
        and are looked for at once."""
        if not self.word:
            return {}
        if self.finder is None:
            self.finder, self.weights = ahocorasick.Automaton(), list(self.word.values())
            for g, i in self.rank.items():
                self.finder.add_word(g, i)
            self.finder.make_automaton()
        line = f"<{'><'.join(words)}>".lower()
        hits = list(self.finder.iter(line))
        if not hits:
            return {}
        ends = np.cumsum([len(w) + 2 for w in line[1:-1].split("><")]) - 1
        best: dict[int, int] = {}
        for at, i in zip(np.searchsorted(ends, [end for end, _ in hits]).tolist(), (i for _, i in hits), strict=True):
            best[at] = min(i, best.get(at, i))
        return {at: self.weights[i] for at, i in sorted(best.items())}

    def marginals(self, weights: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        """P(toxic) at each of the tokens that have a word weight. gaps[i]: other tokens before the i-th, and at the
        end those after the last; these all have the same potentials, so a run of them is a matrix power."""
        enter, other = np.exp(self.move), np.exp([0.0, self.bias])
        runs = {int(g): power(enter * other, int(g)) for g in {*gaps[1:].tolist(), max(0, gaps[0] - 1)}}
        emit = np.exp(np.stack([np.zeros(len(weights)), weights + self.bias], axis=1))
        before, after = [], []
        # no move leads to the very first token
        state = other @ runs[int(gaps[0] - 1)] if gaps[0] else None
        for i, e in enumerate(emit):
            if i:
                state = state @ runs[int(gaps[i])]
            state = e if state is None else (state @ enter) * e
            state = state / state.sum()
            before.append(state)
        back = runs[int(gaps[-1])] @ np.ones(2)
        for i in range(len(emit) - 1, -1, -1):
            after.append(back / back.sum())
            back = enter @ (emit[i] * after[-1])
            if i:
                back = runs[int(gaps[i])] @ back
        joint = np.array(before) * np.array(after[::-1])
        return joint[:, 1] / joint.sum(axis=1)

    def tag(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Expected toxic tokens, and the spans (start, end, probability) of those that are likelier toxic than not."""
        known = self.marks(WORD.findall(text))
        if not known:
            return 0.0, []
        spans = [m.span() for m in WORD.finditer(text)]
        at = np.array([-1, *known, len(spans)])
        p = self.marginals(np.array(list(known.values())), np.diff(at) - 1)
        found = [(*spans[i], float(x)) for i, x in zip(known, p, strict=True) if x >= 0.5]
        return float(p.sum()), found

    def score(self, expected: float) -> float:
        a, b = self.scale
        return float(1 / (1 + np.exp(-np.clip(a * np.log1p(expected) + b, -30, 30))))


def train_chain(sequences: list[tuple[int, ...]], tags: list[list[int]], n_words: int, times: list[int]) -> tuple[np.ndarray, float, np.ndarray]:
    """Word weights, bias and moves that maximise the likelihood of `tags`, by gradient steps with a little shrinkage.
    sequences: word numbers from 1, 0 for all other words; `times`: how often each occurs."""
    longest = max(map(len, sequences))
    words, tag, on = (np.zeros((len(sequences), longest), dtype=np.int64) for _ in range(3))
    for i, (s, t) in enumerate(zip(sequences, tags, strict=True)):
        words[i, : len(s)], tag[i, : len(t)], on[i, : len(s)] = s, t, 1
    on = on * np.array(times)[:, None]
    weight, bias, move = np.zeros(n_words + 1), 0.0, np.zeros((2, 2))
    seen_move = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen_move[a, b] = (((tag[:, :-1] == a) & (tag[:, 1:] == b)) * on[:, 1:]).sum()
    seen_word = np.bincount(words.ravel(), ((tag > 0) * on).ravel().astype(float), n_words + 1)
    size, memory = on.sum(), [np.full(n_words + 1, 1e-8), 1e-8, np.full((2, 2), 1e-8)]
    for _ in range(PASSES):
        emit = np.stack([np.ones(words.shape), np.exp(weight[words] + bias)], axis=2)
        step = np.exp(move)
        fwd, back = np.zeros((longest, len(words), 2)), np.ones((longest, len(words), 2))
        fwd[0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            x = (fwd[t - 1] @ step) * emit[:, t]
            fwd[t] = np.where(on[:, t, None] > 0, x / x.sum(axis=1, keepdims=True), fwd[t - 1])
        for t in range(longest - 2, -1, -1):
            x = (emit[:, t + 1] * back[t + 1]) @ step.T
            back[t] = np.where(on[:, t + 1, None] > 0, x / x.sum(axis=1, keepdims=True), back[t + 1])
        p = fwd * back
        p = (p[:, :, 1] / p.sum(axis=2)).T * on
        pair = fwd[:-1, :, :, None] * step * (emit[:, 1:] * back[1:].transpose(1, 0, 2)).transpose(1, 0, 2)[:, :, None, :]
        pair = (pair / pair.sum(axis=(2, 3), keepdims=True) * on[:, 1:].T[:, :, None, None]).sum(axis=(0, 1))
        want = np.bincount(words.ravel(), p.ravel(), n_words + 1)
        for i, (g, now) in enumerate([((seen_word - want) / size - 1e-5 * weight, weight),
                                      ((seen_word.sum() - want.sum()) / size, bias), ((seen_move - pair) / size - 1e-5 * move, move)]):
            memory[i] = memory[i] + g * g
            now = now + 0.5 * g / np.sqrt(memory[i])
            weight, bias, move = (now, bias, move) if i == 0 else (weight, now, move) if i == 1 else (weight, bias, now)
        bias, weight = bias + weight[0], weight - np.eye(1, n_words + 1)[0] * weight[0]
    return weight, float(bias), move


def windows(at: list[int], size: int) -> list[tuple[int, int]]:
    """(start, end) of CONTEXT tokens on each side of each place of `at`, which is in order; those that meet are one,
    but for cuts into pieces of RUN tokens, so that no piece is long."""
    found: list[tuple[int, int]] = []
    for i in at:
        lo, hi = max(0, i - CONTEXT), min(size, i + CONTEXT + 1)
        if found and lo <= found[-1][1]:
            found[-1] = (found[-1][0], hi)
        elif hi > lo:
            found.append((lo, hi))
    return [(a, min(a + RUN, hi)) for lo, hi in found for a in range(lo, hi, RUN)]


def learn(toxic: list[str], clean: list[str]) -> Field:
    """The field of labelled texts; without texts of both classes it scores every text 0.5 or by its only class."""
    split = [[[sys.intern(w.lower()) for w in WORD.findall(t)] for t in texts] for texts in (toxic, clean)]
    marks = label_features(*[[set(d) for d in docs] for docs in split])
    if not marks:
        share = (len(toxic) + 0.5) / (len(toxic) + len(clean) + 1)
        return Field({}, -5.0, np.zeros((2, 2)), (0.0, float(np.log(share / (1 - share)))))
    first, order = Field(dict.fromkeys(marks, 0.0), 0.0, np.zeros((2, 2)), (0.0, 0.0)), {g: i + 1 for i, g in enumerate(marks)}
    number = {w: order[g] for w in {w for docs in split for d in docs for w in d} if (g := first.feature(w)) is not None}
    times: Counter = Counter()
    for is_toxic, docs in ((1, split[0]), (0, split[1])):
        for d in docs:
            for lo, hi in windows([i for i, w in enumerate(d) if w in number] or [len(d) // 2], len(d)):
                times[tuple(number.get(w, 0) for w in d[lo:hi]), is_toxic] += 1
    sequences = [s for s, _ in times]
    tags = [[int(is_toxic and x > 0) for x in s] for s, is_toxic in times]
    weight, bias, move = train_chain(sequences, tags, len(marks), list(times.values()))
    # without a weight above 0 a feature doesn't tell toxic tokens, and its words are like all others
    field = Field({g: float(weight[i]) for g, i in order.items() if weight[i] > 0}, bias, move, (1.0, 0.0))
    x = np.log1p([field.tag(t)[0] for t in toxic + clean])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    balance = np.where(y > 0, 0.5 / max(1, len(toxic)), 0.5 / max(1, len(clean)))
    a, b = 1.0, -1.0
    for _ in range(3000):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = balance * (y - p)
        a, b = a + 2.0 * (g @ x - 2e-4 * a), b + 2.0 * g.sum()
    field.scale = (float(a), float(b))
    return field


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        per_class: int = SAMPLE_DOCS) -> Field:
    """The field learned from a bounded sample of labelled documents: at most `per_class` of each class, the first by
    hash, of at most SAMPLE_CHARS characters. A document with several labels is toxic if one says so; rows of one id and text count
    once, so neither an id of very many rows nor a repeated row brings more than the bound to the driver."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("y"))
    bodies = docs.where(F.length(text).between(1, SAMPLE_CHARS)).select(F.col(key).alias("id"), F.xxhash64(text).alias("h"))
    ranked = marked.join(bodies, "id").select("y", "id", "h").distinct().withColumn("r", F.xxhash64("id", "h"))
    texts: dict[int, list[str]] = {0: [], 1: []}
    for y in (0, 1):
        chosen = ranked.where(F.col("y") == y).orderBy("r", "id").limit(per_class).select("id", "h")
        found = docs.where(F.length(text).between(1, SAMPLE_CHARS)).select(F.col(key).alias("id"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
        texts[y] = sorted(r.t for r in found.join(F.broadcast(chosen), ["id", "h"], "left_semi").dropDuplicates(["id", "h"]).toLocalIterator())
    return learn(texts[1], texts[0])


def score_documents(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score, spans): one for each row of `docs`; `spans` lists the offending offsets as (start, end,
    probability) in characters of the text.

    Null and empty texts have no spans and the score of a text without toxic tokens; any length is read whole; repeated
    rows get repeated results; an empty table gives an empty result; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def start():
        field = shared.value

        def tag(texts: list[str]) -> list[pa.Array]:
            found = [field.tag(t) for t in texts]
            spans = [[{"start": a, "end": b, "p": p} for a, b, p in s] for _, s in found]
            return [pa.array([field.score(expected) for expected, _ in found], pa.float64()), pa.array(spans, kind)]

        return tag

    return map_texts(rows, "body", "score double, spans array<struct<start:int,end:int,p:double>>", start).withColumnRenamed("key", key)


def drop_toxic(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """`docs` without the rows that the field scores THRESHOLD or more; all columns stay as they are. Null and empty texts have
    no toxic token and stay, long ones are read whole, repeated rows fare alike, an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("double")
    def toxicity(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = shared.value
        for batch in bodies:
            yield pd.Series([field.score(field.tag(t)[0]) for t in batch], dtype=float)

    return docs.where(toxicity(F.coalesce(F.col(text), F.lit(""))) < THRESHOLD)


def predict(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_spans): learned from labels of ids whose crc32 modulo 3 isn't 1."""
    field = fit(docs, labels.where(remainder(key, 3) != 1), key, text)
    found = score_documents(docs, field, key, text)
    return found.select(key, (remainder(key, 3) == 1).alias("held_out"), "score",
                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op4_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
