"""The suffix tree's scores against a plain model, and its probabilities' sums."""

from collections import Counter
from math import log, log10

import numpy as np
import pytest

from framelake.llm import suffix_tree as st

WORDS = [f"w{i}" for i in range(12)]


def corpus():
    rng = np.random.default_rng(4)
    return [" ".join(["the small", rng.choice(WORDS[:4]), "house on the", rng.choice(WORDS), "hill of the small", rng.choice(WORDS[:3]), f"rare{i}"] * 4) for i in range(150)]


class Plain:
    """The same tree from counters of word tuples."""

    def __init__(self, texts):
        docs = [[w.encode() for w in t.lower().split()] + [st.END] for t in texts]
        self.count = Counter(w for d in docs for w in d)
        self.n, self.v = sum(self.count.values()), len(self.count)
        known = {w for w, c in self.count.items() if c >= st.support(self.n, st.WORD) or w == st.END}
        after, total = {}, Counter()
        for d in docs:
            for t in range(len(d)):
                for k in range(1, st.DEPTH + 1):
                    c = tuple(d[max(0, t - k): t])
                    if len(c) == k and all(w in known for w in c):
                        total[c] += 1
                        after.setdefault(c, Counter())[d[t]] += 1
        self.own, self.left, often = {}, {}, lambda c: not c or (total[c] >= st.support(self.n, st.CONTEXT) and often(c[1:]))
        for c in sorted(filter(often, total), key=len):
            met = {w: m for w, m in after[c].items() if m >= st.support(self.n, st.NEXT) and w in known}
            below = {w: self.chance(w, c[1:]) for w in met}
            rest, others = sum(below.values()), total[c] - sum(met.values())
            gain = sum(m * log(m / total[c] / below[w]) for w, m in met.items()) + (others * log(others / total[c] / (1 - rest)) if others else 0)
            if met and gain >= st.DIVERGENCE:
                self.own[c] = {w: m / total[c] * (1 - st.DISCOUNT) for w, m in met.items()}
                self.left[c] = (1 - sum(self.own[c].values())) / (1 - rest)

    def chance(self, word, context):
        while context and context not in self.own:
            context = context[1:]
        if not context:
            return (self.count[word] + 1) / (self.n + self.v + 1)
        return self.own[context][word] if word in self.own[context] else self.left[context] * self.chance(word, context[1:])

    def score(self, text):
        d = [w.encode() for w in text.lower().split()] + [st.END]
        return sum(log10(self.chance(w, tuple(d[max(0, t - st.DEPTH): t]))) for t, w in enumerate(d))


def test_scores_are_those_of_a_plain_tree(spark):
    texts = corpus()
    plain = Plain(texts)
    assert {len(c) for c in plain.own} >= {1, 2, 3}
    probes = [*texts[:5], "", "the small w1 house unseen the small w1", "hill of the small"]
    rows = [(i, t, True) for i, t in enumerate(texts)]
    tree = st.fit(spark.createDataFrame(rows, "doc_id long, text string, train boolean"))
    docs = spark.createDataFrame(rows + [(1000 + i, t, False) for i, t in enumerate(probes)], "doc_id long, text string, train boolean")
    got = {r.doc_id: r.score for r in st.score(docs, tree).collect()}
    for i, t in enumerate(probes):
        assert got[1000 + i] == pytest.approx(plain.score(t), rel=1e-9)


def test_probabilities_add_up_to_one(spark):
    tree = st.fit(spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string"))
    plain = Plain(corpus())
    unseen = tree.kinds - len(tree.ids)
    for context in [(), *plain.own]:
        words = [tree.ids[w] for w in context]
        last = list(range(len(tree.ids)))
        ids = np.array([x for w in last for x in [*words, w]])
        p = 10 ** tree.logs(ids, np.full(len(last), len(words) + 1)).reshape(len(last), -1)[:, -1]
        # a word outside the tree has its log10 (count + 1) added elsewhere; all of them, and words never met, share the rest
        other = 10 ** tree.logs(np.array([*words, -1]), np.array([len(words) + 1]))[-1]
        rest = tree.tokens + tree.kinds + 1 - sum(tree.counts + 1)
        assert unseen >= 0 and p.sum() + other * rest == pytest.approx(1.0, rel=1e-9)
