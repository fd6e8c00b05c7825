"""Language-model scores against brute force with exact ratios."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import interpolation as lm

WORDS = [f"w{i}" for i in range(40)]


def prose(seed: int, n: int) -> str:
    r, out = np.random.default_rng(seed), []
    at = 0
    for _ in range(n):
        at = (at * 3 + int(r.integers(0, 4))) % 40 if r.random() < 0.8 else int(r.integers(40))
        out.append(WORDS[at] if r.random() < 0.9 else WORDS[at].upper())
    return " ".join(out)


ROWS = [(i, prose(i, 5 + i % 37)) for i in range(150)] + [(200, None), (201, ""), (202, " \n\t"), (None, prose(1, 9) + " unknown"), (203, "É é ÄÖ W1\x1cw2 w1"), (204, "x" * 9000), (205, prose(7, 4000)), (5, prose(5, 10)), (5, prose(5, 10))]


def tokens(t: str | None) -> list[str]:
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")), "</s>"]


def brute(rows, order):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base, score) by dictionaries, with weights from exact ratios."""
    fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 7

    def grams(t):  # (context, word) of each length, for each token
        x = ["<s>"] * (order - 1) + tokens(t)
        for j in range(order - 1, len(x)):
            yield [(tuple(x[j - m : j]), x[j]) for m in range(order)]

    def counted(keep):
        n, contexts = Counter(), Counter()
        for i, t in rows:
            if keep(fold(i)):
                for g in grams(t):
                    n.update(g)
                    contexts.update(c for c, _ in g)
        return n, contexts

    def learn(ratios):
        a = 0.5
        for _ in range(1000):
            a = min((sum(a * r / (a * r + 1 - a) for r in ratios) + 1) / (len(ratios) + 2), 1 - 1e-6) if ratios else 0.0
        return a

    n, contexts = counted(lambda f: f not in (-1, 2))
    left, left_contexts = counted(lambda f: f not in (-1, 2, 3))
    words, total, rest = sum(1 for c, _ in n if not c), contexts[()], left_contexts[()]
    weights: dict = {}

    def probability(g, m, n, contexts, total):
        if m == 0:
            return weights[0] * n[g[0]] / max(1, total) + (1 - weights[0]) / (words + 1)
        c = contexts[g[m][0]]
        a = weights[m].get(c.bit_length() - 1, 0.0) if c else 0.0
        return a * n[g[m]] / max(1, c) + (1 - a) * probability(g, m - 1, n, contexts, total)

    gone = [g for i, t in rows if fold(i) == 3 for g in grams(t)]
    weights[0] = learn([left[g[0]] / max(1, rest) * (words + 1) for g in gone])
    for m in range(1, order):
        by: dict = {}
        for g in gone:
            c = left_contexts[g[m][0]]
            if c:
                by.setdefault(c.bit_length() - 1, []).append(left[g[m]] / c / probability(g, m - 1, left, left_contexts, rest))
        found, known = {}, 0.0
        for b in range(48):
            known = found[b] = learn(by[b]) if b in by else known
        weights[m] = found
    for i, t in rows:
        x = tokens(t)
        base = sum(math.log10((n[(), w] + 1) / (total + words + 1)) for w in x)
        yield i, fold(i) == 2, len(x), sum(n[(), w] > 0 for w in x), total, base, sum(math.log10(probability(g, order - 1, n, contexts, total)) for g in grams(t))


def result(df):
    cols = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))


@pytest.mark.parametrize(("order", "piece", "ranges"), [(2, lm.PIECE, None), (2, 700, 5), (3, 2000, 3)])
def test_scores(spark, order, piece, ranges):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id bigint, text string, fold int, train string").repartition(3)
    docs = lm.written(docs, "docs")
    got = result(lm.scores(docs, order=order, piece=piece, ranges=ranges))
    want = sorted(brute(ROWS, order), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=5e-3)  # ratios are told apart by a 32nd of an octave
    held = [g for g in got if g[1]]
    assert held and sum(g[6] for g in held) > sum(g[5] for g in held)


def test_pieces_dont_matter(spark):
    docs = lm.written(spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(4), "docs")
    a, b = (result(lm.scores(docs, piece=p, ranges=r)) for p, r in ((300, 9), (lm.PIECE, 2)))
    assert [x[:5] for x in a] == [x[:5] for x in b] and np.allclose([x[5:] for x in a], [x[5:] for x in b], rtol=1e-9)


def test_without_training_documents(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string").coalesce(1)
    assert [r[1:] for r in result(lm.scores(docs))] == [(False, 1, 0, 0, 0.0, 0.0), (False, 3, 0, 0, 0.0, 0.0)]
    assert lm.scores(docs.where("false")).count() == 0


def test_probabilities_sum_to_one():
    """Over all known words and one unknown, after any context."""
    counts = Counter({"a": 5, "b": 2, "c": 1})
    pairs = Counter({("a", "b"): 2, ("a", "a"): 2, ("a", "c"): 1})
    model = lm.Mixture(8, 3, [np.array([0.7]), np.linspace(0.1, 0.9, lm.BUCKETS + 1)])
    model.weights[1][-1] = 0.0
    for context in "ab":
        total = 0.0
        for w in [*"abc", "?"]:
            c = [np.array([counts[context], counts[w]]), np.array([0, pairs[context, w] if context == "a" else 0])]
            total += model.probabilities(c, np.array([0]))[1][1]
        lost = 0 if context == "a" else model.weights[1][lm.bucket(np.array([2]))[0]]  # b has no followers here, so its estimates sum to 0
        assert abs(total + lost - 1) < 1e-12


def test_learning_recovers_a_mixture():
    r = np.random.default_rng(1)
    a, f, g = 0.3, np.array([0.8, 0.1, 0.1]), np.array([0.2, 0.3, 0.5])
    n = r.multinomial(200_000, a * f + (1 - a) * g)
    assert abs(lm.learn(f / g, n) - a) < 0.02
