"""Vector codes and the filter audit against brute force on small tables with nulls, ties, repeated rows and odd lengths."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import audit, ballcodes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """{length: (rows kept, codes, errors, codebooks)} by all distances."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for d in {len(q) for _, q, _ in kept}:
        mine = sorted((k for k in kept if len(k[1]) == d), key=lambda k: (k[0] is None, k[0] or 0, k[1]))
        edge = [d * i // parts for i in range(parts + 1)]
        part = [[q[edge[p] : edge[p + 1]] for p in range(parts)] for _, q, _ in mine]
        books = [[x[p] for x in part[:entries]] for p in range(parts)]
        apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        nearest = lambda: [[min((apart(x[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for x in part]
        for _ in range(rounds):
            codes = nearest()
            for p in range(parts):
                for e in range(len(books[p])):
                    held = [x[p] for x, c in zip(part, codes, strict=True) if c[p][1] == e]
                    if held:
                        books[p][e] = [sum(col) // len(held) for col in zip(*held, strict=True)]
        codes = nearest()
        out[d] = mine, ["".join(f"{c[1]:02x}" for c in x) for x in codes], [sum(c[0] for c in x) for x in codes], books
    return out


def vectors(seed, n, dim):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(9, dim))
    return (centre[r.integers(9, size=n)] + r.normal(scale=0.4, size=(n, dim))).round(2)


def test_codes(spark):
    x = vectors(1, 150, 32)
    rows = [(i * 3 % 151, v.tolist(), i % 4 if i % 5 else None) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [1.0] * 31 + [None], 1), (1002, [float("nan")] * 32, 2), (1003, [float("inf")] + [0.0] * 31, None), (None, x[3].tolist(), 7), rows[5], rows[5], (0, x[9].tolist(), 1)]
    rows += [(2000 + i, v.tolist(), 3) for i, v in enumerate(vectors(2, 70, 20))] + [(3000, [0.5, -0.25], None), (3001, [], 3)]
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id bigint, embedding array<double>, label int, code string, dim int")
    got = ballcodes.report(df).collect()
    want, digests, by_label = [], {}, Counter()
    for d, (mine, codes, errors, books) in brute_codes(rows).items():
        digests[d] = hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()
        want += [(i, c, e, digests[d], label) for (i, _, label), c, e in zip(mine, codes, errors, strict=True)]
    for _, _, e, _, label in want:
        by_label[label] += e
    assert sorted(map(repr, ((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got))) == sorted(repr((i, c, e, by_label[label], s)) for i, c, e, s, label in want)
    assert ballcodes.report(df.where("false")).count() == 0


def test_codes_of_ties_and_few_rows(spark):
    same = [(i, [1.0, 2.0] * 8, 1) for i in range(70)] + [(100, [1.0, 2.5] * 8, None)]
    df = spark.createDataFrame(same, "vec_id bigint, embedding array<float>, label int")
    rows = {r.vec_id: r for r in ballcodes.report(df).collect()}
    # of 64 equal entries the lowest takes all parts and moves with their mean; the next one then is nearest to most, and the first ends at the odd vector
    assert len(rows) == 71 and {rows[i].code for i in range(70)} == {"0001" * 8} and rows[100].code == "00" * 16 and not any(r.error for r in rows.values())
    few = {r.vec_id: r for r in ballcodes.report(df.where("vec_id IN (3, 100)")).collect()}
    assert few[3].code == "00" * 16 and few[100].code == "0001" * 8 and few[3].error == few[100].error == 0


def test_balls_skip_work_and_hold_huge_components(spark):
    x = np.floor(256 * vectors(3, 4000, 4)).astype(np.int64)
    book = ballcodes.Balls(x[:64])
    code, best, first = book.assign(x, book.guess(x))
    apart = ((x[:, None] - x[None, :64]) ** 2).sum(2)
    assert (code == apart.argmin(1)).all() and (best == apart.min(1)).all()
    again, _, later = book.assign(x, code)
    assert (again == code).all() and later <= first < 0.6 * apart.size
    rows = [(1, [1e300] * 16, 1), (2, [-1e300] * 16, 1), (3, [0.0] * 16, 1)]
    got = {r.vec_id: r for r in ballcodes.report(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert len(got) == 3 and all(r.error == 0 for r in got.values())


TEXT_ROWS = [
    (1, "one two Three four " * 60, "en"), (2, "one two Three four " * 60, "de"), (3, None, None), (4, "", "en"), (5, "LOUD WORDS ÄÖ é漢😀" * 30, "fr"), (6, "a#b", "en"),
    (7, " ".join(f"w{i}" for i in range(400)), "en"), (8, " ".join(f"w{i}" for i in range(400)), "en"), (8, " ".join(f"w{i}" for i in range(400)), "en"), (None, " ".join(f"w{i}" for i in range(400)), "en"),
    (9, "x" * 5000 + " " + "x" * 5000 + " y\x0bz\x1cq", ""), (10, "漢字 " * 1500 + "|", "zh"), (11, "\t\n ", "en"), (12, "é" * 511 + "漢" * 300 + "😀" * 300 + " A", "zh"),
    (13, "".join(chr(c) for c in range(1, 700)) * 3, "zh"), (14, (("k" * 70 + "ab ") * 3 + "k" * 70 + "ac ") * 60, "en"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (7, 1, 1), (8, 1, 0), (10, None, 1), (None, 1, 1), (99, 1, 1)]


def brute_bits(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": bool(set("#$%&*|") & set(t)), "E": i is not None and i > least[t]}
        yield i, lang or "", {k for k, v in failed.items() if v}


def test_audit(spark):
    docs = spark.createDataFrame([(i, t, lang, 5, "x", 0) for i, t, lang in TEXT_ROWS], "doc_id bigint, text string, lang string, n int, t1 string, failed int")
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id bigint, quality int, toxic int, lang string")
    good, bad = {i for i, q, _ in LABELS if q == 1}, {i for i, _, t in LABELS if t == 1}
    bits = list(brute_bits(TEXT_ROWS))
    want = {}
    for part in {p for _, p, _ in bits}:
        mine = [(i, f) for i, p, f in bits if p == part]
        removed = {}
        for order in map("".join, permutations("ABCDE")):
            for step, own in enumerate(order, 1):
                gone = set(order[: step - 1])
                now = [i for i, f in mine if own in f and not f & gone]
                removed[order, step] = now
                want[part, order, step] = [
                    sum(not f & set(order[:step]) for _, f in mine), len(now), sum(own in f and bool(f & gone) for _, f in mine), sum(f == {own} for _, f in mine),
                    sum(i is not None and i in good for i in now), sum(i is not None and i in bad for i in now),
                ]
        for (order, step), _ in removed.items():
            want[part, order, step].append(sum(len(v) for (o, s), v in removed.items() if o[s - 1] == order[step - 1]))
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in audit.audit(docs, labels).collect()}
    assert got == want
    assert audit.audit(docs.where("false"), labels).count() == 0
    assert {r.toxic_lost for r in audit.audit(docs, labels.where("false")).collect()} == {0}


@pytest.mark.parametrize("lane", [4, 5, 7, 64, 512])
def test_transducer_lanes(lane):
    texts = [t or "" for _, t, _ in TEXT_ROWS]
    data = b"".join(t.encode() + b"\0" for t in texts)
    classes = audit.CLASS_OF[np.frombuffer(data, np.uint8)]
    classes[np.cumsum([len(t.encode()) + 1 for t in texts]) - 1] = audit.END
    state, want = audit.BETWEEN, []
    for c in classes.tolist():
        want.append(audit.EMITTED[state * audit.CLASSES + c])
        state = audit.FOLLOWING[state * audit.CLASSES + c] // audit.CLASSES
    assert (audit.transduce(classes, lane) == np.array(want)).all()


def test_word_table_verifies_bytes(monkeypatch):
    col = pa.array(["aa ab aa ab ac", "aa", "", None, "k" * 100 + " " + "k" * 100 + " " + "k" * 99 + "j"])
    want = [3, 1, 0, 0, 2]
    assert audit.counts(col)["distinct"].tolist() == want
    monkeypatch.setattr(audit.Words, "hashes", lambda self: np.zeros(len(self.begin), np.uint64))  # all collide
    assert audit.counts(col)["distinct"].tolist() == want
