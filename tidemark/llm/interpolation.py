"""Language-model scores of documents by deleted interpolation.

The probability of a word after its context is a mixture of the n-gram maximum-likelihood estimate and the mixture of the
next shorter n-gram, down to the uniform distribution over known words and one unknown: p(w|c) = a f(w|c) + (1 - a) p(w|c'),
where c' is c without its first word. The weight a depends on the context's bucket, the logarithm of how often it occurs.
Weights are learned on counts that were held out: a part of the training documents is deleted from the counts, and
expectation-maximisation finds the weights of each length of n-grams that make the deleted part likeliest, shorter ones first.
Scores then use the counts of all training documents.

Counts never meet in one place. Documents are taken in pieces of about PIECE bytes; a piece sends its different n-grams once,
sorted by a hash, in a row for each range of hashes. Each range sums up what all pieces have sent and answers every piece
with totals in the order of its own n-grams; the piece, sent along with its documents, finds them there without any keys.
So an n-gram that a third of all rows hold travels once a piece, and ranges are even, as hashes are. The held-out part is
summarised for expectation-maximisation by buckets and ratios of the two estimates (RATIOS to an octave): a bounded table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, hashes_in_steps, mix, words_of, written

ORDER = 2
#: Rows whose crc32(doc_id as text) mod FOLDS is HELD_OUT are never learned from; those with DELETED teach the weights, and count in the end.
FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Bytes of text of a piece, and for each range of hashes.
PIECE, RANGE = 4 << 20, 2 << 20
#: Buckets of context frequencies (floor of the binary logarithm), steps of an octave that ratios are told apart by, octaves either way.
BUCKETS, RATIOS, OCTAVES = 48, 32, 64
#: No weight is larger: something is left to shorter n-grams.
LARGEST_WEIGHT = 1 - 1e-6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_START, _END, _SALT = np.uint64(0x51A57A127B0C5EED), np.uint64(0x0E4DF1A15F00D5ED), np.uint64(0xA0761D6478BD642F)
_TAG = np.uint64(7)  # the low bits of a key: its length, 0 for one that begins before the text


@dataclass
class Grams:
    """The n-grams of some texts. Places: for each text one before its first word, its words, its end."""

    keys: list[np.ndarray]  # by length less one: of each place
    text: np.ndarray  # of each place
    first: np.ndarray  # the place before each text
    order: int

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, order: int) -> Grams:
        data = _LOWER[data]
        begin, end, row = words_of(data, starts)
        texts = len(starts) - 1
        size = np.bincount(row, minlength=texts) + 2
        first = np.cumsum(size) - size
        token = np.full(int(size.sum()), _END, np.uint64)
        token[first] = _START
        token[np.arange(len(row)) + 2 * row + 1] = hashes_in_steps(data, begin, end)
        text = np.repeat(np.arange(texts), size)
        ahead, place = first[text], np.arange(len(token))
        keys, acc = [], mix(token + _SALT)
        for m in range(1, order + 1):
            if m > 1:
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + token[np.maximum(place - m + 1, ahead)])
            key = acc & ~_TAG | np.uint64(m)
            key[first] &= ~_TAG
            keys.append(key)
        return cls(keys, text, first, order)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, text) of everything that is counted: the n-grams of all lengths, and as contexts the shorter ones before a text's first word."""
        inner = np.ones(len(self.text), bool)
        inner[self.first] = False
        return np.concatenate([*self.keys[:-1], self.keys[-1][inner]]), np.concatenate([*[self.text] * (self.order - 1), self.text[inner]])

    def numbered(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The sorted different keys, and by length where each place's key stands among them."""
        key, _ = self.all()
        unique, begin, by = _runs(key)
        at = np.empty(len(key), np.int64)
        at[by] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
        places = len(self.text)
        out = [at[m * places : (m + 1) * places] for m in range(self.order - 1)]
        inner = np.ones(places, bool)
        inner[self.first] = False
        last = np.zeros(places, np.int64)
        last[inner] = at[(self.order - 1) * places :]
        return unique, [*out, last]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different keys, where the runs of equal ones begin in sorted order, and that order."""
    order = np.argsort(key)
    held = key[order]
    begin = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(key) else np.empty(0, np.int64)
    return held[begin], begin, order


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int64)))


def _pieces(batches, most: int):
    """(task, number, texts with doc_id and fold, checksum) of runs of a task's rows that hold about so many bytes."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def piece():
        t = pa.Table.from_batches(held).combine_chunks()
        data, starts = as_bytes(t["text"].combine_chunks())
        return task, number, t, data, starts, zlib.crc32(np.diff(starts).tobytes(), zlib.crc32(memoryview(np.ascontiguousarray(data))))

    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = min(b.num_rows, int(np.searchsorted(ends, done + most - size, "left")) + 1)
            held.append(b.slice(at, to - at))
            size, at = size + int(ends[to - 1]) - done, to
            if size >= most:
                yield piece()
                number, held, size = number + 1, [], 0
    if held:
        yield piece()


def _asks(order: int, ranges: int, most: int):
    """mapInArrow: of each piece a row for each range of hashes, with its keys there and how often training and deleted documents have them."""

    def run(batches):
        bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
        for task, number, t, data, starts, sign in _pieces(batches, most):
            grams = Grams.of(data, starts, order)
            fold = t["fold"].to_numpy()
            key, text = grams.all()
            unique, begin, by = _runs(key)
            fold = fold[text[by]]
            count = lambda x: np.add.reduceat(x, begin, dtype=np.int64) if len(begin) else begin
            train, deleted = count((fold >= 0) & (fold != HELD_OUT)), count(fold == DELETED)
            cuts = np.concatenate([[0], np.searchsorted(unique, bounds), [len(unique)]])
            full = np.flatnonzero(np.diff(cuts))
            cuts = np.append(cuts[full], cuts[-1])
            same = lambda v: pa.array(np.full(len(full), v, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int64)), same(task), same(number), same(sign), _lists(unique.view(np.int64), cuts), _lists(train, cuts), _lists(deleted, cuts)],
                names=["part", "task", "number", "sign", "keys", "train", "deleted"],
            )

    return run, "part bigint, task bigint, number bigint, sign bigint, keys array<bigint>, train array<bigint>, deleted array<bigint>"


#: Kinds of answers: totals of all of a piece's n-grams, of those of its deleted documents, sums over a range, words of a range by what is left of their counts.
ALL, OF_DELETED, SUMS, WORDS = range(4)
_ANSWER = "kind int, task bigint, number bigint, part bigint, sign bigint, train array<bigint>, deleted array<bigint>"


def _answer(asked: pa.Table) -> pa.Table:
    """Answers to all pieces' rows of one range."""
    sizes = pc.list_value_length(asked["keys"]).to_numpy().astype(np.int64)
    flat = lambda c: np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in asked[c].chunks])
    key, own = flat("keys").view(np.uint64), flat("deleted")
    unique, begin, by = _runs(key)
    at = np.empty(len(key), np.int64)
    at[by] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
    train, deleted = (np.add.reduceat(flat(c)[by], begin) for c in ("train", "deleted"))
    part, cuts = asked["part"][0].as_py(), np.concatenate([[0], np.cumsum(sizes)])
    some = own > 0
    own_cuts = np.concatenate([[0], np.cumsum(np.add.reduceat(some, cuts[:-1], dtype=np.int64))])
    word = (unique & _TAG) == 1
    left = (train - deleted)[word]
    steps = np.where(left > 0, np.round(RATIOS * np.log2(np.maximum(left, 1))), -1).astype(np.int64)
    seen, inverse = np.unique(steps, return_inverse=True)
    sums = [int(train[word].sum()), int(deleted[word].sum()), int((train[word] > 0).sum())]
    n = len(sizes)
    ids = {c: asked[c].to_numpy() for c in ("task", "number", "sign")}
    columns = {
        "kind": np.concatenate([np.full(n, ALL), np.full(n, OF_DELETED), [SUMS, WORDS]]).astype(np.int32),
        **{c: np.concatenate([v, v, [0, 0]]) for c, v in ids.items()},
        "part": np.full(2 * n + 2, part),
        "train": pa.concat_arrays([_lists(train[at], cuts), _lists(train[at[some]], own_cuts), _lists(np.concatenate([sums, seen]), np.array([0, 3, 3 + len(seen)]))]),
        "deleted": pa.concat_arrays([_lists(at[:0], np.zeros(n + 1)), _lists(deleted[at[some]], own_cuts), _lists(np.bincount(inverse, deleted[word], len(seen)), np.array([0, 0, len(seen)]))]),
    }
    return pa.table({c: columns[c] for c in ("kind", "task", "number", "part", "sign", "train", "deleted")})


def _sent(most: int, deleted_only: bool):
    """mapInArrow: each piece with its documents (or the deleted ones), compressed."""

    def run(batches):
        for task, number, t, data, starts, sign in _pieces(batches, most):
            fold = t["fold"].to_numpy()
            if deleted_only:
                t = t.filter(pa.array(fold == DELETED))
                fold = t["fold"].to_numpy()
                data, starts = as_bytes(t["text"].combine_chunks() if t.num_rows else pa.array([], pa.string()))
                if not len(fold):
                    continue
            packed = pa.compress(memoryview(np.ascontiguousarray(data)), codec="zstd", asbytes=True) if len(data) else b""
            one = np.array([0, len(fold)])
            ids = pa.ListArray.from_arrays(pa.array(one.astype(np.int32)), t["doc_id"].combine_chunks())
            yield pa.RecordBatch.from_arrays(
                [pa.array([task]), pa.array([number]), pa.array([sign]), ids, _lists(fold, one), _lists(np.diff(starts), one), pa.array([packed], pa.binary())], names=["task", "number", "sign", "ids", "fold", "sizes", "packed"]
            )

    return run, "task bigint, number bigint, sign bigint, ids array<bigint>, fold array<bigint>, sizes array<bigint>, packed binary"


def _received(piece: pa.Table, answers: pa.Table, order: int) -> tuple[Grams, list[np.ndarray], np.ndarray, np.ndarray]:
    """The n-grams of a piece, by length the number of each place's, and what was answered about each number."""
    signs = {*piece["sign"].to_pylist(), *answers["sign"].to_pylist()}
    if piece.num_rows != 1 or len(signs) != 1:
        raise ValueError("documents must come in the same rows and partitions whenever they are read: write them as a table first")
    sizes = piece["sizes"].combine_chunks().flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = np.frombuffer(pa.decompress(piece["packed"][0].as_py(), int(starts[-1]), codec="zstd", asbytes=True) if starts[-1] else b"", np.uint8)
    grams = Grams.of(data, starts, order)
    unique, at = grams.numbered()
    by = answers.sort_by("part")
    train, deleted = (np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in by[c].chunks]) for c in ("train", "deleted"))
    if len(train) != len(unique):
        raise ValueError("answers don't fit a piece's n-grams")
    return grams, at, train, deleted


def bucket(count: np.ndarray) -> np.ndarray:
    """Of a context's frequency: the floor of its binary logarithm; -1 for 0."""
    return np.where(count > 0, np.minimum(np.frexp(count.astype(np.float64))[1] - 1, BUCKETS - 1), -1)


@dataclass
class Mixture:
    """Weights and totals of a model."""

    tokens: int
    words: int
    weights: list[np.ndarray]  # of the estimates of one word (one weight), two words, ... (by bucket, and 0 for contexts that never occur)

    def probabilities(self, counts: list[np.ndarray], first: np.ndarray, tokens: int | None = None) -> list[np.ndarray]:
        """Of each place by length; counts: of each place's n-gram by length. What stands at `first` means nothing."""
        mu = self.weights[0][0]
        p = mu * counts[0] / max(1, self.tokens if tokens is None else tokens) + (1 - mu) / (self.words + 1)
        out = [p]
        for m, weights in enumerate(self.weights[1:], 1):
            context = np.roll(counts[m - 1], 1)
            a = weights[bucket(context)]
            p = a * counts[m] / np.maximum(context, 1) + (1 - a) * p
            out.append(p)
        return out


def learn(ratios: np.ndarray, n: np.ndarray) -> float:
    """The weight of the longer estimate by expectation-maximisation.

    ratios: of the longer to the shorter estimate, n: how many held-out tokens have it. An imagined token for either keeps
    the weight of a rare bucket off the ends; without any token it is 0.
    """
    total, a = n.sum(), 0.5
    if not total:
        return 0.0
    for _ in range(1000):
        new = (float((n * a * ratios / (a * ratios + 1 - a)).sum()) + 1) / (total + 2)
        if abs(new - a) < 1e-9:
            break
        a = min(new, LARGEST_WEIGHT)
    return a


def _expectations(order: int, m: int, model: Mixture, left: int):
    """Of a piece's deleted documents, how many of their tokens have which bucket of contexts of m words and which ratio of estimates, by what is left of the counts."""

    def run(sent: pa.Table, answered: pa.Table) -> pa.Table:
        n = cell = np.empty(0, np.int64)
        if sent.num_rows:
            grams, at, train, deleted = _received(sent, answered, order)
            counts = [(train - deleted)[x] for x in at]
            context, p = np.roll(counts[m - 1], 1), model.probabilities(counts, grams.first, left)[m - 1]
            some = context > 0
            some[grams.first] = False
            ratio = counts[m][some] / context[some] / p[some]
            step = np.where(ratio > 0, np.clip(np.round(RATIOS * np.log2(np.maximum(ratio, 1e-300))), -RATIOS * OCTAVES, RATIOS * OCTAVES), -RATIOS * OCTAVES - 1).astype(np.int64)
            cell, n = np.unique(bucket(context[some]).astype(np.int64) << 32 | step + (1 << 31), return_counts=True)
        return pa.table({"bucket": cell >> 32, "step": (cell & 0xFFFFFFFF) - (1 << 31), "n": n.astype(np.int64)})

    return run


def fold(doc_id) -> F.Column:
    """crc32(doc_id as text) mod FOLDS; -1 for a null doc_id."""
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % FOLDS).cast("bigint"), F.lit(-1))


def scores(docs: DataFrame, order: int = ORDER, piece: int = PIECE, ranges: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Tokens are words (split at the six ASCII white-space bytes, A to Z in lower case) and one end for each text. score is
    the log10 probability of the text by the mixture of n-grams of up to `order` words, base_score that of add-one counts of
    single words. Null text is empty: the end alone. Repeated rows are documents of their own; a row with a null doc_id is
    scored, but nothing is learned from it, and held_out is false. Without training documents everything is as likely as
    anything. An empty table gives no rows. Other columns are ignored. docs is read several times and must be the same rows
    in the same partitions each time, as a table in files is; this is checked. Words and n-grams are told apart by 61 bits of
    a hash.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be from 2 to 7")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), fold(F.col("doc_id")).alias("fold"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = ranges or max(2, size // RANGE)
    tasks = max(2, size // (2 * piece))  # a few pieces, or four ranges, for a task: no task grows with the input
    ask, asked = _asks(order, ranges, piece)
    answers = written(rows.mapInArrow(ask, asked).repartition(max(2, ranges // 4), "part").groupBy("part").applyInArrow(_answer, _ANSWER), "ngram_totals")
    item = lambda i: F.sum(F.get("train", F.lit(i)))
    tokens, deleted, words = (x or 0 for x in answers.where(F.col("kind") == SUMS).agg(item(0), item(1), item(2)).first())
    by_step = answers.where(F.col("kind") == WORDS).select(F.explode(F.arrays_zip("train", "deleted"))).select("col.*").groupBy("train").agg(F.sum("deleted").alias("n"))
    steps = np.array([tuple(r) for r in by_step.collect()], np.float64).reshape(-1, 2)  # a row for each step of a logarithm
    left = tokens - deleted
    ratios = np.where(steps[:, 0] >= 0, 2 ** (steps[:, 0] / RATIOS) / max(1, left) * (words + 1), 0.0)
    model = Mixture(tokens, words, [np.array([learn(ratios, steps[:, 1])])])

    keys = ["task", "number"]
    dealt = lambda x: x.repartition(tasks, *keys).groupBy(*keys)
    grouped = lambda kind: dealt(answers.where(F.col("kind") == kind).drop("kind"))
    for m in range(1, order):
        send, kind = _sent(piece, True)
        found = dealt(rows.mapInArrow(send, kind)).cogroup(grouped(OF_DELETED)).applyInArrow(_expectations(order, m, model, left), "bucket bigint, step bigint, n bigint")
        table = np.array([tuple(r) for r in found.groupBy("bucket", "step").agg(F.sum("n")).collect()], np.float64).reshape(-1, 3)  # bounded by buckets and steps
        weights, known = np.zeros(BUCKETS + 1), 0.0
        for b in range(BUCKETS):  # a bucket that the held-out part never meets takes the weight of the one below
            mine = table[table[:, 0] == b]
            if len(mine):
                known = learn(np.where(mine[:, 1] >= -RATIOS * OCTAVES, 2 ** (mine[:, 1] / RATIOS), 0.0), mine[:, 2])
            weights[b] = known
        model = Mixture(tokens, words, [*model.weights, weights])  # the last, at -1: contexts that never occur

    def judge(sent: pa.Table, answered: pa.Table) -> pa.Table:
        grams, at, train, _ = _received(sent, answered, order)
        counts = [train[x] for x in at]
        inner = np.ones(len(grams.text), bool)
        inner[grams.first] = False
        text, c = grams.text[inner], counts[0][inner]
        texts = len(grams.first)
        total = lambda x: np.bincount(text, x, texts)
        part = sent["fold"].combine_chunks().flatten().to_numpy()
        return pa.table({
            "doc_id": sent["ids"].combine_chunks().flatten(), "held_out": part == HELD_OUT, "n_tokens": np.bincount(text, minlength=texts), "n_known": total(c > 0).astype(np.int64),
            "train_tokens": np.full(texts, tokens), "base_score": total(np.log10((c + 1) / (tokens + words + 1))), "score": total(np.log10(model.probabilities(counts, grams.first)[-1][inner])),
        })

    send, kind = _sent(piece, False)
    sent = dealt(rows.mapInArrow(send, kind))
    return sent.cogroup(grouped(ALL)).applyInArrow(judge, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
