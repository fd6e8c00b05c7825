"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over bytes, of toxic and of ordinary labelled documents, predict each byte of the
lower-cased text from the four before it, so that they know parts of words too. Below the highest order both back off to
one chain of continuation counts that they share, of four, three, two and one byte down to the uniform distribution: how many
different longer grams end so, in either class. What a class has not seen is thus as likely in the other, and rare
expressions weigh little. A document's score is a logistic function
of the difference of the two log-likelihoods, normalised by length, of the whole text, of its most toxic passage and of
its most toxic word; the function is fitted on labelled documents that the counts leave out.

Grams are counted exactly, over a bounded sample of labelled documents (MAX_LABELS of either class): the different grams
that pass through the driver and the model that is broadcast don't grow beyond that. What a byte adds to the difference depends on its
gram alone: it is worked out once for each gram seen, and once for each context, which decides for grams not seen.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import as_bytes, mix, steps

#: About how many labelled documents of either class teach at most; where there are more, those with the least hashes of doc_id.
MAX_LABELS = 10_000
ORDER, PASSAGE = 5, 16
DISCOUNT = 0.75

#: ASCII characters but letters and digits all count as a space.
_PLAIN = np.array([32 if i < 128 and not chr(i).isalnum() else i for i in range(256)], np.uint64)


def _grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every byte the gram that ends with it, its ORDER bytes as an integer (spaces before a text), and where rows begin."""
    data, starts = as_bytes(pc.utf8_lower(col))
    pad, rows = ORDER - 1, len(starts) - 1
    place = np.arange(len(data)) + (np.repeat(np.arange(rows), np.diff(starts)) + 1) * pad
    line = np.full(len(data) + rows * pad, 32, np.uint64)
    line[place] = _PLAIN[data]
    gram = np.zeros(len(data), np.uint64)
    for i in range(ORDER):
        gram = gram << np.uint64(8) | line[place - (pad - i)]
    return gram, starts


def gram_counts(labelled: DataFrame) -> DataFrame:
    """gram, n0, n1: of labelled (text, toxic), each gram and how often either class has it."""

    def by_step(batches):
        for b in steps(batches):
            key, starts = _grams(b.column("text"))
            toxic = np.repeat(b.column("toxic").to_numpy(zero_copy_only=False).astype(np.uint64), np.diff(starts))
            both, n = np.unique(key << np.uint64(1) | toxic, return_counts=True)
            one = both & np.uint64(1)
            columns = [(both >> np.uint64(1)).astype(np.int64), np.where(one == 0, n, 0), np.where(one == 1, n, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["gram", "n0", "n1"])

    found = labelled.select("text", "toxic").mapInArrow(by_step, "gram bigint, n0 bigint, n1 bigint")
    return found.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _tail(gram: np.ndarray, m: int) -> np.ndarray:
    return gram & np.uint64((1 << 8 * m) - 1)


_ONE_BYTE = np.uint64(8)
_FREE = np.uint64((1 << 64) - 1)  # no gram: these have ORDER bytes


class Table:
    """A number for each of some different grams; a place by hash, or the next free one. Twice to four times as many places as grams."""

    def __init__(self, gram: np.ndarray, value: np.ndarray):
        self.bits = max(1, (2 * len(gram)).bit_length())
        home = self._home(gram)
        order = np.argsort(home, kind="stable")
        n = np.arange(len(gram))
        at = np.maximum.accumulate(home[order] - n) + n if len(gram) else home
        size = max(1 << self.bits, int(at[-1]) + 1 if len(gram) else 0) + 1
        self.gram, self.value = np.full(size, _FREE, np.uint64), np.zeros(size, np.float32)
        self.gram[at], self.value[at] = gram[order], value[order]

    def _home(self, gram: np.ndarray) -> np.ndarray:
        return (mix(gram) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each gram (0 where there is none), and whether there is one."""
        at = self._home(gram)
        here = self.gram[at]
        todo = np.flatnonzero((here != gram) & (here != _FREE))
        while len(todo):
            at[todo] += 1
            here = self.gram[at[todo]]
            todo = todo[(here != gram[todo]) & (here != _FREE)]
        return self.value[at], self.gram[at] == gram


def _discounted(context: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context 1 / its count (0: none), and the part that the discounts of its grams leave to lower orders."""
    total, kinds = np.bincount(context, counts, size), np.bincount(context, counts > 0, size)
    share = np.divide(1, total, out=np.zeros(size), where=total > 0)
    return share, np.where(total > 0, DISCOUNT * kinds * share, 1)


@dataclass
class Model:
    """Log of toxic over ordinary probability from gram counts, and the logistic function on top."""

    seen: Table  # difference of each gram that a class has
    unseen: Table  # by context, of its other grams: both classes back off to the same probability
    weights: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 1.0, -4.0]))  # of the text, of the passage, of the word, constant

    @classmethod
    def of(cls, gram: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> Model:
        """From the different grams, in any order, and how often either class has them."""

        def continuation(m: int):  # for each gram, by how many different grams end with its last m bytes: discounted share of their context, and what that leaves
            end, at, n = np.unique(_tail(gram, m), return_inverse=True, return_counts=True)
            before, context = np.unique(end >> _ONE_BYTE, return_inverse=True)
            share, rest = _discounted(context, n.astype(float), len(before))
            return ((n - DISCOUNT) * share[context])[at], rest[context][at]

        low = np.full(len(gram), 1 / 128)
        for m in range(1, ORDER):
            own, rest = continuation(m)
            low = np.maximum(own + rest * low, 1e-9)
        contexts, context = np.unique(gram >> _ONE_BYTE, return_inverse=True)
        each, rests = [], []
        for n in counts:
            share, rest = _discounted(context, n.astype(float), len(contexts))
            each.append(np.log(np.maximum(n - DISCOUNT, 0) * share[context] + rest[context] * low))
            rests.append(np.log(rest))
        return cls(Table(gram, each[1] - each[0]), Table(contexts, rests[1] - rests[0]))

    def differences(self, gram: np.ndarray) -> np.ndarray:
        """Log of the toxic over the ordinary probability of each gram's last byte."""
        out, known = self.seen.get(gram)
        new = np.flatnonzero(~known)
        out[new] = self.unseen.get(gram[new] >> _ONE_BYTE)[0]
        return out

    def inputs(self, col: pa.Array) -> np.ndarray:
        """For each text: its difference by byte, the largest by byte of any passage of PASSAGE bytes (or of all, if shorter), the largest of a word."""
        gram, starts = _grams(col)
        each = self.differences(gram)
        sums = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
        n = np.diff(starts)
        whole = sums[starts[1:]] - sums[starts[:-1]]
        best = whole / PASSAGE
        row = np.flatnonzero(n > PASSAGE)
        if len(row):
            passages = np.full(len(sums), -np.inf)
            passages[: len(sums) - PASSAGE] = (sums[PASSAGE:] - sums[:-PASSAGE]) / PASSAGE
            bounds = np.stack([starts[row], starts[row + 1] - PASSAGE + 1], 1).ravel()
            best[row] = np.maximum.reduceat(passages, bounds)[::2]
        word = np.zeros(len(n))
        if len(gram):
            begins = _tail(gram, 1) == 32  # a separator counts to the word after it
            begins[starts[:-1][n > 0]] = True
            at = np.flatnonzero(begins)
            filled = np.flatnonzero(n)
            word[filled] = np.maximum.reduceat(np.add.reduceat(each, at), np.searchsorted(at, starts[filled]))
        return np.stack([whole / np.maximum(n, 1), best, word / PASSAGE, np.ones(len(n))], 1)

    def score(self, col: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(col) @ self.weights, -50, 50)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Logistic regression by Newton's method, with a weak pull to 0 after scaling. weight: how many documents each row stands for."""
        weight = np.ones(len(y)) if weight is None else weight
        mean = np.average(x, 0, weight)
        scale = np.maximum(np.sqrt(np.average((x - mean) ** 2, 0, weight)), 1e-9)
        mean[-1], scale[-1] = 0, 1
        z, w = (x - mean) / scale, np.zeros(x.shape[1])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (weight * (p - y)) + 0.1 * w)
            w = w - np.clip(step, -2, 2)
            if abs(step).max() < 1e-9:
                break
        self.weights = w / scale
        self.weights[-1] -= (self.weights[:-1] * mean[:-1]).sum()


def fold(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 5; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """The model of labelled documents outside of fold 0: counts from folds 1 to 3, the logistic function from fold 4.

    Labels of several rows for a doc_id: the largest counts. Null labels and null doc_ids teach nothing. Without any
    label the model is neutral. Of a class with more than max_labels labels a sample of about so many teaches, drawn by a
    hash of doc_id; the logistic function weights each class by what its sample stands for.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).where(fold(F.col("doc_id")) != 0)
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {t: min(1.0, max_labels / max(1, count.get(t, 0))) for t in (False, True)}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 30)) < F.when(F.col("toxic"), share[True] * (1 << 30)).otherwise(share[False] * (1 << 30))
    known = known.where(drawn)  # bounded by max_labels
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(known), "doc_id").withColumn("fold", fold(F.col("doc_id")))
    found = gram_counts(rows.where("fold < 4")).toArrow()  # the different grams
    model = Model.of(found["gram"].to_numpy().astype(np.uint64), (found["n0"].to_numpy(), found["n1"].to_numpy()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sample(batches):
        for b in steps(batches):
            x = shared.value.inputs(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(3)), b.column("toxic")], names=["whole", "best", "word", "toxic"])

    held = rows.where("fold = 4").select("text", "toxic").mapInArrow(sample, "whole double, best double, word double, toxic boolean").toArrow()  # a row for each labelled document of the fold, bounded
    if held.num_rows:
        x = np.stack([*(held[c].to_numpy() for c in ("whole", "best", "word")), np.ones(held.num_rows)], 1)
        y = held["toxic"].to_numpy().astype(float)
        model.calibrate(x, y, np.where(y > 0, 1 / share[True], 1 / share[False]))
    return model


def scores(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs and a column `out`, the score from 0 to 1 of the column text; it takes the place of one of that name. Null text counts as empty, repeated rows score alike."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text"))  # whatever the columns' names

    def run(batches):
        for b in steps(batches):
            col = b.column("text")
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(shared.value.score(col.fill_null("") if col.null_count else col))], names=["row", "score"])

    return rows.mapInArrow(run, StructType().add("row", docs.schema).add("score", DoubleType())).select("row.*", F.col("score").alias(out))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs. A null doc_id is held out of nothing: held_out is false."""
    return scores(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
