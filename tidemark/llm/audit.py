"""Filter interaction audit with a table-driven byte transducer.

One finite-state pass over the UTF-8 bytes of a step of texts feeds everything that the filters ask for: a table of
(state, class of byte) gives the next state and what the byte emits (a word begins or ends, a code point, a capital, a
symbol). The pass runs in lanes, side by side; where a lane begins, the state follows from the four bytes before it. The
word spans that it emits are inserted into an open-addressing hash table, which compares bytes before it calls two words
equal, so that distinct words are counted exactly.

Each document ends as five bits, its failures. Everything else (what a filter removes in an order of filters, what was gone
before, Shapley counts) follows from how many documents of a part have which bits: 32 counts a part.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mix, steps, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: The fifth filter compares documents; the transducer decides the others.
DUPLICATE = 1 << 4
#: Bytes of a lane of the pass.
LANE = 512
#: Longer words are hashed and compared one by one, shorter ones by blocks of eight bytes.
LONG_WORD = 64

SPACE, PLAIN, CAPITAL, SYMBOL, TAIL, LEAD2, LEAD3, LEAD4, END, CLASSES = range(10)
BETWEEN, WORD, DUE1, DUE2, DUE3, STATES = range(6)  # DUEn: in a word, n bytes of a code point to come
BEGINS, ENDS, POINT, IS_CAPITAL, IS_SYMBOL = (1 << i for i in range(5))


def _class_of_bytes() -> np.ndarray:
    out = np.full(256, PLAIN, np.uint8)
    out[[32, *range(9, 14)]] = SPACE
    out[ord("A") : ord("Z") + 1] = CAPITAL
    out[list(b"#$%&*|")] = SYMBOL
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:] = TAIL, LEAD2, LEAD3, LEAD4
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By state * CLASSES + class: CLASSES * the next state, and what is emitted. A stray tail byte is a code point of a word."""
    following, emitted = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    for state in range(STATES):
        for kind in range(CLASSES):
            outside = kind in (SPACE, END)
            expected = kind == TAIL and state >= DUE1
            following[state, kind] = CLASSES * (BETWEEN if outside else {LEAD2: DUE1, LEAD3: DUE2, LEAD4: DUE3}.get(kind, state - 1 if expected else WORD))
            emitted[state, kind] = (
                BEGINS * (state == BETWEEN and not outside) | ENDS * (state != BETWEEN and outside) | POINT * (kind != END and not expected) | IS_CAPITAL * (kind == CAPITAL) | IS_SYMBOL * (kind == SYMBOL)
            )
    return following.ravel(), emitted.ravel()


CLASS_OF = _class_of_bytes()
FOLLOWING, EMITTED = _tables()


def transduce(classes: np.ndarray, lane: int = LANE) -> np.ndarray:
    """What each byte emits; classes: of texts, one after the other, each with an END behind it."""
    n = len(classes)
    lanes = -(-n // lane)
    padded = np.full(lanes * lane, END, np.uint8)
    padded[:n] = classes
    state = np.full(lanes, CLASSES * WORD, np.uint8)
    for back in range(4, 0, -1):  # of the four bytes before a lane, one sets the state at least
        state[1:] = FOLLOWING[state[1:] + padded[lane - back :: lane][: lanes - 1]]
    state[:1] = CLASSES * BETWEEN
    columns = np.ascontiguousarray(padded.reshape(lanes, lane).T)
    for at in columns:
        np.add(at, state, out=at)
        np.take(FOLLOWING, at, out=state, mode="clip")
    return EMITTED[columns.T.ravel()][:n]


class Words:
    """Spans of bytes in rows, in an open-addressing hash table that verifies by the bytes."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray):
        self.raw, self.begin, self.size, self.row = data, begin, end - begin, row
        held = np.zeros(len(data) + 8, np.uint8)
        held[: len(data)] = data
        self.blocks = np.ndarray(len(data) + 1, "<u8", held, strides=(1,))  # the eight bytes from each byte on

    def block(self, words: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8 * k and on of words that are longer than that; zeros behind a word's end."""
        left = np.minimum(self.size[words] - 8 * k, 8).astype(np.uint64)
        return self.blocks[self.begin[words] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - left)))

    def bytes_of(self, word: int) -> bytes:
        return self.raw[self.begin[word] : self.begin[word] + self.size[word]].tobytes()

    def hashes(self) -> np.ndarray:
        """Of (row, word)."""
        out = mix(self.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.size.astype(np.uint64))
        for k in range(LONG_WORD // 8):
            some = np.flatnonzero((self.size > 8 * k) & (self.size <= LONG_WORD))
            if not len(some):
                break
            out[some] = mix(out[some] ^ self.block(some, k))
        for w in np.flatnonzero(self.size > LONG_WORD).tolist():
            out[w] = np.uint64(hash((int(out[w]), self.bytes_of(w))) & 0xFFFFFFFFFFFFFFFF)
        return out

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = (self.row[a] == self.row[b]) & (self.size[a] == self.size[b])
        for k in range(LONG_WORD // 8):
            some = np.flatnonzero(same & (self.size[a] > 8 * k) & (self.size[a] <= LONG_WORD))
            if not len(some):
                break
            same[some] = self.block(a[some], k) == self.block(b[some], k)
        for i in np.flatnonzero(same & (self.size[a] > LONG_WORD)).tolist():
            same[i] = self.bytes_of(a[i]) == self.bytes_of(b[i])
        return same

    def firsts(self) -> np.ndarray:
        """One word of each set of equal words of a row."""
        n = len(self.begin)
        bits = max(1, (2 * n).bit_length())
        table, last = np.full(1 << bits, -1, np.int64), np.int64((1 << bits) - 1)
        slot = (self.hashes() >> np.uint64(64 - bits)).astype(np.int64)
        todo, new = np.arange(n), np.zeros(n, bool)
        while len(todo):  # equal words probe the same places in the same rounds
            at = slot[todo]
            free = table[at] < 0
            table[at[free]] = todo[free]
            holder = table[at]
            own = holder == todo
            new[todo[own]] = True
            todo, holder = todo[~own], holder[~own]
            todo = todo[~self.equal(todo, holder)]
            slot[todo] = (slot[todo] + 1) & last
        return np.flatnonzero(new)


def counts(col: pa.Array) -> dict[str, np.ndarray]:
    """words, distinct, points, capitals, symbols of each text; null is empty."""
    data, starts = as_bytes(col)
    n = len(starts) - 1
    ends = starts[1:] + np.arange(n)  # each text's END
    begin = starts[:-1] + np.arange(n)
    inside = np.ones(len(data) + n, bool)
    inside[ends] = False
    held = np.zeros(len(inside), np.uint8)
    held[inside] = data
    classes = CLASS_OF[held]
    classes[ends] = END
    emitted = transduce(classes)
    total = lambda bit: np.add.reduceat((emitted & bit) != 0, begin, dtype=np.int64) if n else begin
    start, stop = np.flatnonzero(emitted & BEGINS), np.flatnonzero(emitted & ENDS)
    row = np.searchsorted(ends, start)
    first = Words(held, start, stop, row).firsts()
    return {"words": np.bincount(row, minlength=n), "distinct": np.bincount(row[first], minlength=n), "points": total(POINT), "capitals": total(IS_CAPITAL), "symbols": total(IS_SYMBOL)}


def failures(col: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    c = counts(col)
    failed = [c["words"] < 200, 100 * c["distinct"] < 50 * c["words"], 100 * c["capitals"] > 3 * c["points"], c["symbols"] > 0]
    return sum(f.astype(np.int8) << i for i, f in enumerate(failed))


def failed_filters(docs: DataFrame, part: str = "lang") -> DataFrame:
    """part, doc_id, failed, n: how many rows of docs are such.

    failed holds a bit for each filter. E fails if a smaller doc_id has the identical text. A null doc_id neither fails E
    nor makes others fail it; rows that share doc_id and text don't either.
    """
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("part", "doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(29), "text").alias("t2"))

    def run(batches):
        for b in steps(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "doc_id", "t1", "t2")), pa.array(failures(b.column("text")), pa.int8())], names=["part", "doc_id", "t1", "t2", "failed"])

    facts = rows.mapInArrow(run, "part string, doc_id bigint, t1 bigint, t2 bigint, failed tinyint")
    facts = written(facts.groupBy("part", "doc_id", "t1", "t2", "failed").agg(F.count("*").alias("n")), "filter_facts")
    # the smallest doc_id of a text meets rows by (text, doc_id): a text with many rows is no hot key of the join
    least = facts.groupBy("t1", "t2").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    found = facts.join(least, ["t1", "t2", "doc_id"], "left")
    later = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), DUPLICATE).otherwise(0)
    return found.select("part", "doc_id", F.col("failed").cast("int").bitwiseOR(later).alias("failed"), "n")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part.

    docs: doc_id, text and the column `part` (null: empty string), null text is empty; every row counts. labels: doc_id,
    quality, toxic; with several rows for a doc_id, any 1 counts, nulls count as 0. Columns of other names are ignored.
    An empty table of documents has no parts and gives no rows.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(out) for c, out in (("quality", "good"), ("toxic", "bad"))))
    rows = failed_filters(docs, part).join(known, "doc_id", "left")
    cells = rows.groupBy("part", "failed").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("bad", F.lit(0))).alias("bad")
    )
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "bad")).alias("cells"))  # 32 at most
    run = by_part.select("part", "cells", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    run = run.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    before = F.expr(f"aggregate(sequence(1, 5), 0, (bits, i) -> IF(i < step, bits | shiftleft(1, instr('{FILTERS}', substr(filter_order, i, 1)) - 1), bits))")
    run = run.withColumns({"before": before, "own": F.expr(f"shiftleft(1, instr('{FILTERS}', substr(filter_order, step, 1)) - 1)")})
    sums = {
        "kept": "IF(x.failed & (before | own) = 0, x.n, 0)", "removed": "IF(x.failed & own != 0 AND x.failed & before = 0, x.n, 0)", "redundant": "IF(x.failed & own != 0 AND x.failed & before != 0, x.n, 0)",
        "unique_fails": "IF(x.failed = own, x.n, 0)", "good_lost": "IF(x.failed & own != 0 AND x.failed & before = 0, x.good, 0)", "toxic_lost": "IF(x.failed & own != 0 AND x.failed & before = 0, x.bad, 0)",
        # of a document's failing filters each comes first in as many of the orders
        "shapley": f"IF(x.failed & own != 0, x.n * ({len(ORDERS)} div bit_count(x.failed)), 0)",
    }
    return run.select("part", "filter_order", "step", *(F.expr(f"aggregate(cells, 0L, (sum, x) -> sum + {e})").alias(c) for c, e in sums.items()))


#: The same rows in DuckDB SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, false)} AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), m AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END) AS failed,
    count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY ALL
), letters(x) AS (
  VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, failed, n, good, bad, list_contains(failed, filter_order[step]) AS own,
    len(list_filter(failed, lambda x: contains(filter_order[:step - 1], x))) > 0 AS gone
  FROM m, orders, range(1, 6) r(step)
), o AS (
  SELECT part, filter_order, step, CAST(sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN own AND len(failed) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN own AND NOT gone THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM s GROUP BY part, filter_order, step
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM o
"""
