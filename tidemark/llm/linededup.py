"""Line deduplication by winnowing over line hashes.

A document is the sequence of its lines that aren't blank. A window is the shortest run of lines from some line on that
holds at least `least_words` words, so a long line is a window by itself. Each window selects its line of least hash;
windows that select the same line make one position. A run that two places share holds the same windows in both and so
selects the same lines: none can be missed. Positions are joined by their fingerprint, the selected line's hash; only those
whose fingerprint stands at another place too go on. From each of them its matches are extended both ways: back to the
first line of every window that selects it, and on to the windows' ends and over one, two and more of the lines after
them, as long as these hold fewer than `least_words` words (longer runs end with windows of their own). Each extended run
is compared with the earliest place of the same run, and what repeats an earlier run is deleted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from .common import as_bytes, mix, powers, ranges_of, row_key, span_hashes, steps, words_of, written

LEAST_WORDS = 8


def lines_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 64-bit hash and words of every line that isn't blank; white space around a line doesn't count."""
    data, starts = as_bytes(col)
    a, b, row = words_of(data, starts)
    breaks = np.cumsum(data == 10)
    line = breaks[a] if len(a) else a  # words hold no line feed
    new = np.ones(len(a), bool)
    new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1 if len(a) else first
    return row[first], span_hashes(data, a[first], b[last]) if len(a) else np.empty(0, np.uint64), last - first + 1


def _positions(col: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of each position its row, its line in the row, its fingerprint, and the runs that its windows extend to: list<struct<first, last, w1, w2>>."""
    row, h, words = lines_of(col)
    n = len(h)
    docs = len(col)
    begin = np.searchsorted(row, np.arange(docs))  # first line of each row
    end = np.searchsorted(row, np.arange(docs), "right")
    upto = np.cumsum(words)
    last = np.searchsorted(upto, upto - words + least)  # the window's last line
    s = np.flatnonzero(last < end[row])
    e = last[s]
    flat, at = ranges_of(s, e - s + 1)
    if len(s):
        least_hash = np.minimum.reduceat(h[flat], at[:-1])
        selected = np.maximum.reduceat(np.where(h[flat] == np.repeat(least_hash, e - s + 1), flat, -1), at[:-1])  # of equal lines the last: never falls
    else:
        selected = s
    new = np.flatnonzero(np.diff(selected, prepend=-1))  # the first window of each position
    # with each of the lines after the window, fewer than `least` words in all
    after = np.minimum(np.searchsorted(upto, upto[e] + least) - e - 1, end[row[s]] - e - 1)
    e, runs = ranges_of(e, after + 1)
    s = np.repeat(s, after + 1)
    up, down = powers(n + 1)
    two = []
    for salt in (0x51, 0xA7):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)) * up[:n])])
        two.append(mix((sums[e + 1] - sums[s]) * down[s] + (e - s).astype(np.uint64)).view(np.int64))
    base = begin[row[s]]
    structs = pa.StructArray.from_arrays([pa.array((s - base).astype(np.int32)), pa.array((e - base).astype(np.int32)), pa.array(two[0]), pa.array(two[1])], names=["first", "last", "w1", "w2"])
    line = selected[new]
    return row[line], (line - begin[row[line]]).astype(np.int32), h[line].view(np.int64), pa.ListArray.from_arrays(pa.array(runs[np.append(new, len(runs) - 1)].astype(np.int32)), structs)


def positions(texts: DataFrame, least_words: int) -> DataFrame:
    """A row for each position of texts (k1, k2, doc_id, text): its line, its fingerprint, the runs that its windows extend to."""

    def run(batches):
        for b in steps(batches):
            row, line, fingerprint, runs = _positions(b.column("text"), least_words)
            pick = pa.array(row)
            keys = [b.column(c).take(pick) for c in ("doc_id", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(line), pa.array(fingerprint), runs], names=["doc_id", "k1", "k2", "line", "fingerprint", "runs"])

    return texts.mapInArrow(run, "doc_id bigint, k1 bigint, k2 bigint, line int, fingerprint bigint, runs array<struct<first: int, last: int, w1: bigint, w2: bigint>>")


def repeated_runs(texts: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """k1, k2 and runs, array<struct<first, last>> of lines that repeat an earlier run, of the documents that have any."""
    found = written(positions(texts, least_words), "positions")
    doc = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id")
    place = F.struct(doc, "k1", "k2", "line")
    # fingerprints and runs are written so that both sides of a join are plain exchanges: adaptive execution splits frequent keys
    marks = written(found.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("fingerprint"), "fingerprints")
    shared = written(found.join(marks, "fingerprint").select(doc, "k1", "k2", F.explode("runs").alias("run")).select("doc_id", "k1", "k2", "run.*"), "runs")
    place = F.struct("doc_id", "k1", "k2", "first")
    firsts = written(shared.groupBy("w1", "w2").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n"), "origins")
    again = shared.join(firsts, ["w1", "w2"]).where(place != F.col("origin"))
    return again.groupBy("k1", "k2").agg(F.array_distinct(F.collect_list(F.struct("first", "last"))).alias("runs"))


def kept_text(text: str, runs: list[dict]) -> tuple[str, list[int]]:
    """text without the runs' lines, and the numbers of the lines that go; nothing is left if only blank lines would be."""
    lines = text.split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
    gone = {filled[j] for r in runs for j in range(r["first"], r["last"] + 1)}
    kept = [x for i, x in enumerate(lines) if i not in gone]
    return "" if len(gone) == len(filled) else "\n".join(kept), sorted(gone)


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs (doc_id, text, ...) without the lines that repeat an earlier run; all columns in a struct `row`, and n_lines, removed.

    A repeated run is one or more lines of at least `least_words` words in all that stand alike, white space around lines
    aside, earlier in the same document or in one that comes before it by doc_id (null: last). `removed` lists the numbers
    of the deleted lines, from 0. Blank lines stay; a document that loses all other lines becomes empty. Null text stays
    null, n_lines is then 0. Rows equal in doc_id and text are one document and treated alike; rows that share only a
    doc_id are ordered by a hash.
    """
    keys = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    keyed = keys.select("row", *row_key("doc_id", "text"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *row_key("doc_id", "text"))
    joined = keyed.join(repeated_runs(texts, least_words), ["k1", "k2"], "left")

    def run(batches):
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("row").field("text"), batch.column("runs")], names=["row", "text", "runs"])
            for b in steps([whole]):
                texts, removed, count = [], [], []
                for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                    count.append(text.count("\n") + 1 if text else 0)
                    text, gone = kept_text(text, runs) if runs else (text, [])
                    texts.append(text)
                    removed.append(gone)
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array(removed, pa.list_(pa.int32())), pa.array(count, pa.int64())], names=["row", "kept", "removed", "n_lines"])

    kind = StructType().add("row", docs.schema).add("kept", StringType()).add("removed", ArrayType(IntegerType())).add("n_lines", LongType())  # any column name
    out = joined.select("row", "runs").mapInArrow(run, kind)
    return out.select(F.col("row").withField("text", F.col("kept")).alias("row"), "n_lines", "removed")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers, comma-joined), text (what is left) of every row."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), F.array_join("removed", ",").alias("removed"), "row.text"
    )
