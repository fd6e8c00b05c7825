"""Mixture-controlled packing of documents into token sequences.

Each source is a queue of documents, cut into quanta of up to QUANTUM tokens of one document. Deficit round-robin fills
window after window: every window credits a queue with its share of the window's tokens, the queue gives out the quanta that
its credit covers, and what is left over stays as its deficit, until it covers another quantum. The credit of a queue up to
a window is its weight times the window's number, so the window of a quantum follows from how many tokens its queue has
given out by its end: partitions carry deficits over without talking to each other. A queue that runs dry gives nothing
more, and windows fill from the others in their proportions. What windows give out, one after the other, is numbered by a
range-partitioned sort and sums of partitions, and cut into sequences of `length`; what remains at the end goes to sequences
whose lengths are powers of two, so that nothing is padded.

Quanta are narrow rows without ids; ids move once, to meet the list of their document's pieces. Sources are rows of tables
throughout: their number doesn't matter to any task.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import TEXT_STEP, binary, encoder
from .common import as_bytes, row_key, steps, written

#: Most tokens of a document that a queue gives out at a time.
QUANTUM = 256
#: About how many quanta are numbered by one task.
SORTED_ROWS = 250_000
#: Rounds beyond this are one: queues of hardly any weight.
_LAST_ROUND = 1 << 60


def tokens_of(docs: DataFrame, path: str, pattern: str, end_id: int, source: str) -> DataFrame:
    """k1, k2, doc_id, source, n, ids of every row: its ids (16 bits each if they fit, else 32) and end_id after them."""
    named = F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), named).select(*row_key("doc_id", "text"), "doc_id", "source", "text")

    def run(batches):
        e = encoder(path, pattern)
        kind = "<u2" if max(e.size, end_id + 1) <= 1 << 16 else "<u4"
        for b in steps(batches, most=TEXT_STEP):
            ids, starts = e.encode_column(b.column("text"), added=True)
            raw = np.insert(ids, starts[1:], end_id).astype(kind)
            starts = starts + np.arange(len(starts))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.diff(starts)), binary(raw, starts * raw.itemsize)], names=["k1", "k2", "doc_id", "source", "n", "ids"])

    return rows.mapInArrow(run, "k1 bigint, k2 bigint, doc_id bigint, source string, n bigint, ids binary")


def _queued(docs: DataFrame, weights: dict[str, float] | None, length: int) -> DataFrame:
    """row, source, n of the documents (row, source, n, bucket) with at, the tokens before in the queue, and credit, its tokens for each window."""
    sums = docs.groupBy("source", "bucket").agg(F.sum("n").alias("sum"))
    totals = sums.groupBy("source").agg(F.sum("sum").alias("weight"))
    if weights is not None:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        totals = totals.select("source").join(given, "source", "left")
    totals = totals.select("source", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(1e-12)).alias("weight"))
    every = totals.agg(F.sum("weight")).first()[0] or 1.0
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.join(totals, "source").select("source", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"), (F.col("weight") / every * length).alias("credit"))
    order = Window.partitionBy("source", "bucket").orderBy("k1", "k2", "row").rowsBetween(Window.unboundedPreceding, -1)
    laid = docs.withColumn("own", F.coalesce(F.sum("n").over(order), F.lit(0))).join(bases, ["source", "bucket"])
    return laid.select("row", "source", "n", (F.col("base") + F.col("own")).alias("at"), "credit")


def quanta(queued: DataFrame, quantum: int) -> DataFrame:
    """round, source, at, row, start, size: the quanta of the documents, with the window (round) whose credit covers them first. A queue's quanta are in the order of `at`."""
    x = queued.select("*", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(quantum).cast("bigint"))).alias("_", "start"))
    x = x.withColumn("size", F.least(F.col("n") - F.col("start"), F.lit(quantum)))
    at = F.col("at") + F.col("start")
    covered = F.least(F.ceil(F.least((at + F.col("size")) / F.col("credit"), F.lit(float(_LAST_ROUND)))) - 1, F.lit(_LAST_ROUND))
    return x.select(covered.cast("bigint").alias("round"), "source", at.alias("at"), "row", "start", "size")


def numbered(x: DataFrame, tasks: int) -> DataFrame:
    """The quanta with place, the tokens of all quanta before in the order of (round, source, at): sums within the parts of a sorted table, and of parts."""
    x = written(x.repartitionByRange(tasks, "round", "source", "at").withColumn("part", F.spark_partition_id()), "quanta")
    sums = x.groupBy("part").agg(F.sum("size").alias("sum"))  # a row a part
    earlier = (Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("round", "source", "at").rowsBetween(*earlier)
    return x.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, "part").select("row", "start", "size", (F.col("base") + F.col("own")).alias("place"))


def _cut(placed: DataFrame, length: int, total: int) -> DataFrame:
    """row, start, size, sequence, offset of the pieces that quanta (of up to `length` tokens) are cut into by the ends of sequences."""
    full, rest = divmod(total, length)
    tail = [full * length]
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            tail.append(tail[-1] + (1 << bit))
    ends = F.array(*(F.lit(t).cast("bigint") for t in tail))  # where the last full sequence and those after it end
    following = (F.floor(F.col("place") / length) + 1) * length
    cuts = F.array_sort(F.array_distinct(F.filter(F.concat(ends, F.array(F.least(following, F.lit(full * length)))), lambda c: (c > F.col("place")) & (c < F.col("place") + F.col("size")))))
    x = placed.withColumn("cuts", F.concat(F.array(F.col("place")), cuts, F.array(F.col("place") + F.col("size"))))
    x = x.select("row", "start", "place", F.explode(F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.struct(F.get("cuts", i).alias("a"), F.get("cuts", i + 1).alias("b")))).alias("c"))
    late = F.size(F.filter(ends, lambda e: e <= F.col("c.a"))) - 1  # of the sequences at the end
    in_full = F.col("c.a") < full * length
    sequence = F.when(in_full, F.floor(F.col("c.a") / length)).otherwise(full + late)
    first = F.when(in_full, F.floor(F.col("c.a") / length) * length).otherwise(F.get(ends, late))
    return x.select("row", (F.col("start") + F.col("c.a") - F.col("place")).alias("start"), (F.col("c.b") - F.col("c.a")).alias("size"), sequence.cast("bigint").alias("sequence"), (F.col("c.a") - first).alias("offset"))


def pack(docs: DataFrame, path: str, pattern: str, length: int = 1024, end_id: int = 0, source: str = "source", weights: dict[str, float] | None = None, quantum: int = QUANTUM) -> DataFrame:
    """Packs every row of docs (doc_id, text, source) into sequences of `length` tokens; one row per piece.

    doc_id, start, length (which of its document's ids), ids_crc32, doc_tokens, sequence_id, offset, source. Every id lies
    in exactly one piece; the ids of a document are those of its text, where a string of an added token of the vocabulary is
    that token, and end_id. weights: target proportions of the sources, by default their shares of all tokens, so that all
    run dry together; sources without a weight have a very small one. At the end of any window what a source with tokens
    left has given out is less than `quantum` short of its credit, and never beyond it. Null text counts as empty (end_id
    alone), null source as "". Repeated rows are packed as often as they come. Within a source, documents are queued in a
    hashed order. An empty table gives no rows. Other columns are ignored.
    """
    tokens = written(tokens_of(docs, path, pattern, end_id, source).withColumn("row", F.monotonically_increasing_id()), "tokens")
    rows, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    quantum = min(quantum, length)
    # a queue's documents in about sqrt(rows) buckets: neither a bucket nor the list of buckets gets large
    narrow = tokens.select("row", "source", "n", "k1", "k2", F.pmod("k1", F.lit(math.isqrt(rows) + 1)).cast("int").alias("bucket"))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, total // (quantum * SORTED_ROWS))
    pieces = _cut(numbered(quanta(_queued(narrow, weights, length), quantum), tasks), length, total)
    lists = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "size", "sequence", "offset"))).alias("pieces"))  # of a document
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]

    def cut(batches):
        for b in steps(batches, "ids"):
            n = b.column("n").to_numpy()
            raw, _ = as_bytes(b.column("ids"))
            ids = memoryview(raw.view(f"<u{len(raw) // int(n.sum())}").astype("<u4").tobytes())
            lists = b.column("pieces")
            doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())
            flat = lists.flatten()
            start, size, sequence, offset = (flat.field(c).to_numpy() for c in ("start", "size", "sequence", "offset"))
            goes_on = (doc[1:] == doc[:-1]) & (sequence[1:] == sequence[:-1]) & (offset[1:] == offset[:-1] + size[:-1])  # one piece with what is before
            first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
            size, doc, start = np.add.reduceat(size, first), doc[first], start[first]
            low = ((np.cumsum(n) - n)[doc] + start) * 4
            crc = [zlib.crc32(ids[x:y]) for x, y in zip(low.tolist(), (low + 4 * size).tolist(), strict=True)]
            pick = pa.array(doc)
            columns = [b.column("doc_id").take(pick), start, size, np.array(crc, np.int64), n[doc], sequence[first], offset[first], b.column("source").take(pick)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns], names=names)

    laid = tokens.select("row", "doc_id", "source", "n", "ids").join(lists, "row").select("doc_id", "source", "n", "ids", "pieces")
    return laid.mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string")
