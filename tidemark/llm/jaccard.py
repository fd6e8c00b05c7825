"""N-gram Jaccard join by MinHash banding.

A document's set holds the runs of five words of its lower-cased text. MinHash values are grouped into bands of rows; a
pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands, and bands and rows are chosen so that at the
threshold this reaches the target recall. Band hashes are shuffled; documents that share one are compared on their full
sets. A bucket of any size is split into blocks of bounded numbers of documents and of runs, and each pair of blocks is a
tile, so no bucket is too large and no list of all pairs is made: a tile reports link counts and a spanning forest. A pair that shares several
bands is compared in the first of them only.

Documents of the same words are one class and are compared once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mix, powers, row_key, span_hashes, steps, words_of, written
from .components import components
from .groups import changes, pairs_within, unite, whole_groups

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 80
#: Most documents and most runs of a block; pairs that are looked at in one step.
BLOCK, BLOCK_RUNS, PAIRS_AT_ONCE = 1024, 1 << 20, 1 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, whose bands reach the recall within most_hashes."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


def shingles(col: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `words` words, where each row's begin, and two hashes of each row's words.

    A row of fewer words has one run, of all its words; a row without words has none.
    """
    data, starts = as_bytes(pc.utf8_lower(col))
    a, b, row = words_of(data, starts)
    w = span_hashes(data, a, b) if len(a) else np.empty(0, np.uint64)
    rows = len(col)
    first = np.searchsorted(row, np.arange(rows + 1))
    n = np.diff(first)
    up, down = powers(len(w) + 1)
    seq = []
    for salt in (0x35, 0x7B):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w ^ np.uint64(salt)) * up[: len(w)])])
        seq.append(mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + n.astype(np.uint64)).view(np.int64))
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], count)  # each run's first word
    size = np.repeat(np.minimum(n, words), count)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)])])
    return mix((sums[at + size] - sums[at]) * down[at] + size.astype(np.uint64)), begin, seq[0], seq[1]


def band_hashes(h: np.ndarray, begin: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """(rows of text) x bands; rows without runs get no meaningful hash."""
    r = np.random.default_rng(seed)
    a = r.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    c = r.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    filled = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(begin) - 1, bands), np.uint64)
    if len(filled):
        for k in range(bands * rows):
            least = np.minimum.reduceat(h * a[k] + c[k], begin[filled])
            out[filled, k // rows] = mix(out[filled, k // rows] * np.uint64(0x9E3779B97F4A7C15) + least)
    return out.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """k1, k2, doc_id, c1, c2 (hashes of its words), n (runs), bands array<bigint> of docs (doc_id, text)."""

    def run(batches):
        for b in steps(batches, most=1 << 20):
            h, begin, c1, c2 = shingles(b.column("text"), words)
            sig = band_hashes(h, begin, bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, bands, np.int32)), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(c1), pa.array(c2), pa.array(np.diff(begin)), lists], names=["k1", "k2", "doc_id", "c1", "c2", "n", "bands"])

    keyed = docs.select(*row_key("doc_id", "text"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return keyed.mapInArrow(run, "k1 bigint, k2 bigint, doc_id bigint, c1 bigint, c2 bigint, n bigint, bands array<bigint>")


def _candidates(table: pa.Table, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a tile to be compared in it: across its two blocks or within its one, and sharing no band before."""
    t1, t2, side, band = (table[c].to_numpy() for c in ("t1", "t2", "side", "band"))
    sig = table["bands"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, bands)
    none = np.empty(0, np.int64)
    out = [(none, none)]
    for i, j in pairs_within(changes(table, ["bucket", "t1", "t2"]), PAIRS_AT_ONCE):
        ok = (t1[i] == t2[i]) | (side[i] != side[j])
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 1 << 17):
            x, y = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            first = np.argmax(sig[x] == sig[y], 1) == band[x]
            out.append((x[first].astype(np.int32), y[first].astype(np.int32)))
    return tuple(np.concatenate(z).astype(np.int64) for z in zip(*out, strict=True))


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Size of the intersection of sets[i] and sets[j], ascending arrays, for each pair."""
    used, inverse = np.unique(np.concatenate([i, j]), return_inverse=True)
    if len(used) < 16 or len(i) < 6 * len(used):
        out = np.zeros(len(i), np.int64)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            a, b = (sets[x], sets[y]) if len(sets[x]) < len(sets[y]) else (sets[y], sets[x])
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            out[k] = (b[at] == a).sum()
        return out
    values, place = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True)
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    counts = np.zeros((len(used), len(used)), np.float32)
    for low in range(0, len(values), 4096):
        s, e = np.searchsorted(place, [low, low + 4096])
        m = np.zeros((len(used), 4096), np.float32)
        m[owner[s:e], place[s:e] - low] = 1
        counts += m @ m.T
    return counts[inverse[: len(i)], inverse[len(i) :]].astype(np.int64)


def join(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, n_links, copy_of, kept of every row of docs: links() without the row keys."""
    return links(docs, **how).drop("k1", "k2")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document of each class of links(), that of the smallest doc_id; all columns stay.

    Of rows equal in doc_id and text any one stays. Rows without a doc_id stay but for those equal in text.
    """
    kept = links(docs, **how).where("kept OR doc_id IS NULL").select("k1", "k2").distinct()
    rows = docs.select(F.struct("*").alias("row"), *row_key("doc_id", "text"))
    return rows.join(kept, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row.*")


def links(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, block_runs: int = BLOCK_RUNS) -> DataFrame:
    """k1, k2 (the row's key), doc_id, class_id, n_links, copy_of, kept of every row of docs (doc_id, text).

    n_links counts the other documents whose sets have a Jaccard similarity >= threshold, class_id is the smallest doc_id
    to be reached by links, copy_of the smallest doc_id of the documents of the same words, kept says that class_id is the
    row's own. Words are runs of characters but ASCII white space, in lower case. A text of fewer than five words has one
    run, of all its words; null or empty texts, and rows without a doc_id, link with nothing. Repeated rows are documents
    of their own with one doc_id. An empty table gives no rows. Other columns are ignored.
    """
    bands, rows = choose_bands(threshold, recall)
    sigs = written(signatures(docs, words, bands, rows), "signatures")
    usable = sigs.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(usable.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    spread = classes.select("c1", "c2", "n", F.posexplode("bands").alias("band", "h")).select("c1", "c2", "n", "band", F.xxhash64("band", "h").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("runs")).where("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("runs") / block_runs)).cast("int")
    members = spread.join(shared, "bucket").withColumn("blocks", blocks).withColumn("own", F.expr("CAST(pmod(c1, blocks) AS int)"))
    tiled = members.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other")).select(
        "bucket", "band", F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), (F.col("own") > F.col("other")).cast("int").alias("side"), "c1", "c2"
    )
    tile = ["bucket", "t1", "t2"]
    light = tiled.join(classes.select("c1", "c2", "bands"), ["c1", "c2"])

    def needed(batches):  # the members of a tile that have anyone to be compared with in it
        for t in whole_groups(batches, tile, 4 << 20):
            i, j = _candidates(t, bands)
            some = np.zeros(t.num_rows, bool)
            some[i] = some[j] = True
            yield from t.filter(pa.array(some)).combine_chunks().to_batches()

    kind = "c1 bigint, c2 bigint, bucket bigint, band int, t1 int, t2 int, side int, bands array<bigint>"
    wanted = written(light.repartition("bucket", "t1", "t2").sortWithinPartitions(*tile, "side").select("c1", "c2", *tile[:1], "band", *tile[1:], "side", "bands").mapInArrow(needed, kind), "tiles")

    def full_sets(batches):
        for b in steps(batches, most=1 << 20):
            h, begin, c1, c2 = shingles(b.column("text"), words)
            sets = [np.unique(h[s:e]).tobytes() for s, e in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), pa.array(sets, pa.binary())], names=["c1", "c2", "runs"])

    asked = wanted.select("c1", "c2").distinct().join(classes.select("c1", "c2", F.col("rep").alias("doc_id")), ["c1", "c2"])
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(asked.select("doc_id").distinct(), "doc_id")
    sets = texts.mapInArrow(full_sets, "c1 bigint, c2 bigint, runs binary").dropDuplicates(["c1", "c2"])
    heavy = wanted.join(sets, ["c1", "c2"]).join(classes.select("c1", "c2", "rep", "copies"), ["c1", "c2"])

    def verify(batches):
        for t in whole_groups(batches, tile, 16 << 20):
            i, j = _candidates(t, bands)
            sets = [np.frombuffer(x, np.uint64) for x in t["runs"].to_pylist()]
            size = np.array([len(x) for x in sets])
            ok = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
            i, j = i[ok], j[ok]
            starts = np.flatnonzero(changes(t, tile))
            cut = np.searchsorted(i, [*starts[1:], t.num_rows])
            common = np.concatenate([np.empty(0, np.int64), *(overlaps(sets, i[s:e], j[s:e]) for s, e in zip([0, *cut[:-1]], cut, strict=True) if e > s)])
            linked = common >= threshold * (size[i] + size[j] - common) - 1e-9
            i, j = i[linked], j[linked]
            copies, rep, label = t["copies"].to_numpy(), t["rep"].to_numpy(), np.arange(t.num_rows)
            links = (np.bincount(i, copies[j], t.num_rows) + np.bincount(j, copies[i], t.num_rows)).astype(np.int64)
            unite(label, i, j)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([t["c1"].to_numpy()[some], t["c2"].to_numpy()[some], links[some], rep[some], rep[label[some]]], names=["c1", "c2", "links", "a", "b"])

    columns = [*tile, "band", "side", "c1", "c2", "rep", "copies", "bands", "runs"]
    found = written(heavy.select(columns).repartition(*tile).sortWithinPartitions(*tile, "side").mapInArrow(verify, "c1 bigint, c2 bigint, links bigint, a bigint, b bigint"), "links")
    linked = found.groupBy("c1", "c2").agg(F.sum("links").alias("links"))
    parts = components(found.select("a", "b"))
    known = classes.select("c1", "c2", "rep", "copies").join(linked, ["c1", "c2"], "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("c1", "c2", F.col("rep").alias("copy_of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class_id"))
    done = usable.select("k1", "k2", "doc_id", "c1", "c2").join(known, ["c1", "c2"]).select("k1", "k2", "doc_id", "class_id", "n_links", "copy_of")
    alone = sigs.where("n = 0 OR doc_id IS NULL").select("k1", "k2", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("doc_id").alias("copy_of"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))
