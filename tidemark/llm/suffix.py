"""Exact removal of repeated byte strings with merged Burrows-Wheeler transforms.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller doc_id. Suffixes are
never shuffled one by one. Winnowing samples anchors so that every string of `length` bytes selects one, and equal
strings select the same; a string is repeated only if its anchor occurs in another document too, which a filter on
anchor hashes decides. Strings with such anchors go, as contexts of their anchor, to the task that owns the anchor: a
shard sends each different context once, with the smallest doc_id that has it there, and keeps the places to itself.

At the owner the contexts of each shard have a suffix order and a Burrows-Wheeler transform of their own, and these are
merged: an interleave of the shards is refined by two symbols a pass, each a stable one, until it is right to the depth
of `length`; no suffix is sorted anew. The passes also tell where neighbours part, that is their common prefixes:
neighbours that haven't parted after `length` symbols form the repeated intervals, and the smallest doc_id of an interval
says which of its strings go.

Blocks of the interleave that share a prefix refine apart from all others. So an anchor with very many places isn't merged
in one task: its block is split by all further symbols at once, down to the blocks of equal strings, of which a shard
sends two hashes and the smallest doc_id; these are spread over all tasks.

Texts equal as a whole are one class: all but the first go entirely.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashes_in_steps, mix, powers, ranges_of, shared_dir, steps, texts_of, written

LENGTH, ANCHOR, SHARD_BYTES, MERGED_BYTES = 50, 24, 4 << 20, 1 << 17
#: Places of an anchor from which on its block is split into those of equal strings; places in a shard that a sketch counts.
HOT_PLACES, COUNTED = 1024, 8
#: Most tasks of a step; a task holds one shard at a time, however many it works on.
TASKS = 1 << 16
#: Transforms that a merge begins with: contexts are dealt to them by their shards.
TRANSFORMS = 8
_END = 0xFF  # a byte that UTF-8 never holds
_OTHER = np.random.default_rng(50).permutation(256).astype(np.uint8)  # bytes renamed, for a second hash


def anchors(data: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, first window, last window) of each anchor: the k bytes from there, and the range of the strings that select it.

    A string of `length` bytes selects the k-gram in it of least hash, of equal ones the last. Positions count from the
    row's start. Rows shorter than `length` have no strings. And the anchors' 64-bit hashes, as a fifth array.
    """
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none, np.empty(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    # hash above, position below: the least value of a window is its least hash, of equal ones the last
    key = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    w, have = length - k + 1, 1
    least = key
    while have < w:
        step = min(have, w - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    chosen = (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)  # by window's start
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(chosen)]
    window = np.flatnonzero(np.arange(len(chosen)) + length <= starts[row + 1])  # windows within one row
    if not len(window):
        return none, none, none, none, np.empty(0, np.uint64)
    at = chosen[window]
    new = np.ones(len(window), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[window[1:]] != row[window[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    r = row[window[first]]
    return r, at[first] - starts[r], window[first] - starts[r], window[last] - starts[r], mix(h[at[first]])  # mixed anew: least hashes lie close together


def _member(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values are among the ascending ones."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ascending, values)
    at[at == len(ascending)] = 0
    return ascending[at] == values


def packed_anchors(packed: list[bytes], length: int, k: int, most: int = 1 << 19) -> tuple[list[bytes], tuple[np.ndarray, ...]]:
    """The texts of compressed ones, and anchors() of them, a step of texts at a time."""
    raw = [zlib.decompress(x) for x in packed]
    found, low = [], 0
    while low < len(raw):
        high, size = low, 0
        while high < len(raw) and (high == low or size + len(raw[high]) <= most):
            size += len(raw[high])
            high += 1
        starts = np.concatenate([[0], np.cumsum([len(x) for x in raw[low:high]])]).astype(np.int64)
        row, *rest = anchors(np.frombuffer(b"".join(raw[low:high]), np.uint8), starts, length, k)
        found.append((row + low, *rest))
        low = high
    return raw, tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else anchors(np.empty(0, np.uint8), np.zeros(1, np.int64), length, k)


def suffix_order(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order of all rotations of strings that each end in _END: prefix doubling from eight symbols on, cyclic within a string."""
    n = len(data)
    nxt = np.arange(1, n + 1)
    nxt[starts[1:] - 1] = starts[:-1]
    longest, span = int(np.diff(starts).max()), 8
    key, at = data.astype(np.uint64), nxt
    for _ in range(span - 1):
        key = key << np.uint64(8) | data[at]
        at = nxt[at]
    while True:  # at: the symbol `span` places on
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], s[1:] != s[:-1]]), dtype=np.uint64)
        if span >= longest or rank[order[-1]] == n - 1:
            return order
        key = rank << np.uint64(32) | rank[at]
        at, span = at[at], 2 * span


def merged_intervals(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges the transforms of shards, each (bytes, string starts), to the given depth.

    Returns, in the merged order of suffixes, each one's shard, its place in the shard's bytes, and the number of its
    interval: suffixes share an interval if they share their first `depth` symbols.
    """
    orders = [suffix_order(data, starts) for data, starts in shards]
    single, double, base = [], [], 0
    for (data, starts), order in zip(shards, orders, strict=True):
        before = np.arange(-1, len(data) - 1)
        before[starts[:-1]] = starts[1:] - 1  # what precedes a string's start is its own end
        rank = np.empty(len(data), np.int32)
        rank[order] = np.arange(base, base + len(data), dtype=np.int32)
        one = before[order]
        two = before[one]
        # the symbols in front, and where the suffix longer by them stands in its shard's order
        single.append((data[one], rank[one]))
        double.append((data[two].astype(np.uint16) << np.uint16(8) | data[one], rank[two]))
        base += len(data)
    at = np.arange(base, dtype=np.int32)  # of each shard's suffixes, in the shard's order: the place in the interleave
    every, block, part = np.arange(base, dtype=np.int32), np.zeros(base, np.int32), np.zeros(base, bool)
    for passes, transforms in ((depth % 2, single), (depth // 2, double)):
        chars, front = (np.concatenate(x) for x in zip(*transforms, strict=True))
        symbol, to, moved = np.empty_like(chars), np.empty(base, np.int32), np.empty(base, np.int32)
        for _ in range(passes):
            symbol[at] = chars
            move = np.argsort(symbol, kind="stable")  # a suffix with those symbols in front goes where suffixes that begin with them stand
            to[move] = every
            moved[front] = to[at]
            at, moved = moved, at
            s, b = symbol[move], block[move]
            part[1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])  # here the common prefix with the one before ends
            block = np.cumsum(part, dtype=np.int32)
            if block[-1] == base - 1:
                break
    source, place = np.empty(base, np.int32), np.empty(base, np.int64)
    source[at] = np.repeat(np.arange(len(shards), dtype=np.int32), [len(x) for x in orders])
    place[at] = np.concatenate(orders)
    return source, place, block


def _least_by_string(contexts: list[bytes], shard: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each string of `length` bytes, context by context, the smallest doc_id of any context that holds it."""
    order = np.argsort(shard, kind="stable")
    shards, where, offsets = [], [], []
    for s in np.unique(shard):
        mine = order[np.searchsorted(shard[order], s) : np.searchsorted(shard[order], s, "right")]
        size = np.array([len(contexts[i]) + 1 for i in mine])
        starts = np.concatenate([[0], np.cumsum(size)])
        shards.append((np.frombuffer(b"".join(contexts[i] + bytes([_END]) for i in mine), np.uint8), starts))
        where.append(np.repeat(mine, size))
        offsets.append(np.arange(starts[-1]) - np.repeat(starts[:-1], size))
    source, place, block = merged_intervals(shards, length)
    base = np.concatenate([[0], np.cumsum([len(x) for x in where])])
    at = base[source] + place
    context, offset = np.concatenate(where)[at], np.concatenate(offsets)[at]
    least = np.full(int(block[-1]) + 1, np.iinfo(np.int64).max)
    size = np.array([len(c) for c in contexts])
    whole = offset <= size[context] - length  # others have an end within
    np.minimum.at(least, block[whole], doc[context[whole]])
    out = np.empty(int((size - length + 1).sum()), np.int64)
    out[(np.cumsum(size - length + 1) - (size - length + 1))[context[whole]] + offset[whole]] = least[block[whole]]
    return out


#: A different context of a shard on its way to its anchor's task: anchor's hash, smallest document, length.
_SENT = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("size", "<u2")])
#: A different string of an anchor with many places: its hashes, smallest document.
_STRING = np.dtype([("hash", "<u8"), ("other", "<u8"), ("doc", "<i8")])
#: Strings of a shard's context, by its number, that repeat one of a smaller document: the first and the last, by their offset in the context.
_FOUND = np.dtype([("number", "<u4"), ("first", "<u2"), ("last", "<u2")])
#: Where a shard has a context: its number, row, first string's start.
_PLACE = np.dtype([("number", "<u4"), ("row", "<u4"), ("start", "<u4")])


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys (the first counts most) are neighbours, and where each group of equal ones begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    return order, np.flatnonzero(new)


def _least_of_groups(order: np.ndarray, begins: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place its group's number; and of each group the smallest document."""
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(order)))
    return group, np.minimum.reduceat(doc[order], begins) if len(begins) else np.empty(0, np.int64)


def _repeated_contexts(shard: np.ndarray, number: np.ndarray, sent: np.ndarray, text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, _FOUND) for all contexts of some anchors: which of their strings occur in a context of a smaller document."""
    data, ends = np.frombuffer(text, np.uint8), np.cumsum(sent["size"], dtype=np.int64)
    starts = ends - sent["size"]
    order, begins = _groups(sent["hash"], hashes_in_steps(data, starts, ends))
    group, least = _least_of_groups(order, begins, sent["doc"])
    one = order[begins]  # some place of each different context
    anchor = sent["hash"][one]
    alike = np.zeros(len(one), bool)
    alike[1:] = anchor[1:] == anchor[:-1]
    alike[:-1] |= alike[1:]
    several = np.flatnonzero(alike)  # of an anchor with one context only, the context's smallest document holds for all its strings
    strings = np.zeros(len(one), np.int64)
    strings[several] = sent["size"][one[several]].astype(np.int64) - length + 1
    first = np.cumsum(strings) - strings
    mins = np.empty(int(strings.sum()), np.int64)
    # strings of different anchors never are equal, so an anchor is merged with a few others at a time, in a CPU's cache
    upto, low = np.cumsum(sent["size"][one[several]], dtype=np.int64), 0
    cuts = np.flatnonzero(anchor[several][1:] != anchor[several][:-1]) + 1
    while low < len(several):
        high = int(np.searchsorted(upto, (upto[low - 1] if low else 0) + MERGED_BYTES))
        k = int(np.searchsorted(cuts, max(high, low + 1)))
        high = int(cuts[k]) if k < len(cuts) else len(several)
        some = several[low:high]
        contexts = [text[a:b] for a, b in zip(starts[one[some]].tolist(), ends[one[some]].tolist(), strict=True)]
        mins[first[some[0]] : first[some[-1]] + strings[some[-1]]] = _least_by_string(contexts, shard[one[some]] % TRANSFORMS, least[some], length)
        low = high
    doc, last = sent["doc"], sent["size"].astype(np.int64) - length
    whole = np.flatnonzero(~alike[group] & (least[group] < doc))
    some = np.flatnonzero(alike[group])
    flat, at = ranges_of(first[group[some]], strings[group[some]])
    owner = np.repeat(some, np.diff(at))
    gone = mins[flat] < doc[owner]
    edge = np.zeros(len(gone) + 1, bool)
    edge[at[:-1]] = True
    begin, end = gone.copy(), gone.copy()
    begin[1:] &= ~gone[:-1] | edge[1:-1]
    end[:-1] &= ~gone[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end)
    offset = np.arange(len(gone)) - np.repeat(at[:-1], np.diff(at))
    found = np.empty(len(whole) + len(begin), _FOUND)
    at = np.concatenate([whole, owner[begin]])
    found["number"] = number[at]
    found["first"], found["last"] = np.concatenate([np.zeros(len(whole), np.int64), offset[begin]]), np.concatenate([last[whole], offset[end]])
    return shard[at], found


def repeated_strings(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """h1, h2 (hashes of a text), doc_id (the first that has it), removed binary: pairs of unsigned 32-bit [start, end) byte ranges."""
    spark = docs.sparkSession
    texts = texts_of(docs).where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(11), "text").alias("h2"), "text")
    total = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0  # one number
    shards = max(1, -(-total // shard_bytes))
    bits = np.uint64(min(32, max(8, (shards - 1).bit_length())))  # anchors are dealt by so many leading bits of their hashes
    tasks = min(shards, TASKS)

    def pack(batches):  # a task sends equal texts once, compressed, and later only their smallest doc_id
        seen: dict[tuple[int, int], int] = {}
        later: dict[tuple[int, int], int] = {}
        names = ["shard", "h1", "h2", "doc_id", "packed"]

        def rest():
            rows = [(h1 % shards, h1, h2, doc) for (h1, h2), doc in later.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), pa.nulls(len(rows), pa.binary())], names=names)

        for b in steps(batches):
            if len(seen) > 100_000:
                yield from rest()
                seen.clear()
                later.clear()
            rows: list[list] = [[], [], [], [], []]
            for doc, h1, h2, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "h1", "h2", "text")), strict=True):
                if (h1, h2) in seen:
                    if doc < min(seen[h1, h2], later.get((h1, h2), doc + 1)):
                        later[h1, h2] = doc
                    continue
                seen[h1, h2] = doc
                for column, value in zip(rows, (h1 % shards, h1, h2, doc, zlib.compress(text.encode(), 1)), strict=True):
                    column.append(value)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(r, pa.int64()) for r in rows[:4]), pa.array(rows[4], pa.binary())], names=names)
        yield from rest()

    classes = (
        texts.mapInArrow(pack, "shard bigint, h1 bigint, h2 bigint, doc_id bigint, packed binary").repartition(tasks, "shard")
        .groupBy("shard", "h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("packed", ignorenulls=True).alias("packed"))
    )
    # bucketed by shard: later steps join what they learn about a shard to its texts without moving the texts again
    table = f"tidemark_texts_{uuid.uuid4().hex}"
    classes.write.bucketBy(tasks, "shard").option("compression", "none").option("path", f"{shared_dir(spark)}/tidemark/{table}").saveAsTable(table)
    held = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # forgets the name; the files stay, as results are lazy

    def sketch(batches):  # by bucket, the 32 bits after those of the bucket of a shard's anchors; twice if in several documents; and of frequent ones the number of places
        for b in steps(batches, "packed"):
            _, (row, _, _, _, h) = packed_anchors(b.column("packed").to_pylist(), length, anchor)
            shard = b.column("shard").to_numpy()[row]
            for s in np.unique(shard):
                mine = shard == s
                value, doc = h[mine] >> (np.uint64(32) - bits), row[mine]
                order = np.argsort(value, kind="stable")  # rows ascend, so those of a value do
                value, doc = value[order], doc[order]
                new = np.ones(len(value), bool)
                new[1:] = value[1:] != value[:-1]
                begins = np.flatnonzero(new)
                size = np.diff(begins, append=len(value))
                second = np.zeros(len(value), bool)  # of another document than the one before it, for the first time
                second[1:] = ~new[1:] & (doc[1:] != doc[:-1])
                _, at = np.unique(np.cumsum(new)[second], return_index=True)
                new[np.flatnonzero(second)[at]] = True
                values, frequent, places = value[new], value[begins[size >= COUNTED]], size[size >= COUNTED]
                bucket, other = (values >> np.uint64(32)).astype(np.int64), (frequent >> np.uint64(32)).astype(np.int64)
                cut = np.flatnonzero(np.diff(bucket)) + 1
                if len(values):
                    names = bucket[np.concatenate([[0], cut])]
                    counted = np.stack([frequent.astype("<u4"), places.astype("<u4")], 1)
                    many = [x.tobytes() for x in np.split(counted, np.searchsorted(other, names[1:]))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names), pa.array(np.full(len(names), s)), pa.array([x.astype("<u4").tobytes() for x in np.split(values, cut)], pa.binary()), pa.array(many, pa.binary())],
                        names=["bucket", "shard", "values", "many"],
                    )

    def repeated(table: pa.Table) -> pa.Table:  # values in several documents, and which of these have very many places
        raw = [np.frombuffer(x, "<u4") for x in table["values"].to_pylist()]
        every, count = np.unique(np.concatenate(raw), return_counts=True)
        many = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 2) for x in table["many"].to_pylist()])
        np.add.at(count, np.searchsorted(every, many[:, 0]), many[:, 1])
        twice, hot = every[count > 1], every[count >= HOT_PLACES]
        hit = _member(np.concatenate(raw), twice)
        found = [np.unique(x[h]) for x, h in zip(raw, np.split(hit, np.cumsum([len(x) for x in raw])[:-1]), strict=True)]
        columns = {"values": [x.tobytes() for x in found], "hot": [x[_member(x, hot)].tobytes() for x in found]}
        return pa.table({"shard": table["shard"], "bucket": table["bucket"], **{k: pa.array(v, pa.binary()) for k, v in columns.items()}}).filter(pa.array([len(x) > 0 for x in found]))

    blobs = held.mapInArrow(sketch, "bucket bigint, shard bigint, values binary, many binary")
    marked = written(blobs.groupBy("bucket").applyInArrow(repeated, "shard bigint, bucket bigint, values binary, hot binary"), "anchors")
    kinds = {"kind": pa.int32(), "bucket": pa.int64(), "shard": pa.int64(), "base": pa.int64(), "sent": pa.binary(), "texts": pa.binary()}

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in kinds}

        def send(kind: int, bucket: np.ndarray, sent: np.ndarray, base: int, text=None) -> None:  # in order of the bucket
            cut = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
            for low, high in zip(cut[:-1], cut[1:], strict=True):
                packed = zlib.compress(text(low, high), 1) if text else b""
                for k, v in zip(kinds, (kind, int(bucket[low]), shard, base + low, zlib.compress(sent[low:high].tobytes(), 1), packed), strict=True):
                    out[k].append(v)

        if left.num_rows and right.num_rows:
            shard = left["shard"][0].as_py()
            left = left.sort_by([("h1", "ascending"), ("h2", "ascending")])
            raw, (row, _, first, last, h) = packed_anchors(left["packed"].to_pylist(), length, anchor)
            named = lambda c: np.sort(np.concatenate([np.frombuffer(v, "<u4").astype(np.uint64) | np.uint64(b << 32) for b, v in zip(right["bucket"].to_pylist(), right[c].to_pylist(), strict=True)]))
            keep = _member(h >> (np.uint64(32) - bits), named("values"))
            row, first, last, h = (z[keep] for z in (row, first, last, h))
            hot = _member(h >> (np.uint64(32) - bits), named("hot"))
            doc, whole = left["doc_id"].to_numpy()[row], b"".join(raw)
            data, begin = np.frombuffer(whole, np.uint8), np.cumsum([0, *map(len, raw)])[row] + first
            size = last - first + length
            # each different context once, its places by its number
            r, b, n, d = row[~hot], begin[~hot], size[~hot], doc[~hot]
            order, at = _groups(h[~hot], hashes_in_steps(data, b, b + n))
            group, least = _least_of_groups(order, at, d)
            one = order[at]
            sent = np.empty(len(one), _SENT)
            sent["hash"], sent["doc"], sent["size"] = h[~hot][one], least, n[one]
            low, high = b[one].tolist(), (b + n)[one].tolist()
            send(0, (sent["hash"] >> (np.uint64(64) - bits)).astype(np.int64), sent, 0, lambda i, j: b"".join([whole[x:y] for x, y in zip(low[i:j], high[i:j], strict=True)]))
            places = np.empty(len(group), _PLACE)
            places["number"], places["row"], places["start"] = group, r, first[~hot]
            # each different string of anchors with many places once
            start, at = ranges_of(begin[hot], size[hot] - length + 1)
            owner = np.repeat(np.flatnonzero(hot), np.diff(at))
            one_hash, two_hash = hashes_in_steps(data, start, start + length), hashes_in_steps(_OTHER[data], start, start + length) if len(start) else np.empty(0, np.uint64)
            order, at = _groups(one_hash, two_hash)
            group, least = _least_of_groups(order, at, doc[owner])
            strings = np.empty(len(at), _STRING)
            strings["hash"], strings["other"], strings["doc"] = one_hash[order[at]], two_hash[order[at]], least
            send(1, (strings["hash"] >> (np.uint64(64) - bits)).astype(np.int64), strings, len(sent))
            more = np.empty(len(group), _PLACE)
            more["number"], more["row"], more["start"] = group + len(sent), row[owner], start - begin[owner] + first[owner]
            sizes = np.concatenate([sent["size"], np.full(len(strings), length)]).astype("<u2")
            for k, v in zip(kinds, (2, 0, shard, 0, zlib.compress(np.concatenate([places, more]).tobytes(), 1), zlib.compress(sizes.tobytes(), 1)), strict=True):
                out[k].append(v)
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    def resolve(table: pa.Table) -> pa.Table:
        merged = table["kind"][0].as_py() == 0
        sent = [np.frombuffer(zlib.decompress(x), _SENT if merged else _STRING) for x in table["sent"].to_pylist()]
        shard = np.repeat(table["shard"].to_numpy(), [len(x) for x in sent])
        number = np.concatenate([np.arange(b, b + len(x)) for b, x in zip(table["base"].to_pylist(), sent, strict=True)])
        x = np.concatenate(sent)
        if merged:
            owner, found = _repeated_contexts(shard, number, x, b"".join([zlib.decompress(t) for t in table["texts"].to_pylist()]), length)
        else:
            group, least = _least_of_groups(*_groups(x["hash"], x["other"]), x["doc"])
            gone = least[group] < x["doc"]
            owner, found = shard[gone], np.zeros(int(gone.sum()), _FOUND)
            found["number"] = number[gone]
        order = np.argsort(owner, kind="stable")
        names, at = np.unique(owner[order], return_index=True)
        parts = np.split(found[order], at[1:]) if len(names) else []
        return pa.table({"shard": pa.array(names, pa.int64()), "kind": pa.array([0] * len(names), pa.int32()), "sent": pa.array([zlib.compress(v.tobytes(), 1) for v in parts], pa.binary()), "texts": pa.nulls(len(names), pa.binary())})

    found_kinds = "shard bigint, kind int, sent binary, texts binary"
    dealt = written(held.groupBy("shard").cogroup(marked.groupBy("shard")).applyInArrow(contexts, "kind int, bucket bigint, shard bigint, base bigint, sent binary, texts binary"), "contexts")
    # as many tasks as shards: the bytes are few for the work on them, so joining small partitions would make long tasks
    found = dealt.where("kind < 2").repartition(tasks, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(resolve, found_kinds)
    known = written(found, "repeats").unionByName(dealt.where("kind = 2").select("shard", "kind", "sent", "texts"))

    def ranges(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("h1", "ascending"), ("h2", "ascending")])
        spans: list[bytes] = [b""] * left.num_rows
        by = {k: [(zlib.decompress(a), b) for j, a, b in zip(right["kind"].to_pylist(), right["sent"].to_pylist(), right["texts"].to_pylist(), strict=True) if j == k] for k in (0, 2)} if right.num_rows else {2: []}
        if left.num_rows and by[2]:
            place, size = np.frombuffer(by[2][0][0], _PLACE), np.frombuffer(zlib.decompress(by[2][0][1]), "<u2").astype(np.int64)
            found = np.concatenate([np.frombuffer(v, _FOUND) for v, _ in by[0]] or [np.empty(0, _FOUND)])
            found = found[np.argsort(found["number"], kind="stable")]
            doc = left["doc_id"].to_numpy()[place["row"]]
            least = np.full(len(size), np.iinfo(np.int64).max)
            np.minimum.at(least, place["number"], doc)
            again = doc > least[place["number"]]  # a context of a smaller document of this shard
            whole, rest = place[again], place[~again]
            begins = np.searchsorted(found["number"], rest["number"])
            at, cut = ranges_of(begins, np.searchsorted(found["number"], rest["number"], "right") - begins)
            each = np.repeat(np.arange(len(rest)), np.diff(cut))
            row = np.concatenate([whole["row"], rest["row"][each]]).astype(np.int64)
            low = np.concatenate([whole["start"], rest["start"][each].astype(np.int64) + found["first"][at]]).astype(np.int64)
            high = np.concatenate([whole["start"] + size[whole["number"]], rest["start"][each].astype(np.int64) + found["last"][at] + length]).astype(np.int64)
            order = np.lexsort((low, row))
            row, low, high = row[order], low[order], high[order]
            offset = row << 33  # rows apart, so that one running maximum serves all
            top = np.maximum.accumulate(high + offset) if len(row) else high
            new = np.ones(len(row), bool)
            new[1:] = (low + offset)[1:] > top[:-1]
            first = np.flatnonzero(new)
            end = top[np.append(first[1:], len(row)) - 1] - offset[first] if len(row) else top
            both, row = np.stack([low[first], end], 1).astype("<u4"), row[first]
            names, cut = np.unique(row, return_index=True)
            for r, x in zip(names.tolist(), np.split(both, cut[1:]), strict=False):
                spans[r] = x.tobytes()
        return pa.table({"h1": left["h1"], "h2": left["h2"], "doc_id": left["doc_id"], "packed": left["packed"], "removed": pa.array(spans, pa.binary())})

    return held.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(ranges, "h1 bigint, h2 bigint, doc_id bigint, packed binary, removed binary")


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text).

    Null text counts as empty. A row without a doc_id comes before and after none: it loses nothing and takes nothing from
    others. Repeated rows get the same answer, once each, and don't count as repeats of each other. Texts shorter than
    `length` bytes lose nothing. An empty table gives no rows. Other columns are ignored.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "packed"):
            removed, count, sha = [], [], []
            for packed, spans in zip(b.column("packed").to_pylist(), b.column("removed").to_pylist(), strict=True):
                cut = np.frombuffer(spans, "<u4").reshape(-1, 2).tolist()
                raw, at, h = zlib.decompress(packed), 0, hashlib.sha256()
                for low, high in cut:
                    h.update(raw[at:low])
                    at = high
                h.update(raw[at:])
                removed.append(sum(high - low for low, high in cut))
                count.append(len(cut))
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("h1", "h2", "doc_id")), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)], names=["h1", "h2", "first", "removed", "spans", "sha"])

    first = repeated_strings(docs, length).mapInArrow(digest, "h1 bigint, h2 bigint, first bigint, removed bigint, spans bigint, sha string")
    rows = texts_of(docs).select(
        "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(11), "text").alias("h2"), F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.when(F.col("doc_id").isNull() | (F.octet_length("text") < length), F.sha2("text", 256)).alias("own"),
    )
    none = F.col("own").isNotNull()
    again = F.col("doc_id") > F.col("first")
    return rows.join(first, ["h1", "h2"], "left").select(
        "doc_id", "n_bytes",
        F.when(none, 0).when(again, F.col("n_bytes")).otherwise(F.col("removed")).cast("bigint").alias("n_removed"),
        F.when(none, 0).when(again, 1).otherwise(F.col("spans")).cast("bigint").alias("n_spans"),
        F.when(none, F.col("own")).when(again, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
