"""Byte-level BPE encoding and decoding of whole texts, long ones in overlapping chunks.

A text longer than `chunk_chars` is cut into chunks that overlap; every chunk is pre-tokenised by itself, in parallel.
The pre-tokeniser has no memory but its position, so from the first place where the boundaries of two neighbouring
chunks meet, both cut the rest alike: there the text is cut into pieces, and the pieces are encoded in parallel. A text
of which some overlap holds no common boundary (say a run of letters longer than the overlap) is encoded in one piece.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, row_key, steps, texts_of

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: Bytes of encoded pieces and their ids that a worker remembers; beyond them it starts anew.
CACHE_BYTES = 40 << 20
#: Most pieces that are put together in one step.
PIECES_AT_ONCE = 1 << 20
#: Bytes of text of a step.
TEXT_STEP = 4 << 20

_WHITE, _LETTER, _MARK = np.zeros((3, 256), bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LETTER[[i for i in range(128) if chr(i).isalpha()]] = True
_MARK[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def read_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes to rank, from a .tiktoken rank file or from the vocabulary of a byte-level tokenizers .json file; and the latter's added tokens."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, {}
    # byte-level vocabularies write a byte that is no printable Latin-1 character as chr(256 + how many such came before)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    added = {x["content"]: x["id"] for x in held.get("added_tokens", [])}
    return {bytes(back[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in added}, added


def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where texts (UTF-8 bytes, row starts) can be cut so that their pieces, encoded apart, give the same ids.

    White space after a character that isn't white space always begins a pre-token, and so does an ASCII mark after an
    ASCII letter.
    """
    cut = np.zeros(len(data), bool)
    cut[1:] = (_WHITE[data[1:]] & (data[:-1] > 32)) | (_LETTER[data[:-1]] & _MARK[data[1:]])
    some = np.flatnonzero(cut[1:] & (data[:-1] >= 128)) + 1  # the character before may be white space of two or three bytes: no cut after any that begins like one
    cut[some[(data[some - 2] == 0xC2) | ((data[some - 3] >= 0xE1) & (data[some - 3] <= 0xE3) & (some >= 3))]] = False
    cut[starts[:-1][np.diff(starts) > 0]] = True
    return np.flatnonzero(cut)


def binary(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """data cut at the offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


class Encoder:
    """Ids of texts. A column's different pieces are looked up; those not seen before are encoded in one go, as one text."""

    def __init__(self, path: str, pattern: str):
        ranks, self.added = read_ranks(path)
        self.engine = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max([*ranks.values(), *self.added.values()]) + 1
        back = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in self.added.items()}
        self.tokens = pa.array([back.get(i, b"") for i in range(self.size)], pa.binary())
        self.sizes = np.diff(np.frombuffer(self.tokens.buffers()[1], np.int32)[: self.size + 1]).astype(np.int64)
        self.pattern = regex.compile(pattern)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.known, self.held = pa.array([], pa.binary()), 0  # ids of each piece, 32 bits each

    def _learn(self, pieces: list[bytes]) -> None:
        """What follows a piece can't change how it is cut if it ends with another character than white space; others are encoded alone."""
        white = b" \t\n\v\f\r"
        order = [i for i, p in enumerate(pieces) if p[0] in white and (p[-1] > 32 if p[-1] < 128 else not p.decode()[-1].isspace())]
        ids = np.array(self.engine.encode_ordinary(b"".join([pieces[i] for i in order]).decode()), np.int64)
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(pieces[i]) for i in order])) + 1 if order else np.empty(0, np.int64)
        alone = np.setdiff1d(np.arange(len(pieces)), order).tolist()
        single = [np.array(self.engine.encode_ordinary(pieces[i].decode()), "<u4") for i in alone]
        flat, sizes = np.concatenate([ids.astype("<u4"), *single]), np.concatenate([np.diff(ends, prepend=0), [len(x) for x in single]]).astype(np.int64)
        known = len(self.known)
        self.known = pa.concat_arrays([self.known, binary(flat, np.concatenate([[0], np.cumsum(sizes)]) * 4)])
        self.number.update((pieces[i], known + k) for k, i in enumerate([*order, *alone]))
        self.held += 4 * len(flat) + sum(map(len, pieces)) + 200 * len(pieces)

    def _numbers(self, pieces: list[bytes]) -> np.ndarray:
        found = list(map(self.number.get, pieces))
        if None in found:
            if self.held > CACHE_BYTES:
                self._forget()
                found = [None] * len(pieces)
            self._learn([p for p, f in zip(pieces, found, strict=True) if f is None])
            found = list(map(self.number.__getitem__, pieces))
        return np.array(found, np.int64)

    def _plain(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, starts = as_bytes(col)
        cut = piece_starts(data, starts)
        offsets = np.append(cut, len(data))
        flat, counts = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for low in range(0, len(cut), PIECES_AT_ONCE):
            some = offsets[low : low + PIECES_AT_ONCE + 1]
            coded = binary(data[some[0] : some[-1]], some - some[0]).dictionary_encode()
            number = self._numbers(coded.dictionary.to_pylist())
            taken = self.known.take(pa.array(number[coded.indices.to_numpy()]))
            ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
            flat.append(np.frombuffer(taken.buffers()[2], "<u4")[ends[0] // 4 : ends[-1] // 4])
            counts.append(np.diff(ends) // 4)
        ids, upto = np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return ids, upto[np.searchsorted(cut, starts)]

    def encode_column(self, col: pa.Array, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after the other, and where each row's begin (one more than rows). added: strings of added tokens are these tokens."""
        if not (added and self.split and any(pc.any(pc.match_substring(col, t)).as_py() for t in self.added)):
            return self._plain(col)
        split = [self.split.split(t or "") for t in col.to_pylist()]
        texts = [t for parts in split for t in parts[::2]]
        ids, starts = self._plain(pa.array(texts, pa.string()))
        last = np.cumsum([(len(parts) + 1) // 2 for parts in split])  # texts up to each row's end
        gaps = np.setdiff1d(np.arange(len(texts)), last - 1)  # a token stands after each text but a row's last
        ids = np.insert(ids, starts[gaps + 1], [self.added[t] for parts in split for t in parts[1::2]])
        return ids, np.concatenate([[0], starts[last] + last - np.arange(1, len(last) + 1)])

    def encode(self, text: str, added: bool = False) -> np.ndarray:
        return self.encode_column(pa.array([text], pa.string()), added)[0]

    def decode(self, ids: np.ndarray) -> bytes:
        parts = self.tokens.take(pa.array(ids, pa.int64()))
        ends = np.frombuffer(parts.buffers()[1], np.int32)
        return parts.buffers()[2].to_pybytes()[ends[parts.offset] : ends[parts.offset + len(parts)]] if len(parts) else b""

    def decode_column(self, col: pa.Array) -> pa.Array:
        """Bytes of each row's ids (binary, 32 bits each)."""
        data, starts = as_bytes(col)
        ids = np.frombuffer(data, "<u4")
        upto = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        return binary(self.decode(ids), upto[starts // 4])

    def boundaries(self, text: str) -> list[int]:
        return [m.end() for m in self.pattern.finditer(text)]


@functools.lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, pattern)


def _hex(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def _encoded(df: DataFrame, path: str, pattern: str, keep: list[str], schema: str) -> DataFrame:
    """keep, and the ids of text as little-endian unsigned 32-bit integers."""

    def run(batches):
        e = encoder(path, pattern)
        for b in steps(batches, most=TEXT_STEP):
            ids, starts = e.encode_column(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), binary(ids, starts * 4)], names=[*keep, "ids"])

    return df.select(*keep, "text").mapInArrow(run, schema + ", ids binary")


def encode(docs: DataFrame, path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, ids binary) of every row of docs (doc_id, text); ids are little-endian unsigned 32-bit integers.

    Null text counts as empty and has no ids. Rows equal in doc_id and text are one document, encoded once if they are
    long, and come out as often as they came in; rows that share a doc_id only are separate. Other columns are ignored.
    """
    texts = texts_of(docs).withColumn("n", F.length("text"))
    short = _encoded(texts.where(F.col("n") <= chunk_chars), path, pattern, ["doc_id"], "doc_id bigint")
    long = texts.where(F.col("n") > chunk_chars).select(*row_key("doc_id", "text"), "doc_id", "text")
    arrow = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("text", pa.string())])

    def cut(batches):  # a chunk runs on into the next by the overlap
        for b in steps(batches):
            for k1, k2, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "doc_id", "text")), strict=True):
                parts = [text[i : i + chunk_chars + overlap] for i in range(0, len(text), chunk_chars)]
                n = len(parts)
                yield pa.RecordBatch.from_pydict({"k1": [k1] * n, "k2": [k2] * n, "doc_id": [doc_id] * n, "chunk": range(n), "chunks": [n] * n, "text": parts}, schema=arrow)

    def bounds(batches):  # boundaries in the overlap with the chunk before and with the chunk after, counted from the overlap's start
        e = encoder(path, pattern)
        for b in steps(batches):
            heads, tails = [], []
            for text in b.column("text").to_pylist():
                found = e.boundaries(text)
                heads.append([x for x in [0, *found] if x < overlap and x < len(text)])
                # a pre-token that ends with the chunk may go on beyond it, and the one before it may depend on what follows
                tails.append([x - chunk_chars for x in found[:-2] if x >= chunk_chars])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=["k1", "k2", "chunk", "heads", "tails"])

    key = ["k1", "k2", "chunk"]
    # the only exchange of texts; equal documents meet in it and are encoded once
    spread = long.mapInArrow(cut, "k1 bigint, k2 bigint, doc_id bigint, chunk int, chunks int, text string").groupBy(*key).agg(
        F.first("doc_id").alias("doc_id"), F.first("chunks").alias("chunks"), F.first("text").alias("text"), F.count("*").alias("copies")
    )
    order, whole = Window.partitionBy("k1", "k2").orderBy("chunk"), Window.partitionBy("k1", "k2")
    cuts = (
        spread.select(*key, "text").mapInArrow(bounds, "k1 bigint, k2 bigint, chunk int, heads array<int>, tails array<int>")
        .withColumn("cut", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("heads", F.lag("tails").over(order)))))
        .select(*key, "cut", F.lead("cut").over(order).alias("end"), F.min(F.col("cut").isNotNull()).over(whole).alias("all_met"))
    )
    met = spread.join(cuts, key)
    size = f"CASE WHEN chunk = chunks - 1 THEN {chunk_chars + overlap} ELSE {chunk_chars} + end - cut END"
    pieces = met.where("all_met").select(*key, "doc_id", "copies", F.expr(f"substring(text, cut + 1, {size})").alias("text"))
    rejoined = (
        met.where("NOT all_met").groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("parts"))
        .select("k1", "k2", F.lit(0).alias("chunk"), "doc_id", "copies", F.expr(f"array_join(transform(parts, x -> substring(x.text, 1, {chunk_chars})), '')").alias("text"))
    )
    coded = _encoded(pieces.unionByName(rejoined), path, pattern, [*key, "doc_id", "copies"], "k1 bigint, k2 bigint, chunk int, doc_id bigint, copies bigint")
    ids = coded.groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))

    def join(batches):  # the parts of a row lie one after the other already
        for b in batches:
            data, starts = as_bytes(b.column("parts").flatten())
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column("parts")).to_numpy())])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copies"), binary(data, starts[ends])], names=["doc_id", "copies", "ids"])

    whole_ids = ids.select("doc_id", "copies", F.transform("parts", lambda x: x["ids"]).alias("parts")).mapInArrow(join, "doc_id bigint, copies bigint, ids binary")
    joined = whole_ids.select("doc_id", "ids", F.explode(F.expr("sequence(1, copies)")))
    return short.unionByName(joined.select("doc_id", "ids"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the raw bytes of the ids, concatenated."""

    def run(batches):
        e = encoder(path, pattern)
        for b in steps(batches, "ids"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), e.decode_column(b.column("ids"))], names=["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encode, then decode what was encoded."""
    return decode(encode(docs, path, pattern), path, pattern).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
