"""Shared by the training-data operators: row keys, written tables, and text as bytes in NumPy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared_dir, written  # noqa: F401

#: Most bytes of text that one NumPy step works on; a longer document makes a step alone.
STEP_BYTES = 2 << 20

def row_key(*cols: str) -> list[Column]:
    """Two 64-bit hashes of these columns, never null. Rows equal in them are one document: they get one answer each."""
    c = [F.col(x) for x in cols]
    return [F.xxhash64(*c).alias("k1"), F.xxhash64(F.lit(17), *reversed(c)).alias("k2")]


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text with null as empty, and the columns named; all others are left out, so that no name clashes."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows that hold at most so many bytes of text."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
            to = max(to, at + 1)
            yield b.slice(at, to - at)
            at = to


def as_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after the other, and where each begins (one more than rows). Null counts as empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) else "")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    ends = np.frombuffer(buffers[1], np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]] if buffers[2] is not None else np.empty(0, np.uint8)
    return data, ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E6C63D0876A9A35)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(32)
    return x


BASE = 0x2545F4914F6CDD1D  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        m = 1 << max(16, (n - 1).bit_length())
        _powers = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(m - 1, b, np.uint64))]) for b in (BASE, _INVERSE))
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], equal for equal bytes wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashes_in_steps(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """span_hashes() of ascending spans, of about so many bytes at a time."""
    out, low = np.empty(len(starts), np.uint64), 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + most, "right")))
        base = starts[low]
        out[low:high] = span_hashes(data[base : ends[low:high].max()], starts[low:high] - base, ends[low:high] - base)
        low = high
    return out


def ranges_of(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """starts[i], starts[i] + 1, ... counts[i] of them, for all i; and offsets."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return np.arange(ends[-1]) - np.repeat(ends[:-1] - starts, counts), ends


#: Word separators: the six ASCII white-space bytes. All other bytes belong to words.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, starts: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each maximal run of bytes that aren't separators, and the row it is in; no word crosses rows."""
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, z
    inside = ~between[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = starts[:-1][starts[:-1] < n]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0]
    last[cuts - 1] = inside[cuts - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return a, b, np.searchsorted(starts, a, "right") - 1
