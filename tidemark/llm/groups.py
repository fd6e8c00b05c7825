"""What the pair operators share: groups from sorted streams, pairs within groups, and local components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], most_bytes: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups, several at a time, from batches sorted by keys; a group is never cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size < most_bytes:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.flatnonzero(changes(table, keys))[-1]
        if last:
            yield table.slice(0, last)
            held = table.slice(last).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row begins a group."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = table[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def pairs_within(new: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), i < j, of rows of one group, in steps of about so many. Only for groups of bounded size."""
    n = len(new)
    group = np.cumsum(new) - 1
    ends = np.append(np.flatnonzero(new)[1:], n)[group]
    count = ends - np.arange(n) - 1  # of each row as i
    upto, low = np.cumsum(count), 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + most, "right")))
        some = count[low:high]
        i = np.repeat(np.arange(low, high), some)
        yield i, np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + i + 1
        low = high


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the components of a[i] and b[i]; label holds each element's root and stays compressed."""
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
