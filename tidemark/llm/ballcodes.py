"""Vector code compression by ball k-means over the parts of vectors.

A vector of integers is cut into parts, each of which is replaced by the index of the nearest entry of its position's
codebook. Codebooks are learned by rounds of k-means, and no round compares a part with all entries: an entry and the parts
that it held before form a ball. Entries whose distance from a ball's entry is at most twice the ball's radius are its
neighbours; no part of the ball can be nearer to any other entry. A part nearer to its entry than half way to the first
neighbour lies in the stable core and keeps its code without any work. The half distances to the neighbours cut the rest of
the ball into rings: a part in the n-th ring is compared with the first n neighbours only, as others are farther by the
triangle inequality. Distances are squared integers, so that all comparisons and ties are exact.

Before the first round a part is put into the ball of the nearest of eight entries about its first coordinate; the argument
holds for any ball. A round reads the table of vectors and codes that the one before has written, and gathers sums by entry; only
codebooks pass through the driver and to the tasks: at most `entries` times a vector for each length of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are held within this, so that sums of squares stay exact in 64 bits (components beyond 262,144 at a scale of 256).
LARGEST = 1 << 26
#: Rows that are worked on at a time.
ROWS_AT_ONCE = 8192

Books = dict[int, list[np.ndarray]]  # by length of vectors: the entries of each part


def cuts(length: int, parts: int) -> list[int]:
    """Where parts begin, and the end: equal if the length is a multiple of their number, else they differ by one at most."""
    return [length * i // parts for i in range(parts + 1)]


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, dim, q array<int> = floor(scale * x), held within LARGEST. Without vectors that are null, or hold null, NaN or infinite components."""
    ok = F.expr("embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    whole = F.transform("embedding", lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.lit(float(scale)) * x.cast("double"))))
    rows = vectors.select("vec_id", "label", "embedding").where(ok)
    return rows.select("vec_id", "label", F.size("embedding").alias("dim"), F.transform(whole, lambda x: F.floor(x).cast("int")).alias("q"))


def _matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), dim)


def _squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(-1)


class Balls:
    """The entries of a codebook with, of each, all entries by their squared distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = _squares(entries[:, None] - entries[None, :])
        np.fill_diagonal(apart, -1)  # an entry itself comes first, before equal ones
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)

    def guess(self, x: np.ndarray, tries: int = 8) -> np.ndarray:
        """An entry near each part, the nearest of the few whose first coordinates lie about its own: a ball to begin with."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64)
        order = np.argsort(self.entries[:, 0], kind="stable")
        tries = min(tries, len(order))
        at = np.clip(np.searchsorted(self.entries[order, 0], x[:, 0]) - tries // 2, 0, len(order) - tries)
        tried = order[at[:, None] + np.arange(tries)]
        return np.take_along_axis(tried, _squares(x[:, None] - self.entries[tried]).argmin(1)[:, None], 1)[:, 0]

    def assign(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each part (ties to the lower index), its squared distance, and how many distances were computed. code: the balls that parts come from."""
        code, own = code.copy(), code
        best = _squares(x - self.entries[own])
        far = np.zeros(len(self.entries), np.int64)
        np.maximum.at(far, own, best)  # squared radii
        ring = np.zeros(len(x), np.int64)
        for ball in np.unique(own):
            mine = np.flatnonzero(own == ball)
            near = int(np.searchsorted(self.apart[ball], 4 * far[ball], "right"))  # the entry and its neighbours
            ring[mine] = np.searchsorted(self.apart[ball, :near], 4 * best[mine], "right")  # 1: stable core
        todo, computed = np.flatnonzero(ring > 1), len(x)
        start = np.sqrt(best.astype(np.float64))
        for n in range(1, len(self.entries)):
            todo = todo[ring[todo] > n]
            # what is found on the way narrows the ring: an entry at least as near is within both distances of the ball's entry
            todo = todo[self.apart[own[todo], n] <= (start[todo] + np.sqrt(best[todo].astype(np.float64))) ** 2 * (1 + 1e-12)]
            if not len(todo):
                break
            other = self.order[own[todo], n]
            d = _squares(x[todo] - self.entries[other])
            computed += len(todo)
            nearer = (d < best[todo]) | ((d == best[todo]) & (other < code[todo]))
            code[todo[nearer]], best[todo[nearer]] = other[nearer], d[nearer]
        return code, best, computed


def _encode(balls: dict[int, list[Balls]], parts: int):
    """mapInArrow: the table's rows with new codes and their squared error, from the codes that the rows hold (none: a guess)."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                dims = b.column("dim").to_numpy()
                for d in np.unique(dims).tolist():
                    rows = b.filter(pa.array(dims == d))
                    x, edge, books = _matrix(rows.column("q"), d), cuts(d, parts), balls[d]
                    old, n = rows.column("code"), rows.num_rows
                    held = None if old.null_count else np.frombuffer(b"".join(old.to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                    code, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                    for p in range(parts):
                        part = x[:, edge[p] : edge[p + 1]]
                        code[:, p], best, _ = books[p].assign(part, books[p].guess(part) if held is None else held[:, p])
                        error += best
                    raw = pa.array([r.tobytes() for r in code], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("vec_id", "label", "dim", "q")), raw, pa.array(error)], names=["vec_id", "label", "dim", "q", "code", "error"])

    return run


def _sums(parts: int):
    """mapInArrow: of each length, part, entry and position within the part how many vectors' parts are coded so, and their sum; one row each a task."""

    def run(batches):
        totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                rows = b.filter(pa.array(dims == d))
                x, edge = _matrix(rows.column("q"), d), cuts(d, parts)
                code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(x), parts).astype(np.int64)
                count, sums = totals.setdefault(d, (np.zeros((parts, 256), np.int64), np.zeros((d, 256), np.int64)))
                for p in range(parts):
                    count[p] += np.bincount(code[:, p], minlength=256)
                    for i in range(edge[p], edge[p + 1]):
                        np.add.at(sums[i], code[:, p], x[:, i])
        for d, (count, sums) in totals.items():
            edge = np.array(cuts(d, parts))
            part_of = np.searchsorted(edge, np.arange(d), "right") - 1
            i, entry = np.nonzero(count[part_of] > 0)
            columns = [np.full(len(i), d), i, entry, count[part_of[i], entry], sums[i, entry]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["dim", "i", "entry", "n", "total"])

    return run


def seeds(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> Books:
    """Codebooks that hold the parts of the first vectors by vec_id (null last), of each length of vectors; of equal vec_ids the smaller vector comes first."""
    out = {}
    for (d,) in rows.select("dim").distinct().collect():  # lengths of vectors
        first = rows.where(F.col("dim") == d).orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).toArrow()
        x, edge = _matrix(first["q"], d), cuts(d, parts)
        out[d] = [x[:, edge[p] : edge[p + 1]] for p in range(parts)]
    return out


def moved(books: Books, coded: DataFrame, parts: int = PARTS) -> Books:
    """Each entry replaced by the floor of the mean of its parts; unused entries stay."""
    kind = "dim bigint, i bigint, entry bigint, n bigint, total bigint"
    # one row for each entry and component of a codebook
    means = coded.select("dim", "q", "code").mapInArrow(_sums(parts), kind).groupBy("dim", "i", "entry").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    out = {d: [b.copy() for b in book] for d, book in books.items()}
    for r in means:
        edge = cuts(r["dim"], parts)
        p = int(np.searchsorted(edge, r["i"], "right")) - 1
        out[r["dim"]][p][r["entry"], r["i"] - edge[p]] = r["total"] // r["n"]
    return out


def digest(book: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for part in book for entry in part.tolist() for v in entry).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """(vec_id, label, dim, q, code, error) of every usable row of vectors (vec_id, embedding, label), and the final codebooks.

    code holds a byte for each part, error is the squared distance of q from its entries. Vectors that are null or hold
    null or non-finite components are dropped. Vectors of different lengths have codebooks of their own; one of a length
    that parts doesn't divide is cut as evenly as possible, so that some parts may be empty. Repeated rows count as often as
    they come, a null vec_id is kept and comes last among the seeds. Fewer rows than entries make fewer entries. An empty
    table gives no rows and no codebooks. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code holds one byte for each part")
    table = written(quantised(vectors, scale).withColumn("code", F.lit(None).cast("binary")), "quantised")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema) + ", error bigint"
    books = seeds(table, parts, entries)
    balls = lambda: {d: [Balls(b) for b in book] for d, book in books.items()}
    for _ in range(rounds):
        table = written(table.select("vec_id", "label", "dim", "q", "code").mapInArrow(_encode(balls(), parts), kind), "coded")
        books = moved(books, table, parts)
    return table.select("vec_id", "label", "dim", "q", "code").mapInArrow(_encode(balls(), parts), kind), books


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that compress() keeps. label_error sums over equal labels, nulls together."""
    coded, books = compress(vectors)
    coded = written(coded.select("vec_id", "label", "dim", "code", "error"), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    digests = coded.sparkSession.createDataFrame([(d, digest(b)) for d, b in books.items()], "dim int, codebooks_sha256 string")
    rows = coded.alias("a").join(by_label.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label"))).join(digests, "dim")
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The same rows in DuckDB SQL: all distances, no balls."""
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(
            f"a{n} AS (SELECT v.vec_id, v.label, v.p, v.x, (arg_min({{'e': b.e}}, [list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e])).e AS e,"
            f" min(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM v JOIN b{n} b ON v.p = b.p GROUP BY ALL)"
        )
        if n < ROUNDS:
            steps.append(
                f"m{n} AS (SELECT p, e, list(CAST(s // c - CASE WHEN s % c < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY i) AS x FROM (SELECT p, e, i, sum(x[i]) AS s, count(*) AS c FROM a{n}, range(1, len(x) + 1) r(i) GROUP BY p, e, i) GROUP BY p, e)"
            )
            steps.append(f"b{n + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m ON b.p = m.p AND b.e = m.e)")
    last = f"a{ROUNDS}"
    return f"""
WITH q AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), v AS MATERIALIZED (
  SELECT vec_id, label, CAST(p AS INTEGER) AS p, q[(p * len(q)) // {PARTS} + 1 : ((p + 1) * len(q)) // {PARTS}] AS x FROM q, range({PARTS}) r(p)
), b0 AS MATERIALIZED (
  SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id, x) AS INTEGER) - 1 AS e, x FROM v WHERE vec_id IN (SELECT vec_id FROM q ORDER BY vec_id LIMIT {ENTRIES})
), {", ".join(steps).replace(" AS (", " AS MATERIALIZED (")}, o AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM {last} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{ROUNDS}) AS codebooks_sha256
FROM o
"""


SQL = _sql()
