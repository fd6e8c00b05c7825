"""Exact top-k search by inner product with a pivot table.

Vectors are quantised to integers. Pivots are chosen by spread from a bounded sample: each is the vector farthest from those
before it; the origin is one too. The table, built once and written, holds every vector's distances to all pivots. By the
triangle inequality each pivot gives a lower bound of the distance of two vectors, the difference of their distances to it;
the largest counts, and with the norms (distances to the origin) it bounds the inner product from above.

A query begins with the k-th best score of the sample. Candidates lie in groups that are near in their distances: a group
whose intervals of distances rule it out is never looked at. The others' candidates are bounded by the maximum over all
pivots, and those that are left by what all distances allow jointly (the product of their placements in the pivots' space).
They are evaluated in the order of their bounds, and a query stops for good when the next bound lies below its k-th best
score. Queries and candidates are dealt in blocks, and a task compares one block of either; a query's best of each block are
merged at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Most vectors of a block; smaller blocks are made while there are fewer pairs of blocks than tasks at a time.
QUERY_BLOCK, CANDIDATE_BLOCK, LEAST_BLOCK = 16_384, 32_768, 2048
#: Vectors that pivots are chosen from, pivots for each component, candidates that a query evaluates before it looks at the bounds again, candidates of a group.
SAMPLE, PIVOTS, AT_ONCE, GROUP = 4096, 0.75, 256, 64
_LONGEST = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, q array<bigint> = floor(scale * x) for each component; without vectors that are null, empty, or hold null, NaN or infinite components."""
    ok = F.expr("embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    return vectors.select("vec_id", "embedding").where(ok).where("vec_id IS NOT NULL").select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("q"))


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def pivots_of(sample: np.ndarray, share: float = PIVOTS) -> np.ndarray:
    """The origin, and share * components vectors of the sample, at least one and at most all, each the farthest from those before."""
    x = sample.astype(np.float64)
    if not len(x):
        return np.zeros((1, sample.shape[1]))
    chosen = [int(np.argmax((x * x).sum(1)))]
    near = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(max(1, int(share * x.shape[1])), len(x)):
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return np.concatenate([np.zeros((1, x.shape[1])), x[chosen]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The table's entries: the distance of each vector to each pivot, the first of which is the origin."""
    f = x.astype(np.float64)
    out = np.empty((len(f), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((f - p) ** 2).sum(1))
    return out


def placements(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """What all distances together say of each vector: its coordinates in the space that the pivots span, and its distance from that space."""
    p = pivots[1:] / max(1.0, np.abs(pivots).max(initial=0))
    u, size, _ = np.linalg.svd(p.T, full_matrices=False) if len(p) else (np.zeros((pivots.shape[1], 0)), np.zeros(0), None)
    f = x.astype(np.float64)
    inside = f @ u[:, size > 1e-9 * max(size.max(initial=0), 1e-300)]
    return np.column_stack([inside, np.sqrt(np.maximum((f * f).sum(1) - (inside * inside).sum(1), 0))])


def _scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of a vector with several. float64 sums of integers below 2**53 are exact; others use Python's integers."""
    return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if exact else np.array([sum(int(a) * int(b) for a, b in zip(y, q, strict=True)) for y in x], object)


def _is_exact(q: np.ndarray, x: np.ndarray) -> bool:
    largest = lambda m: float(np.abs(m.astype(np.float64)).max()) if m.size else 1.0
    return max(largest(q), 1.0) * max(largest(x), 1.0) * q.shape[1] < 2.0**53


def best_of_block(qid: np.ndarray, q: np.ndarray, dq: np.ndarray, least: np.ndarray, xid: np.ndarray, x: np.ndarray, dx: np.ndarray, pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """(number of the query, vector, score) of each query's k best among x without its own id, ties to the smaller id, that reach `least`; and how many pairs were in groups looked at, bounded jointly, and scored.

    dq, dx: the table's entries.
    """
    exact = _is_exact(q, x)
    widest = int(np.argmax(dx.std(0)))  # groups are near in the distance that spreads most
    order = np.argsort(dx[:, widest], kind="stable")
    xid, x, dx = xid[order], x[order], dx[order]
    begin = np.arange(0, len(x), GROUP)
    low, high = np.minimum.reduceat(dx, begin), np.maximum.reduceat(dx, begin)
    tq, tx = placements(q, pivots), placements(x, pivots)
    by_pivot = np.ascontiguousarray(dx.T)
    norms, top = dx[:, 0] ** 2, float(dx[:, 0].max(initial=0))
    number, vector, score, seen = [], [], [], {"looked_at": 0, "bounded_jointly": 0, "scored": 0}
    for i in range(len(q)):
        if i % AT_ONCE == 0:
            joint = tq[i : i + AT_ONCE] @ tx.T  # what all distances allow together
        own = float(dq[i, 0])
        slack = 1e-9 * (own * top + 1) + 1e-12 * (own * own + top * top)
        apart = np.maximum(np.maximum(dq[i] - high, low - dq[i]).max(1), 0)  # of each group at least
        open_ = np.flatnonzero((own * own + high[:, 0] ** 2 - apart * apart) / 2 + slack >= least[i])
        some = (begin[open_][:, None] + np.arange(GROUP)).ravel()
        some = some[some < len(x)]
        seen["looked_at"] += len(some)
        few = 2 * len(some) < len(x)
        columns = by_pivot[:, some] if few else by_pivot  # else all at once, those of closed groups aside
        apart, now = np.zeros(columns.shape[1]), np.empty(columns.shape[1])
        for distance, mine in zip(columns, dq[i], strict=True):  # the largest lower bound of any pivot
            np.maximum(apart, np.abs(np.subtract(distance, mine, out=now), out=now), out=apart)
        apart = apart if few else apart[some]
        bound = (own * own + norms[some] - apart * apart) / 2 + slack
        kept = bound >= least[i]
        some, bound = some[kept], bound[kept]
        seen["bounded_jointly"] += len(some)
        bound = np.minimum(bound, joint[i % AT_ONCE, some] + slack)
        kept = bound >= least[i]
        some, bound = some[kept], bound[kept]
        by = np.argsort(-bound)
        some, bound = some[by], bound[by]
        best_id, best = np.empty(0, xid.dtype), np.empty(0, np.int64 if exact else object)
        for at in range(0, len(some), AT_ONCE):
            if len(best) == k and bound[at] < float(best[-1]):
                break
            now = some[at : at + AT_ONCE]
            now = now[xid[now] != qid[i]]
            seen["scored"] += len(now)
            best_id, best = np.concatenate([best_id, xid[now]]), np.concatenate([best, _scores(q[i], x[now], exact)])
            first = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[first], best[first]
        number.append(np.full(len(best), i))
        vector.append(best_id)
        score.append(best)
    return np.concatenate(number), np.concatenate(vector), np.concatenate(score), seen


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: float = PIVOTS, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors (vec_id, q array<bigint>) of largest inner product with each query.

    A query's own vec_id is no candidate. Ties go to the smaller vec_id. Vectors of another length than the query's are
    none either. Repeated vec_ids: each row is a candidate, so a vec_id can come more than once; query rows equal in
    vec_id and vector are one query and answered once, those that share the vec_id only are answered each by itself.
    Scores beyond the range of a long are held at its ends. Fewer than k candidates give fewer rows; an empty table gives
    none.
    """
    drawn = vectors.select("vec_id", "q").orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "q").limit(SAMPLE).toArrow()  # bounded
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(drawn["q"].to_pylist()):
        by_length.setdefault(len(v), []).append(i)
    sample = {n: (drawn["vec_id"].to_numpy()[at], _matrix(drawn["q"].take(pa.array(at)))) for n, at in by_length.items()}
    chosen = {n: pivots_of(x, pivots) for n, (_, x) in sample.items()}
    of = lambda n: chosen.get(n, np.zeros((1, n)))

    def enter(seek: bool):
        def run(batches):
            for b in batches:
                length = b.column("dim").to_numpy()
                for n in np.unique(length):
                    some = b.filter(pa.array(length == n))
                    q = _matrix(some.column("q"))
                    t = distances(q, of(int(n)))
                    columns = [*some.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, t.size + 1, t.shape[1], dtype=np.int32)), pa.array(t.ravel()))]
                    if seek:  # the k-th best score of the sample, none if it has fewer
                        ids, x = sample.get(int(n), (np.empty(0, np.int64), q[:0]))
                        least = np.full(len(q), -np.inf)
                        exact = _is_exact(q, x)
                        for i, own in enumerate(some.column("vec_id").to_pylist()):
                            s = _scores(q[i], x[ids != own], exact)
                            if len(s) >= k:
                                least[i] = float(np.sort(s)[-k])
                        columns.append(pa.array(least if len(q) else [], pa.float64()))
                    yield pa.RecordBatch.from_arrays(columns, names=[*some.schema.names, "entry", *(["least"] if seek else [])])

        return run

    dim = F.size("q").alias("dim")
    kind = "vec_id bigint, q array<bigint>, dim int"
    table = written(vectors.select("vec_id", "q", dim).mapInArrow(enter(False), f"{kind}, entry array<double>"), "pivot_table")
    asked = queries.select("vec_id", "q", dim).dropDuplicates(["vec_id", "q"]).mapInArrow(enter(True), f"{kind}, entry array<double>, least double")
    asked = written(asked.withColumn("key", F.xxhash64("vec_id", "q")), "queries")
    n, m = table.count(), asked.count()
    rows, tasks = max(1, -(-m // query_block)), vectors.sparkSession.sparkContext.defaultParallelism
    cols = max(1, -(-n // candidate_block), min(-(-n // LEAST_BLOCK), -(-tasks // rows)))
    copies = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    a = asked.select("*", F.pmod("key", F.lit(rows)).cast("int").alias("row")).select("*", copies(cols).alias("col"))
    b = table.select("*", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(cols)).cast("int").alias("col")).select("*", copies(rows).alias("row"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        number = x = s = np.empty(0, np.int64)
        if left.num_rows and right.num_rows:
            q, t = _matrix(left["q"]), _matrix(left["entry"])
            number, x, s, _ = best_of_block(left["vec_id"].to_numpy(), q, t, left["least"].to_numpy(), right["vec_id"].to_numpy(), _matrix(right["q"]), _matrix(right["entry"]), of(q.shape[1]), k)
        if s.dtype == object:
            s = np.array([max(-_LONGEST - 1, min(_LONGEST, v)) for v in s], np.int64)
        keys = [left[c].take(pa.array(number.astype(np.int64))) for c in ("vec_id", "key")]
        return pa.table({"query_id": keys[0], "key": keys[1], "vec_id": pa.array(x, pa.int64()), "score": pa.array(s, pa.int64())})

    near = a.groupBy("dim", "row", "col").cogroup(b.groupBy("dim", "row", "col")).applyInArrow(run, "query_id bigint, key bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    """top_k() of the rows whose vec_id is divisible by 100, against all rows."""
    q = quantised(vectors)
    return top_k(q, q.where("vec_id % 100 = 0"))


#: The same rows in DuckDB SQL.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
