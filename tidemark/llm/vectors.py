"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are rotated to their principal axes, so that the leading dimensions hold most of every product. Tiles are
ranges of the first coordinate, those of too many vectors (ties) split by a hash; two vectors of cosine t are at most sqrt(2 - 2t) apart in any coordinate, so only tiles
so near meet. Within a pair of tiles products are accumulated over the leading dimensions first; the rest of a product is
bounded by the product of the two suffix norms, and a pair is given up as soon as its cosine cannot reach the threshold.
What remains is decided by the cosine of the vectors as given, in double precision.

Equal vectors are one class and are compared once. A pair of tiles reports link counts and a spanning forest, not links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .groups import changes, unite, whole_groups

THRESHOLD, TILE, STEP_DIMS, ROWS_AT_ONCE = 0.9, 16_384, 16, 256
#: Vectors of a tile at least, while there are fewer pairs of tiles than tasks at a time.
LEAST_TILE = 2048

#: Vectors that can link: not null, and finite and not null in all components, not all zero.
USABLE = "embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x != 0)"


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes, the largest first, of the unit vectors of each length: from sums of products over all of them."""

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                u = _units(_matrix(b.column("embedding").filter(pa.array(dims == d))))
                sums[int(d)] = sums.get(int(d), 0) + u.T @ u
        for d, s in sums.items():
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s.ravel())], names=["dim", "i", "j", "v"])

    out = {}
    rows = classes.select("dim", "embedding").mapInArrow(products, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    for d, g in rows.groupby("dim"):  # d * d numbers for each length of vectors
        m = np.zeros((d, d))
        m[g["i"], g["j"]] = g["v"]
        out[int(d)] = np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1])
    return out


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, rotation: np.ndarray, threshold: float):
    """Yields index arrays (i, j) of the linked pairs of rows of a and b, i < j only if the tile is the same."""
    ua, ub = _units(a), _units(b)
    ya, yb = ua @ rotation, ub @ rotation
    d = a.shape[1]
    steps = [*range(0, d, STEP_DIMS), d]
    suffix = lambda y: np.sqrt(np.maximum(np.cumsum((y * y)[:, ::-1], 1)[:, ::-1], 0))
    sa, sb = suffix(ya), suffix(yb)
    slack = 1e-9
    first = steps[1]
    lead = np.ascontiguousarray(yb[:, :first].T)
    tail = lambda s, at: s[:, at] if at < d else np.zeros(len(s))
    for low in range(0, len(a), ROWS_AT_ONCE):
        part = ya[low : low + ROWS_AT_ONCE, :first] @ lead
        limit = part + np.outer(tail(sa, first)[low : low + ROWS_AT_ONCE], tail(sb, first)) >= threshold - slack
        if same:
            limit &= np.arange(len(b)) > np.arange(low, low + len(part))[:, None]
        i, j = np.nonzero(limit)
        for at in range(0, len(i), 1 << 17):
            x, y = i[at : at + (1 << 17)], j[at : at + (1 << 17)]
            got = part[x, y]
            x = x + low
            for lo, hi in zip(steps[1:-1], steps[2:], strict=True):
                got = got + (ya[x, lo:hi] * yb[y, lo:hi]).sum(1)
                live = got + tail(sa, hi)[x] * tail(sb, hi)[y] >= threshold - slack
                x, y, got = x[live], y[live], got[live]
            exact = (ua[x] * ub[y]).sum(1) >= threshold
            if exact.any():
                yield x[exact], y[exact]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding array of numbers).

    n_links counts the other vectors of cosine >= threshold, component_id is the smallest vec_id to be reached by links,
    kept says that it is the row's own. Vectors that are null, all zero, empty, or hold null or non-finite components, and
    those whose vec_id is null, link with nothing, nor do vectors of different lengths with each other. Repeated rows are
    vectors of their own. An empty table gives no rows. Other columns are ignored.
    """
    rows = vectors.select("vec_id", "embedding", F.expr(f"coalesce(vec_id IS NOT NULL AND {USABLE}, false)").alias("ok"))
    same = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast("double")).otherwise(x.cast("double")))  # -0.0 is 0.0
    ids = rows.where("ok").select("vec_id", "embedding", F.xxhash64(same).alias("e1"), F.xxhash64(F.lit(3), same).alias("e2"))
    classes = written(ids.groupBy("e1", "e2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "vectors")
    rotations = classes.sparkSession.sparkContext.broadcast(axes(classes))

    def lead(batches):
        for b in batches:
            dims, x = b.column("dim").to_numpy(), np.zeros(b.num_rows)
            for d in np.unique(dims):
                here = dims == d
                x[here] = _units(_matrix(b.column("embedding").filter(pa.array(here)))) @ rotations.value[int(d)][:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x)], names=[*b.schema.names, "x"])

    schema = "e1 bigint, e2 bigint, rep bigint, n bigint, embedding array<{}>, dim int".format(classes.schema["embedding"].dataType.elementType.simpleString())
    placed = classes.mapInArrow(lead, schema + ", x double")
    rows_ = classes.count()
    tasks = classes.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, -(-rows_ // tile), min(-(-rows_ // min(tile, LEAST_TILE)), int((2 * tasks) ** 0.5) + 1))
    edges = np.unique(placed.approxQuantile("x", [i / tiles for i in range(1, tiles)], 0.2 / tiles)) if tiles > 1 else np.empty(0)
    low, high = np.concatenate([[-1.0], edges]), np.concatenate([edges, [1.0]])
    until = np.searchsorted(low, high + np.sqrt(2 - 2 * threshold) + 1e-9, "right") - 1  # the last range in reach of each
    since = np.searchsorted(until, np.arange(len(low)))  # the first range whose reach includes it

    def range_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, b.column("x").to_numpy(), "right").astype(np.int32))], names=["r"])

    held = np.zeros(len(low), np.int64)
    for r, n in placed.select("x").mapInArrow(range_of, "r int").groupBy("r").count().collect():  # a row a range
        held[r] = n
    parts_of = np.maximum(1, -(-held // (2 * tile)))  # a range of ties is split by a hash into tiles
    begin = np.concatenate([[0], np.cumsum(parts_of)])

    def deal(batches):  # a copy of each vector for each pair of tiles that its own is in
        for b in batches:
            range_ = np.searchsorted(edges, b.column("x").to_numpy(), "right")
            own = begin[range_] + b.column("e1").to_numpy() % parts_of[range_]
            first = begin[since[range_]]
            count = begin[until[range_] + 1] - first  # tiles in reach lie side by side
            pick = np.repeat(np.arange(len(own)), count)
            other = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[pick]
            mine = own[pick]
            for s in range(0, len(pick), 10_000):
                p = pa.array(pick[s : s + 10_000])
                t1, t2 = np.minimum(mine, other)[s : s + 10_000], np.maximum(mine, other)[s : s + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(p) for c in ("dim", "e1", "e2", "rep", "n", "embedding")), pa.array(t1.astype(np.int32)), pa.array(t2.astype(np.int32)), pa.array((mine[s : s + 10_000] != t1).astype(np.int32))],
                    names=["dim", "e1", "e2", "rep", "n", "embedding", "t1", "t2", "side"],
                )

    element = classes.schema["embedding"].dataType.elementType.simpleString()
    dealt = placed.mapInArrow(deal, f"dim int, e1 bigint, e2 bigint, rep bigint, n bigint, embedding array<{element}>, t1 int, t2 int, side int")

    def compare(batches):
        for table in whole_groups(batches, ["dim", "t1", "t2"]):
            starts = np.flatnonzero(changes(table, ["dim", "t1", "t2"]))
            for s, e in zip(starts, [*starts[1:], table.num_rows], strict=True):
                t = table.slice(s, e - s)
                x, side, n = _matrix(t["embedding"]), t["side"].to_numpy(), t["n"].to_numpy()
                own = t["t1"][0].as_py() == t["t2"][0].as_py()
                m = len(x) if own else int((side == 0).sum())
                a, b = (x, x) if own else (x[:m], x[m:])
                at = 0 if own else m
                if not len(a) or not len(b):
                    continue
                links, label = np.zeros(len(x), np.int64), np.arange(len(x))
                for i, j in tile_links(a, b, own, rotations.value[t["dim"][0].as_py()], threshold):
                    j = j + at
                    links += np.bincount(i, n[j], len(x)).astype(np.int64) + np.bincount(j, n[i], len(x)).astype(np.int64)
                    unite(label, i, j)
                some = np.flatnonzero(links)
                rep = t["rep"].to_numpy()
                yield pa.RecordBatch.from_arrays([t["e1"].to_numpy()[some], t["e2"].to_numpy()[some], links[some], rep[some], rep[label[some]]], names=["e1", "e2", "links", "a", "b"])

    found = written(
        dealt.repartition("dim", "t1", "t2").sortWithinPartitions("dim", "t1", "t2", "side").mapInArrow(compare, "e1 bigint, e2 bigint, links bigint, a bigint, b bigint"), "links"
    )
    linked = found.groupBy("e1", "e2").agg(F.sum("links").alias("links"))
    parts = components(found.select("a", "b"))
    known = classes.select("e1", "e2", "rep", "n").join(linked, ["e1", "e2"], "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("e1", "e2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    done = ids.select("vec_id", "e1", "e2").join(known, ["e1", "e2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The same rows in DuckDB SQL.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
), c AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
