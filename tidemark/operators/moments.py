"""Co-moments of features and labels by group, and ridge regressions from them.

A group is kept as its number of rows, means, and sums of centred products: of features with features (xx) and of features
with labels (xy). Two such sets are merged by what their means differ (pairwise combination), so no digits are lost to large
means, and rows, batches, tasks and groups merge in any order. Several labels share the features' part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KIND = "n bigint, mean array<double>, xx array<double>, xy array<double>"


class _Held:
    """Co-moments by key, merged as they come. p features, q labels; columns of a matrix are features, then labels."""

    def __init__(self, p: int, q: int):
        self.p, self.q, self.at = p, q, {}
        self.n, self.mean, self.products = np.zeros(0), np.zeros((0, p + q)), np.zeros((0, p, p + q))

    def places(self, keys: list) -> np.ndarray:
        out = np.array([self.at.setdefault(k, len(self.at)) for k in keys], np.int64)
        more = len(self.at) - len(self.n)
        if more > 0:
            more = max(more, len(self.n))
            self.n = np.concatenate([self.n, np.zeros(more)])
            self.mean = np.concatenate([self.mean, np.zeros((more, self.p + self.q))])
            self.products = np.concatenate([self.products, np.zeros((more, self.p, self.p + self.q))])
        return out

    def add(self, place: np.ndarray, n: np.ndarray, mean: np.ndarray, products: np.ndarray) -> None:
        """Merges sets into those at different places."""
        before, both = self.n[place], self.n[place] + n
        apart = mean - self.mean[place]
        self.mean[place] += apart * (n / both)[:, None]
        self.products[place] += products + (apart[:, : self.p, None] * apart[:, None, :]) * (before * n / both)[:, None, None]
        self.n[place] = both

    def add_rows(self, keys: list, code: np.ndarray, x: np.ndarray) -> None:
        """Merges rows of a batch; code: the number of each row's key."""
        order = np.argsort(code, kind="stable")
        code, x = code[order], x[order]
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        n = np.diff(np.append(begin, len(code)))
        mean = np.add.reduceat(x, begin) / n[:, None]
        x = x - np.repeat(mean, n, 0)
        products = np.empty((len(begin), self.p, self.p + self.q))
        for k, (a, m) in enumerate(zip(begin, n, strict=True)):
            products[k] = x[a : a + m, : self.p].T @ x[a : a + m]
        self.add(self.places([keys[c] for c in code[begin]]), n.astype(float), mean, products)

    def frame(self, by: list[str]) -> pd.DataFrame:
        size = len(self.at)
        out = pd.DataFrame([k for k in self.at], columns=by) if by else pd.DataFrame(index=range(size))
        out["n"] = self.n[:size].astype(np.int64)
        out["mean"], out["xx"], out["xy"] = list(self.mean[:size]), list(self.products[:size, :, : self.p].reshape(size, self.p * self.p)), list(self.products[:size, :, self.p :].reshape(size, self.p * self.q))
        return out


def _sets(f: pd.DataFrame, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(f)
    stack = lambda c, k: np.stack(f[c].to_list()).astype(float).reshape(n, *k) if n else np.zeros((0, *k))
    return f["n"].to_numpy(float), stack("mean", (p + q,)), np.concatenate([stack("xx", (p, p)), stack("xy", (p, q))], 2)


def _plain(f: pd.DataFrame, by: list[str]) -> list[tuple]:
    """Keys as hashable values."""
    hashable = lambda v: tuple(v) if isinstance(v, np.ndarray | list) else v
    return [tuple(map(hashable, r)) for r in f[by].itertuples(index=False, name=None)]


def _keys_kind(df: DataFrame, by: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{k}` {kinds[k]}, " for k in by)


def co_moments(df: DataFrame, features: list[str], labels: list[str], by: list[str]) -> DataFrame:
    """MOD-09: by, n, mean, xx, xy of the rows that have all features and labels. A task keeps a set for each group that it meets."""
    p, q = len(features), len(labels)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Held(p, q)
        for f in frames:
            if not len(f):
                continue
            if not by:
                held.add_rows([()], np.zeros(len(f), np.int64), f[[*features, *labels]].to_numpy(float))
                continue
            keys = pd.MultiIndex.from_tuples(_plain(f, by)) if len(by) > 1 else pd.Index([k[0] for k in _plain(f, by)], tupleize_cols=False)
            code, different = pd.factorize(keys, use_na_sentinel=False)
            held.add_rows([k if len(by) > 1 else (k,) for k in different], code, f[[*features, *labels]].to_numpy(float))
        if held.at:  # pandas has no type for lists of no rows
            yield held.frame(by)

    x = df.select(*by, *(F.col(c).cast("double").alias(c) for c in [*features, *labels]))
    for c in [*features, *labels]:  # a condition a column: Spark rewrites one of all columns (na.drop) for each subset of the names, 2 ** (p + q) of them
        x = x.where(F.col(c).isNotNull() & ~F.isnan(c))
    return merged(x.mapInPandas(run, _keys_kind(df, by) + KIND), by, p, q)


def merged(sets: DataFrame, by: list[str], p: int, q: int) -> DataFrame:
    """Sets of co-moments merged by other keys: all of a key meet in one task, a set for each task or group before."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Held(p, q)
        for f in frames:
            keys = _plain(f, by) if by else [()] * len(f)
            n, mean, products = _sets(f, p, q)
            left = np.arange(len(f))
            while len(left):  # one set of each key at a time
                _, first = np.unique(held.places([keys[i] for i in left]), return_index=True)
                some = left[first]
                held.add(held.places([keys[i] for i in some]), n[some], mean[some], products[some])
                left = np.delete(left, first)
        if held.at:
            yield held.frame(by)

    x = sets.select(*by, "n", "mean", "xx", "xy").where("n > 0")
    return (x.repartition(*by) if by else x.coalesce(1)).mapInPandas(run, _keys_kind(sets, by) + KIND)


def prefixes(sets: DataFrame, order: str, p: int, q: int) -> DataFrame:
    """The sets of all rows up to each one, by `order`, a row each; sets: a row for each day or the like, so that one task merges them."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Held(p, q)
        at = held.places([()])
        for f in filter(len, frames):
            n, mean, products = _sets(f, p, q)
            rows = []
            for i in range(len(f)):
                held.add(at, n[i : i + 1], mean[i : i + 1], products[i : i + 1])
                rows.append((held.n[0], held.mean[0].copy(), held.products[0].copy()))
            out = f[[order]].copy()
            out["n"], out["mean"] = [int(r[0]) for r in rows], [r[1] for r in rows]
            out["xx"], out["xy"] = [r[2][:, :p].ravel() for r in rows], [r[2][:, p:].ravel() for r in rows]
            yield out

    return sets.select(order, "n", "mean", "xx", "xy").where("n > 0").coalesce(1).sortWithinPartitions(order).mapInPandas(run, _keys_kind(sets, [order]) + KIND)


def ridge(sets: DataFrame, p: int, labels: list[str], alphas: list[float], keys: list[str]) -> DataFrame:
    """MOD-09: keys, n, alpha, label, coefficients, intercept of the ridge regression of each label with each set and penalty.

    Minimises |y - X w - b|^2 + alpha |w|^2 in closed form, for all labels of a set at once; the intercept isn't penalised.
    """
    q = len(labels)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, mean, products = _sets(f, p, q)
            out = []
            for i, (_, row) in enumerate(f.iterrows()):
                for a in alphas:
                    w = np.linalg.lstsq(products[i, :, :p] + a * np.eye(p), products[i, :, p:], rcond=None)[0]
                    b = mean[i, p:] - mean[i, :p] @ w
                    out += [(*(row[k] for k in keys), int(n[i]), float(a), label, w[:, j], float(b[j])) for j, label in enumerate(labels)]
            yield pd.DataFrame(out, columns=[*keys, "n", "alpha", "label", "coefficients", "intercept"])

    return sets.mapInPandas(run, _keys_kind(sets, keys) + "n bigint, alpha double, label string, coefficients array<double>, intercept double")


def predicted(features: list[str], model: F.Column | None = None) -> F.Column:
    """intercept + coefficients * features, of columns of these names, or of the fields of a model."""
    part = F.col if model is None else model.getField
    return sum((part("coefficients")[i] * F.col(c) for i, c in enumerate(features)), part("intercept"))
