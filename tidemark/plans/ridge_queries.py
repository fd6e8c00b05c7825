"""Ridge regressions on all features of the modeling table, and placebo refits, each with an oracle that solves the equations in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import modeling, panel, validation
from ..sources.folders import written
from . import tables as t
from .study_queries import _SPEARMAN
from .tables import query, rounded

_P = len(panel.FEATURES)
_INITIAL, _STEP = 500, 250
_RANKED = ", ".join(
    f"CASE WHEN {c} IS NULL OR (every - n_{c}) / every > 0.3 THEN 0.0 ELSE 2 * (rank() OVER (PARTITION BY date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2) / n_{c} - 1 END" for c in panel.FEATURES
)
#: rows (date, symbol, v: the ranked features, y), folds, and by day sums of features and of their products up to it.
_ROWS = f"""x AS (SELECT *, count(*) OVER (PARTITION BY date) AS every, {", ".join(f"count({c}) OVER (PARTITION BY date) AS n_{c}" for c in panel.FEATURES)} FROM features),
r AS (SELECT date, symbol, [{_RANKED}] AS v FROM x),
rows AS MATERIALIZED (SELECT r.date, r.symbol, v, label_5d AS y FROM r JOIN labels_5d l ON l.date = r.date AND l.symbol = r.symbol WHERE label_5d IS NOT NULL),
dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM rows)),
fb AS (SELECT k AS fold, {_INITIAL} + k * {_STEP} AS b, least({_INITIAL} + (k + 1) * {_STEP} - 1, n - 1) AS c FROM (SELECT DISTINCT n FROM dd) CROSS JOIN (SELECT unnest(generate_series(0, 1000)) AS k) WHERE {_INITIAL} + k * {_STEP} < n),
folds AS MATERIALIZED (SELECT CAST(fold AS INTEGER) AS fold, a.date AS train_end, b.date AS test_start, c.date AS test_end FROM fb JOIN dd a ON a.i = fb.b - 6 JOIN dd b ON b.i = fb.b JOIN dd c ON c.i = fb.c),
daily AS (SELECT date, count(*) AS n, {", ".join(f"sum(v[{i}]) AS s{i}" for i in range(1, _P + 1))}, {", ".join(f"sum(v[{i}] * v[{j}]) AS s{i}_{j}" for i in range(1, _P + 1) for j in range(i, _P + 1))} FROM rows GROUP BY date),
upto AS MATERIALIZED (SELECT date, sum(n) OVER w AS n, {", ".join(f"sum(s{i}) OVER w AS s{i}" for i in range(1, _P + 1))}, {", ".join(f"sum(s{i}_{j}) OVER w AS s{i}_{j}" for i in range(1, _P + 1) for j in range(i, _P + 1))} FROM daily WINDOW w AS (ORDER BY date))"""
_MATRIX = "[" + ", ".join("[" + ", ".join(f"s{min(i, j)}_{max(i, j)} - s{i} * s{j} / n" + (" + al" if i == j else "") for j in range(1, _P + 1)) + f", xy{i} - s{i} * sy / n]" for i in range(1, _P + 1)) + "]"
#: w, b0 of each (fold, g, al) of `sums` by Gauss-Jordan elimination; ridge matrices need no pivoting.
_SOLVE = f"""g(fold, g, al, k, m) AS (SELECT fold, g, al, 0, {_MATRIX} FROM sums UNION ALL
  SELECT fold, g, al, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1]) ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM g WHERE k < {_P}),
solved AS MATERIALIZED (SELECT g.fold, g.g, g.al, list_transform(m, lambda r: r[{_P + 1}]) AS w, sy / n - list_dot_product(list_transform(m, lambda r: r[{_P + 1}]), [{", ".join(f"s{i}" for i in range(1, _P + 1))}]) / n AS b0
  FROM g JOIN sums s ON s.fold = g.fold AND s.g = g.g AND s.al = g.al WHERE k = {_P})"""
_XY = ", ".join(f"sum(v[{i}] * y) AS xy{i}" for i in range(1, _P + 1))
_XY_UPTO = ", ".join(f"sum(xy{i}) OVER w AS xy{i}" for i in range(1, _P + 1))


def _table(spark, d):
    b = t.prices(spark, d)
    x = modeling.modeling_table(b, panel.sessions(b.select("date"))).select("date", "symbol", *panel.FEATURES, "label_5d")
    return written(x, "modeling")  # read for folds, models and tests


def _folds(x):
    return validation.walk_forward_folds(x.where("label_5d IS NOT NULL"), _INITIAL, _STEP)


@query(f"""WITH RECURSIVE {_ROWS},
yd AS (SELECT date, sum(y) AS sy, {_XY} FROM rows GROUP BY date), yu AS (SELECT date, sum(sy) OVER w AS sy, {_XY_UPTO} FROM yd WINDOW w AS (ORDER BY date)),
sums AS MATERIALIZED (SELECT fold, 0 AS g, al, u.*, yu.* EXCLUDE (date) FROM folds JOIN upto u ON u.date = train_end JOIN yu ON yu.date = train_end CROSS JOIN (SELECT unnest([0.01::DOUBLE, 0.1, 1.0, 10.0, 100.0]) AS al)), {_SOLVE},
t AS (SELECT f.fold, s.al AS alpha, b0 + list_dot_product(w, v) AS p, y AS l FROM rows JOIN folds f ON date BETWEEN test_start AND test_end JOIN solved s ON s.fold = f.fold)
{_SPEARMAN.format(g="alpha, fold", x="t")}""")
def mod_09_ridge_all_features(spark, d):
    """MOD-07, MOD-09: rank IC of every walk-forward fold and penalty of ridge regressions on all 15 ranked features."""
    x = _table(spark, d)
    return rounded(validation.walk_forward_ridge(x, _folds(x), panel.FEATURES, "label_5d", [0.01, 0.1, 1.0, 10.0, 100.0])[0])


@query(f"""WITH RECURSIVE {_ROWS},
o AS (SELECT *, row_number() OVER (ORDER BY date, symbol) AS i, {", ".join(f"row_number() OVER (ORDER BY substr(md5(concat_ws('|', {s}, date, symbol)), 1, 13), date, symbol) AS h{s}" for s in (1, 2, 3))} FROM rows),
py AS MATERIALIZED (SELECT date, v, y, -1 AS g FROM rows UNION ALL {" UNION ALL ".join(f"SELECT a.date, a.v, b.y, {s} FROM o a JOIN o b ON b.h{s} = a.i" for s in (1, 2, 3))}),
yd AS (SELECT date, g, sum(y) AS sy, {_XY} FROM py GROUP BY date, g), yu AS (SELECT date, g, sum(sy) OVER w AS sy, {_XY_UPTO} FROM yd WINDOW w AS (PARTITION BY g ORDER BY date)),
sums AS MATERIALIZED (SELECT fold, g, 1.0::DOUBLE AS al, u.*, yu.* EXCLUDE (date, g) FROM folds JOIN upto u ON u.date = train_end JOIN yu ON yu.date = train_end), {_SOLVE},
t AS (SELECT f.fold, CAST(s.g AS INTEGER) AS seed, b0 + list_dot_product(w, v) AS p, y AS l FROM py JOIN folds f ON date BETWEEN test_start AND test_end JOIN solved s ON s.fold = f.fold AND s.g = py.g)
{_SPEARMAN.format(g="seed, fold", x="t")}""")
def mod_11_placebo_refits(spark, d):
    """MOD-11: rank IC by fold of ridge regressions refitted to labels permuted over the whole table, three seeds; -1 is the real label."""
    x = _table(spark, d)
    return rounded(validation.placebo_ridge(x, _folds(x), panel.FEATURES, "label_5d", [1, 2, 3]))
