"""Operators on a (date, symbol) panel of bars: features, labels, ranks. Every window is bounded by a symbol or a date."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import average_rank, full, log_ratio, trailing, with_mean_ranks
from ..sources.folders import written


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("date")


def momentum(bars: DataFrame, windows: tuple[int, ...] = (1, 5, 20, 60, 126)) -> DataFrame:
    """WIN-01: log return over w rows of the symbol, as momentum_{w}d."""
    return bars.withColumns({f"momentum_{w}d": log_ratio(F.col("close"), F.lag("close", w).over(by_symbol())) for w in windows})


def reversal(bars: DataFrame, windows: tuple[int, ...] = (1, 5)) -> DataFrame:
    """WIN-02: the negated log return over w rows, as reversal_{w}d."""
    return bars.withColumns({f"reversal_{w}d": -log_ratio(F.col("close"), F.lag("close", w).over(by_symbol())) for w in windows})


def drawdown(bars: DataFrame, windows: tuple[int, ...] = (20, 60)) -> DataFrame:
    """WIN-03: close over the largest close of w full rows, less one."""
    return bars.withColumns({f"drawdown_{w}d": F.try_divide(F.col("close"), full(F.max("close"), F.col("close"), trailing(w, "symbol"), w)) - 1 for w in windows})


def overnight_gap(bars: DataFrame) -> DataFrame:
    """WIN-04: log of open over the close before."""
    return bars.withColumn("gap_overnight", log_ratio(F.col("open"), F.lag("close").over(by_symbol())))


def with_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ret_1d", log_ratio(F.col("close"), F.lag("close").over(by_symbol())))


def realized_vol(bars: DataFrame, windows: tuple[int, ...] = (20, 60)) -> DataFrame:
    """WIN-05: sample deviation of w full daily returns."""
    return with_returns(bars).withColumns({f"realized_vol_{w}d": full(F.stddev_samp("ret_1d"), F.col("ret_1d"), trailing(w, "symbol"), w) for w in windows})


def market_return(returns: DataFrame) -> DataFrame:
    """WIN-07: equal-weight mean of ret_1d over the date's symbols."""
    return returns.withColumn("mkt_ret", F.avg("ret_1d").over(Window.partitionBy("date")))


def idiosyncratic_vol(bars: DataFrame, w: int = 20) -> DataFrame:
    """WIN-06: deviation over w full rows of what a rolling beta to the market leaves of each return.

    beta = sample covariance / population variance of the market over w full rows.
    """
    x = market_return(with_returns(bars))
    span = trailing(w, "symbol")
    both = F.when(F.col("ret_1d").isNotNull() & F.col("mkt_ret").isNotNull(), 1)
    beta = F.when(F.count(both).over(span) == w, F.try_divide(F.covar_samp("ret_1d", "mkt_ret").over(span), F.var_pop("mkt_ret").over(span)))
    x = x.withColumn("residual", F.col("ret_1d") - beta * F.col("mkt_ret"))
    return x.withColumn(f"idio_vol_{w}d", full(F.stddev_samp("residual"), F.col("residual"), span, w))


def liquidity(bars: DataFrame, w: int = 20) -> DataFrame:
    """WIN-08: mean dollar volume, Amihud illiquidity over w full rows, log price."""
    x = with_returns(bars).withColumn("dollar_volume", F.col("close") * F.col("volume"))
    x = x.withColumn("illiquidity", F.abs("ret_1d") / F.nullif(F.col("dollar_volume"), F.lit(0.0)))
    span = trailing(w, "symbol")
    return x.withColumns(
        {
            f"adv_dollar_{w}d": full(F.avg("dollar_volume"), F.col("dollar_volume"), span, w),
            f"amihud_{w}d": full(F.avg("illiquidity"), F.col("illiquidity"), span, w),
            "log_price": F.log(F.greatest("close", F.lit(1e-9))),
        }
    )


def lagged(df: DataFrame, columns: list[str], rows: int = 1) -> DataFrame:
    """WIN-09: columns as of `rows` rows before."""
    return df.withColumns({c: F.lag(c, rows).over(by_symbol()) for c in columns})


FEATURES = [
    "momentum_5d", "momentum_20d", "momentum_60d", "momentum_126d", "reversal_1d", "reversal_5d", "drawdown_20d", "drawdown_60d",
    "gap_overnight", "realized_vol_20d", "realized_vol_60d", "idio_vol_20d", "adv_dollar_20d", "amihud_20d", "log_price",
]


class _Column:
    """Values of a group's rows in their order, and which of them aren't null; with the arithmetic of SQL on doubles."""

    def __init__(self, v: np.ndarray, ok: np.ndarray):
        self.v, self.ok = v, ok

    @classmethod
    def of(cls, t: pa.Table, name: str) -> _Column:
        c = t[name].combine_chunks()
        return cls(c.fill_null(0.0).to_numpy(zero_copy_only=False), ~c.is_null().to_numpy(zero_copy_only=False))

    def lag(self, rows: int) -> _Column:
        n = len(self.v)
        out = _Column(np.zeros(n), np.zeros(n, bool))
        out.v[rows:], out.ok[rows:] = self.v[: max(0, n - rows)], self.ok[: max(0, n - rows)]
        return out

    def over(self, b: _Column) -> _Column:
        ok = self.ok & b.ok & (b.v != 0)
        return _Column(self.v / np.where(ok, b.v, 1.0), ok)

    def log_ratio(self, b: _Column) -> _Column:
        r = self.over(b)
        ok = r.ok & ~(r.v <= 0)
        return _Column(np.log(np.where(ok, r.v, 1.0)), ok)

    def full(self, w: int) -> np.ndarray:
        """Which rows have w last rows without nulls."""
        n = np.concatenate([np.zeros(w, np.int64), np.cumsum(self.ok)])
        return (n[w:] - n[:-w] == w) & (np.arange(len(self.v)) >= w - 1)

    def folded(self, w: int, f) -> np.ndarray:
        """f over the last w values of each row, the earliest first, in the same order wherever a window stands, so that equal windows stay equal; 0 before the first one."""
        m = len(self.v) - w + 1
        if m <= 0:
            return np.zeros(len(self.v))
        return np.concatenate([np.zeros(w - 1), reduce(f, (self.v[j : j + m] for j in range(w)))])


def _sum(c: _Column, w: int) -> np.ndarray:
    return c.folded(w, np.add)


def _products(a: _Column, b: _Column, w: int) -> np.ndarray:
    """Sums over w rows of products of what a and b differ from their means by. Both are taken from their windows' first values, so a constant window gives 0."""
    m = len(a.v) - w + 1
    if m <= 0:
        return np.zeros(len(a.v))
    mean = lambda c: sum((c.v[j : j + m] - c.v[:m] for j in range(1, w)), np.zeros(m)) / w
    x, y = mean(a), mean(b)
    return np.concatenate([np.zeros(w - 1), sum(((a.v[j : j + m] - a.v[:m] - x) * (b.v[j : j + m] - b.v[:m] - y) for j in range(w)), np.zeros(m))])


def _deviation(c: _Column, w: int) -> _Column:
    return _Column(np.sqrt(_products(c, c, w) / (w - 1)), c.full(w))


def _symbol_features(t: pa.Table) -> pa.Table:
    """build_features() of one symbol: the definitions of momentum(), reversal() and so on, each window added up at once for all rows."""
    t = t.sort_by("date")
    with np.errstate(all="ignore"):
        close, opened, volume, ret, market = (_Column.of(t, c) for c in ("close", "open", "volume", "ret_1d", "mkt_ret"))
        dollars = _Column(close.v * volume.v, close.ok & volume.ok)
        cost = _Column(np.abs(ret.v), ret.ok).over(dollars)
        both = _Column(ret.v, ret.ok & market.ok)
        beta = _Column(_products(ret, market, 20) / 19, both.full(20)).over(_Column(_products(market, market, 20) / 20, both.full(20)))
        residual = _Column(ret.v - beta.v * market.v, both.ok & beta.ok)
        out = {f"momentum_{w}d": close.log_ratio(close.lag(w)) for w in (5, 20, 60, 126)}
        for w in (1, 5):
            r = close.log_ratio(close.lag(w))
            out[f"reversal_{w}d"] = _Column(-r.v, r.ok)
        for w in (20, 60):
            top = _Column(close.folded(w, np.maximum), close.full(w))
            r = close.over(top)
            out[f"drawdown_{w}d"] = _Column(r.v - 1, r.ok)
            out[f"realized_vol_{w}d"] = _deviation(ret, w)
        out["gap_overnight"] = opened.log_ratio(close.lag(1))
        out["idio_vol_20d"] = _deviation(residual, 20)
        out["adv_dollar_20d"] = _Column(_sum(dollars, 20) / 20, dollars.full(20))
        out["amihud_20d"] = _Column(_sum(cost, 20) / 20, cost.full(20))
        out["log_price"] = _Column(np.log(np.maximum(np.where(close.ok, close.v, 1e-9), 1e-9)), np.ones(len(close.v), bool))
        before = {c: out[c].lag(1) for c in FEATURES}
    rest = [c for c in t.column_names if c not in ("open", "close", "volume", "ret_1d", "mkt_ret")]
    return pa.table({**{c: t[c] for c in rest}, **{c: pa.array(x.v, pa.float64(), mask=~x.ok, from_pandas=False) for c, x in before.items()}})


def build_features(bars: DataFrame, features: list[str] = FEATURES, keep: tuple[str, ...] = (), placed: bool = False) -> DataFrame:
    """MOD-01: date, symbol and the 15 features, each as of the row before.

    The market's means are a row a day. All windows of a symbol come from one group of its rows (a row a day), so that rows
    move once and a window of 60 rows doesn't cost 60 steps a row and statistic. keep: other columns of the bars to go along;
    placed: bars are bucketed by symbol, so that returns are made twice instead of being written.
    """
    number = lambda c: F.col(c).cast("double").alias(c)
    x = with_returns(bars.select("date", "symbol", *keep, number("open"), number("close"), number("volume")))
    market = with_returns(bars.select("date", "symbol", number("close"))) if placed else (x := written(x, "returns"))  # read for the market and for the features
    market = market.groupBy(F.col("date").alias("_date")).agg(F.avg("ret_1d").alias("mkt_ret"))
    x = x.join(F.broadcast(market), x["date"].eqNullSafe(market["_date"]), "left").drop("_date")  # a row a day
    kinds = dict(x.dtypes)
    made = x.groupBy("symbol").applyInArrow(_symbol_features, ", ".join(f"`{c}` {kinds[c]}" for c in ("date", "symbol", *keep)) + ", " + ", ".join(f"{c} double" for c in FEATURES))
    return made.select("date", "symbol", *features, *keep)


def _mean_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1; equal values share their mean rank, NaN is the largest value."""
    order = np.argsort(v, kind="stable")
    s = v[order]
    new = s[1:] != s[:-1]
    if s.dtype.kind == "f":
        new &= ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
    begin = np.flatnonzero(np.concatenate([[True], new]))
    n = np.diff(np.append(begin, len(s)))
    out = np.empty(len(s))
    out[order] = np.repeat(begin + 1 + (n - 1) / 2, n)
    return out


def rank_normalize(df: DataFrame, columns: list[str], max_null: float = 0.3) -> DataFrame:
    """WIN-10: per date 2 * (mean rank / values) - 1; nulls become 0; a date with a larger share of nulls has none at all.

    A task ranks the columns of one date after another: one sort of its rows, not one for each column, all held at once.
    """

    ranked = _ranked(columns, max_null)
    return df.groupBy("date").applyInArrow(ranked, ", ".join(f"`{c}` {'double' if c in columns else kind}" for c, kind in df.dtypes))


def _ranked(columns: list[str], max_null: float):
    """rank_normalize() of a date's rows."""

    def ranked(t: pa.Table) -> pa.Table:
        every = t.num_rows
        for c in columns:
            values = t[c].combine_chunks()
            there = ~values.is_null().to_numpy(zero_copy_only=False)
            have, out = int(there.sum()), np.zeros(every)
            if have:
                out[there] = 2 * (_mean_ranks(values.drop_null().to_numpy(zero_copy_only=False)) / have) - 1
            kept = (every - have) / every <= max_null
            t = t.set_column(t.schema.get_field_index(c), c, pa.array(out, pa.float64()) if kept else pa.nulls(every, pa.float64()))
        return t

    return ranked


def ranks_with_labels(df: DataFrame, columns: list[str], raw: str, label: str, max_null: float = 0.3) -> DataFrame:
    """WIN-10, WIN-11: rank_normalize() over all rows of a date, and of the rows that have a raw return (and a symbol) their label, what it exceeds the date's mean by.

    Both come from one group of the date, so that ranks needn't meet labels in a join.
    """
    ranked = _ranked(columns, max_null)

    def run(t: pa.Table) -> pa.Table:
        t = ranked(t)
        t = t.filter(t[raw].is_valid())
        value = t[raw].combine_chunks().to_numpy(zero_copy_only=False)
        t = t.append_column(label, pa.array(value - value.mean() if len(value) else value, pa.float64(), from_pandas=False))
        return t.filter(t["symbol"].is_valid())

    return df.groupBy("date").applyInArrow(run, ", ".join(f"`{c}` {'double' if c in columns else kind}" for c, kind in df.dtypes) + f", `{label}` double")


def sessions(bars: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """SRC-17: session_idx, date of the weekdays from the first to the last bar that are no holiday. One row a day."""
    days = bars.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)
    if holidays is not None:
        days = days.join(holidays.select("date"), "date", "left_anti")
    return days.select((F.row_number().over(Window.orderBy("date")) - 1).cast("bigint").alias("session_idx"), "date")


def forward_returns(bars: DataFrame, calendar: DataFrame, horizon: int = 5, keep: tuple[str, ...] = (), days: DataFrame | None = None) -> DataFrame:
    """MOD-02, JOIN-03: date, symbol, target_date and forward log return over `horizon` sessions (null without a price there).

    A date that is no session moves along the symbols' observed dates instead. keep: other columns of the bars to go along; days: the bars'
    dates, if they are cheaper to read elsewhere.
    """
    order = Window.orderBy("date")  # one row a day
    seen = (bars if days is None else days).select("date").distinct().withColumns({"observed_idx": F.row_number().over(order), "observed_target": F.lead("date", horizon).over(order)})
    ahead = calendar.select((F.col("session_idx") - horizon).alias("session_idx"), F.col("date").alias("session_target"))
    days = seen.join(calendar, "date", "left").join(ahead, "session_idx", "left").select(
        "date", "session_idx", "observed_idx", F.when(F.col("session_idx").isNotNull(), F.col("session_target")).otherwise(F.col("observed_target")).alias("target_date")
    )
    # the symbol's row exactly `horizon` steps on, by a range of one step: bars aren't joined to themselves
    step = lambda i: F.max("close").over(Window.partitionBy("symbol").orderBy(i).rangeBetween(horizon, horizon))
    raw = bars.select("date", "symbol", "close", *(c for c in keep if c != "close")).join(F.broadcast(days), "date").withColumn("target_close", F.when(F.col("session_idx").isNotNull(), step("session_idx")).otherwise(step("observed_idx")))
    name = f"raw_forward_return_{horizon}d"
    return raw.select("date", "symbol", "target_date", log_ratio(F.col("target_close"), F.col("close")).alias(name), *keep)


def build_labels(bars: DataFrame, calendar: DataFrame, horizon: int = 5, keep: tuple[str, ...] = (), days: DataFrame | None = None) -> DataFrame:
    """MOD-02, JOIN-03, WIN-11: the forward returns that there are, and their excess over the date's mean."""
    name = f"raw_forward_return_{horizon}d"
    out = forward_returns(bars, calendar, horizon, keep, days).where(F.col(name).isNotNull())
    return out.select("date", "symbol", "target_date", name, (F.col(name) - F.avg(name).over(Window.partitionBy("date"))).alias(f"label_{horizon}d"), *keep)


def buckets(df: DataFrame, score: str, most: int = 10, tie: str = "symbol") -> DataFrame:
    """WIN-12: quantile bucket of the date's first-ranks, from 0: max(0, ceil((r - 1) q / (n - 1)) - 1), q = min(most, n)."""
    r = F.row_number().over(Window.partitionBy("date").orderBy(score, tie))
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    x = df.where(F.col(score).isNotNull()).withColumns({"_r": r, "_n": n})
    q = F.least(F.lit(most), F.col("_n"))
    return x.withColumn("bucket", F.greatest(F.lit(0), F.ceil((F.col("_r") - 1) * q / F.greatest(F.col("_n") - 1, F.lit(1))) - 1).cast("int")).drop("_r", "_n")


def correlation(a: str, b: str):
    """Pearson's correlation, 0 where a side doesn't vary (F.corr raises there)."""
    c = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(c)


def rank_ic(df: DataFrame, prediction: str, label: str, by: list[str]) -> DataFrame:
    """AGG-07: Spearman correlation of the pairs that have both, by group; 0 where it is undefined; and the number of pairs."""
    x = df.where(F.col(prediction).isNotNull() & F.col(label).isNotNull())
    x = x.withColumns({"_p": average_rank(F.col(prediction), *by), "_l": average_rank(F.col(label), *by)})
    return x.groupBy(*by).agg(correlation("_p", "_l").alias("rank_ic"), F.count("*").alias("n"))


def pooled_rank_ic(df: DataFrame, prediction: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """AGG-07 over all rows of few large groups: ranks come from ranges of values and their counts, not from one window a group."""
    x = df.where(F.col(prediction).isNotNull() & F.col(label).isNotNull()).select(*by, F.col(prediction).cast("double").alias("p"), F.col(label).cast("double").alias("l"))
    x = with_mean_ranks(written(x, "pairs"), {"l": "rank_l", "p": "rank_p"}, by)  # read several times
    return correlated_ranks(x, "rank_p", "rank_l", by)


def correlated_ranks(df: DataFrame, a: str, b: str, by: tuple[str, ...]) -> DataFrame:
    """AGG-07 of ranks already given: rank_ic and number of rows by group."""
    return df.groupBy(*by).agg(correlation(a, b).alias("rank_ic"), F.count("*").alias("n"))


def bucket_metrics(df: DataFrame, score: str, label: str, most: int = 10) -> DataFrame:
    """AGG-08: per date mean label of the top and bottom bucket, their spread and the share of positive labels on top."""
    x = buckets(df.where(F.col(label).isNotNull()), score, most)
    x = x.withColumns({"lo": F.min("bucket").over(Window.partitionBy("date")), "hi": F.max("bucket").over(Window.partitionBy("date"))})
    top, low = F.when(F.col("bucket") == F.col("hi"), F.col(label)), F.when(F.col("bucket") == F.col("lo"), F.col(label))
    return x.groupBy("date").agg(F.avg(top).alias("top_mean"), F.avg(low).alias("bottom_mean"), (F.avg(top) - F.avg(low)).alias("spread"), F.avg((top > 0).cast("double")).alias("hit_rate"), F.count("*").alias("n"))


def rolling_adv(bars: DataFrame, w: int = 20, least: int = 5) -> DataFrame:
    """WIN-13: mean dollar volume of up to w rows, null with fewer than `least`."""
    span = trailing(w, "symbol")
    value = F.col("close") * F.col("volume")
    return bars.withColumn("adv", F.when(F.count(value).over(span) >= min(least, w), F.avg(value).over(span)))


def month_starts(dates: DataFrame) -> DataFrame:
    """WIN-15: the months' first calendar days among the dates."""
    return dates.select(F.trunc("date", "MM").alias("rebalance_date")).distinct()


def universe(bars: DataFrame, listings: DataFrame, top: int, w: int = 20, snap: bool = False) -> DataFrame:
    """JOIN-08, WIN-14: per rebalance date the `top` listed symbols by rolling dollar volume, ties by symbol.

    Rebalance dates are months' first days; with snap each moves to the first date with bars in its month.
    """
    adv = rolling_adv(bars, w).where("adv IS NOT NULL")
    if snap:
        days = bars.select("date").distinct().groupBy(F.trunc("date", "MM")).agg(F.min("date").alias("rebalance_date")).select("rebalance_date")
    else:
        days = month_starts(bars)
    active = "(ipo_date IS NULL OR ipo_date <= date) AND (delist_date IS NULL OR delist_date > date)"
    x = adv.join(days, F.col("date") == F.col("rebalance_date")).join(listings.select("symbol", "ipo_date", "delist_date"), "symbol").where(active)
    rank = F.row_number().over(Window.partitionBy("rebalance_date").orderBy(F.desc("adv"), "symbol"))
    return x.select("rebalance_date", "symbol", "adv", rank.alias("rank")).where(F.col("rank") <= top)


def latest(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """WIN-16, WIN-17, WIN-18: the first n rows of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def carry_forward(grid: DataFrame, bars: DataFrame) -> DataFrame:
    """WIN-22: the last known close on every (date, symbol) of the grid."""
    x = grid.join(bars.select("date", "symbol", "close"), ["date", "symbol"], "left")
    return x.select("date", "symbol", F.last("close", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)).alias("mark"))


def decay_weights(df: DataFrame, half_life: float = 378.0) -> DataFrame:
    """WIN-24: 0.5 ** (rows to the symbol's last / half_life)."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))) - 1
    return df.withColumn("weight", F.pow(F.lit(0.5), back / half_life))


def percent_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """WIN-25: mean rank over the number of values, per date."""
    return df.withColumn(out, average_rank(F.col(column), "date") / F.count(column).over(Window.partitionBy("date")))


def date_blocks(dates: DataFrame, n: int) -> DataFrame:
    """WIN-26: n contiguous blocks of distinct dates, from 0; the first ones take what is left over. One row a day."""
    return dates.select("date").distinct().withColumn("block", F.ntile(n).over(Window.orderBy("date")) - 1)


def session_shift(df: DataFrame, calendar: DataFrame, k: int, out: str) -> DataFrame:
    """WIN-21, WIN-28: the session k sessions from the row's; null beyond the calendar or for a date that is no session."""
    moved = calendar.select((F.col("session_idx") - k).alias("session_idx"), F.col("date").alias(out))
    return df.join(calendar.join(moved, "session_idx").select("date", out), "date", "left")


def intraday_features(ticks: DataFrame) -> DataFrame:
    """AGG-04, WIN-19: by symbol and UTC date of ticks (symbol, ts, seq, price): return, range, volatility, first and last 30 ticks.

    Deviation of log returns is that of the population; the first-30 mark is tick min(n - 1, 29), the last-30 mark max(0, n - 30), from 0.
    """
    day = Window.partitionBy("symbol", "date").orderBy("ts", "seq")
    x = ticks.withColumn("date", F.to_date("ts"))
    x = x.withColumns({"i": F.row_number().over(day) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("symbol", "date")), "r": log_ratio(F.col("price"), F.lag("price").over(day))})
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("price")))
    first, last = at(F.lit(0)), at(F.col("n") - 1)
    return x.groupBy("symbol", "date").agg(
        log_ratio(last, first).alias("minute_return"), (F.try_divide(F.max("price"), F.min("price")) - 1).alias("minute_range"), F.coalesce(F.stddev_pop("r"), F.lit(0.0)).alias("minute_vol"),
        log_ratio(at(F.least(F.col("n") - 1, F.lit(29))), first).alias("first_30_return"), log_ratio(last, at(F.greatest(F.col("n") - 30, F.lit(0)))).alias("last_30_return"), F.count("*").alias("n_ticks"),
    )


def volume_ratio(daily: DataFrame, column: str = "n_ticks", w: int = 20) -> DataFrame:
    """WIN-20: a value over its mean of up to w rows, the current one included."""
    return daily.withColumn("volume_ratio", F.try_divide(F.col(column), F.avg(column).over(trailing(w, "symbol"))))


def close_imbalance(daily: DataFrame) -> DataFrame:
    """WIN-20: the last 30 ticks' return times the volume ratio, by symbol and date; without a ratio 0."""
    return daily.withColumn("close_imbalance", F.col("last_30_return") * F.coalesce("volume_ratio", F.lit(0.0)))


def mature(labels: DataFrame, label: str, report_date) -> DataFrame:
    """PRJ-13: labels whose target date lies after the report date are null."""
    return labels.withColumn(label, F.when(F.col("target_date") <= F.lit(report_date).cast("date"), F.col(label)))


def clean_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ-20: null, NaN and infinite values become 0."""
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), 0.0).otherwise(F.col(c)) for c in columns})
