"""Queries over the panel of bars, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, panel
from ..sources.folders import written
from . import tables as t
from .tables import query, rounded

W = "PARTITION BY symbol ORDER BY date"


@query(f"""
WITH m AS (SELECT date, symbol, lag(x) OVER ({W}) AS x FROM (SELECT date, symbol, ln(close / lag(close, 20) OVER ({W})) AS x FROM bars)),
n AS (SELECT *, count(x) OVER (PARTITION BY date) AS have, count(*) OVER (PARTITION BY date) AS every FROM m),
r AS (SELECT date, symbol, CASE WHEN (every - have) / every <= 0.3 THEN coalesce(2 * (rank() OVER (PARTITION BY date ORDER BY x NULLS LAST) + (count(x) OVER (PARTITION BY date, x) - 1) / 2) / have - 1, 0) END AS f, x FROM n),
j AS (SELECT r.date, r.symbol, CASE WHEN x IS NULL AND f IS NOT NULL THEN 0 ELSE f END AS f, y.label_5d AS l FROM r JOIN labels_5d y ON y.date = r.date AND y.symbol = r.symbol),
k AS (SELECT date, symbol, f, l, rank() OVER (PARTITION BY date ORDER BY f) + (count(*) OVER (PARTITION BY date, f) - 1) / 2 AS rf, rank() OVER (PARTITION BY date ORDER BY l) + (count(*) OVER (PARTITION BY date, l) - 1) / 2 AS rl FROM j WHERE f IS NOT NULL AND l IS NOT NULL)
SELECT date, round(coalesce(CASE WHEN isnan(corr(rf, rl)) THEN 0 ELSE corr(rf, rl) END, 0), 6) + 0.0 AS rank_ic, count(*) AS n FROM k GROUP BY date
""")
def flagship_rank_ic(spark, d):
    """Bars to lagged momentum, to per-date ranks, against 5-session labels: rank IC by date."""
    b = written(t.bars(spark, d), "bars")  # read for features, sessions and labels
    x = panel.rank_normalize(panel.lagged(panel.momentum(b, (20,)), ["momentum_20d"]).select("date", "symbol", "momentum_20d"), ["momentum_20d"])
    y = panel.build_labels(b, panel.sessions(b.select("date")))
    return rounded(panel.rank_ic(x.select("date", "symbol", "momentum_20d").join(y, ["date", "symbol"]), "momentum_20d", "label_5d", ["date"]))


@query("SELECT date, symbol, round(open, 10) AS open, round(high, 10) AS high, round(low, 10) AS low, round(close, 10) AS close, round(vwap, 10) AS vwap, volume, trade_count FROM bars WHERE date <= DATE '1999-12-31'")
def src_01_scan_to_cutoff(spark, d):
    return rounded(t.bars(spark, d).where("date <= DATE '1999-12-31'"), 10)


@query("SELECT CAST(session_idx AS BIGINT) AS session_idx, date FROM sessions")
def src_17_calendar(spark, d):
    return t.sessions(spark, d)


@query("SELECT date, symbol, " + ", ".join(f"round(ln(close / lag(close, {w}) OVER ({W})), 6) + 0.0 AS momentum_{w}d" for w in (1, 5, 20, 60, 126)) + " FROM bars")
def win_01_momentum(spark, d):
    x = panel.momentum(t.bars(spark, d))
    return rounded(x.select("date", "symbol", *(c for c in x.columns if c.startswith("momentum"))))


@query(f"SELECT date, symbol, round(-ln(close / lag(close, 1) OVER ({W})), 6) + 0.0 AS reversal_1d, round(-ln(close / lag(close, 5) OVER ({W})), 6) + 0.0 AS reversal_5d FROM bars")
def win_02_reversal(spark, d):
    return rounded(panel.reversal(t.bars(spark, d)).select("date", "symbol", "reversal_1d", "reversal_5d"))


@query("SELECT date, symbol, " + ", ".join(f"CASE WHEN count(close) OVER ({W} ROWS {w - 1} PRECEDING) = {w} THEN round(close / max(close) OVER ({W} ROWS {w - 1} PRECEDING) - 1, 6) + 0.0 END AS drawdown_{w}d" for w in (20, 60)) + " FROM bars")
def win_03_drawdown(spark, d):
    return rounded(panel.drawdown(t.bars(spark, d)).select("date", "symbol", "drawdown_20d", "drawdown_60d"))


@query(f"SELECT date, symbol, round(ln(open / lag(close) OVER ({W})), 6) + 0.0 AS gap_overnight FROM bars")
def win_04_overnight_gap(spark, d):
    return rounded(panel.overnight_gap(t.bars(spark, d)).select("date", "symbol", "gap_overnight"))


@query("SELECT date, symbol, " + ", ".join(f"CASE WHEN count(ret_1d) OVER ({W} ROWS {w - 1} PRECEDING) = {w} THEN round(stddev_samp(ret_1d) OVER ({W} ROWS {w - 1} PRECEDING), 6) END AS realized_vol_{w}d" for w in (20, 60)) + " FROM returns")
def win_05_realized_vol(spark, d):
    return rounded(panel.realized_vol(t.bars(spark, d)).select("date", "symbol", "realized_vol_20d", "realized_vol_60d"))


@query(f"""
WITH m AS (SELECT date, symbol, ret_1d, avg(ret_1d) OVER (PARTITION BY date) AS mkt_ret FROM returns),
b AS (SELECT *, CASE WHEN count(CASE WHEN ret_1d IS NOT NULL AND mkt_ret IS NOT NULL THEN 1 END) OVER w = 20 THEN covar_samp(ret_1d, mkt_ret) OVER w / nullif(var_pop(mkt_ret) OVER w, 0) END AS beta FROM m WINDOW w AS ({W} ROWS 19 PRECEDING)),
r AS (SELECT date, symbol, mkt_ret, ret_1d - beta * mkt_ret AS residual FROM b)
SELECT date, symbol, round(mkt_ret, 6) + 0.0 AS mkt_ret, CASE WHEN count(residual) OVER ({W} ROWS 19 PRECEDING) = 20 THEN round(stddev_samp(residual) OVER ({W} ROWS 19 PRECEDING), 6) END AS idio_vol_20d FROM r
""")
def win_06_07_idiosyncratic_vol(spark, d):
    return rounded(panel.idiosyncratic_vol(t.bars(spark, d)).select("date", "symbol", "mkt_ret", "idio_vol_20d"))


@query(f"""
WITH x AS (SELECT date, symbol, close, close * volume AS dv, abs(ret_1d) / nullif(close * volume, 0) AS il FROM returns)
SELECT date, symbol, CASE WHEN count(dv) OVER w = 20 THEN round(ln(avg(dv) OVER w), 8) END AS log_adv_dollar_20d, CASE WHEN count(il) OVER w = 20 THEN round(1e6 * avg(il) OVER w, 6) END AS amihud_20d, round(ln(greatest(close, 1e-9)), 6) AS log_price
FROM x WINDOW w AS ({W} ROWS 19 PRECEDING)
""")
def win_08_liquidity(spark, d):
    x = panel.liquidity(t.bars(spark, d)).select("date", "symbol", "adv_dollar_20d", (F.col("amihud_20d") * 1e6).alias("amihud_20d"), "log_price")
    return x.select("date", "symbol", F.round(F.log("adv_dollar_20d"), 8).alias("log_adv_dollar_20d"), F.round("amihud_20d", 6).alias("amihud_20d"), F.round("log_price", 6).alias("log_price"))


@query(f"SELECT date, symbol, lag(close) OVER ({W}) AS close, lag(volume) OVER ({W}) AS volume FROM bars")
def win_09_lag(spark, d):
    return panel.lagged(t.bars(spark, d).select("date", "symbol", "close", "volume"), ["close", "volume"])


@query(f"""
WITH x AS (SELECT date, symbol, close AS a, ln(close / lag(close, 60) OVER ({W})) AS b FROM bars),
n AS (SELECT *, count(b) OVER (PARTITION BY date) AS nb, count(*) OVER (PARTITION BY date) AS n FROM x)
SELECT date, symbol, round(2 * (rank() OVER (PARTITION BY date ORDER BY a) + (count(*) OVER (PARTITION BY date, a) - 1) / 2) / n - 1, 6) + 0.0 AS a,
  CASE WHEN (n - nb) / n <= 0.3 THEN CASE WHEN b IS NULL THEN 0.0 ELSE round(2 * (rank() OVER (PARTITION BY date ORDER BY b NULLS LAST) + (count(b) OVER (PARTITION BY date, b) - 1) / 2) / nb - 1, 6) + 0.0 END END AS b FROM n
""")
def win_10_rank_normalize(spark, d):
    x = panel.momentum(t.bars(spark, d), (60,)).select("date", "symbol", F.col("close").alias("a"), F.col("momentum_60d").alias("b"))
    return rounded(panel.rank_normalize(x, ["a", "b"]))


@query("SELECT date, symbol, target_date, round(raw_forward_return_5d, 6) + 0.0 AS raw_forward_return_5d, round(label_5d, 6) + 0.0 AS label_5d FROM labels_5d")
def mod_02_labels(spark, d):
    """MOD-02, JOIN-03, WIN-11."""
    return rounded(panel.build_labels(t.bars(spark, d), t.sessions(spark, d)))


@query("""
WITH x AS (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS r, count(*) OVER (PARTITION BY date) AS n FROM scores)
SELECT date, symbol, CAST(greatest(0, ceil((r - 1) * least(10, n) / greatest(n - 1, 1)) - 1) AS INTEGER) AS bucket FROM x
""")
def win_12_buckets(spark, d):
    return panel.buckets(t.scores(spark, d), "score").select("date", "symbol", "bucket")


@query(f"SELECT date, symbol, CASE WHEN count(*) OVER w >= 5 THEN round(ln(avg(close * volume) OVER w), 8) END AS log_adv FROM bars WINDOW w AS ({W} ROWS 19 PRECEDING)")
def win_13_rolling_adv(spark, d):
    return panel.rolling_adv(t.bars(spark, d)).select("date", "symbol", F.round(F.log("adv"), 8).alias("log_adv"))


_UNIVERSE = """
WITH a AS (SELECT date, symbol, CASE WHEN count(*) OVER w >= 5 THEN avg(close * volume) OVER w END AS adv FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
days AS ({}),
u AS (SELECT a.date AS rebalance_date, a.symbol, adv, row_number() OVER (PARTITION BY a.date ORDER BY adv DESC, a.symbol) AS rank FROM a JOIN days ON days.date = a.date JOIN listings l ON l.symbol = a.symbol
  WHERE adv IS NOT NULL AND (ipo_date IS NULL OR ipo_date <= a.date) AND (delist_date IS NULL OR delist_date > a.date))
SELECT rebalance_date, symbol, round(ln(adv), 8) AS log_adv, CAST(rank AS INTEGER) AS rank FROM u WHERE rank <= 20
"""


@query(_UNIVERSE.format("SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS date FROM bars"))
def win_14_15_join_08_universe(spark, d):
    """WIN-14, WIN-15, JOIN-08: monthly universe; months whose first day has no bars drop out."""
    return panel.universe(t.bars(spark, d), t.listings(spark, d), 20).select("rebalance_date", "symbol", F.round(F.log("adv"), 8).alias("log_adv"), "rank")


@query(_UNIVERSE.format("SELECT min(date) AS date FROM bars GROUP BY date_trunc('month', date)"))
def ref_01_universe_snapped(spark, d):
    return panel.universe(t.bars(spark, d), t.listings(spark, d), 20, snap=True).select("rebalance_date", "symbol", F.round(F.log("adv"), 8).alias("log_adv"), "rank")


@query("SELECT symbol, date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 3")
def win_17_18_last_rows(spark, d):
    return panel.latest(t.bars(spark, d), ["symbol"], [F.desc("date")], 3).select("symbol", "date", "close")


@query("""
SELECT g.date, g.symbol, last_value(close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS mark
FROM (SELECT s.date, x.symbol FROM sessions s CROSS JOIN (SELECT DISTINCT symbol FROM bars) x) g LEFT JOIN bars b ON b.date = g.date AND b.symbol = g.symbol
""")
def win_22_carry_forward(spark, d):
    """WIN-22, JOIN-20: last known close on the symbol x session grid."""
    b = t.bars(spark, d)
    grid = t.sessions(spark, d).select("date").crossJoin(b.select("symbol").distinct())
    return panel.carry_forward(grid, b)


@query(f"SELECT date, symbol, lead(label_5d, 1) OVER ({W}) AS next_label, round(pow(0.5, (row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1) / 378.0), 8) AS weight FROM scores")
def win_23_24_shift_and_decay(spark, d):
    x = t.scores(spark, d).withColumn("next_label", F.lead("label_5d", 1).over(panel.by_symbol()))
    return panel.decay_weights(x).select("date", "symbol", "next_label", F.round("weight", 8).alias("weight"))


@query("SELECT date, symbol, round((rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2) / count(*) OVER (PARTITION BY date), 6) AS pct FROM scores")
def win_25_percent_rank(spark, d):
    return rounded(panel.percent_rank(t.scores(spark, d), "score", "pct").select("date", "symbol", "pct"))


@query("SELECT date, CAST(ntile(8) OVER (ORDER BY date) - 1 AS INTEGER) AS block FROM (SELECT DISTINCT date FROM bars)")
def win_26_date_blocks(spark, d):
    return panel.date_blocks(t.bars(spark, d), 8)


@query("""
SELECT b.date, b.symbol, n.date AS next_session, p.date AS placebo_session FROM bars b LEFT JOIN sessions s ON s.date = b.date
LEFT JOIN sessions n ON n.session_idx = s.session_idx + 1 LEFT JOIN sessions p ON p.session_idx = s.session_idx - 20
""")
def win_21_28_session_shift(spark, d):
    c = t.sessions(spark, d)
    return panel.session_shift(panel.session_shift(t.bars(spark, d).select("date", "symbol"), c, 1, "next_session"), c, -20, "placebo_session")


_INTRADAY = """
WITH x AS (SELECT symbol, CAST(ts AS DATE) AS date, price, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol, CAST(ts AS DATE)) AS n, lag(price) OVER w AS p FROM ticks WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, seq)),
y AS (SELECT *, CASE WHEN p > 0 AND price > 0 THEN ln(price / p) END AS r FROM x),
z AS (SELECT symbol, date, max(CASE WHEN i = 0 THEN price END) AS f, max(CASE WHEN i = n - 1 THEN price END) AS l, max(CASE WHEN i = least(n - 1, 29) THEN price END) AS f30, max(CASE WHEN i = greatest(n - 30, 0) THEN price END) AS l30,
  max(price) AS hi, min(price) AS lo, coalesce(stddev_pop(r), 0) AS v, count(*) AS n_ticks FROM y GROUP BY 1, 2)
"""


@query(_INTRADAY + """
SELECT symbol, date, CASE WHEN f > 0 AND l > 0 THEN round(ln(l / f), 6) + 0.0 END AS minute_return, CASE WHEN lo <> 0 THEN round(hi / lo - 1, 6) END AS minute_range, round(v, 6) AS minute_vol,
  CASE WHEN f30 > 0 AND f > 0 THEN round(ln(f30 / f), 6) + 0.0 END AS first_30_return, CASE WHEN l30 > 0 AND l > 0 THEN round(ln(l / l30), 6) + 0.0 END AS last_30_return, n_ticks FROM z
""")
def agg_04_win_19_intraday(spark, d):
    return rounded(panel.intraday_features(t.ticks(spark, d)))


@query("SELECT symbol, date, n_ticks, round(n_ticks / avg(n_ticks) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), 6) AS volume_ratio FROM (SELECT symbol, CAST(ts AS DATE) AS date, count(*) AS n_ticks FROM ticks GROUP BY 1, 2)")
def win_20_volume_ratio(spark, d):
    daily = t.ticks(spark, d).groupBy("symbol", F.to_date("ts").alias("date")).agg(F.count("*").alias("n_ticks"))
    return rounded(panel.volume_ratio(daily))


@query(_INTRADAY + """, v AS (SELECT symbol, date, CASE WHEN l30 > 0 AND l > 0 THEN ln(l / l30) END AS r, n_ticks / avg(n_ticks) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS q FROM z)
SELECT symbol, date, round(r * coalesce(q, 0), 6) + 0.0 AS close_imbalance FROM v
""")
def win_20_close_imbalance(spark, d):
    return rounded(panel.close_imbalance(panel.volume_ratio(panel.intraday_features(t.ticks(spark, d)))).select("symbol", "date", "close_imbalance"))


@query("SELECT date, symbol, target_date, CASE WHEN target_date <= DATE '2001-06-30' THEN round(label_5d, 6) + 0.0 END AS label_5d FROM labels_5d")
def prj_13_label_maturity(spark, d):
    x = panel.build_labels(t.bars(spark, d), t.sessions(spark, d)).drop("raw_forward_return_5d")
    return rounded(panel.mature(x, "label_5d", "2001-06-30"))


@query(f"SELECT date, symbol, coalesce(round(ln(close / lag(close, 20) OVER ({W})), 6), 0.0) + 0.0 AS momentum_20d FROM bars")
def prj_20_clean_matrix(spark, d):
    return rounded(panel.clean_matrix(panel.momentum(t.bars(spark, d), (20,)).select("date", "symbol", "momentum_20d"), ["momentum_20d"]))


_IC = """
WITH r AS (SELECT {0} AS g, rank() OVER (PARTITION BY {0} ORDER BY score) + (count(*) OVER (PARTITION BY {0}, score) - 1) / 2 AS p, rank() OVER (PARTITION BY {0} ORDER BY label_5d) + (count(*) OVER (PARTITION BY {0}, label_5d) - 1) / 2 AS l FROM scores)
SELECT {1} round(coalesce(CASE WHEN isnan(corr(p, l)) THEN 0 ELSE corr(p, l) END, 0), 6) + 0.0 AS rank_ic, count(*) AS n FROM r GROUP BY g
"""


@query(_IC.format("year(date)", "CAST(g AS INTEGER) AS year,"))
def agg_07_rank_ic_by_year(spark, d):
    return rounded(panel.rank_ic(t.scores(spark, d).withColumn("year", F.year("date")), "score", "label_5d", ["year"]))


@query(_IC.format("0", ""))
def agg_07_rank_ic_pooled(spark, d):
    return rounded(panel.pooled_rank_ic(t.scores(spark, d), "score", "label_5d"))


@query("""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS r, count(*) OVER (PARTITION BY date) AS n FROM scores),
b AS (SELECT date, label_5d, greatest(0, ceil((r - 1) * least(10, n) / greatest(n - 1, 1)) - 1) AS b FROM x),
c AS (SELECT *, max(b) OVER (PARTITION BY date) AS hi, min(b) OVER (PARTITION BY date) AS lo FROM b)
SELECT date, round(avg(label_5d) FILTER (b = hi), 6) + 0.0 AS top_mean, round(avg(label_5d) FILTER (b = lo), 6) + 0.0 AS bottom_mean, round(avg(label_5d) FILTER (b = hi) - avg(label_5d) FILTER (b = lo), 6) + 0.0 AS spread,
  round(avg(CASE WHEN label_5d > 0 THEN 1.0 ELSE 0.0 END) FILTER (b = hi), 6) AS hit_rate, count(*) AS n FROM c GROUP BY date
""")
def agg_08_bucket_metrics(spark, d):
    return rounded(panel.bucket_metrics(t.scores(spark, d), "score", "label_5d"))


@query("""
SELECT g.seq, g.symbol, g.ts, b.ts AS ts_hit, b.price FROM (SELECT seq, symbol, ts FROM ticks WHERE event_type = 'signup') g
LEFT JOIN LATERAL (SELECT ts, price FROM ticks b WHERE b.event_type = 'view' AND b.symbol = g.symbol AND b.ts >= g.ts ORDER BY ts, seq LIMIT 1) b ON true
""")
def join_05_asof_forward(spark, d):
    x = t.ticks(spark, d)
    hit = asof.forward(x.where("event_type = 'signup'").select("seq", "symbol", "ts"), x.where("event_type = 'view'").select("symbol", "ts", "price"), ["symbol"], "ts", "ts", ["price"])
    return hit.select("seq", "symbol", "ts", "ts_hit", "price")


@query("""
SELECT g.date, g.symbol, b.ts AS ts_hit, b.price, b.seq FROM event_grid g LEFT JOIN LATERAL (SELECT ts, price, seq FROM ticks b WHERE b.symbol = g.symbol AND b.ts <= CAST(g.date AS TIMESTAMP) ORDER BY ts DESC, seq DESC LIMIT 1) b ON true
""")
def join_06_asof_backward(spark, d):
    grid = t.event_grid(spark, d).withColumn("at", F.col("date").cast("timestamp"))
    return asof.backward(grid, t.ticks(spark, d).select("symbol", "ts", "price", "seq"), ["symbol"], "at", "ts", ["price", "seq"], ["seq"]).select("date", "symbol", "ts_hit", "price", "seq")


_COUNTS = "count(*) FILTER (e.at >= CAST(g.date AS TIMESTAMP) - INTERVAL {} DAY AND e.at <= CAST(g.date AS TIMESTAMP) - INTERVAL {} DAY) AS {}"


@query(f"""
SELECT g.date, g.symbol, {_COUNTS.format(7, 0, "filings_7d")}, {_COUNTS.format(30, 0, "filings_30d")}, CAST(floor(epoch_us(CAST(g.date AS TIMESTAMP) - max(e.at)) / 86400000000) AS BIGINT) AS days_since_last
FROM event_grid g JOIN (SELECT symbol, accepted_at AS at FROM filings) e ON e.symbol = g.symbol AND e.at <= CAST(g.date AS TIMESTAMP) GROUP BY 1, 2
""")
def join_07_mod_03_filing_counts(spark, d):
    return asof.range_counts(t.event_grid(spark, d), t.filings(spark, d), "symbol", "accepted_at", {"filings_7d": (7, 0), "filings_30d": (30, 0)})


@query("""
WITH c AS (SELECT g.date, g.symbol, s.session_idx FROM bars g LEFT JOIN sessions s ON s.date = g.date),
e AS (SELECT a.symbol, s.session_idx FROM actions a JOIN sessions s ON s.date = a.ex_date)
SELECT date, symbol, EXISTS (SELECT 1 FROM e WHERE e.symbol = c.symbol AND e.session_idx - c.session_idx BETWEEN 1 AND 5) AS event_within FROM c
""")
def join_17_event_within(spark, d):
    return asof.within_sessions(t.bars(spark, d).select("date", "symbol"), t.actions(spark, d).select("symbol", F.col("ex_date").alias("event_date")), t.sessions(spark, d))


_ROUNDED = ", ".join({"adv_dollar_20d": "round(ln(adv_dollar_20d), 8) AS adv_dollar_20d", "amihud_20d": "round(1e6 * amihud_20d, 6) AS amihud_20d"}.get(c, f"round({c}, 6) + 0.0 AS {c}") for c in panel.FEATURES)


@query(f"SELECT date, symbol, {_ROUNDED} FROM features")
def mod_01_features(spark, d):
    """MOD-01: all 15 features at once; dollar volume as its logarithm, illiquidity in millionths."""
    x = panel.build_features(t.bars(spark, d)).withColumn("amihud_20d", F.col("amihud_20d") * 1e6).withColumn("adv_dollar_20d", F.log("adv_dollar_20d"))
    return rounded(x.withColumn("adv_dollar_20d", F.round("adv_dollar_20d", 8)).select("date", "symbol", *(F.when(F.lit(c == "adv_dollar_20d"), F.col(c)).otherwise(F.round(c, 6)).alias(c) for c in panel.FEATURES)), 8)
