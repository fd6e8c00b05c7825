"""Queries on curation, reference data and data quality, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation, quality, reference
from ..sources.folders import fresh
from . import tables as t
from .tables import query, rounded

_GAPS = """
hits AS (SELECT a.symbol, a.ex_date, CASE WHEN event_type = 'split' THEN 0 ELSE 1 END AS k, coalesce(ratio, -amount) AS v, (SELECT max(date) FROM bars b WHERE b.symbol = a.symbol AND b.date < a.ex_date) AS date FROM actions a),
lists AS (SELECT h.symbol, h.date, any_value(b.close) AS c, list(v ORDER BY ex_date, k, v DESC) AS vs FROM hits h JOIN bars b ON b.symbol = h.symbol AND b.date = h.date GROUP BY 1, 2),
gaps AS (SELECT symbol, date, list_reduce(list_prepend(1.0::DOUBLE, vs), lambda f, v: CASE WHEN v > 0 THEN f * v WHEN c * f > -v THEN f * (c * f + v) / (c * f) ELSE f END) AS pf,
  list_reduce(list_prepend(1.0::DOUBLE, vs), lambda f, v: CASE WHEN v > 0 THEN f * v ELSE f END) AS sf FROM lists)
"""


@query(f"""
WITH {_GAPS},
f AS (SELECT b.*, product(coalesce(pf, 1)) OVER w AS f, product(coalesce(sf, 1)) OVER w AS s FROM bars b LEFT JOIN gaps g ON g.symbol = b.symbol AND g.date = b.date WINDOW w AS (PARTITION BY b.symbol ORDER BY b.date DESC ROWS UNBOUNDED PRECEDING))
SELECT date, symbol, round(open * f, 8) AS open, round(high * f, 8) AS high, round(low * f, 8) AS low, round(close * f, 8) AS close, round(vwap * f, 8) AS vwap, round(volume / s, 6) AS volume, round(f, 10) AS factor FROM f
""")
def cur_01_join_09_adjusted_bars(spark, d):
    x = curation.adjust(t.bars(spark, d), t.actions(spark, d))
    return x.select("date", "symbol", *(F.round(c, 8).alias(c) for c in ("open", "high", "low", "close", "vwap")), F.round("volume", 6).alias("volume"), F.round("factor", 10).alias("factor"))


@query(f"""
WITH {_GAPS},
f AS (SELECT b.*, product(coalesce(pf, 1)) OVER (PARTITION BY b.symbol ORDER BY b.date DESC ROWS UNBOUNDED PRECEDING) AS f FROM bars b LEFT JOIN gaps g ON g.symbol = b.symbol AND g.date = b.date)
SELECT date, symbol, round(close * f, 8) AS close FROM f WHERE date IN (SELECT ex_date FROM actions)
""")
def cur_02_changed_dates(spark, d):
    a = t.actions(spark, d)
    x = curation.changed_only(curation.adjust(t.bars(spark, d), a), a.select(F.col("ex_date").alias("date")))
    return x.select("date", "symbol", F.round("close", 8).alias("close"))


@query("""
SELECT symbol, date, l_orderkey, source, price FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linestatus AS source, l_extendedprice AS price,
  row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_returnflag, l_orderkey DESC, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1
""")
def snk_04_win_16_vendor_priority(spark, d):
    x = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_orderkey", F.col("l_linestatus").alias("source"), F.col("l_extendedprice").alias("price"), "l_returnflag", "l_linenumber", "l_partkey")
    return curation.prefer(x, ["symbol", "date"], ["l_returnflag", F.desc("l_orderkey"), "l_linenumber", "l_partkey"]).select("symbol", "date", "l_orderkey", "source", "price")


@query("SELECT c_custkey, c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0")
def snk_03_upsert(spark, d):
    x = t.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return curation.upsert(x, x.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS date, NULL::VARCHAR AS extra FROM events UNION SELECT user_id, event_type, CAST(ts AS DATE), 'x' FROM events WHERE event_id % 2 = 0")
def snk_02_set_01_02_append_distinct(spark, d):
    x = t.table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("date"), "event_id")
    return curation.append_distinct(x.drop("event_id"), x.where("event_id % 2 = 0").drop("event_id").withColumn("extra", F.lit("x")))


@query("""
WITH src AS (SELECT CAST(symbol AS VARCHAR) AS symbol, CASE WHEN symbol % 3 = 0 THEN '' ELSE name END AS name, exchange, ipo_date, NULL::DATE AS delist_date, 'listing' AS source, 1 AS r FROM listings
  UNION ALL SELECT CAST(symbol AS VARCHAR), 'X' || name, '', ipo_date + 5, delist_date, 'delisting', 2 FROM listings)
SELECT symbol, arg_min(name, r) FILTER (name <> '') AS name, arg_min(exchange, r) FILTER (exchange <> '') AS exchange, 'common_stock' AS asset_type, min(ipo_date) AS ipo_date, max(delist_date) AS delist_date,
  CASE WHEN bool_or(delist_date IS NOT NULL) THEN 'delisted' ELSE 'active' END AS status, 'delisting,listing' AS sources FROM src GROUP BY symbol
""")
def agg_01_prj_01_golden_records(spark, d):
    return curation.golden_records(_listing_sources(spark, d))


def _listing_sources(spark, d):
    """Listings and delistings in layouts of their own, aligned."""
    x = t.listings(spark, d)
    a = x.select("symbol", F.when(F.col("symbol") % 3 == 0, "").otherwise(F.col("name")).alias("title"), "exchange", "ipo_date")
    b = x.select(F.col("symbol").alias("ticker"), F.concat(F.lit("X"), "name").alias("name"), F.date_add("ipo_date", 5).alias("start"), "delist_date")
    fields = {"symbol": ["symbol", "ticker"], "name": ["name", "title"], "exchange": ["exchange"], "asset_type": ["type"], "ipo_date": ["ipo_date", "start"], "delist_date": ["delist_date"]}
    one, two = curation.aligned(a, fields, "listing", 1), curation.aligned(b, fields, "delisting", 2)
    typed = lambda f: f.select("symbol", "name", F.col("exchange").cast("string").alias("exchange"), F.col("asset_type").cast("string").alias("asset_type"), "ipo_date", F.col("delist_date").cast("date").alias("delist_date"), "source", "source_rank")
    return typed(one).unionByName(typed(two))


# renames of negative balances to the next key, two of some symbols; links of customers' nations to suppliers; orders as filings
_REFERENCE = """
raw AS (SELECT CAST(s_suppkey AS VARCHAR) AS o, CAST(s_suppkey + 1 AS VARCHAR) AS n, DATE '2001-01-01' + CAST(s_nationkey AS INTEGER) AS dt, CASE WHEN s_acctbal < -500 THEN 'K' || s_nationkey END AS c FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CAST(s_suppkey + 2 AS VARCHAR), DATE '2002-01-01', NULL FROM supplier WHERE s_acctbal < -700),
links AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, min('C' || s_nationkey) AS cik FROM supplier WHERE s_acctbal > 2000 GROUP BY 1),
last AS (SELECT o, arg_max(n, dt) AS n, max(dt) AS dt, arg_max(coalesce(c, '-'), dt) AS c FROM raw GROUP BY 1),
filed AS (SELECT DISTINCT 'C' || (o_custkey % 25) AS cik, o_orderstatus AS form, CAST(o_orderdate AS DATE) AS filing_date, CAST(o_orderkey AS VARCHAR) AS accession_number FROM orders),
by_cik AS (SELECT cik, min(symbol) AS symbol FROM links GROUP BY 1),
master AS (SELECT CAST(l.symbol AS VARCHAR) AS symbol, coalesce(last.n, CAST(l.symbol AS VARCHAR)) AS primary_symbol, last.dt AS change_date, coalesce(nullif(last.c, '-'), a.cik, b.cik) AS cik FROM listings l
  LEFT JOIN last ON last.o = CAST(l.symbol AS VARCHAR) LEFT JOIN links a ON a.symbol = CAST(l.symbol AS VARCHAR) LEFT JOIN links b ON b.symbol = coalesce(last.n, CAST(l.symbol AS VARCHAR)))
"""


def _reference_sources(spark, d):
    s, name = t.table(spark, d, "supplier"), F.col("s_suppkey").cast("string")
    first = s.where("s_acctbal < 0").select(name.alias("oldSymbol"), (F.col("s_suppkey") + 1).cast("string").alias("newSymbol"), F.expr("date_add(DATE '2001-01-01', CAST(s_nationkey AS int))").alias("date"), F.when(F.col("s_acctbal") < -500, F.concat(F.lit("k"), "s_nationkey")).alias("cik"))
    second = s.where("s_acctbal < -700").select(F.concat(F.lit(" "), name).alias("oldSymbol"), (F.col("s_suppkey") + 2).cast("string").alias("newSymbol"), F.lit("2002-01-01").cast("date").alias("date"), F.lit(None).cast("string").alias("cik"))
    changes = first.withColumn("cik", F.upper("cik")).unionByName(second).unionByName(second.withColumn("newSymbol", F.lit("")))
    links = s.where("s_acctbal > 2000").select(name.alias("ticker"), F.concat(F.lit("C"), "s_nationkey").alias("cik_str"))
    o = t.table(spark, d, "orders")
    filings = o.select(F.concat(F.lit("C"), F.col("o_custkey") % 25).alias("cik"), F.lit("").alias("symbol"), F.col("o_orderstatus").alias("form"), F.to_date("o_orderdate").alias("filingDate"), F.col("o_orderkey").cast("string").alias("accessionNumber"))
    return changes, links, filings.unionByName(filings)


@query(f"WITH {_REFERENCE} SELECT symbol, primary_symbol, change_date, cik, coalesce('cik:' || cik, 'symbol:' || primary_symbol) AS issuer_key FROM master")
def ref_01_security_master(spark, d):
    changes, links, _ = _reference_sources(spark, d)
    x = t.listings(spark, d).withColumn("symbol", F.col("symbol").cast("string"))
    return reference.security_master(x, changes, links).select("symbol", "primary_symbol", "change_date", "cik", "issuer_key")


@query(f"WITH {_REFERENCE} SELECT filed.cik, coalesce(by_cik.symbol, '') AS symbol, form, filing_date, accession_number FROM filed LEFT JOIN by_cik ON by_cik.cik = filed.cik")
def ref_01_filing_index(spark, d):
    _, links, filings = _reference_sources(spark, d)
    return reference.filing_index(filings, links).drop("accepted_at")


@query(f"""WITH {_REFERENCE}, adv AS (SELECT date, symbol, CASE WHEN count(*) OVER w >= 5 THEN avg(close * volume) OVER w END AS adv FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
act AS (SELECT adv.date, adv.symbol FROM adv JOIN listings l ON l.symbol = adv.symbol WHERE adv IS NOT NULL AND (ipo_date IS NULL OR ipo_date <= adv.date) AND (delist_date IS NULL OR delist_date > adv.date)),
sized AS (SELECT date, least(count(*), 20) AS n FROM act GROUP BY 1)
SELECT 'listing_history' AS artifact, count(*) AS rows, 8 AS columns FROM listings UNION ALL SELECT 'ticker_changes', count(*), 5 FROM (SELECT DISTINCT * FROM raw) UNION ALL SELECT 'sec_filing_index', count(*), 6 FROM filed
UNION ALL SELECT 'security_master', count(*), 12 FROM master UNION ALL SELECT 'time_varying_universe', CAST(sum(n) AS BIGINT), 4 FROM sized WHERE date IN (SELECT CAST(date_trunc('month', date) AS DATE) FROM bars)
UNION ALL SELECT 'universe_snapshots', CAST(sum(n) AS BIGINT), 4 FROM sized WHERE date IN (SELECT min(date) FROM bars GROUP BY date_trunc('month', date))
""")
def ref_01_rebuild(spark, d):
    """REF-01: every derived reference table written in one go, with its size."""
    changes, links, filings = _reference_sources(spark, d)
    return reference.rebuild(_listing_sources(spark, d), changes, links, filings, t.bars(spark, d), fresh(spark, "reference"), 20)


@query("SELECT user_id AS symbol, CAST(ts AS DATE) AS date, count(DISTINCT event_type) AS source_count, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources, max(ts) AS last_verified FROM events GROUP BY 1, 2")
def agg_02_corroborated(spark, d):
    x = t.table(spark, d, "events").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("date"), "event_type", "ts")
    return curation.corroborated(x, ["symbol", "date"], "event_type", "ts")


@query("""
WITH r AS (SELECT symbol, date, close * volume AS v, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars)
SELECT symbol, round(avg(v), 6) AS adv, count(DISTINCT date) AS n_sessions FROM r WHERE rn <= 30 GROUP BY symbol HAVING count(DISTINCT date) >= 20 ORDER BY avg(v) DESC, symbol LIMIT 10
""")
def agg_03_srt_02_stage0_universe(spark, d):
    return rounded(curation.stage0_universe(t.bars(spark, d), t.listings(spark, d), 10, 30, 20))


@query("SELECT p_partkey, p_name, CASE WHEN t IN ('stock', 'cs', 'common_stock', 'common', 'equity', 'us_equity', '') THEN 'common_stock' WHEN t IN ('etf', 'etp', 'etn', 'fund') THEN 'etf' ELSE t END AS asset_type FROM (SELECT *, regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g') AS t FROM part) WHERE NOT regexp_matches(upper(p_name), '\\b(RED|BLUE)\\b')")
def prj_02_03_asset_filters(spark, d):
    x = t.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), curation.asset_type(F.col("p_type")).alias("asset_type"))
    return curation.common_stocks(x, ("RED", "BLUE")).withColumnRenamed("name", "p_name")


@query("SELECT symbol, exchange, ipo_date, delist_date FROM listings WHERE (ipo_date IS NULL OR ipo_date <= DATE '2001-10-15') AND (delist_date IS NULL OR delist_date > DATE '2001-10-15')")
def prj_04_active_listings(spark, d):
    return curation.active_on(t.listings(spark, d), "2001-10-15").select("symbol", "exchange", "ipo_date", "delist_date")


@query("""
WITH dim AS (SELECT c_nationkey, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer)
SELECT n_nationkey AS c_nationkey, n_name, c_custkey, c_name FROM nation LEFT JOIN dim ON dim.c_nationkey = n_nationkey AND rn = 1
""")
def join_10_preferred_lookup(spark, d):
    dim = t.table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name", "c_acctbal")
    left = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return curation.preferred_lookup(left, dim, "c_nationkey", [F.desc("c_acctbal"), "c_custkey"]).select("c_nationkey", "n_name", "c_custkey", "c_name")


@query("""
SELECT s.s_suppkey AS symbol, coalesce(a.c, b.c, p.c) AS issuer FROM supplier s LEFT JOIN (SELECT s_suppkey AS symbol, s_suppkey + 1 AS renamed FROM supplier WHERE s_suppkey % 5 = 0) r ON r.symbol = s.s_suppkey
LEFT JOIN (SELECT s_suppkey AS k, 'C' || s_nationkey AS c FROM supplier WHERE s_suppkey % 2 = 0) a ON a.k = r.renamed LEFT JOIN (SELECT s_suppkey AS k, 'C' || s_nationkey AS c FROM supplier WHERE s_suppkey % 2 = 0) b ON b.k = s.s_suppkey
LEFT JOIN (SELECT s_suppkey AS k, 'C' || s_nationkey AS c FROM supplier WHERE s_suppkey % 2 = 0) p ON p.k = s.s_suppkey - 1
""")
def join_11_issuer_keys(spark, d):
    s = t.table(spark, d, "supplier")
    rows = s.select(F.col("s_suppkey").alias("symbol"), (F.col("s_suppkey") - 1).alias("primary"))
    renames = s.where("s_suppkey % 5 = 0").select(F.col("s_suppkey").alias("symbol"), (F.col("s_suppkey") + 1).alias("new_symbol"))
    links = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("symbol"), F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("cik"))
    return curation.issuer_keys(rows, renames, links).select("symbol", "issuer")


_GRADED = """
WITH c AS (SELECT date, count(*) AS row_count FROM bars GROUP BY 1), e AS (SELECT max(row_count) AS expected FROM c),
days AS (SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM bars),
g AS (SELECT days.date, CASE WHEN s.date IS NULL THEN 'GREEN' WHEN c.row_count IS NULL THEN 'RED' WHEN c.row_count < 20 THEN 'AMBER' ELSE 'GREEN' END AS status,
  CASE WHEN s.date IS NULL THEN 'NO_SESSION' WHEN c.row_count IS NULL THEN 'MISSING' WHEN c.row_count < 20 THEN 'LOW_ROW_COUNT' ELSE 'OK' END AS qc_code,
  CASE WHEN s.date IS NULL THEN 0 ELSE c.row_count END AS row_count, CAST(CASE WHEN s.date IS NULL THEN 0 ELSE 20 END AS BIGINT) AS expected_rows
  FROM days LEFT JOIN sessions s ON s.date = days.date LEFT JOIN c ON c.date = days.date)
"""


def _graded(spark, d):
    b = t.bars(spark, d)
    days = b.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    return quality.grade_partitions(b.groupBy("date").agg(F.count("*").alias("row_count")), days, t.sessions(spark, d), 20)


@query(_GRADED + "SELECT * FROM g")
def agg_15_partition_grades(spark, d):
    return _graded(spark, d)


@query(_GRADED + """
SELECT max(date) AS anchor, round(avg(CASE WHEN status = 'GREEN' THEN 1.0 ELSE 0.0 END), 8) AS green_ratio, count(*) FILTER (status = 'RED') AS red_days,
  (SELECT max(date) FROM c WHERE row_count >= 25 AND date <= (SELECT max(date) FROM g) - 30) AS cutoff FROM g
""")
def agg_16_coverage(spark, d):
    counts = t.bars(spark, d).groupBy("date").agg(F.count("*").alias("n_symbols"))
    return rounded(quality.coverage(_graded(spark, d), counts, 25, 30), 8)


@query("SELECT s.date, x.symbol FROM sessions s CROSS JOIN (SELECT DISTINCT symbol FROM bars) x WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.date = s.date AND b.symbol = x.symbol)")
def join_12_join_20_set_03_missing_units(spark, d):
    b = t.bars(spark, d)
    return quality.missing_units(t.sessions(spark, d).select("date").crossJoin(b.select("symbol").distinct()), b, ["date", "symbol"])


@query("""
WITH x AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS date, ts, event_type, CASE WHEN event_id % 50 <> 0 THEN value END AS value FROM events),
d AS (SELECT coalesce(sum(n), 0) AS dup FROM (SELECT count(*) AS n FROM x GROUP BY symbol, date, event_type HAVING count(*) > 1)),
s AS (SELECT count(*) AS n, max(0) AS z, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS nulls, count(*) FILTER (ts > CAST(date AS TIMESTAMP) + INTERVAL 1 DAY) AS late FROM x)
SELECT 'events' AS dataset, n AS rows_checked, CAST(dup AS BIGINT) AS duplicate_keys, round(dup / n, 8) AS duplicate_rate, round(nulls, 8) AS null_rate_max, late AS pit_violations,
  CASE WHEN late > 0 THEN 'timestamp_violation' WHEN dup / n > 0.01 THEN 'duplicate_keys' WHEN dup > 0 THEN 'ok_minor_duplicates' ELSE 'ok' END AS status,
  CASE WHEN late > 0 THEN 'CRITICAL' WHEN dup / n > 0.01 THEN 'WARNING' ELSE 'OK' END AS verdict FROM s, d
""")
def agg_17_prj_14_quality_row(spark, d):
    x = t.table(spark, d, "events").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("date"), "ts", "event_type", F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("value"))
    return rounded(quality.quality_row(x, "events", ["symbol", "date", "event_type"], ["symbol", "value"], "ts"), 8)


@query("SELECT x.symbol, n AS expected, coalesce(k, 0) AS completed, n - coalesce(k, 0) AS remaining FROM (SELECT DISTINCT symbol FROM bars) x CROSS JOIN (SELECT count(*) AS n FROM sessions) LEFT JOIN (SELECT symbol, count(DISTINCT b.date) AS k FROM bars b JOIN sessions s ON s.date = b.date GROUP BY 1) y ON y.symbol = x.symbol")
def agg_18_progress(spark, d):
    b, s = t.bars(spark, d), t.sessions(spark, d).select("date")
    return quality.progress(s.crossJoin(b.select("symbol").distinct()), b.join(s, "date", "left_semi"))


@query("""
SELECT date, count(*) AS row_count, count(DISTINCT symbol) AS symbol_count, sha1(CAST(count(*) AS VARCHAR) || '|' || string_agg(DISTINCT CAST(symbol AS VARCHAR), '|' ORDER BY CAST(symbol AS VARCHAR))) AS content_hash,
  CASE WHEN count(DISTINCT symbol) >= 20 THEN 'HEALTHY' ELSE 'INCOMPLETE' END AS status FROM bars GROUP BY date
""")
def agg_19_manifest(spark, d):
    return quality.manifest(t.bars(spark, d), 20)


@query("SELECT event_type, latest, age_minutes, CASE WHEN age_minutes > 1450 THEN 'STALE' ELSE 'FRESH' END AS status FROM (SELECT event_type, max(ts) AS latest, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts))) / 60000000) AS BIGINT) AS age_minutes FROM events GROUP BY 1)")
def agg_43_freshness(spark, d):
    return quality.freshness(t.table(spark, d, "events"), "event_type", "ts", "2024-01-31 00:00:00", 1450)


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|' || coalesce(CAST(o_custkey AS VARCHAR), '\\N') || '|' || coalesce(o_orderstatus, '\\N') || '|' || coalesce(o_orderpriority, '\\N') || '|' || year(o_orderdate)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS content FROM orders GROUP BY 1""")
def agg_48_fingerprint(spark, d):
    x = t.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year"))
    return quality.fingerprint(x, ["year"])


@query("SELECT a.symbol, a.date, a.close AS primary_value, b.vwap AS vendor_value, round(abs(b.vwap - a.close) / abs(a.close), 8) AS difference FROM bars a JOIN bars b ON a.symbol = b.symbol AND a.date = b.date")
def join_16_cross_vendor(spark, d):
    b = t.bars(spark, d)
    x = quality.cross_vendor(b, b.select("symbol", "date", F.col("vwap").alias("close")), ["symbol", "date"], "close")
    return x.withColumn("difference", F.round("difference", 8))


@query("""
WITH x AS (SELECT lag(close) OVER w AS m1, lag(close, 20) OVER w AS m20, lag(close, 126) OVER w AS m126 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT 'short' AS feature_group, round(avg(CASE WHEN coalesce(m1, m20) IS NOT NULL THEN 1.0 ELSE 0.0 END), 8) AS coverage, true AS ready FROM x UNION ALL SELECT 'long', round(avg(CASE WHEN m126 IS NOT NULL THEN 1.0 ELSE 0.0 END), 8), true FROM x
""")
def agg_27_group_coverage(spark, d):
    from ..operators import panel

    x = panel.momentum(t.bars(spark, d), (1, 20, 126))
    return rounded(quality.group_coverage(x, {"short": ["momentum_1d", "momentum_20d"], "long": ["momentum_126d"]}), 8)


@query("""
WITH a AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders), b AS (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS DATE) AS month FROM lineitem)
SELECT coalesce(a.month, b.month) AS month, CASE WHEN a.month IS NULL THEN [0] ELSE [1] END AS missing FROM a FULL JOIN b ON a.month = b.month WHERE a.month IS NULL OR b.month IS NULL
""")
def set_05_month_gaps(spark, d):
    return quality.month_gaps(t.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")), t.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")))


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_13_set_04_semi(spark, d):
    """JOIN-13, SET-04: keys on both sides."""
    return t.table(spark, d, "customer").select("c_custkey").join(t.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").distinct()


@query("SELECT b.date, b.symbol, b.close FROM bars b WHERE EXISTS (SELECT 1 FROM actions a WHERE a.symbol = b.symbol AND b.date BETWEEN a.ex_date - 2 AND a.ex_date + 2)")
def src_03_needed_slices(spark, d):
    """SRC-03: only the (symbol, date) slices around actions, by an equi semi-join."""
    need = t.actions(spark, d).select("symbol", F.explode(F.expr("sequence(date_sub(ex_date, 2), date_add(ex_date, 2))")).alias("date")).distinct()
    return t.bars(spark, d).join(need, ["symbol", "date"], "left_semi").select("date", "symbol", "close")


@query("SELECT date, symbol, close FROM bars WHERE date = (SELECT max(date) FROM bars WHERE date < DATE '2001-06-15')")
def src_21_latest_prior_partition(spark, d):
    b = t.bars(spark, d)
    last = b.where("date < DATE '2001-06-15'").agg(F.max("date").alias("date"))
    return b.join(last, "date", "left_semi").select("date", "symbol", "close")
