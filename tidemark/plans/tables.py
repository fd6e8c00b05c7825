"""Domain tables derived from the driver's tables: once as DataFrames, once as DuckDB views for the oracle.

The SQL is written on its own, from the definitions, so that a comparison means something.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel
from ..sources.folders import bucketed, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that must give the same rows."""

    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums come in any order; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c, kind in df.dtypes if kind == "double"})


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars: symbol = supplier, price = extended price / quantity, in the order of (order, line, part) within a day."""
    x = table(spark, d, "lineitem").select(
        F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("symbol"), F.try_divide("l_extendedprice", "l_quantity").alias("price"), "l_quantity",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("at"),
    )
    return x.groupBy("date", "symbol").agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"),
        F.try_divide(F.sum("amount").cast("double"), F.sum("l_quantity")).alias("vwap"), F.sum("l_quantity").cast("bigint").alias("volume"), F.count("*").alias("trade_count"),
    )


def prices(spark: SparkSession, d: str) -> DataFrame:
    """date, symbol, open, close and volume of bars(), bucketed by symbol. Only what they need of the lines moves, once, to the symbol's task."""
    x = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_suppkey").alias("symbol"), "l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey")
    x = x.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "symbol")
    price, at = F.try_divide("l_extendedprice", "l_quantity"), F.struct("l_orderkey", "l_linenumber", "l_partkey")
    x = x.groupBy("date", "symbol").agg(F.min_by(price, at).alias("open"), F.max_by(price, at).alias("close"), F.sum("l_quantity").cast("bigint").alias("volume"))
    return bucketed(x, "prices", "symbol")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return panel.sessions(bars(spark, d).select("date"))


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), "event_type")


def news(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").where("event_type IN ('view', 'click')")
    return x.select(F.col("user_id").alias("symbol"), F.col("ts").alias("published_at"), F.get_json_object("props", "$.k").alias("source"), F.col("event_type").alias("vendor"), F.col("event_id").alias("news_id"))


def filings(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").where("event_type = 'purchase'")
    return x.select(F.col("user_id").alias("symbol"), F.col("ts").alias("accepted_at"), F.when(F.col("event_id") % 3 == 0, "10-K").when(F.col("event_id") % 3 == 1, "10-Q").otherwise("8-K").alias("form"), "event_id")


def event_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol of the events on every day of theirs."""
    x = table(spark, d, "events")
    days = x.select(F.to_date("ts").alias("date")).distinct()
    return days.crossJoin(x.select(F.col("user_id").alias("symbol")).distinct())  # days x symbols: JOIN-20's expectation grid


def actions(spark: SparkSession, d: str) -> DataFrame:
    """Corporate actions: a split of price factor 0.5 on the last day of a symbol's returned lines of each year, a dividend on the last day of its accepted lines of each quarter, a hundredth of the quarter's lowest price."""
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"), "l_returnflag", F.try_divide("l_extendedprice", "l_quantity").alias("price"))
    split = x.where("l_returnflag = 'R'").groupBy("symbol", F.trunc("date", "year")).agg(F.max("date").alias("ex_date"))
    paid = x.where("l_returnflag = 'A'").groupBy("symbol", F.trunc("date", "quarter")).agg(F.max("date").alias("ex_date"), F.round(F.min("price") / 100, 2).alias("amount"))
    none = F.lit(None).cast("double")
    return split.select("symbol", "ex_date", F.lit("split").alias("event_type"), F.lit(0.5).alias("ratio"), none.alias("amount")).unionByName(paid.select("symbol", "ex_date", F.lit("dividend").alias("event_type"), none.alias("ratio"), "amount"))


def listings(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    range_ = bars(spark, d).groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return s.join(range_, F.col("s_suppkey") == F.col("symbol")).select(
        "symbol", F.col("s_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "NYSE").otherwise("NASDAQ").alias("exchange"), F.lit("common_stock").alias("asset_type"),
        F.col("a").alias("ipo_date"), F.when(F.col("symbol") % 7 == 0, F.col("b")).alias("delist_date"), F.col("s_acctbal").alias("balance"),
    )


def scores(spark: SparkSession, d: str, b: DataFrame | None = None) -> DataFrame:
    """date, symbol, score (20-day momentum, lagged), label_5d of the dates that have both. b: bars(), if they are written already."""
    b = written(bars(spark, d).select("date", "symbol", "close"), "bars") if b is None else b  # read for scores, sessions and labels
    days = b.select("date")
    x = panel.lagged(panel.momentum(b.select("date", "symbol", "close"), (20,)), ["momentum_20d"]).withColumn("score", F.round("momentum_20d", 10))
    y = panel.build_labels(x, panel.sessions(days), keep=("score",), days=days).where("symbol IS NOT NULL AND score IS NOT NULL")
    return y.select("date", "symbol", "score", F.round("label_5d", 10).alias("label_5d"), F.round("raw_forward_return_5d", 10).alias("raw_forward_return_5d"))


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as reported transactions: accession = order, issuer = customer, code by flag and status."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_custkey").alias("issuer"), F.col("o_orderdate").alias("accepted_at"), F.col("o_orderpriority").alias("role"), "o_orderstatus")
    x = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("owner"),
        F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").when(F.col("l_linestatus") == "O", "M").otherwise("F").alias("code"),
        F.col("l_quantity").cast("decimal(18,4)").alias("shares"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10000) / 10000).cast("decimal(18,4)").alias("price"), F.to_date("l_shipdate").alias("traded_on"),
    )
    return x.join(o, "accession")


VIEWS: dict[str, str] = {
    "bars": """SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS symbol, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS vwap, CAST(sum(l_quantity) AS BIGINT) AS volume, count(*) AS trade_count
  FROM (SELECT *, l_extendedprice / l_quantity AS p, (l_orderkey * 16 + l_linenumber) * 10000000 + l_partkey AS k FROM lineitem) GROUP BY 1, 2""",
    "sessions": """SELECT row_number() OVER (ORDER BY date) - 1 AS session_idx, date FROM (
  SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM bars) WHERE isodow(date) < 6""",
    "ticks": "SELECT user_id AS symbol, ts, event_id AS seq, value AS price, event_type FROM events",
    "news": """SELECT user_id AS symbol, ts AS published_at, regexp_extract(props, '"k": *([0-9]+)', 1) AS source, event_type AS vendor, event_id AS news_id FROM events WHERE event_type IN ('view', 'click')""",
    "filings": "SELECT user_id AS symbol, ts AS accepted_at, CASE event_id % 3 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END AS form, event_id FROM events WHERE event_type = 'purchase'",
    "event_grid": "SELECT date, symbol FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) CROSS JOIN (SELECT DISTINCT user_id AS symbol FROM events)",
    "actions": """SELECT l_suppkey AS symbol, max(CAST(l_shipdate AS DATE)) AS ex_date, 'split' AS event_type, 0.5::DOUBLE AS ratio, NULL::DOUBLE AS amount FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey, year(l_shipdate)
  UNION ALL SELECT l_suppkey, max(CAST(l_shipdate AS DATE)), 'dividend', NULL, round(min(l_extendedprice / l_quantity) / 100, 2) FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey, date_trunc('quarter', l_shipdate)""",
    "listings": """SELECT symbol, s_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'NYSE' ELSE 'NASDAQ' END AS exchange, 'common_stock' AS asset_type, a AS ipo_date, CASE WHEN symbol % 7 = 0 THEN b END AS delist_date, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN (SELECT symbol, min(date) AS a, max(date) AS b FROM bars GROUP BY 1) ON s_suppkey = symbol""",
    "returns": "SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS ret_1d FROM bars",
    "features": "SELECT date, symbol, " + ", ".join(f"lag({c}) OVER (PARTITION BY symbol ORDER BY date) AS {c}" for c in panel.FEATURES) + """ FROM (
  SELECT *, CASE WHEN count(residual) OVER w20 = 20 THEN stddev_samp(residual) OVER w20 END AS idio_vol_20d FROM (
    SELECT *, ret_1d - CASE WHEN count(CASE WHEN ret_1d IS NOT NULL AND mkt_ret IS NOT NULL THEN 1 END) OVER w20 = 20 THEN covar_samp(ret_1d, mkt_ret) OVER w20 / nullif(var_pop(mkt_ret) OVER w20, 0) END * mkt_ret AS residual,
      ln(close / lag(close, 5) OVER w) AS momentum_5d, ln(close / lag(close, 20) OVER w) AS momentum_20d, ln(close / lag(close, 60) OVER w) AS momentum_60d, ln(close / lag(close, 126) OVER w) AS momentum_126d,
      -ln(close / lag(close, 1) OVER w) AS reversal_1d, -ln(close / lag(close, 5) OVER w) AS reversal_5d,
      CASE WHEN count(*) OVER w20 = 20 THEN close / max(close) OVER w20 - 1 END AS drawdown_20d, CASE WHEN count(*) OVER w60 = 60 THEN close / max(close) OVER w60 - 1 END AS drawdown_60d, ln(open / lag(close) OVER w) AS gap_overnight,
      CASE WHEN count(ret_1d) OVER w20 = 20 THEN stddev_samp(ret_1d) OVER w20 END AS realized_vol_20d, CASE WHEN count(ret_1d) OVER w60 = 60 THEN stddev_samp(ret_1d) OVER w60 END AS realized_vol_60d,
      CASE WHEN count(*) OVER w20 = 20 THEN avg(close * volume) OVER w20 END AS adv_dollar_20d, CASE WHEN count(il) OVER w20 = 20 THEN avg(il) OVER w20 END AS amihud_20d, ln(greatest(close, 1e-9)) AS log_price
    FROM (SELECT *, avg(ret_1d) OVER (PARTITION BY date) AS mkt_ret, abs(ret_1d) / nullif(close * volume, 0) AS il FROM returns)
    WINDOW w AS (PARTITION BY symbol ORDER BY date), w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), w60 AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING))
  WINDOW w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))""",
    "labels_5d": """SELECT date, symbol, target_date, r AS raw_forward_return_5d, r - avg(r) OVER (PARTITION BY date) AS label_5d FROM (
  SELECT b.date, b.symbol, t.target_date, ln(c.close / b.close) AS r FROM bars b JOIN (
    SELECT o.date, CASE WHEN s.session_idx IS NOT NULL THEN n.date ELSE o.observed END AS target_date
    FROM (SELECT date, lead(date, 5) OVER (ORDER BY date) AS observed FROM (SELECT DISTINCT date FROM bars)) o LEFT JOIN sessions s ON s.date = o.date LEFT JOIN sessions n ON n.session_idx = s.session_idx + 5
  ) t ON t.date = b.date JOIN bars c ON c.symbol = b.symbol AND c.date = t.target_date)""",
    "scores": """SELECT x.date, x.symbol, round(score, 10) AS score, round(label_5d, 10) AS label_5d, round(raw_forward_return_5d, 10) AS raw_forward_return_5d FROM (
  SELECT date, symbol, lag(m) OVER (PARTITION BY symbol ORDER BY date) AS score FROM (SELECT date, symbol, ln(close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY date)) AS m FROM bars)) x
  JOIN labels_5d y ON x.date = y.date AND x.symbol = y.symbol WHERE score IS NOT NULL""",
    "transactions": """SELECT l_orderkey AS accession, l_linenumber AS line, l_partkey AS part, l_suppkey AS owner, CASE WHEN l_returnflag = 'A' THEN 'P' WHEN l_returnflag = 'R' THEN 'S' WHEN l_linestatus = 'O' THEN 'M' ELSE 'F' END AS code,
  CAST(l_quantity AS DECIMAL(18,4)) AS shares, CAST(floor(l_extendedprice / l_quantity * 10000) / 10000 AS DECIMAL(18,4)) AS price, CAST(l_shipdate AS DATE) AS traded_on, o_custkey AS issuer, o_orderdate AS accepted_at, o_orderpriority AS role, o_orderstatus
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
}
#: Names that are tables of the driver as well; the views take them over.
_ORDER = list(VIEWS)


def with_views(sql: str) -> str:
    """sql behind the views that it needs, directly or through others. sql that begins with WITH goes on with its own."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _ORDER:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.IGNORECASE):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _ORDER if n in needed)
    body = sql.strip()
    recursive = "RECURSIVE " if re.match(r"WITH RECURSIVE\b", body) else ""
    own = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body)
    return f"WITH {recursive}{head},\n{own}" if own != body else f"WITH {head}\n{body}"

