"""Queries on payloads and text, each with its oracle. Payloads are built from the driver's tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import eastern_to_utc
from ..operators import filing_events as ev
from ..operators import modeling
from ..sources import payloads as p
from ..sources import tables as io
from ..streaming import streams
from . import tables as t
from .tables import query, rounded


@query("SELECT CAST(symbol AS VARCHAR) AS symbol, date, close, volume, trade_count FROM bars")
def src_05_bars_from_json(spark, d):
    b = t.bars(spark, d).select("symbol", F.struct(F.unix_millis(F.col("date").cast("timestamp")).alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("vwap").alias("vw"), F.col("trade_count").alias("n")).alias("b"), F.year("date").alias("y"))
    g = b.groupBy("y", "symbol").agg(F.collect_list("b").alias("rows")).select(F.to_json(F.struct(F.create_map(F.col("symbol").cast("string"), "rows").alias("bars"))).alias("payload"))
    return p.bars_from_json(g, "payload").select("symbol", "date", "close", "volume", "trade_count")


@query("SELECT symbol, ts, seq, sha256('feed|trade|' || CAST(symbol AS VARCHAR) || '|' || CAST(epoch_us(ts) AS VARCHAR) || '|' || printf('%.4f', price)) AS event_id FROM ticks")
def src_06_tick_ids(spark, d):
    return p.ticks_with_ids(t.ticks(spark, d).drop("event_type"), "feed", "trade").select("symbol", "ts", "seq", "event_id")


@query("SELECT s_name AS symbol, s_acctbal AS trade_price, s_acctbal - 1 AS bid, s_acctbal + 1 AS ask, CASE WHEN s_suppkey % 2 = 0 THEN 0.5::DOUBLE END AS delta FROM supplier")
def src_07_flat_snapshots(spark, d):
    s = t.table(spark, d, "supplier")
    trade, quote = F.struct(F.col("s_acctbal").alias("p"), F.lit(1).alias("s")), F.struct((F.col("s_acctbal") - 1).alias("bp"), (F.col("s_acctbal") + 1).alias("ap"))
    camel = F.to_json(F.struct(F.col("s_name").alias("symbol"), trade.alias("latestTrade"), quote.alias("latestQuote"), F.create_map(F.lit("delta"), F.lit(0.5)).alias("greeks")))
    snake = F.to_json(F.struct(F.col("s_name").alias("symbol"), trade.alias("latest_trade"), quote.alias("latest_quote")))
    return p.flat_snapshots(s.select(F.when(F.col("s_suppkey") % 2 == 0, camel).otherwise(snake).alias("payload")), "payload")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda x: upper(x)))), ',') AS symbols, list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda x: upper(x))))[1] AS primary_symbol FROM part")
def src_08_news_symbols(spark, d):
    x = t.table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(" , ")).alias("tickers"))
    return p.news_rows(x, "tickers").select("p_partkey", F.array_join("symbols", ",").alias("symbols"), "primary_symbol")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1.0 / (p_size + 1) WHEN 1 THEN 1.0 / p_size END AS ratio FROM part")
def src_09_split_ratios(spark, d):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat((F.col("p_size") + 1).cast("string"), F.lit(":1"))).when(F.col("p_partkey") % 3 == 1, F.col("p_size").cast("string")).otherwise("none")
    return t.table(spark, d, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", p.split_ratio(F.col("raw")).alias("ratio"))


@query("SELECT c_custkey, 'balance' AS metric_name, c_acctbal AS metric_value FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer")
def src_10_prj_17_ref_02_metrics(spark, d):
    c = t.table(spark, d, "customer").select("c_custkey", F.to_json(F.create_map(F.lit("balance"), F.col("c_acctbal").cast("string"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"))).alias("payload"))
    return p.metrics_from_maps(c, ["c_custkey"], "payload")


@query("SELECT symbol, form, CAST(accepted_at AS DATE) AS filing_date, event_id FROM filings WHERE form IN ('8-K', '10-K') AND CAST(accepted_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def src_11_filings_of_forms(spark, d):
    x = t.filings(spark, d).select("symbol", "form", F.to_date("accepted_at").alias("filing_date"), "event_id")
    return p.filings_of_forms(x, "2024-01-05", "2024-01-20", ("8-K", "10-K"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS cik, CAST(o_orderdate AS DATE) AS metric_date, 'gaap:Price:USD' AS metric_name, o_totalprice AS metric_value, CAST(o_orderdate AS DATE) + 3 AS available_at FROM orders WHERE o_orderstatus <> 'F'")
def src_12_company_facts(spark, d):
    o = t.table(spark, d, "orders")
    fact = F.struct(F.to_date("o_orderdate").alias("end"), F.date_add(F.to_date("o_orderdate"), 2).alias("filed"), F.col("o_totalprice").alias("val"), F.lit("10-K").alias("form"))
    g = o.groupBy("o_custkey", "o_orderstatus").agg(F.collect_list(fact).alias("f"))
    concept = F.when(F.col("o_orderstatus") == "F", "Other").otherwise("Price")
    j = g.select(F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.create_map(F.lit("gaap"), F.create_map(concept, F.struct(F.create_map(F.lit("USD"), "f").alias("units")))).alias("facts"))).alias("payload"))
    return p.company_facts(j, "payload", ["Price"])


@query("SELECT CAST(o_custkey AS VARCHAR) AS cik, 'Company ' || o_orderstatus AS company, '4' AS form, CAST(o_orderdate AS DATE) AS filed_date, printf('%010d-24-%06d', o_custkey, o_orderkey % 1000000) AS accession FROM orders WHERE o_orderkey % 3 = 0")
def src_13_index_manifest(spark, d):
    o = t.table(spark, d, "orders")
    acc = F.format_string("%010d-24-%06d", "o_custkey", F.col("o_orderkey") % 1000000)
    line = F.concat_ws("|", F.col("o_custkey").cast("string"), F.concat(F.lit("Company "), "o_orderstatus"), F.when(F.col("o_orderkey") % 3 == 0, "4").otherwise("10-K"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("edgar/data/"), acc, F.lit(".txt")))
    x = o.select(line.alias("line")).unionByName(o.limit(1).select(F.lit("CIK|Company Name").alias("line")))
    return p.index_manifest(x, "line", ("4",)).select("cik", "company", "form", "filed_date", "accession")


@query("SELECT conv_id, CAST(turn AS INTEGER) AS number, role AS type, sha256(text) AS body_sha, CASE WHEN turn % 2 = 0 THEN '1.01,5.0' || (turn % 9 + 1) ELSE '' END AS items FROM conversations")
def src_14_evt_02_document_blocks(spark, d):
    c = t.table(spark, d, "conversations")
    note = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\nItem 1.01 and ITEM  5.0"), (F.col("turn") % 9 + 1).cast("string"), F.lit(" and 2.02"))).otherwise("")
    block = F.concat(F.lit("<DOCUMENT>\n<TYPE>"), "role", F.lit("\n<FILENAME>f.txt\n<TEXT>"), "text", F.lit("\u0001"), note, F.lit("</TEXT>\n</DOCUMENT>"))
    g = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda s: s["b"]), "\n").alias("raw"))
    x = p.document_blocks(g, ["conv_id"], "raw")
    return x.select("conv_id", "number", "type", F.sha2(F.substring_index("body", "\u0001", 1), 256).alias("body_sha"), F.array_join("items", ",").alias("items"))


@query("SELECT l_orderkey AS accession, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS shares, CAST(max(CAST(l_shipdate AS DATE)) AS DATE) AS last_date FROM lineitem GROUP BY 1")
def src_15_ownership_xml(spark, d):
    li = t.table(spark, d, "lineitem")
    v = lambda tag, c: F.concat(F.lit(f"<{tag}><value>"), c, F.lit(f"</value></{tag}>"))
    row = F.concat(
        F.lit("<nonDerivativeTransaction>"), v("securityTitle", F.lit("Common Stock")), v("transactionDate", F.date_format("l_shipdate", "yyyy-MM-dd")), F.lit("<transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts>"),
        v("transactionShares", F.col("l_quantity").cast("decimal(18,2)").cast("string")), v("transactionPricePerShare", F.lit("1.5")), F.lit("</transactionAmounts></nonDerivativeTransaction>"),
    )
    g = li.groupBy("l_orderkey").agg(F.concat(F.lit("<ownershipDocument><issuer><issuerCik>1</issuerCik><issuerTradingSymbol>AB</issuerTradingSymbol></issuer><nonDerivativeTable>"), F.array_join(F.collect_list(row), ""), F.lit("</nonDerivativeTable></ownershipDocument>")).alias("xml"))
    x = p.ownership_transactions(g, ["l_orderkey"], "xml")
    return x.groupBy(F.col("l_orderkey").alias("accession")).agg(F.count("*").alias("n"), F.sum("shares").cast("double").alias("shares"), F.max("traded_on").alias("last_date"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'merger' WHEN 1 THEN 'none' END AS event_type, CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'promotable_not_material' ELSE 'promotable_not_material,quote_not_in_excerpt' END WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'quote_not_in_excerpt' END ELSE 'missing_payload' END AS errors FROM documents")
def src_16_evt_06_model_payloads(spark, d):
    x = t.table(spark, d, "documents").select("doc_id", "text")
    quote = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 12)).otherwise("@@ not there @@")
    js = F.to_json(F.struct(F.when(F.col("doc_id") % 3 == 0, "merger").otherwise("none").alias("event_type"), F.lit("no").alias("is_material_candidate"), F.array(F.struct(quote.alias("quote"), F.lit("x").alias("supports"))).alias("evidence")))
    raw = F.when(F.col("doc_id") % 3 == 2, "no answer").otherwise(F.concat(F.lit("Sure: "), js, F.lit(" done")))
    y = p.model_payloads(x.withColumn("raw", raw), "raw")
    return y.select("doc_id", "payload.event_type", F.array_join(p.contradictions("payload", "text"), ",").alias("errors"))


@query("SELECT conv_id, CAST(count(*) FILTER (turn % 4 = 3) AS INTEGER) AS missing, 1 AS unexpected, count(*) FILTER (turn % 4 = 0) AS twice FROM conversations GROUP BY 1")
def src_16_batch_ids(spark, d):
    c = t.table(spark, d, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"))
    got = c.where("turn % 4 <> 3").unionByName(c.where("turn % 4 = 0")).unionByName(c.select("conv_id").distinct().withColumn("turn", F.lit(-1).cast("bigint")))
    return p.batch_ids(c, got, "conv_id", "turn")


@query("""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number FROM documents),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(part) DESC, number) AS rank FROM x WHERE length(trim(part)) > 0)
SELECT doc_id, CAST(number AS INTEGER) AS number, substr(part, 1, 200) AS snippet, 'snp_' || substr(sha256(CAST(doc_id AS VARCHAR) || '|' || number || '|' || substr(part, 1, 200)), 1, 16) AS snippet_id, CAST(rank AS INTEGER) AS rank FROM y WHERE rank <= 3
""")
def evt_05_snippets(spark, d):
    return p.snippets(t.table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", 200, 3)


@query("""
SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style)\\b.*?</(script|style)>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))) AS text_sha FROM pages
""")
def scalar_html_text(spark, d):
    """Section 2.8: tag strip and entities."""
    return t.table(spark, d, "pages").select("page_id", F.sha2(p.plain_text(F.col("html")), 256).alias("text_sha"))


@query("""
WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, make_date(CAST(year(o_orderdate) AS INTEGER), 4, 1) AS a, make_date(CAST(year(o_orderdate) AS INTEGER), 10, 31) AS o FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN CAST(d AS TIMESTAMP) + INTERVAL 12 HOUR + CASE WHEN d >= a + CAST(7 - isodow(a) AS INTEGER) AND d < o - CAST(isodow(o) % 7 AS INTEGER) THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END END AS accepted_at FROM x
""")
def scalar_eastern_to_utc(spark, d):
    """Section 2.8: acceptance times in New York (at noon; summer time of 1987 to 2006) to UTC, some of them malformed."""
    text = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderkey") % 4 > 0, "120000").otherwise("noon"))
    return t.table(spark, d, "orders").select("o_orderkey", eastern_to_utc(text).alias("accepted_at"))


@query("SELECT item_id, count(*) AS n_docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def scalar_exact_evidence(spark, d):
    """Section 2.8, evidence check: documents that hold a benchmark text; candidates share a whole word of its inside, not all pairs."""
    needles = t.table(spark, d, "benchmark").where("length(text) > 0").select("item_id", F.col("text").alias("needle"))
    docs = t.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return p.holders(docs, needles).groupBy("item_id").agg(F.count("*").alias("n_docs"))


@query("SELECT symbol, CASE WHEN symbol % 2 = 0 THEN name END AS name, exchange FROM listings")
def src_20_mapped_reference(spark, d):
    x = t.listings(spark, d).withColumn("title", F.when(F.col("symbol") % 2 == 0, F.col("name"))).drop("name")
    return p.mapped(x, {"symbol": ["ticker", "symbol"], "name": ["name", "title"], "exchange": ["primary_exchange", "exchange"]})


@query("SELECT symbol, event_type, ex_date, ratio, amount FROM actions")
def src_19_action_union(spark, d):
    a = t.actions(spark, d)
    return p.action_union(a.where("event_type = 'split'"), a.where("event_type = 'dividend' AND symbol % 2 = 0"), a.where("event_type = 'dividend' AND symbol % 2 = 1"))


@query("SELECT 'bars' AS dataset, count(*) AS rows, max(date) AS latest, 9 AS columns, '' AS missing, 'available' AS state FROM bars UNION ALL SELECT 'actions', count(*), NULL, 5, 'source', 'schema_mismatch' FROM actions")
def snk_08_prj_15_contract(spark, d):
    return io.contract(spark, {"bars": t.bars(spark, d), "actions": t.actions(spark, d)}, {"bars": ["date", "symbol"], "actions": ["symbol", "source"]})


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, TRY_CAST(o_orderpriority AS INTEGER) AS o_orderpriority, NULL::DOUBLE AS extra FROM orders")
def snk_06_coerced(spark, d):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderdate", T.DateType()), T.StructField("o_orderpriority", T.IntegerType()), T.StructField("extra", T.DoubleType())])
    return io.coerced(t.table(spark, d, "orders"), schema)


@query("SELECT p_partkey, upper(replace(p_brand, '#', '')) AS ticker, contains(lower(p_type), 'economy') AS listed FROM part")
def prj_07_10_tickers_and_titles(spark, d):
    x = t.table(spark, d, "part")
    return x.select("p_partkey", ev.ticker_flags(F.replace("p_brand", F.lit("#"), F.lit(" ")))["ticker"].alias("ticker"), ev.contains_any(F.col("p_type"), ("economy",)).alias("listed"))


@query("""
SELECT CAST(to_timestamp(floor(epoch(ts) / 300) * 300) AT TIME ZONE 'UTC' AS TIMESTAMP) AS bar_at, symbol, arg_min(price, epoch_us(ts) * 1000 + seq % 1000) AS open, max(price) AS high, min(price) AS low, arg_max(price, epoch_us(ts) * 1000 + seq % 1000) AS close, count(*) AS n_ticks FROM ticks GROUP BY 1, 2
""")
def str_02_coarse_bars(spark, d):
    """STR-02 over the table; the same function takes a stream."""
    return streams.coarse_bars(t.ticks(spark, d))


@query("SELECT news_id, symbol, CAST(published_at AS DATE) + 1 AS available_at FROM news")
def str_04_availability(spark, d):
    return streams.available_from(t.news(spark, d), "published_at", 1).select("news_id", "symbol", "available_at")


_PER = "count(*) FILTER (n.published_at > CAST(g.date AS TIMESTAMP) - INTERVAL {} DAY AND n.published_at <= CAST(g.date AS TIMESTAMP))"


@query("""
SELECT g.date, g.symbol, count(*) FILTER (n.published_at >= CAST(g.date AS TIMESTAMP) - INTERVAL 1 DAY) AS news_1d, count(*) FILTER (n.published_at >= CAST(g.date AS TIMESTAMP) - INTERVAL 7 DAY) AS news_7d,
  round(count(*) FILTER (n.published_at >= CAST(g.date AS TIMESTAMP) - INTERVAL 7 DAY) / greatest(count(*) FILTER (n.published_at >= CAST(g.date AS TIMESTAMP) - INTERVAL 37 DAY AND n.published_at < CAST(g.date AS TIMESTAMP) - INTERVAL 7 DAY) / 30 * 7, 1), 8) AS abnormal_volume,
  count(DISTINCT n.source) FILTER (n.published_at >= CAST(g.date AS TIMESTAMP) - INTERVAL 7 DAY) AS sources_7d, count(DISTINCT n.vendor) FILTER (n.published_at >= CAST(g.date AS TIMESTAMP) - INTERVAL 7 DAY) AS vendors_7d,
  round(count(DISTINCT n.vendor || ' ' || n.source) FILTER (n.published_at >= CAST(g.date AS TIMESTAMP) - INTERVAL 7 DAY) / greatest(count(*) FILTER (n.published_at >= CAST(g.date AS TIMESTAMP) - INTERVAL 7 DAY), 1), 8) AS novelty,
  CAST(floor(epoch_us(CAST(g.date AS TIMESTAMP) - max(n.published_at)) / 86400000000) AS BIGINT) AS days_since_last
FROM event_grid g JOIN news n ON n.symbol = g.symbol AND n.published_at <= CAST(g.date AS TIMESTAMP) GROUP BY 1, 2
""")
def mod_04_news_features(spark, d):
    news = t.news(spark, d).withColumn("headline", F.concat_ws(" ", "vendor", "source"))
    return rounded(modeling.news_features(t.event_grid(spark, d), news), 8)


@query("SELECT b.date, b.symbol, close AS feature, coalesce(v, 0.0) AS event_value, v IS NOT NULL AS has_event FROM bars b LEFT JOIN (SELECT symbol, ex_date AS date, max(coalesce(amount, ratio)) AS v FROM actions GROUP BY 1, 2) a ON a.symbol = b.symbol AND a.date = b.date")
def join_01_attach_group(spark, d):
    """JOIN-01: nulls of the attached group become 0, and has_event tells them apart."""
    a = t.actions(spark, d).groupBy("symbol", F.col("ex_date").alias("date")).agg(F.max(F.coalesce("amount", "ratio")).alias("event_value"))
    x = t.bars(spark, d).select("date", "symbol", F.col("close").alias("feature")).join(a, ["date", "symbol"], "left")
    return x.withColumn("has_event", F.col("event_value").isNotNull()).fillna(0.0, ["event_value"])


@query("""
WITH a AS (SELECT date, symbol, (rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2) / count(*) OVER (PARTITION BY date) AS p,
  (rank() OVER (PARTITION BY date ORDER BY raw_forward_return_5d) + (count(*) OVER (PARTITION BY date, raw_forward_return_5d) - 1) / 2) / count(*) OVER (PARTITION BY date) AS q FROM scores)
SELECT date, symbol, round((p + q) / 2, 8) AS ensemble FROM a
""")
def mod_12_join_19_ensemble(spark, d):
    from ..operators import panel

    x = t.scores(spark, d)
    a = panel.percent_rank(x, "score", "p").select("date", "symbol", "p")
    b = panel.percent_rank(x, "raw_forward_return_5d", "q").select("date", "symbol", "q")
    return rounded(a.join(b, ["date", "symbol"]).select("date", "symbol", ((F.col("p") + F.col("q")) / 2).alias("ensemble")), 8)


@query("SELECT coalesce(a.date, b.date) AS date, coalesce(a.symbol, b.symbol) AS symbol, a.r1, b.r5 FROM (SELECT date, symbol, lead(close, 1) OVER (PARTITION BY symbol ORDER BY date) - close AS r1 FROM bars WHERE close >= open) a FULL JOIN (SELECT date, symbol, lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) - close AS r5 FROM bars WHERE volume >= 25) b ON a.date = b.date AND a.symbol = b.symbol")
def join_04_merge_horizons(spark, d):
    from ..operators import panel

    b = t.bars(spark, d)
    one = b.where("close >= open").select("date", "symbol", (F.lead("close", 1).over(panel.by_symbol()) - F.col("close")).alias("r1"))
    five = b.where("volume >= 25").select("date", "symbol", (F.lead("close", 5).over(panel.by_symbol()) - F.col("close")).alias("r5"))
    return one.join(five, ["date", "symbol"], "full")


@query("SELECT l.doc_id, l.toxic = 1 AS expected, regexp_matches(lower(d.text), '\\b(stupid|idiot|trash)\\b') AS got, CASE WHEN (l.toxic = 1) = regexp_matches(lower(d.text), '\\b(stupid|idiot|trash)\\b') THEN '' ELSE 'toxic_mismatch' END AS errors FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def evt_09_fixture_gate(spark, d):
    """EVT-09: expectations joined to results, differences as errors."""
    x = t.table(spark, d, "labels").join(t.table(spark, d, "documents"), "doc_id")
    got = F.lower("text").rlike(r"\b(stupid|idiot|trash)\b")
    return x.select("doc_id", (F.col("toxic") == 1).alias("expected"), got.alias("got"), F.when((F.col("toxic") == 1) == got, "").otherwise("toxic_mismatch").alias("errors"))


@query("SELECT d.doc_id, d.lang, count(*) AS n FROM documents d JOIN (SELECT doc_id, quality FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id GROUP BY 1, 2")
def join_24_checkpoint_reuse(spark, d):
    """JOIN-24, JOIN-23: rows that may be reused, by an inner join on their keys."""
    from ..operators import curation

    docs = t.table(spark, d, "documents").select("doc_id", "lang")
    done = curation.prefer(t.table(spark, d, "labels").where("quality = 1"), ["doc_id"], [F.desc("toxic")])
    return docs.join(done.select("doc_id"), "doc_id").groupBy("doc_id", "lang").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderkey, lpad(CAST(o_orderkey % 7 + 1 AS VARCHAR), 2, '0') AS item, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'early' WHEN o_orderstatus = 'F' THEN 'family_f' ELSE 'other' END AS route FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def prj_05_06_routes(spark, d):
    """PRJ-05, PRJ-06: route by set and date, normalised item numbers."""
    x = t.table(spark, d, "orders").where(F.to_date("o_orderdate").between(F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date")))
    route = F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "early").when(F.col("o_orderstatus") == "F", "family_f").otherwise("other")
    return x.select("o_orderstatus", "o_orderkey", F.lpad((F.col("o_orderkey") % 7 + 1).cast("string"), 2, "0").alias("item"), route.alias("route"))


@query("WITH x AS (SELECT doc_id, year, n FROM (SELECT o_custkey AS doc_id, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1, 2)) SELECT CAST(s.years AS INTEGER) AS years, count(DISTINCT doc_id) AS n_candidates, CAST(sum(n) AS BIGINT) AS n_events FROM (SELECT unnest([1, 2, 3]) AS years) s JOIN x ON x.year > (SELECT max(year) FROM x) - s.years GROUP BY 1")
def evt_08_scenarios(spark, d):
    """EVT-08: growing year windows by a range join of a few scenarios."""
    o = t.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    last = o.agg(F.max("year").alias("last"))
    windows = last.select("last", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("years"))  # three rows
    return o.join(F.broadcast(windows), F.col("year") > F.col("last") - F.col("years")).groupBy("years").agg(F.count_distinct("doc_id").alias("n_candidates"), F.sum("n").alias("n_events"))

