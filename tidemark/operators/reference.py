"""Reference tables that others derive from: ticker changes, the security master, the filing index, and one rebuild of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_existing
from ..sources.tables import write_artifacts
from . import curation, panel


def _name(df: DataFrame, *names: str) -> F.Column:
    """The first of the named columns that df has and that isn't blank, trimmed and in upper case."""
    return F.nullif(F.upper(F.trim(first_existing(df, list(names)).cast("string"))), F.lit(""))


def ticker_changes(changes: DataFrame) -> DataFrame:
    """REF-01: old_symbol, new_symbol, change_date, cik, reason of renames from either layout; rows without symbols or a date go, equal ones come once."""
    reason = F.coalesce(first_existing(changes, ["reason"]).cast("string"), F.lit("rename"))
    x = changes.select(
        _name(changes, "oldSymbol", "old_symbol").alias("old_symbol"), _name(changes, "newSymbol", "new_symbol").alias("new_symbol"),
        first_existing(changes, ["date", "change_date"]).try_cast("date").alias("change_date"), first_existing(changes, ["cik"]).cast("string").alias("cik"), reason.alias("reason"),
    )
    return x.na.drop(subset=["old_symbol", "new_symbol", "change_date"]).distinct()


def ticker_links(links: DataFrame) -> DataFrame:
    """symbol, cik of a company list in either layout; of several for a symbol the smallest cik."""
    x = links.select(_name(links, "ticker", "symbol").alias("symbol"), _name(links, "cik_str", "cik").alias("cik"))
    return x.na.drop().groupBy("symbol").agg(F.min("cik").alias("cik"))


def security_master(listings: DataFrame, changes: DataFrame, links: DataFrame) -> DataFrame:
    """REF-01, JOIN-11: listings with issuer_key, cik, primary_symbol and change_date.

    The last change of a symbol leads to its primary symbol. The cik is that of the change, of the symbol or of the primary
    symbol; issuers without one go by their primary symbol.
    """
    last = Window.partitionBy("old_symbol").orderBy(F.desc("change_date"), F.desc("new_symbol"), F.desc("cik"))
    latest = ticker_changes(changes).withColumn("_r", F.row_number().over(last)).where("_r = 1").select(F.col("old_symbol").alias("symbol"), "new_symbol", "change_date", F.col("cik").alias("change_cik"))
    own, target = ticker_links(links).withColumnRenamed("cik", "own_cik"), ticker_links(links).select(F.col("symbol").alias("primary_symbol"), F.col("cik").alias("target_cik"))
    x = listings.withColumn("symbol", _name(listings, "symbol")).where("symbol IS NOT NULL").join(latest, "symbol", "left").withColumn("primary_symbol", F.coalesce("new_symbol", "symbol"))
    x = x.join(own, "symbol", "left").join(target, "primary_symbol", "left").withColumn("cik", F.coalesce("change_cik", "own_cik", "target_cik"))
    key = F.when(F.col("cik").isNotNull(), F.concat(F.lit("cik:"), F.col("cik"))).otherwise(F.concat(F.lit("symbol:"), F.col("primary_symbol")))
    return x.withColumn("issuer_key", key).select("issuer_key", "cik", "primary_symbol", "change_date", *listings.columns)


def filing_index(filings: DataFrame, links: DataFrame) -> DataFrame:
    """REF-01: cik, symbol, form, filing_date, accepted_at, accession_number of filings in either layout; a missing symbol is that of the cik (the first by name), else empty."""
    x = filings.select(
        F.nullif(F.trim(first_existing(filings, ["cik"]).cast("string")), F.lit("")).alias("cik"), _name(filings, "symbol").alias("own"), first_existing(filings, ["form"]).cast("string").alias("form"),
        first_existing(filings, ["filingDate", "filing_date"]).try_cast("date").alias("filing_date"), first_existing(filings, ["acceptanceDateTime", "accepted_at"]).cast("string").alias("accepted_at"),
        first_existing(filings, ["accessionNumber", "accession_number"]).cast("string").alias("accession_number"),
    ).na.drop(subset=["cik", "form", "filing_date"])
    by_cik = ticker_links(links).groupBy("cik").agg(F.min("symbol").alias("linked"))
    symbol = F.coalesce("own", "linked", F.lit("")).alias("symbol")
    return x.join(by_cik, "cik", "left").select("cik", symbol, "form", "filing_date", "accepted_at", "accession_number").distinct()


def rebuild(sources: DataFrame, changes: DataFrame, links: DataFrame, filings: DataFrame, bars: DataFrame, root: str, top: int = 100) -> DataFrame:
    """REF-01: all derived reference tables below root from their raw sources (listing rows with source_rank, renames, company list, filings, bars); artifact, rows, columns of each.

    Later tables read the written earlier ones, so that each is derived once.
    """
    spark = bars.sparkSession
    out = write_artifacts({"listing_history": curation.golden_records(sources), "ticker_changes": ticker_changes(changes), "sec_filing_index": filing_index(filings, links)}, root)
    listings = spark.read.parquet(f"{root}/listing_history")
    frames = {"security_master": security_master(listings, spark.read.parquet(f"{root}/ticker_changes"), links)}
    names = bars.withColumn("symbol", F.col("symbol").cast("string"))
    frames["time_varying_universe"] = panel.universe(names, listings, top)
    frames["universe_snapshots"] = panel.universe(names, listings, top, snap=True)
    return out.unionByName(write_artifacts(frames, root))
