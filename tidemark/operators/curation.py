"""Curation, archive merges and reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_existing
from . import asof, panel


def adjustment_gaps(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """symbol, date (last bar before the ex-date), price_factor, split_factor: all actions between two bars taken together.

    Within a gap actions apply in order of ex-date, a split before a dividend; a dividend's factor uses the close as the
    actions before it have adjusted it. Actions before the first bar change nothing.
    """
    x = actions.withColumn("before", F.date_sub("ex_date", 1))
    x = asof.backward(x, bars.select("symbol", "date", "close"), ["symbol"], "before", "date", ["close"], []).where("date_hit IS NOT NULL")
    rank = F.when(F.col("event_type") == "split", 0).otherwise(1)
    gap = x.groupBy("symbol", F.col("date_hit").alias("date")).agg(F.first("close").alias("close"), F.array_sort(F.collect_list(F.struct("ex_date", rank.alias("rank"), "ratio", "amount"))).alias("steps"))
    step = "aggregate(steps, 1.0D, (f, s) -> CASE WHEN s.rank = 0 THEN f * s.ratio WHEN close * f > s.amount THEN f * (close * f - s.amount) / (close * f) ELSE f END)"
    splits = "aggregate(steps, 1.0D, (f, s) -> CASE WHEN s.rank = 0 THEN f * s.ratio ELSE f END)"
    return gap.select("symbol", "date", F.expr(step).alias("price_factor"), F.expr(splits).alias("split_factor"))


def adjust(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """CUR-01, JOIN-09, PF-06: prices times the factors of all later actions, volume divided by those of later splits."""
    later = Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    x = bars.join(adjustment_gaps(bars, actions), ["symbol", "date"], "left")
    factor, split = (F.product(F.coalesce(c, F.lit(1.0))).over(later) for c in ("price_factor", "split_factor"))
    x = x.withColumns({"_f": factor, "_s": split})
    return x.select("date", "symbol", *((F.col(c) * F.col("_f")).alias(c) for c in ("open", "high", "low", "close", "vwap")), (F.col("volume") / F.col("_s")).alias("volume"), F.col("_f").alias("factor"))


def changed_only(curated: DataFrame, changed: DataFrame) -> DataFrame:
    """CUR-02: the rows of changed dates of a table curated from the full history."""
    return curated.join(changed.select("date").distinct(), "date", "left_semi")


def prefer(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """SNK-04, WIN-16: one row for each key, the first in the given order (vendor priority, then recency)."""
    return panel.latest(df, keys, order)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-03: the new rows, and the old ones whose keys they don't have; of equal keys among the new any one may win."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return panel.latest(both, keys, [F.desc("_batch")]).drop("_batch")


def append_distinct(old: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-02, SET-01, SET-02: both tables by name without exact duplicates; maps count by their JSON."""
    both = old.unionByName(new, allowMissingColumns=True)
    maps = [c for c, kind in both.dtypes if kind.startswith("map")]
    return both.withColumns({f"_{c}": F.to_json(c) for c in maps}).dropDuplicates([f"_{c}" if c in maps else c for c in both.columns]).drop(*(f"_{c}" for c in maps))


def golden_records(sources: DataFrame) -> DataFrame:
    """AGG-01: one record for each symbol from source rows with source_rank: first non-empty values by rank, earliest listing, latest delisting, sorted source names."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("source_rank"))).alias(c)
    return sources.groupBy("symbol").agg(
        first("name"), first("exchange"), F.coalesce(F.min_by("asset_type", F.when(F.coalesce(F.col("asset_type"), F.lit("")) != "", F.col("source_rank"))), F.lit("common_stock")).alias("asset_type"),
        F.min("ipo_date").alias("ipo_date"), F.max("delist_date").alias("delist_date"), F.when(F.bool_or(F.col("delist_date").isNotNull()), "delisted").otherwise("active").alias("status"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )


def corroborated(frames: DataFrame, keys: list[str], source: str, verified: str) -> DataFrame:
    """AGG-02: keys with the number and sorted list of sources that report them and the latest verification."""
    return frames.groupBy(*keys).agg(F.count_distinct(source).alias("source_count"), F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"), F.max(verified).alias("last_verified"))


def stage0_universe(bars: DataFrame, assets: DataFrame, top: int, sessions: int, least: int) -> DataFrame:
    """AGG-03, SRT-02: the `top` assets by mean dollar volume of their last `sessions` bars; at least `least` of them are needed."""
    recent = panel.latest(bars.join(assets.select("symbol"), "symbol", "left_semi"), ["symbol"], [F.desc("date")], sessions)
    x = recent.groupBy("symbol").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"), F.count_distinct("date").alias("n_sessions")).where(F.col("n_sessions") >= least)
    return x.orderBy(F.desc("adv"), "symbol").limit(top)


def asset_type(value) -> F.Column:
    """PRJ-02: lower case with underscores; stock kinds become common_stock."""
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[^a-z0-9]+", "_")
    return F.when(x.isin("stock", "cs", "common_stock", "common", "equity", "us_equity", ""), "common_stock").when(x.isin("etf", "etp", "etn", "fund"), "etf").otherwise(x)


#: Words in names of funds and notes.
FUND_WORDS = (
    "ETF", "ETN", "ETP", "FUND", "TRUST", "SHARES", "BOND", "TREASURY", "INCOME", "ULTRA", "BEAR", "BULL", "INVERSE", "LEVERAGED",
    "SPDR", "ISHARES", "VANGUARD", "INVESCO", "PROSHARES", "DIREXION", "WISDOMTREE",
)


def common_stocks(assets: DataFrame, words: tuple[str, ...] = FUND_WORDS) -> DataFrame:
    """PRJ-03: assets whose name has none of the words, as whole words in any case."""
    return assets.where(~F.upper(F.coalesce("name", F.lit(""))).rlike(rf"\b(?:{'|'.join(words)})\b"))


def active_on(listings: DataFrame, day) -> DataFrame:
    """PRJ-04: listings that have begun by that day and not ended."""
    day = F.lit(day).cast("date")
    return listings.where((F.col("ipo_date").isNull() | (F.col("ipo_date") <= day)) & (F.col("delist_date").isNull() | (F.col("delist_date") > day)))


def preferred_lookup(left: DataFrame, dim: DataFrame, key: str, order: list) -> DataFrame:
    """JOIN-10: left with the preferred row of the dimension for its key. Spark broadcasts the dimension if it is small."""
    return left.join(panel.latest(dim, [key], order), key, "left")


def issuer_keys(rows: DataFrame, renames: DataFrame, links: DataFrame) -> DataFrame:
    """JOIN-11: issuer = that of the symbol's rename chain, else of the symbol, else of its primary symbol."""
    a = renames.select("symbol", F.col("new_symbol").alias("renamed"))
    cik = lambda c, out: links.select(F.col("symbol").alias(c), F.col("cik").alias(out))
    x = rows.join(a, "symbol", "left").join(cik("renamed", "c1"), "renamed", "left").join(cik("symbol", "c2"), "symbol", "left").join(cik("primary", "c3"), "primary", "left")
    return x.withColumn("issuer", F.coalesce("c1", "c2", "c3")).drop("c1", "c2", "c3")


def aligned(frame: DataFrame, fields: dict[str, list[str]], source: str, rank: int) -> DataFrame:
    """PRJ-01: a vendor's layout as the listing schema, by candidate column names; symbols trimmed and in upper case."""
    columns = {out: first_existing(frame, names) for out, names in fields.items()}
    columns["symbol"] = F.upper(F.trim(columns["symbol"].cast("string")))
    return frame.select(*(c.alias(n) for n, c in columns.items()), F.lit(source).alias("source"), F.lit(rank).alias("source_rank"))
