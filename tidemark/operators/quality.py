"""Data quality: grading, gaps, duplicates, point-in-time checks, fingerprints, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grade_partitions(counts: DataFrame, days: DataFrame, calendar: DataFrame, expected: int) -> DataFrame:
    """AGG-15: date, status, qc_code, row_count, expected_rows of every day of counts (date, row_count).

    GREEN / NO_SESSION where there is none, RED / MISSING without a count, AMBER / LOW_ROW_COUNT below expectation, else GREEN / OK.
    """
    x = days.join(calendar.select("date", F.lit(True).alias("open")), "date", "left").join(counts, "date", "left")
    closed, missing, low = F.col("open").isNull(), F.col("row_count").isNull(), F.col("row_count") < expected
    return x.select(
        "date", F.when(closed, "GREEN").when(missing, "RED").when(low, "AMBER").otherwise("GREEN").alias("status"),
        F.when(closed, "NO_SESSION").when(missing, "MISSING").when(low, "LOW_ROW_COUNT").otherwise("OK").alias("qc_code"),
        F.when(closed, 0).otherwise(F.col("row_count")).cast("bigint").alias("row_count"), F.when(closed, 0).otherwise(expected).cast("bigint").alias("expected_rows"),
    )


def coverage(graded: DataFrame, symbols: DataFrame, expected: int, lag_days: int) -> DataFrame:
    """AGG-16: share of GREEN days, number of RED days, latest date with all expected symbols that lies lag_days before the last one."""
    anchor = graded.agg(F.max("date").alias("anchor"), F.avg((F.col("status") == "GREEN").cast("double")).alias("green_ratio"), F.count_if(F.col("status") == "RED").alias("red_days"))
    full = symbols.where(F.col("n_symbols") >= expected)
    return anchor.crossJoin(full.crossJoin(anchor.select("anchor").withColumnRenamed("anchor", "a")).where(F.col("date") <= F.date_sub("a", lag_days)).agg(F.max("date").alias("cutoff")))  # single rows


def missing_units(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-12, SET-03: what is expected but not there."""
    return expected.join(actual.select(*keys).distinct(), keys, "left_anti")


def quality_row(df: DataFrame, name: str, keys: list[str], required: list[str], available: str | None = None) -> DataFrame:
    """AGG-17: rows, rows that share their keys, largest share of nulls of a required column, rows available over a day too late, verdict."""
    late = F.count_if(F.col(available).cast("timestamp") > F.col("date").cast("timestamp") + F.expr("INTERVAL 1 DAY")) if available else F.lit(0)
    missing = [c for c in required if c not in df.columns]
    there = [c for c in required if c in df.columns]
    nulls = [F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)) for c in there]
    stats = df.agg(F.count("*").alias("rows_checked"), (F.greatest(*nulls) if len(nulls) > 1 else nulls[0] if nulls else F.lit(0.0)).alias("null_rate_max"), late.alias("pit_violations"))
    whole = df.na.drop(subset=keys)
    twice = whole.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_keys"))
    x = stats.crossJoin(twice).withColumn("duplicate_rate", F.coalesce(F.try_divide("duplicate_keys", "rows_checked"), F.lit(0.0)))  # one row each
    state = (
        F.when(F.col("rows_checked") == 0, "zero_rows").when(F.lit(bool(missing)), "schema_mismatch").when(F.col("pit_violations") > 0, "timestamp_violation")
        .when(F.col("duplicate_rate") > 0.01, "duplicate_keys").when(F.col("duplicate_keys") > 0, "ok_minor_duplicates").otherwise("ok")
    )
    verdict = F.when(state.isin("schema_mismatch", "timestamp_violation"), "CRITICAL").when(state.isin("zero_rows", "duplicate_keys"), "WARNING").otherwise("OK")
    return x.select(F.lit(name).alias("dataset"), "rows_checked", "duplicate_keys", "duplicate_rate", "null_rate_max", "pit_violations", state.alias("status"), verdict.alias("verdict"))


def missing_columns(df: DataFrame, required: list[str | tuple[str, ...]]) -> list[str]:
    """PRJ-15: required columns that the schema lacks; of a tuple of alternatives one is enough."""
    options = [(r,) if isinstance(r, str) else r for r in required]
    return [" or ".join(o) for o in options if not any(c in df.columns for c in o)]


def progress(expected: DataFrame, done: DataFrame) -> DataFrame:
    """AGG-18: per symbol expected, completed and remaining dates."""
    a = expected.groupBy("symbol").agg(F.count_distinct("date").alias("expected"))
    b = done.groupBy("symbol").agg(F.count_distinct("date").alias("completed"))
    return a.join(b, "symbol", "left").select("symbol", "expected", F.coalesce("completed", F.lit(0)).alias("completed"), (F.col("expected") - F.coalesce("completed", F.lit(0))).alias("remaining"))


def manifest(df: DataFrame, expected: int) -> DataFrame:
    """AGG-19: per date rows, symbols, a SHA-1 over the count and the sorted symbols, and whether all symbols are there."""
    names = F.array_join(F.array_sort(F.collect_set(F.col("symbol").cast("string"))), "|")
    return df.groupBy("date").agg(
        F.count("*").alias("row_count"), F.count_distinct("symbol").alias("symbol_count"), F.sha1(F.concat_ws("|", F.count("*").cast("string"), names)).alias("content_hash"),
    ).withColumn("status", F.when(F.col("symbol_count") >= expected, "HEALTHY").otherwise("INCOMPLETE"))


def freshness(events: DataFrame, by: str, at: str, now, stale_minutes: int) -> DataFrame:
    """AGG-43: per dataset its latest time, its age in minutes and whether it is stale."""
    x = events.groupBy(by).agg(F.max(at).alias("latest"))
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))) / 60_000_000)
    return x.withColumn("age_minutes", age).withColumn("status", F.when(F.col("age_minutes") > stale_minutes, "STALE").otherwise("FRESH"))


def fingerprint(df: DataFrame, by: list[str]) -> DataFrame:
    """AGG-48: per partition its rows and an order-free hash of their content, a sum of hashes: rows that come twice count twice.

    A row's hash is the first 15 hex digits of the MD5 of its values as strings, joined by bars, so that any engine can repeat it.
    """
    values = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns))
    content = F.sum(F.conv(F.substring(F.md5(values), 1, 15), 16, 10).cast("decimal(20,0)"))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), content.cast("string").alias("content"))


def pit_violations(df: DataFrame, available: str, date: str = "date") -> DataFrame:
    """PRJ-14: rows that were not yet available on their date."""
    return df.where(F.col(available).cast("timestamp") > F.col(date).cast("timestamp"))


def cross_vendor(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """JOIN-16: both vendors' values of the same keys and their relative difference."""
    x = a.select(*keys, F.col(value).alias("primary_value")).join(b.select(*keys, F.col(value).alias("vendor_value")), keys)
    return x.withColumn("difference", F.try_divide(F.abs(F.col("vendor_value") - F.col("primary_value")), F.abs("primary_value")))


def group_coverage(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """AGG-27: per feature group the share of rows with any value, and whether there is one at all."""
    rows = [F.struct(F.lit(g).alias("feature_group"), F.avg(F.coalesce(*cols).isNotNull().cast("double")).alias("coverage")) for g, cols in groups.items()]
    return df.agg(F.array(*rows).alias("g")).select(F.explode("g").alias("g")).select("g.*").withColumn("ready", F.col("coverage") > 0)


def month_gaps(*frames: DataFrame) -> DataFrame:
    """SET-05: for each month of any frame (date) the numbers of the frames that lack it."""
    months = [f.select(F.trunc("date", "MM").alias("month")).distinct().withColumn("source", F.lit(i)) for i, f in enumerate(frames)]
    every = months[0]
    for m in months[1:]:
        every = every.unionByName(m)
    have = every.groupBy("month").agg(F.collect_set("source").alias("have"))
    return have.select("month", F.array_sort(F.array_except(F.array(*(F.lit(i) for i in range(len(frames)))), "have")).alias("missing")).where(F.size("missing") > 0)


def trailing_share(df: DataFrame, by: str, at: str, minutes: int, now) -> DataFrame:
    """Rows per key in the minutes before now."""
    return df.where(F.col(at) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES")).groupBy(by).agg(F.count("*").alias("n"))

