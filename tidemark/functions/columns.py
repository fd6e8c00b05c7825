"""Column helpers that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.folders import written


def first_existing(df: DataFrame, names: list[str]) -> Column:
    """The first value that isn't null of those named columns that df has; null if it has none."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None)


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b), null where the ratio has no logarithm."""
    ratio = F.try_divide(a, b)
    return F.when(ratio > 0, F.log(ratio))


def trailing(w: int, *by: str, order: str = "date") -> WindowSpec:
    """The last w rows, the current one included."""
    return Window.partitionBy(*by).orderBy(order).rowsBetween(1 - w, 0)


def full(value: Column, counted: Column, window: WindowSpec, w: int) -> Column:
    """value over the window if all its w rows have `counted`, else null."""
    return F.when(F.count(counted).over(window) == w, value.over(window))


def average_rank(value: Column, *by: str) -> Column:
    """Rank from 1 among the rows that have a value; equal values share their mean rank. Null stays null."""
    order = Window.partitionBy(*by).orderBy(value.asc_nulls_last())  # one sort for both
    ranks = F.rank().over(order)
    ties = F.count(value).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(value.isNotNull(), ranks + (ties - 1) / 2)


def ordered_counts(df: DataFrame, value: str, by: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """Of each different value that isn't null, by group: n, how many rows of the group lie before it, and the group's total.

    Values are counted first; counts are summed up within ranges of values and over ranges, so that no window holds more
    than a range of a group. Where the ranges lie (approximate quantiles of all rows) doesn't change the result.
    """
    bounds = df.approxQuantile(value, [k / parts for k in range(1, parts)], 1 / (2 * parts)) if parts > 1 else []
    part = F.size(F.filter(F.array(*(F.lit(float(b)) for b in sorted(set(bounds)))), lambda b: b < F.col(value))) if bounds else F.lit(0)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")).withColumn("_part", part)
    earlier = (Window.unboundedPreceding, -1)
    counts = counts.withColumn("_inside", F.coalesce(F.sum("n").over(Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(*earlier)), F.lit(0)))
    sums = counts.groupBy(*by, "_part").agg(F.sum("n").alias("_sum"))  # a row a range and group
    sums = sums.withColumns({"_base": F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(*earlier)), F.lit(0)), "total": F.sum("_sum").over(Window.partitionBy(*by))})
    return counts.join(sums.drop("_sum"), [*by, "_part"]).select(*by, value, "n", (F.col("_base") + F.col("_inside")).alias("before"), "total")


def with_mean_ranks(df: DataFrame, values: dict[str, str], by: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """df (a written table, without nulls in the values) with the mean rank, from 1, of each row's value within its group; values: double column to rank column.

    Rows are ranked within ranges of values (approximate quantiles of the group, which don't change the result) and over
    the ranges' counts. A value that is a bound, and NaN, is a range of its own, ranked by its count alone, so neither a large group
    nor a frequent value makes a long task; and a row moves once for each column. parts is a power of 2.
    """
    shares = F.array(*(F.lit(k / parts) for k in range(1, parts)))
    cut = written(df.groupBy(*by).agg(*(F.percentile_approx(F.when(~F.isnan(c), F.col(c)), shares, F.lit(4 * parts)).alias(f"_cut_{c}") for c in values)), "cuts")  # a row a group
    here = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by), F.lit(True))
    x = df
    for c, out in values.items():
        bounds = cut.select(*(F.col(k).alias(f"_by_{k}") for k in by), F.col(f"_cut_{c}").alias("_cut"))

        def placed(rows, c=c, bounds=bounds):
            y, step = rows.join(F.broadcast(bounds), here, "left").withColumn("_range", F.lit(0)), parts // 2
            while step:  # a binary search: how many bounds lie below the value
                y, step = y.withColumn("_range", F.col("_range") + F.when(F.col(c) > F.col("_cut")[F.col("_range") + (step - 1)], step).otherwise(0)), step // 2
            exact = F.col("_cut")[F.least("_range", F.lit(parts - 2))] == F.col(c)
            return y.withColumn("_exact", F.isnan(c) | F.coalesce(exact, F.lit(False))).drop("_cut", *(f"_by_{k}" for k in by))

        sums = placed(df.select(*by, c)).groupBy(*by, "_range", "_exact").agg(F.count("*").alias("_n"))  # some rows a group
        before = Window.partitionBy(*by).orderBy("_range", "_exact").rowsBetween(Window.unboundedPreceding, -1)
        bases = sums.select(*(F.col(k).alias(f"_by_{k}") for k in by), F.col("_range").alias("_r"), F.col("_exact").alias("_e"), "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        spread = F.when(F.col("_exact"), F.pmod(F.xxhash64(*df.columns), F.lit(4 * parts))).otherwise(F.lit(-1))
        x = placed(x).withColumn("_spread", spread)
        x = x.join(F.broadcast(bases), here & (F.col("_range") == F.col("_r")) & (F.col("_exact") == F.col("_e"))).drop("_r", "_e", *(f"_by_{k}" for k in by))
        inside = average_rank(F.when(~F.col("_exact"), F.col(c)), *by, "_range", "_spread")
        x = x.withColumn(out, F.col("_base") + F.when(F.col("_exact"), (F.col("_n") + 1) / 2).otherwise(inside)).drop("_range", "_exact", "_spread", "_n", "_base")
    return x


def quantiles(df: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """By group the exact quantiles of a value, interpolated between neighbours, as columns q0, q1, ... A row a group.

    The values are written to the shared folder first, as they are read several times.
    """
    x = ordered_counts(written(df.select(*by, value), "values"), value, by)

    def at(k: Column) -> Column:  # the value of the k-th row, from 0
        return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value)))

    out = {}
    for i, s in enumerate(shares):
        place = F.lit(float(s)) * (F.col("total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        rest = F.max(place - F.floor(place))
        out[f"q{i}"] = (low + rest * (high - low)).alias(f"q{i}")
    return x.groupBy(*by).agg(*out.values())


def gates(checks: list[tuple[str, Column]]) -> Column:
    """Sorted names of the failed checks; a check that is null doesn't fail."""
    return F.array_sort(F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks))))


def reasons(checks: list[tuple[str, Column]]) -> Column:
    """Sorted names of the conditions that hold."""
    return F.array_sort(F.array_compact(F.array(*(F.when(holds, F.lit(name)) for name, holds in checks))))


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(t)) for t in terms))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, absolute error below 7.5e-8 (a five-term polynomial)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = poly * F.exp(-x * x / 2) / 2.5066282746310002
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def eastern_to_utc(text: Column, form: str = "yyyyMMddHHmmss") -> Column:
    """Section 2.8: New York wall-clock text as a UTC time without zone, summer time heeded; null if it isn't of that form."""
    return F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz"))


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts as strings, joined by bars: any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("bigint") / float(1 << 52)


def short_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 16 hex digits of the SHA-256 of the parts, joined by bars; null parts count as empty."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 16))
