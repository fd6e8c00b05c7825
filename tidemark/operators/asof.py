"""Temporal joins without inequality joins: queries and facts are united, and windows by key carry facts to queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _united(queries: DataFrame, facts: DataFrame, keys: list[str], query_at: str, fact_at: str, carried: list[str], extra: list[str]) -> DataFrame:
    q = queries.select(*keys, F.col(query_at).alias("_at"), F.lit(0).alias("_fact"), F.struct(*queries.columns).alias("_query"), *(F.lit(None).cast("string").alias(f"_{c}") for c in extra))
    f = facts.select(*keys, F.col(fact_at).alias("_at"), F.lit(1).alias("_fact"), F.struct(F.col(fact_at).alias("_fact_at"), *carried).alias("_carried"), *(F.col(c).cast("string").alias(f"_{c}") for c in extra))
    return q.unionByName(f, allowMissingColumns=True)


def forward(queries: DataFrame, facts: DataFrame, keys: list[str], query_at: str, fact_at: str, carried: list[str], max_wait: str | None = None) -> DataFrame:
    """JOIN-05: each query with the first fact of its keys at or after it; null if none, or none within max_wait (an interval). One pass of a key's rows."""
    x = _united(queries, facts, keys, query_at, fact_at, carried, [])
    # backwards in time, so that the frame only grows; at equal times facts come first, and those without a time come last
    w = Window.partitionBy(*keys).orderBy(F.col("_at").desc_nulls_last(), F.desc("_fact")).rowsBetween(Window.unboundedPreceding, 0)
    got = x.withColumn("_hit", F.last("_carried", ignorenulls=True).over(w)).where("_fact = 0")
    got = got.withColumn("_hit", F.when(F.col("_hit._fact_at") >= F.col("_at"), F.col("_hit")))
    if max_wait:
        got = got.withColumn("_hit", F.when(F.col("_hit._fact_at") <= F.col("_at") + F.expr(f"INTERVAL {max_wait}"), F.col("_hit")))
    return got.select("_query.*", F.col("_hit._fact_at").alias(f"{fact_at}_hit"), *(F.col(f"_hit.{c}").alias(c) for c in carried))


def backward(queries: DataFrame, facts: DataFrame, keys: list[str], query_at: str, fact_at: str, carried: list[str], ties: list[str]) -> DataFrame:
    """JOIN-06: each query with the last fact of its keys at or before it; facts of equal time are ordered by `ties` (of carried)."""
    x = _united(queries, facts, keys, query_at, fact_at, carried, [])
    order = [F.col("_at"), F.desc("_fact"), *(F.col(f"_carried.{t}") for t in ties)]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = x.withColumn("_hit", F.last("_carried", ignorenulls=True).over(w)).where("_fact = 0")
    return got.select("_query.*", F.col("_hit._fact_at").alias(f"{fact_at}_hit"), *(F.col(f"_hit.{c}").alias(c) for c in carried))


_DAY_US = 86_400_000_000
#: Length of the parts of a key's time that are summed up apart, so that a busy key isn't one task's work.
_PART_US = 30 * _DAY_US


def _us(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _mark(t, turn: int, name: str | None, delta: int) -> F.Column:
    """A change of a running count at a time; turn 0 counts at that time already, turn 2 only after it. Grid dates read in turn 1."""
    return F.struct(t.alias("_t"), F.lit(turn).alias("_turn"), F.lit(name).alias("_name"), F.lit(delta).alias("_delta"))


def _counted(marks: DataFrame, grid: DataFrame, facts: DataFrame, key: str, at: str, names: list[str]) -> DataFrame:
    """date, key, a count for each name, days_since_last of the grid's dates at midnight, from marks (key, _t, _turn, _name, _delta).

    Running sums within parts of a key's time, and over the parts before: linear in marks and dates. Dates before a key's
    first fact are left out.
    """
    none = F.lit(None)
    x = marks.withColumns({"date": none.cast("date"), "_seen": none.cast("bigint")})
    x = x.unionByName(facts.select(F.col(key), _us(at).alias("_t"), F.lit(0).alias("_turn"), none.cast("string").alias("_name"), F.lit(0).alias("_delta"), none.cast("date").alias("date"), _us(at).alias("_seen")))
    x = x.unionByName(grid.select(F.col(key), _us("date").alias("_t"), F.lit(1).alias("_turn"), none.cast("string").alias("_name"), F.lit(0).alias("_delta"), "date", none.cast("bigint").alias("_seen")))
    x = x.where("_t IS NOT NULL").withColumn("_part", F.floor(F.col("_t") / _PART_US))
    of = lambda n: F.sum(F.when(F.col("_name") == n, F.col("_delta")).otherwise(0))
    every = {**{f"_{n}": of(n) for n in names}, "_last": F.max("_seen")}
    sums = x.groupBy(key, "_part").agg(*(c.alias(n) for n, c in every.items()))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a key and part
    base = sums.select(key, "_part", *((F.max if n == "_last" else F.sum)(n).over(before).alias(f"_base{n}") for n in every))
    inside = Window.partitionBy(key, "_part").orderBy("_t", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    read = x.withColumns({n: c.over(inside) for n, c in every.items()}).where("_turn = 1").join(base, [key, "_part"])
    read = read.withColumn("_last", F.greatest("_last", "_base_last")).where("_last IS NOT NULL")
    return read.select("date", key, *((F.col(f"_{n}") + F.coalesce(f"_base_{n}", F.lit(0))).alias(n) for n in names), F.floor((F.col("_t") - F.col("_last")) / _DAY_US).alias("days_since_last"))


def _range_marks(facts: DataFrame, key: str, at: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """A fact counts at the dates from b to a days after it, bounds included."""
    t = _us(at)
    marks = [m for n, (a, b) in windows.items() for m in (_mark(t + b * _DAY_US, 0, n, 1), _mark(t + a * _DAY_US, 2, n, -1))]
    return facts.select(F.col(key), F.explode(F.array(*marks)).alias("m")).select(key, "m.*")


def _distinct_marks(facts: DataFrame, key: str, at: str, name: str, value: str, days: int) -> DataFrame:
    """A fact counts from its time until the next one of the same value, or until `days` after it: one fact of each value of a window counts."""
    x = facts.select(F.col(key), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("_v"), _us(at).alias("_t")).where("_t IS NOT NULL").withColumn("_part", F.floor(F.col("_t") / _PART_US))
    own = Window.partitionBy(key, "_v", "_part").orderBy("_t")
    first = x.groupBy(key, "_v", "_part").agg(F.min("_t").alias("_first"))
    after = first.select(key, "_v", "_part", F.lead("_first").over(Window.partitionBy(key, "_v").orderBy("_part")).alias("_later"))  # a row a key, value and part
    x = x.withColumn("_next", F.lead("_t").over(own)).join(after, [key, "_v", "_part"]).withColumn("_next", F.coalesce("_next", "_later"))
    out_of = F.col("_t") + days * _DAY_US
    over = F.when(F.col("_next") <= out_of, _mark(F.col("_next"), 0, name, -1)).otherwise(_mark(out_of, 2, name, -1))
    return x.select(key, F.explode(F.array(_mark(F.col("_t"), 0, name, 1), over)).alias("m")).select(key, "m.*")


def range_counts(grid: DataFrame, facts: DataFrame, key: str, at: str, windows: dict[str, tuple[int, int]], distinct: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """JOIN-07: for each (date, key) of the grid how many facts lie from a to b days before its midnight, bounds included.

    windows: name to (a, b), say (30, 0) for the last 30 days. distinct: name to (column, days), exact counts of the
    column's different values (null is one) in the last days. Dates before a key's first fact are left out. Also
    days_since_last. Facts enter and leave running counts, which dates read: no join of dates with facts, no window's set.
    """
    marks = _range_marks(facts, key, at, windows)
    for n, (value, days) in (distinct or {}).items():
        marks = marks.unionByName(_distinct_marks(facts, key, at, n, value, days))
    return _counted(marks, grid, facts, key, at, [*windows, *(distinct or {})])


def within_sessions(panel: DataFrame, events: DataFrame, calendar: DataFrame, k: int = 5) -> DataFrame:
    """JOIN-17: whether the symbol has an event in the next k sessions (not the current one): an equi-join on exploded sessions."""
    idx = events.select("symbol", F.col("event_date").alias("date")).join(calendar, "date").select("symbol", F.explode(F.sequence(F.col("session_idx") - k, F.col("session_idx") - 1)).alias("session_idx")).distinct()
    near = idx.join(calendar, "session_idx").select("symbol", "date", F.lit(True).alias("_near"))
    return panel.join(near, ["symbol", "date"], "left").withColumn("event_within", F.coalesce("_near", F.lit(False))).drop("_near")
