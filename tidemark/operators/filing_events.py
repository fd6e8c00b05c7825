"""Events from filings: candidates, exclusion reasons, first tradable time, labels, controls, studies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import contains_any, gates, log_ratio, quantiles, reasons, short_id
from . import asof, panel

#: Titles of common shares, titles that exclude, terms of private purchases.
COMMON_TITLES = ("common stock", "class a common stock", "class b common stock", "ordinary shares", "ordinary share", "common shares", "common share")
EXCLUDED_TITLES = (
    "warrant", "option", "restricted stock unit", "rsu", "preferred", "convertible", "unit", "right to receive", "phantom",
    "performance stock unit", "depositary share", "common units", "limited partnership",
)
PRIVATE_TERMS = ("private placement", "purchase agreement", "subscription agreement", "pipe", "sponsor", "initial public offering", "simultaneously with the consummation", "warrant")


def common_title(title) -> F.Column:
    """PRJ-10: whether a security title names common shares and nothing that excludes."""
    return contains_any(title, COMMON_TITLES) & ~contains_any(title, EXCLUDED_TITLES)


def ticker_flags(ticker) -> dict[str, F.Column]:
    """PRJ-07: normalised ticker, whether it can't be traded, is over the counter, looks preferred."""
    x = F.upper(F.regexp_replace(F.coalesce(ticker, F.lit("")), r"\s+", ""))
    return {"ticker": x, "invalid": ~x.rlike(r"^[A-Z]{1,5}(?:[.\-][A-Z]{1,2})?$"), "otc": x.rlike(r"^[A-Z]{4}[FY]$") | x.endswith(".OB") | x.endswith(".PK"), "preferred": x.rlike(r"-P[A-Z]?$|\.PR")}


def candidate_events(transactions: DataFrame, chief: str, director: str) -> DataFrame:
    """AGG-05, PRJ-08, PRJ-09: one purchase candidate for each accession of transactions.

    Sums, maximum and median over strict purchases (code P, price and shares above zero), distinct owners, a strength
    score (log value, three quarters of log owners, half for a chief, a quarter for a director) and sorted exclusion reasons.
    """
    strict = (F.col("code") == "P") & (F.col("price") > 0) & (F.col("shares") > 0)
    value = F.when(strict, (F.col("shares") * F.col("price")).cast("decimal(38,6)"))
    x = transactions.withColumn("value", value).withColumn("strict", strict)
    g = x.groupBy("accession", "issuer", "accepted_at").agg(
        F.count("*").alias("n_rows"), F.count("value").alias("n_strict"), F.sum("value").cast("double").alias("total_value"), F.max("value").cast("double").alias("max_value"),
        F.median(F.when(F.col("strict"), F.col("price").cast("double"))).alias("median_price"), F.count_distinct(F.when(F.col("strict"), F.col("owner"))).alias("n_insiders"),
        F.coalesce(F.bool_or(F.when(F.col("strict"), F.col("role") == chief)), F.lit(False)).alias("chief_buy"), F.coalesce(F.bool_or(F.when(F.col("strict"), F.col("role") == director)), F.lit(False)).alias("director_buy"),
        F.bool_or(F.col("code") == "S").alias("has_sale"), F.max(F.datediff("traded_on", F.col("accepted_at").cast("date"))).alias("delay"),
    )
    score = F.log1p(F.coalesce("total_value", F.lit(0.0))) + 0.75 * F.log1p(F.col("n_insiders").cast("double")) + F.when(F.col("chief_buy"), 0.5).otherwise(0.0) + F.when(F.col("director_buy"), 0.25).otherwise(0.0)
    why = reasons([("no_strict_open_market_buy_rows", F.col("n_strict") == 0), ("mixed_p_and_s", (F.col("n_strict") > 0) & F.col("has_sale")), ("late_report", F.col("delay") > 10)])
    return g.select(
        short_id("evt_", F.col("issuer"), F.col("accession")).alias("event_id"), "accession", "issuer", "accepted_at", "n_rows", "n_strict", "total_value", "max_value", "median_price", "n_insiders",
        "chief_buy", "director_buy", F.round(score, 6).alias("strength"), why.alias("exclusion_reasons"), (F.size(why) == 0).alias("eligible"),
    )


def control_events(transactions: DataFrame) -> DataFrame:
    """AGG-06: control candidates by family: mechanical (codes A, M, F) and sales (code S), one for each accession."""
    family = F.when(F.col("code").isin("A", "M", "F"), "mechanical").when(F.col("code") == "S", "sales")
    return transactions.withColumn("family", family).where("family IS NOT NULL").groupBy("family", "accession", "issuer", "accepted_at").agg(F.count("*").alias("n_rows"), F.sum((F.col("shares") * F.col("price")).cast("decimal(38,6)")).cast("double").alias("total_value"))


def first_tradable(events: DataFrame, calendar: DataFrame, at: str = "accepted_at", latency: int = 5) -> DataFrame:
    """WIN-29: events with tradable_at and its session, by calendar (session_idx, date, open_at, close_at).

    The session is that of the UTC date, or the next. Before its open: open + latency; from its close on: the next open
    + latency; within: the next full minute after at + latency if not after the close, else the next open.
    """
    dates = calendar.select("date").unionByName(events.select(F.col(at).cast("date").alias("date")))  # events may come before the first session
    days = dates.agg(F.min("date").alias("a")).crossJoin(calendar.agg(F.max("date").alias("b"))).where("a <= b").select(F.explode(F.sequence("a", "b")).alias("day"))
    next_ = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)  # one row a day
    own = days.join(calendar.select(F.col("date").alias("day"), "session_idx"), "day", "left").select("day", F.first("session_idx", ignorenulls=True).over(next_).alias("session_idx"))
    later = calendar.select((F.col("session_idx") - 1).alias("session_idx"), F.col("open_at").alias("next_open"), F.col("date").alias("next_date"))
    c = own.join(calendar, "session_idx").join(later, "session_idx", "left")
    x = events.withColumn("day", F.col(at).cast("date")).join(c.drop("date").withColumn("session", F.date_add(F.col("open_at").cast("date"), 0)), "day", "left")
    wait = F.expr(f"INTERVAL {latency} MINUTES")
    moved = F.col(at) + wait
    minute = F.date_trunc("minute", moved).cast("timestamp_ntz")
    minute = F.when(minute < moved, minute + F.expr("INTERVAL 1 MINUTE")).otherwise(minute)
    before, after, fits = F.col(at) < F.col("open_at"), F.col(at) >= F.col("close_at"), minute <= F.col("close_at")
    tradable = F.when(before, F.col("open_at") + wait).when(after, F.col("next_open") + wait).when(fits, minute).otherwise(F.col("next_open"))
    session = F.when(before | (~after & fits), F.col("session")).otherwise(F.col("next_date"))
    return x.select(*events.columns, tradable.alias("tradable_at"), session.alias("entry_session"))


def event_labels(events: DataFrame, bars: DataFrame, calendar: DataFrame, horizons: tuple[int, ...] = (1, 5, 20), cost: float = 0.005, benchmark: DataFrame | None = None) -> DataFrame:
    """EVT-01, JOIN-05, JOIN-15: net and abnormal log returns of events (event_id, symbol, tradable_at) over session horizons.

    The stock leg runs from the open of the first bar at or after tradable_at to the close of the session h later, less
    cost; the benchmark leg (date, close) from the entry session's close. Sorted blockers say what is missing.
    """
    facts = bars.select("symbol", F.col("date").cast("timestamp_ntz").alias("bar_at"), F.col("open").alias("entry_open"), F.col("date").alias("entry_date"))
    q = events.withColumn("entry_from", F.date_trunc("day", F.col("tradable_at")).cast("timestamp_ntz"))
    x = asof.forward(q, facts, ["symbol"], "entry_from", "bar_at", ["entry_open", "entry_date"])
    legs = x.join(calendar.select(F.col("date").alias("entry_date"), "session_idx"), "entry_date", "left").withColumn("h", F.explode(F.array(*(F.lit(h) for h in horizons))))
    legs = legs.withColumn("exit_idx", F.col("session_idx") + F.col("h")).join(calendar.select(F.col("session_idx").alias("exit_idx"), F.col("date").alias("exit_date")), "exit_idx", "left")
    legs = legs.join(bars.select("symbol", F.col("date").alias("exit_date"), F.col("close").alias("exit_close")), ["symbol", "exit_date"], "left")
    b = benchmark.select("date", F.col("close").alias("b"))
    legs = legs.join(b.select(F.col("date").alias("entry_date"), F.col("b").alias("b0")), "entry_date", "left").join(b.select(F.col("date").alias("exit_date"), F.col("b").alias("b1")), "exit_date", "left")
    legs = legs.withColumn("net", log_ratio(F.col("exit_close"), F.col("entry_open")) - cost).withColumn("abnormal", F.col("net") - log_ratio(F.col("b1"), F.col("b0")))
    at = lambda c, h: F.max(F.when(F.col("h") == h, F.col(c)))
    out = legs.groupBy("event_id", "symbol", "tradable_at", "entry_date").agg(*(f for h in horizons for f in (at("net", h).alias(f"ret_{h}d_net"), at("abnormal", h).alias(f"abret_{h}d_net"))))
    blockers = reasons([("missing_entry_bar", F.col("entry_date").isNull()), *((f"missing_exit_{h}d", F.col("entry_date").isNotNull() & F.col(f"ret_{h}d_net").isNull()) for h in horizons)])
    return out.withColumn("label_blockers", blockers).withColumn("label_status", F.when(F.size("label_blockers") == 0, "LABELED").when(F.col("entry_date").isNull(), "BLOCKED").otherwise("PARTIAL"))


def labelled(labels: DataFrame, metric: str) -> DataFrame:
    """PRJ-12: events whose labels are whole and whose metric is there."""
    return labels.where((F.col("label_status") == "LABELED") & F.col(metric).isNotNull())


def study_summary(labels: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """AGG-09: per group number, mean, median, share above zero, and the five largest absolute values' share of all. Groups may be few and large."""
    x = labels.where(F.col(metric).isNotNull()).select(*by, "event_id", metric)
    largest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs(metric)), "event_id"))  # cut to five a task before the exchange
    top = x.withColumn("_r", largest).where("_r <= 5").groupBy(*by).agg(F.sum(F.abs(metric)).alias("_top"))
    g = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), F.avg((F.col(metric) > 0).cast("double")).alias("hit_rate"), F.sum(F.abs(metric)).alias("_all"))
    mid = quantiles(x, metric, [0.5], tuple(by)).withColumnRenamed("q0", "median")
    return g.join(mid, by).join(top, by).select(*by, "n", "mean", "median", "hit_rate", F.try_divide("_top", "_all").alias("top5_share"))


def bootstrap_ci(labels: DataFrame, metric: str, by: list[str], iterations: int = 1000, seed: int = 7) -> DataFrame:
    """AGG-10: 95% interval of the group mean by a Poisson bootstrap with hashed weights: one aggregation by (group, iteration).

    The weight of an event in an iteration is how many shares of the Poisson distribution lie below unit_hash(seed, event,
    iteration). It is hashed once for all groups of the event, and hashes are compared as hex digits, in their order.
    """
    shares = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
    digits = [f"{int(p * (1 << 52)):013x}g" for p in shares]  # g: behind all digits that go on
    weight = F.lit(len(digits))
    for k in reversed(range(len(digits))):
        weight = F.when(F.col("_h") < digits[k], k).otherwise(weight)
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("event_id").cast("string"), F.col("_i").cast("string")))
    x = labels.where(F.col(metric).isNotNull()).groupBy("event_id").agg(F.collect_list(F.struct(*by, F.col(metric).alias("_v"))).alias("_sets"))  # an event's groups
    x = x.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("_h", hashed).withColumn("_w", weight).select("_i", "_w", F.explode("_sets").alias("_s")).select("_i", "_w", "_s.*")
    means = x.groupBy(*by, "_i").agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w").cast("double")).alias("_m"))
    return means.groupBy(*by).agg(F.percentile("_m", F.lit(0.025)).alias("ci_low"), F.percentile("_m", F.lit(0.975)).alias("ci_high"))


def strength_buckets(labels: DataFrame, metric: str, strength: str = "strength") -> DataFrame:
    """AGG-11: mean of the metric by quartile of strength (edges inclusive above), and Q4 less Q1. Edges are one row."""
    x = labels.where(F.col(metric).isNotNull() & F.col(strength).isNotNull())
    edges = quantiles(x, strength, [0.25, 0.5, 0.75])
    b = F.when(F.col(strength) <= F.col("q0"), "Q1").when(F.col(strength) <= F.col("q1"), "Q2").when(F.col(strength) <= F.col("q2"), "Q3").otherwise("Q4")
    g = x.crossJoin(edges).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg(metric).alias("mean"))
    ends = g.agg((F.max(F.when(F.col("bucket") == "Q4", F.col("mean"))) - F.max(F.when(F.col("bucket") == "Q1", F.col("mean")))).alias("q4_minus_q1"))
    return g.crossJoin(ends)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """AGG-12: rows by value, or by element of an array."""
    is_array = dict(df.dtypes)[column].startswith("array")
    return df.select((F.explode(column) if is_array else F.col(column)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def separation(summary: DataFrame, family: str, primary: str) -> DataFrame:
    """AGG-28: the primary family's mean less each other family's. A row a family."""
    p = summary.where(F.col(family) == primary).select(F.col("mean").alias("primary_mean"))
    return summary.where(F.col(family) != primary).crossJoin(p).select(family, (F.col("primary_mean") - F.col("mean")).alias("mean_difference"))


def study_verdict(summary: DataFrame, min_sample: int = 300) -> DataFrame:
    """AGG-41: failed gates and decision of each row of a study summary (n, mean, median, q4_minus_q1)."""
    failed = gates([(f"sample_size<{min_sample}", F.col("n") >= min_sample), ("mean<=50bps", F.col("mean") > 0.005), ("median<=0", F.col("median") > 0), ("q4_minus_q1<=75bps", F.col("q4_minus_q1") > 0.0075)])
    decision = F.when(F.col("n") == 0, "BLOCKED_DATA_COVERAGE").when(F.col("n") < min_sample, "COLLECT_MORE_HISTORY").when(F.size(failed) > 0, "KILL_OR_REWORK").otherwise("CONTINUE")
    return summary.select("*", failed.alias("failures"), decision.alias("decision"), F.when(decision == "CONTINUE", "PASS").otherwise("NOT_PROMOTABLE").alias("status"))


def monthly_coverage(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """AGG-13: per month candidates, eligible ones, labelled ones, their ratios and a verdict."""
    c = candidates.groupBy(F.trunc("accepted_at", "MM").alias("month")).agg(F.count("*").alias("n_candidates"), F.count_if("eligible").alias("n_eligible"))
    done = labels.where("label_status = 'LABELED'").groupBy(F.trunc("tradable_at", "MM").alias("month")).agg(F.count("*").alias("n_labeled"))
    x = c.join(done, "month", "left").withColumn("n_labeled", F.coalesce("n_labeled", F.lit(0)))
    ratio = F.try_divide(F.col("n_labeled").cast("double"), F.col("n_eligible").cast("double"))
    return x.select("*", ratio.alias("label_ratio"), F.when(F.col("n_eligible") == 0, "NO_EVENTS").when(ratio >= 0.8, "COVERED").when(ratio > 0, "PARTIAL").otherwise("MISSING").alias("coverage"))


def placebo_times(events: DataFrame, calendar: DataFrame, sessions: int = -20) -> DataFrame:
    """EVT-03, WIN-28: the events moved by so many sessions, at the same time of day; those that leave the calendar drop out."""
    x = events.withColumn("date", F.col("accepted_at").cast("date"))
    moved = panel.session_shift(x, calendar, sessions, "placebo").where("placebo IS NOT NULL")
    days = F.datediff("placebo", "date")
    return moved.withColumn("accepted_at", F.expr("accepted_at + make_dt_interval(1) * datediff(placebo, date)")).withColumn("shift_days", days).drop("date", "placebo")


def variants(labels: DataFrame) -> dict[str, DataFrame]:
    """PRJ-11: fixed subsets of labelled events: by a chief, by several insiders, of the top quartile by value. Edges are one row."""
    edge = quantiles(labels, "total_value", [0.75]).withColumnRenamed("q0", "edge")
    return {"chief": labels.where("chief_buy"), "clustered": labels.where("n_insiders >= 2"), "top_value": labels.crossJoin(edge).where("total_value >= edge").drop("edge")}
