"""Event studies over families of events: packets of summaries by horizon, fixed variants, months covered by their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quantiles
from ..sources.folders import written
from . import filing_events as ev
from . import gates


def strength_spread(df: DataFrame, value: str, strength: str, by: list[str]) -> DataFrame:
    """AGG-11 by group: by, q1_mean to q4_mean of the value by quartile of strength (edges inclusive above), q4_minus_q1. Groups may be few and large."""
    x = df.where(F.col(value).isNotNull() & F.col(strength).isNotNull()).select(*by, value, F.col(strength).cast("double").alias(strength))
    edges = quantiles(x, strength, [0.25, 0.5, 0.75], tuple(by))  # a row a group
    x = x.join(edges, by)
    quarter = F.when(F.col(strength) <= F.col("q0"), 1).when(F.col(strength) <= F.col("q1"), 2).when(F.col(strength) <= F.col("q2"), 3).otherwise(4)
    means = {f"q{k}_mean": F.avg(F.when(quarter == k, F.col(value))) for k in range(1, 5)}
    return x.groupBy(*by).agg(*(c.alias(n) for n, c in means.items())).withColumn("q4_minus_q1", F.col("q4_mean") - F.col("q1_mean"))


def study_packet(labels: DataFrame, horizons: tuple[int, ...], rules: DataFrame, primary: str = "primary", strength: str = "strength", iterations: int = 1000, seed: int = 7, family_of_rules: str = "event_study") -> DataFrame:
    """EVT-04: one row for each family, horizon and kind (net, abnormal_net) of labels (family, event_id, strength, label_status, ret_{h}d_net, abret_{h}d_net).

    n, mean, median, hit_rate, top5_share, ci_low, ci_high (bootstrap), means by quartile of strength and their spread;
    mean_difference is the primary family's mean less the row's, for the other families. Rows of the primary family have
    the failures, decision and status of the gates, which see the other families as {family}_separation. Only whole labels
    count. All sets are grouped in one pass over the labels in long form.
    """
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(k).alias("kind"), F.col(f"{c}_{h}d_net").alias("value")) for h in horizons for k, c in (("net", "ret"), ("abnormal_net", "abret"))))
    long = labels.where("label_status = 'LABELED'").select("family", "event_id", strength, F.explode(each).alias("x")).select("family", "event_id", strength, "x.*").where("value IS NOT NULL")
    long, by = written(long, "study"), ["family", "horizon", "kind"]  # read for each figure
    x = ev.study_summary(long, "value", by).join(ev.bootstrap_ci(long, "value", by, iterations, seed), by).join(strength_spread(long, "value", strength, by), by, "left")
    first = x.where(F.col("family") == primary).select("horizon", "kind", F.col("mean").alias("_primary"))
    x = x.join(first, ["horizon", "kind"], "left").withColumn("mean_difference", F.when(F.col("family") != primary, F.col("_primary") - F.col("mean"))).drop("_primary")
    x = written(x, "packet")  # a row for each family, horizon and kind
    keys = ["horizon", "kind"]
    metrics = gates.long_metrics(x.where(F.col("family") == primary), keys, family_of_rules, ["n", "mean", "median", "q4_minus_q1"])
    apart = x.where(F.col("family") != primary).select(*keys, F.lit(family_of_rules).alias("family"), F.concat("family", F.lit("_separation")).alias("metric"), F.col("mean_difference").alias("value"))
    verdict = gates.evaluate(metrics.unionByName(apart), keys, rules).select(*keys, F.lit(primary).alias("family"), "failures", "decision", "status")
    return x.join(verdict, by, "left")


#: Flags and reasons that a clean, timely, unmixed event must not have; days that it may take to be reported.
DISALLOWED = ("mixed_p_and_s", "late_report", "private_or_unit_purchase", "private_or_unit_purchase_flag", "ambiguous_or_invalid_ticker", "non_common_security_title", "missing_price", "zero_price", "otc_symbol")
TIMELY_DAYS = 2


def clean_timely(labels: DataFrame, days: int = TIMELY_DAYS) -> DataFrame:
    """PRJ-11: eligible events reported within so many days, without a disallowed flag or reason. labels: eligible, days_to_report, flags, exclusion_reasons (arrays)."""
    none = F.array().cast("array<string>")
    bad = F.array(*map(F.lit, DISALLOWED))
    return labels.where(F.coalesce("eligible", F.lit(False)) & (F.col("days_to_report") <= days) & ~F.arrays_overlap(F.coalesce("flags", none), bad) & ~F.arrays_overlap(F.coalesce("exclusion_reasons", none), bad))


def variants(labels: DataFrame, days: int = TIMELY_DAYS) -> DataFrame:
    """PRJ-11: the clean, timely, unmixed events with `variants`, the names of the fixed variants that each belongs to.

    All belong to clean_timely_unmixed; by officers or directors, by chiefs, by several insiders or in several transactions,
    and of the top quartile by value among the clean ones. The quartile's edge is one row.
    """
    x = clean_timely(labels, days)
    edge = quantiles(x.where("total_value IS NOT NULL"), "total_value", [0.75]).withColumnRenamed("q0", "_edge")
    x = x.join(F.broadcast(edge), F.lit(True), "left")  # one row or none
    names = [
        ("clean_timely_unmixed", F.lit(True)), ("officer_director_only", (F.col("n_officers") > 0) | (F.col("n_directors") > 0)), ("ceo_cfo_only", F.col("chief_buy")),
        ("clustered_buyers", (F.col("n_insiders") > 1) | (F.col("n_strict") > 1)), ("large_purchase_q4", F.col("total_value") >= F.col("_edge")),
    ]
    return x.withColumn("variants", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in names)))).drop("_edge")


def monthly_matrix(inputs: dict[str, DataFrame], labeled: str = "labeled", eligible: str = "eligible", least: float = 0.8) -> DataFrame:
    """AGG-13: month, n_{name} for each input (date), missing (names without rows), label_ratio and coverage of every month from the first to the last of any input.

    One union with source tags, counted once; months without anything are rows too. coverage: NO_INPUT without any row,
    MISSING_INPUTS if some other input has none, NO_EVENTS without eligible ones, else by the share of eligible events that
    are labelled: COVERED from `least` on, PARTIAL above 0, UNLABELED.
    """
    tagged = None
    for name, df in inputs.items():
        one = df.select(F.trunc("date", "MM").alias("month"), F.lit(name).alias("input"))
        tagged = one if tagged is None else tagged.unionByName(one)
    counts = tagged.where("month IS NOT NULL").groupBy("month").agg(*(F.count_if(F.col("input") == n).alias(f"n_{n}") for n in inputs))  # a row a month
    spine = counts.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    x = spine.join(counts, "month", "left").select("month", *(F.coalesce(f"n_{n}", F.lit(0)).alias(f"n_{n}") for n in inputs))
    missing = F.array_compact(F.array(*(F.when(F.col(f"n_{n}") == 0, F.lit(n)) for n in inputs)))
    ratio = F.try_divide(F.col(f"n_{labeled}").cast("double"), F.col(f"n_{eligible}").cast("double"))
    others = F.size(F.array_except(missing, F.array(F.lit(labeled), F.lit(eligible)))) > 0
    verdict = (
        F.when(F.size(missing) == len(inputs), "NO_INPUT").when(others, "MISSING_INPUTS").when(F.col(f"n_{eligible}") == 0, "NO_EVENTS").when(ratio >= least, "COVERED").when(ratio > 0, "PARTIAL").otherwise("UNLABELED")
    )
    return x.select("*", missing.alias("missing"), ratio.alias("label_ratio"), verdict.alias("coverage"))


def month_gaps(matrix: DataFrame, inputs: list[str]) -> DataFrame:
    """AGG-13: input, first, last, months: the runs of months without rows of each input. A row a month and input before."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("input"), (F.col(f"n_{n}") == 0).alias("gap")) for n in inputs))).alias("x")
    order = Window.partitionBy("input").orderBy("month")  # the months
    x = matrix.select("month", each).select("month", "x.*").withColumn("_i", F.row_number().over(order)).where("gap")
    x = x.withColumn("_run", F.col("_i") - F.row_number().over(order))
    return x.groupBy("input", "_run").agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count("*").alias("months")).drop("_run")
