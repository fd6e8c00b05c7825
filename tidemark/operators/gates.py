"""Gates as data: one table of rules for all families of metrics, one plan that evaluates it, and what follows from failures."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """A metric of a family must compare so with a bound, else the subject fails with a name, under an objective, and this decision (the one of least priority counts)."""

    family: str
    metric: str
    must: str
    bound: float
    failure: str
    objective: str = "predictive"
    decision: str = "REJECT"
    priority: int = 9
    missing_fails: bool = False


def _separations(family: str, controls: tuple[str, ...], decision: str, missing_fails: bool) -> tuple[Gate, ...]:
    return tuple(Gate(family, f"{c}_separation", ">", 0.0075, f"{c}_separation<=75bps", "false_discovery", decision, missing_fails=missing_fails) for c in controls)


# Metrics, bounds and names of the failures of each family, and its decision without any.
CONTROLS = ("mechanical_acquisition_codes", "sales_placebo")
GATES = (
    Gate("event_study", "n", ">", 0, "sample_size<300", decision="BLOCKED_DATA_COVERAGE", priority=1, missing_fails=True),
    Gate("event_study", "n", ">=", 300, "sample_size<300", decision="COLLECT_MORE_HISTORY", priority=2, missing_fails=True),
    Gate("event_study", "mean", ">", 0.005, "mean_abret_5d_net<=50bps", decision="KILL_OR_REWORK"),
    Gate("event_study", "median", ">", 0, "median_abret_5d_net<=0", decision="KILL_OR_REWORK"),
    Gate("event_study", "q4_minus_q1", ">", 0.0075, "q4_minus_q1<=75bps", decision="KILL_OR_REWORK"),
    *_separations("event_study", CONTROLS, "KILL_OR_REWORK", False),
    Gate("rework_variant", "n", ">=", 100, "sample_size<100", decision="REJECTED", missing_fails=True),
    Gate("rework_variant", "mean", ">", 0.005, "mean_abret_5d_net<=50bps", decision="REJECTED", missing_fails=True),
    Gate("rework_variant", "median", ">", 0, "median_abret_5d_net<=0", decision="REJECTED", missing_fails=True),
    *_separations("rework_variant", CONTROLS, "REJECTED", True),
    Gate("predictive", "rank_ic", ">=", 0.02, "rank_ic<0.02", missing_fails=True),
    Gate("predictive", "least_year_ic", ">", 0, "not all yearly IC values are positive", "stability", missing_fails=True),
    Gate("predictive", "max_abs_placebo_ic", "<=", 0.1, "abs(placebo)>0.1", "robustness"),
    Gate("predictive", "cost_stress_net_return", ">=", 0, "cost_stress_net_return<0", "cost"),
    Gate("predictive", "pbo", "<=", 0.5, "pbo>0.5", "robustness"),
    Gate("predictive", "coverage", ">=", 0.98, "coverage<0.98", "robustness", missing_fails=True),
    Gate("backtest", "net_return", ">=", 0, "net_return<0", "cost", missing_fails=True),
    Gate("backtest", "cost_total", ">", 0, "cost_total<=0", "cost", missing_fails=True),
    Gate("backtest", "turnover", "<=", 2, "turnover>2", "cost"),
    Gate("negative_controls", "max_abs_control_ic", "<=", 0.1, "negative_control>0.1", "false_discovery", missing_fails=True),
    Gate("negative_controls", "future_news_leak_ic", "<=", 0.1, "future_news_leak_sentinel_ic>0.1", "leakage"),
    Gate("negative_controls", "max_single_feature_score_drop", "<=", 0.75, "single_feature_dependence>0.75", "fragility"),
    Gate("negative_controls", "min_feature_ablation_score_ratio", ">=", 0.25, "feature_ablation_ratio<0.25", "fragility"),
    Gate("paper_evidence", "net_return", ">=", 0, "paper_net_return<0.0", "cost", "failing", missing_fails=True),
    Gate("paper_evidence", "excess_return", ">=", -1, "paper_excess_return<-1.0", "predictive", "failing"),
    Gate("paper_evidence", "drawdown", "<=", 0.05, "paper_drawdown>0.05", "robustness", "failing"),
    Gate("paper_evidence", "turnover", "<=", 2, "paper_turnover>2.0", "cost", "failing"),
    Gate("paper_evidence", "backtest_gap", "<=", 0.05, "paper_vs_backtest_gap>0.05", "robustness", "failing"),
)
PASSED = {"event_study": "CONTINUE", "rework_variant": "CONTINUE_DIAGNOSTIC", "predictive": "PROMOTE", "backtest": "SHORTLIST", "negative_controls": "CLEAN", "paper_evidence": "positive"}


def rule_table(spark: SparkSession, gates: tuple[Gate, ...] = GATES, passed: dict[str, str] | None = None) -> DataFrame:
    """One row a gate: its fields, and passed, its family's decision without failures."""
    kinds = {"str": "string", "float": "double", "int": "int", "bool": "boolean"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(Gate)) + ", passed string"
    names = passed or PASSED
    return spark.createDataFrame([(*(float(v) if f.name == "bound" else v for f, v in zip(fields(Gate), astuple(g), strict=True)), names.get(g.family, "PASS")) for g in gates], schema)


def long_metrics(df: DataFrame, keys: list[str], family: str, metrics: list[str]) -> DataFrame:
    """keys, family, metric, value: a row for each metric of each row."""
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return df.select(*keys, F.lit(family).alias("family"), F.explode(values).alias("m")).select(*keys, "family", "m.*")


def evaluate(metrics: DataFrame, keys: list[str], rules: DataFrame) -> DataFrame:
    """AGG-41: keys, family, failures (sorted), by_objective, decision, status of each subject in metrics (keys, family, metric, value).

    A metric that is missing or null fails a gate only if the gate says so. Metrics without gates don't matter, subjects of a
    family without gates drop out. All families go through one join with the rules, however many there are.
    """
    subjects = metrics.select(*keys, "family").distinct()
    values = metrics.groupBy(*keys, "family", "metric").agg(F.max("value").alias("value"))
    asked = subjects.join(F.broadcast(rules), "family").join(values, [*keys, "family", "metric"], "left")  # a row a rule
    v, b = F.col("value"), F.col("bound")
    holds = F.when(F.col("must") == ">", v > b).when(F.col("must") == ">=", v >= b).when(F.col("must") == "<", v < b).when(F.col("must") == "<=", v <= b)
    failed = F.when(v.isNull() | F.isnan(v), F.col("missing_fails")).otherwise(~holds)
    only = lambda c: F.when(failed, c)
    g = asked.groupBy(*keys, "family").agg(
        F.array_sort(F.collect_set(only(F.col("failure")))).alias("failures"), F.array_sort(F.collect_set(only(F.struct("objective", "failure")))).alias("_pairs"),
        F.min_by(only(F.col("decision")), only(F.struct("priority", "decision"))).alias("_decision"), F.first("passed").alias("_passed"),
    )
    objectives = F.array_distinct(F.transform("_pairs", lambda p: p["objective"]))
    by = F.map_from_arrays(objectives, F.transform(objectives, lambda o: F.transform(F.filter("_pairs", lambda p: p["objective"] == o), lambda p: p["failure"])))
    clean = F.size("failures") == 0
    return g.select(*keys, "family", "failures", by.alias("by_objective"), F.when(clean, F.col("_passed")).otherwise(F.col("_decision")).alias("decision"), F.when(clean, "PASS").otherwise("NOT_PROMOTABLE").alias("status"))


def failure_counts(verdicts: DataFrame) -> DataFrame:
    """AGG-42: number of subjects by family, objective and failure."""
    x = verdicts.select("family", F.explode("by_objective").alias("objective", "f")).select("family", "objective", F.explode("f").alias("failure"))
    return x.groupBy("family", "objective", "failure").agg(F.count("*").alias("n"))


def adjusted_scores(runs: DataFrame, lanes: DataFrame, penalty: float, lane: str = "lane", score: str = "score") -> DataFrame:
    """AGG-42: runs with complexity_tier and promotable of their lane (lane, complexity_tier, promotable), and the score less the penalty for each tier. An unknown lane counts as tier 0 and isn't promotable."""
    x = runs.join(lanes.withColumnRenamed("lane", lane), lane, "left").withColumns({"complexity_tier": F.coalesce("complexity_tier", F.lit(0)), "promotable": F.coalesce("promotable", F.lit(False))})
    return x.withColumn("adjusted_score", F.col(score) - F.col("complexity_tier") * penalty)


def autopsies(runs: DataFrame, verdicts: DataFrame, periods: DataFrame, run: str, strong: float = 0.05, max_pbo: float = 0.5, worst: int = 5) -> DataFrame:
    """AGG-42: run, classification, worst periods of each run (run, score, cost_net, pbo, cpcv_mean).

    verdicts: run and failures; periods: run, kind (year, quarter, fold), period, rank_ic. A run that fails is infra_invalid
    if something is missing, weak_rejected if its score is low, else strong_ and its first trouble: costs, robustness,
    unstable periods, overfitting. worst lists the lowest periods, lowest first.
    """
    rank = F.row_number().over(Window.partitionBy(run).orderBy("rank_ic", "kind", "period"))
    p = periods.withColumn("_r", rank).groupBy(run).agg(
        F.count_if(F.col("kind") == "year").alias("_years"), F.coalesce(F.bool_and(F.when(F.col("rank_ic").isNotNull(), F.col("rank_ic") > 0)), F.lit(True)).alias("_positive"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= worst, F.struct("_r", "kind", "period", "rank_ic")))), lambda x: F.struct(x["kind"].alias("kind"), x["period"].alias("period"), x["rank_ic"].alias("rank_ic"))).alias("worst"),
    )
    x = runs.join(verdicts.groupBy(run).agg(F.array_distinct(F.flatten(F.collect_list("failures"))).alias("failures")), run, "left").join(p, run, "left")
    none = F.array().cast("array<string>")
    failures = F.coalesce("failures", none)
    names = lambda *parts: F.exists(failures, lambda f: F.lower(f).rlike("|".join(parts)))
    any_ = F.size(failures) > 0
    costly = (F.coalesce("cost_net", F.lit(0.0)) < 0) | names("cost", "net_return")
    kind = (
        F.when(F.exists(failures, lambda f: F.lower(f).rlike("infra|missing") & (f != "negative_controls.missing")), "infra_invalid").when(~any_, "promotable").when(F.col("score") < strong, "weak_rejected")
        .when(costly, "strong_cost_failed").when(names("negative_control", "future_news", "single_feature", "feature_ablation", "placebo"), "strong_robustness_failed")
        .when((F.coalesce("_years", F.lit(0)) == 0) | ~F.coalesce("_positive", F.lit(True)), "strong_unstable").when((F.col("pbo") > max_pbo) | (F.col("cpcv_mean") < 0), "strong_overfit_risk").otherwise("weak_rejected")
    )
    return x.select(run, kind.alias("classification"), failures.alias("failures"), F.coalesce("worst", F.array().cast("array<struct<kind: string, period: string, rank_ic: double>>")).alias("worst"))
