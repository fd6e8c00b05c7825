"""Roll-ups of attempt, run and experiment ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import gates


def _recent(ledger: DataFrame, since, at: str) -> DataFrame:
    return ledger.where(F.col(at) >= F.lit(since).cast("timestamp_ntz"))


def scheduler_decisions(ledger: DataFrame, since, at: str = "created_at") -> DataFrame:
    """AGG-20: decisions since a time by vendor, dataset (null: empty) and decision: number, latest time, largest reason."""
    by = ["vendor", F.coalesce("dataset", F.lit("")).alias("dataset"), "decision"]
    return _recent(ledger, since, at).groupBy(*by).agg(F.count("*").alias("count"), F.max(at).alias("latest_at"), F.max("reason").alias("latest_reason"))


def controller_decisions(ledger: DataFrame, since, at: str = "created_at") -> DataFrame:
    """AGG-20: a controller's decisions since a time by vendor, dataset and action: largest widths, tasks, budgets and latency, mean rows per credit."""
    largest = ("target_width", "active_width", "eligible_tasks", "budget_remaining_minute", "budget_remaining_daily", "latency_ms")
    return _recent(ledger, since, at).groupBy("vendor", "dataset", "action").agg(
        F.count("*").alias("count"), *(F.max(c).alias(c) for c in largest), F.avg("rows_per_credit").alias("rows_per_credit"), F.max("reason").alias("latest_reason"), F.max(at).alias("latest_at")
    )


def archive_writes(ledger: DataFrame, since, at: str = "created_at") -> DataFrame:
    """AGG-21: writes since a time by output: successes, failures, rows, duplicates, schema mismatches, mean and largest duration."""
    done = F.col("status") == "success"
    return _recent(ledger, since, at).groupBy("output_name").agg(
        F.count("*").alias("writes"), F.count_if(done).alias("successes"), F.count_if(~done).alias("failures"), F.sum("rows_in").alias("rows_in"), F.sum("rows_written").alias("rows_written"),
        F.sum("duplicates_dropped").alias("duplicates_dropped"), F.sum("schema_mismatch").alias("schema_mismatches"), F.avg("duration_ms").alias("avg_duration_ms"), F.max("duration_ms").alias("max_duration_ms"),
        F.max(at).alias("latest_at"), F.max("error").alias("latest_error"),
    )


def ingestion_events(ledger: DataFrame, since, at: str = "created_at") -> DataFrame:
    """AGG-22: ingestion events since a time by vendor (null: empty), dataset, output and status: rows at each step, latest partition, hash, error and time."""
    by = [F.coalesce("vendor", F.lit("")).alias("vendor"), "dataset", "output_name", "status"]
    return _recent(ledger, since, at).groupBy(*by).agg(
        F.count("*").alias("events"), *(F.sum(c).alias(c) for c in ("rows_in", "rows_normalized", "rows_written", "duplicates_dropped")),
        F.max("partition_date").alias("latest_partition_date"), F.max("payload_hash").alias("latest_payload_hash"), F.max("error").alias("latest_error"), F.max(at).alias("latest_at"),
    )


def quality_checks(ledger: DataFrame, since, at: str = "created_at") -> DataFrame:
    """AGG-23: data quality checks since a time by dataset, verdict and status: rows and partitions checked, violations of each kind."""
    summed = ("rows_checked", "partitions_checked", "duplicate_key_count", "timestamp_violation_count", "pit_violation_count")
    return _recent(ledger, since, at).groupBy("dataset", "verdict", "status").agg(F.count("*").alias("checks"), *(F.sum(c).alias(c) for c in summed), F.max("reason").alias("latest_reason"), F.max(at).alias("latest_at"))


def attempts(events: DataFrame, vendor: str, status: str, failed: str) -> DataFrame:
    """AGG-24: per vendor attempts, failures and their share."""
    return events.groupBy(vendor).agg(F.count("*").alias("attempts"), F.count_if(F.col(status) == failed).alias("failures"), F.avg((F.col(status) == failed).cast("double")).alias("failure_rate"))


def latest_failures(events: DataFrame, status: str, failed: str, at: str, tie: str, n: int = 20) -> DataFrame:
    """AGG-24, SRT-02: the n latest failures."""
    return events.where(F.col(status) == failed).orderBy(F.desc(at), F.desc(tie)).limit(n)


def throughput(attempts_: DataFrame, tasks: DataFrame, key: str, lane: str, minutes: float) -> DataFrame:
    """AGG-25, JOIN-21: rows per minute by lane of the tasks, from a left join of attempts to tasks."""
    x = attempts_.join(tasks, key, "left").withColumn(lane, F.coalesce(lane, F.lit("unassigned")))
    return x.groupBy(lane).agg(F.count("*").alias("attempts"), (F.sum("rows") / minutes).alias("rows_per_minute"))


def backlog(events: DataFrame, payload: str, path: str) -> DataFrame:
    """AGG-26: tasks by class read from a JSON payload: below 25 urgent, below 75 normal, else deferred."""
    k = F.get_json_object(payload, path).try_cast("int")
    kind = F.when(k < 25, "urgent").when(k < 75, "normal").when(k.isNotNull(), "deferred").otherwise("unknown")
    return events.groupBy(kind.alias("backlog_class")).agg(F.count("*").alias("n"), F.avg(k).alias("mean_k"))


def experiments(runs: DataFrame, group: str, score: str, run: str, order: Column | None = None) -> DataFrame:
    """AGG-38, AGG-39: per group runs, the best run, the best score, and its lead over the mean.

    The best run has the largest `order`, ties to the larger run; by default order is the score.
    """
    return runs.groupBy(group).agg(F.count("*").alias("n_runs"), F.max_by(run, F.struct(F.col(score) if order is None else order, F.col(run))).alias("best_run"), F.max(score).alias("best_score"), (F.max(score) - F.avg(score)).alias("lead"))


def leaderboard(runs: DataFrame, score: str, tie: str, n: int = 20) -> DataFrame:
    """AGG-40: the n best, nulls last, with their rank. A top-k report."""
    top = runs.orderBy(F.col(score).desc_nulls_last(), tie).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), tie)))  # n rows


def objective_verdicts(runs: DataFrame) -> DataFrame:
    """AGG-42: per run (run, ic, n, turnover) failed gates, a score less a charge for complexity, and a verdict."""
    failed = gates([("rank_ic<=0.02", F.col("ic") > 0.02), ("n<100", F.col("n") >= 100), ("turnover>1", F.col("turnover") <= 1)])
    return runs.select("*", failed.alias("failures"), (F.col("ic") - 0.001 * F.col("turnover")).alias("adjusted"), F.when(F.size(failed) == 0, "PROMOTE").when(F.size(failed) == 1, "NEAR_MISS").otherwise("REJECT").alias("verdict"))


def failure_groups(verdicts: DataFrame) -> DataFrame:
    """AGG-39: failed gates by number of runs."""
    return verdicts.select(F.explode("failures").alias("failure")).groupBy("failure").agg(F.count("*").alias("n"))


def utilisation(events: DataFrame, vendor: str, dataset: str, states: list[str]) -> DataFrame:
    """AGG-46: per vendor the number of rows of each state, in columns, and the first state's share."""
    x = events.groupBy(vendor).pivot(dataset, states).agg(F.count(F.lit(1)))
    x = x.select(vendor, *(F.coalesce(s, F.lit(0)).alias(s) for s in states))
    return x.withColumn("share", F.try_divide(F.col(states[0]).cast("double"), sum((F.col(s) for s in states[1:]), F.col(states[0])).cast("double")))


def trailing_counts(events: DataFrame, at: str, now, windows: dict[str, int]) -> DataFrame:
    """AGG-47: number of rows in each trailing window of minutes before now. One row."""
    end = F.lit(now).cast("timestamp_ntz")
    return events.agg(*(F.count_if((F.col(at) > end - F.expr(f"INTERVAL {m} MINUTES")) & (F.col(at) <= end)).alias(n) for n, m in windows.items()))


def eta(expected: DataFrame, done: DataFrame, key: str, at: str, now, minutes: int) -> DataFrame:
    """AGG-50: remaining units, units a minute in the trailing window, minutes to go. One row."""
    total = expected.agg(F.count_distinct(key).alias("expected"))
    recent = F.count_distinct(F.when(F.col(at) > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES"), F.col(key)))
    x = total.crossJoin(done.agg(F.count_distinct(key).alias("completed"), (recent / minutes).alias("per_minute")))
    return x.withColumn("remaining", F.col("expected") - F.col("completed")).withColumn("eta_minutes", F.try_divide(F.col("remaining").cast("double"), F.col("per_minute")))


def degradation(metrics: DataFrame, by: str, order: str, value: str, least: float, k: int) -> DataFrame:
    """WIN-27: whether a group's last k values all lie below a bound."""
    x = metrics.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_r") <= k)
    return x.groupBy(by).agg(F.count("*").alias("n"), ((F.count("*") == k) & F.bool_and(F.col(value) < least)).alias("degraded"))
