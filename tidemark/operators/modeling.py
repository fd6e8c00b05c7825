"""Modeling tables, signals and boosted trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import reasons
from ..sources.folders import written
from . import asof, panel


def modeling_table(bars: DataFrame, calendar: DataFrame, horizon: int = 5, report_date: str | None = None, version: str = "v1") -> DataFrame:
    """MOD-06, JOIN-02: features ranked by date, joined to labels; labels beyond the report date are null. A row of the bars for each (date, symbol).

    bars: a table bucketed by symbol (else rows move more often): forward returns go along with the features of a symbol, and
    ranks and labels come from one group of a date, so that wide rows move once.
    """
    raw, label = f"raw_forward_return_{horizon}d", f"label_{horizon}d"
    ahead = panel.forward_returns(bars, calendar, horizon, ("open", "close", "volume"))
    x = panel.build_features(ahead, keep=("target_date", raw), placed=True)
    x = panel.ranks_with_labels(x, panel.FEATURES, raw, label)
    x = panel.mature(x, label, report_date) if report_date else x
    return x.withColumn("feature_version", F.lit(version))


def fundamental_features(dates: DataFrame, facts: DataFrame) -> DataFrame:
    """MOD-05: per (date, symbol) number, mean and age in days of the latest value of each metric (symbol, metric_name, metric_value, metric_date, available_at).

    One as-of join by (symbol, metric); metrics with nothing available yet don't count, and neither do dates without any.
    """
    metrics = facts.select("symbol", "metric_name").distinct()
    q = dates.join(metrics, "symbol").withColumn("at", F.col("date"))
    hit = asof.backward(q, facts, ["symbol", "metric_name"], "at", "available_at", ["metric_value", "metric_date"], ["metric_date", "metric_value"]).where("available_at_hit IS NOT NULL")
    return hit.groupBy("date", "symbol").agg(F.count("*").alias("metric_count"), F.avg("metric_value").alias("metric_mean"), F.min(F.datediff("date", "available_at_hit")).alias("metric_age"))


def news_features(grid: DataFrame, news: DataFrame, at: str = "published_at", source: str = "source", vendor: str = "vendor", headline: str = "headline") -> DataFrame:
    """MOD-04: per (date, symbol) with earlier news: items of 1 and 7 days, different sources and vendors of 7 days, volume against that of the 30 days before (at least 1), share of different headlines, days since the last item."""
    windows = {"news_1d": (1, 0), "news_7d": (7, 0), "_news_37d": (37, 0)}
    x = asof.range_counts(grid, news, "symbol", at, windows, {"sources_7d": (source, 7), "vendors_7d": (vendor, 7), "_headlines_7d": (headline, 7)})
    base = F.greatest((F.col("_news_37d") - F.col("news_7d")) / 30 * 7, F.lit(1.0))
    novelty = F.when(F.col("news_7d") > 0, F.col("_headlines_7d") / F.col("news_7d")).otherwise(0.0)
    return x.select("date", "symbol", "news_1d", "news_7d", "sources_7d", "vendors_7d", (F.col("news_7d") / base).alias("abnormal_volume"), novelty.alias("novelty"), "days_since_last")


def boosted_trees(train: DataFrame, features: list[str], label: str, weight: str | None = None, rounds: int = 100, depth: int = 5, step: float = 0.05, least: int = 1, seed: int = 7):
    """MOD-10: Spark ML's gradient-boosted trees on clean features, with time-decay weights if given.

    The defaults are the study's: 100 rounds, 31 leaves (depth 5), learning rate (step) 0.05. least: rows of a leaf. Every tree takes all rows and features.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    x = panel.clean_matrix(train.where(F.col(label).isNotNull()), features)
    trees = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="prediction", maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=least, seed=seed, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), trees]).fit(x)


def predictions(model, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(panel.clean_matrix(df, features)).drop("_features")


def grid_trees(df: DataFrame, folds: DataFrame, features: list[str], label: str, grid: list[dict], weight: str | None = None, at_once: int = 4) -> dict[int, DataFrame]:
    """MOD-10: for each entry of the grid (rounds, depth, step, least), by its number, the test rows of all folds, without features, with the prediction of trees fitted anew up to each fold's train_end.

    df: a written table, as every fit reads it. Fits don't wait for one another: a pool of at_once threads hands (fold, setting)
    to Spark. Folds and settings are few rows.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    rest = [c for c in df.columns if c not in features]
    jobs = [(k, f) for k in range(len(grid)) for f in folds.orderBy("fold").collect()]

    def fit(job):
        k, f = job
        model = boosted_trees(df.where(F.col("date") <= f["train_end"]), features, label, weight, **grid[k])
        return k, predictions(model, df.where(F.col("date").between(f["test_start"], f["test_end"])), features).select(*rest, "prediction")

    out = {k: df.where("false").select(*rest).withColumn("prediction", F.lit(None).cast("double")) for k in range(len(grid))}
    with ThreadPoolExecutor(at_once) as pool:
        for k, made in pool.map(inheritable_thread_target(df.sparkSession)(fit), jobs):
            out[k] = out[k].unionByName(made)
    return out


def walk_forward_trees(df: DataFrame, folds: DataFrame, features: list[str], label: str, weight: str | None = None, rounds: int = 100, depth: int = 5, step: float = 0.05, least: int = 1) -> DataFrame:
    """MOD-10: grid_trees() with one setting."""
    return grid_trees(df, folds, features, label, [{"rounds": rounds, "depth": depth, "step": step, "least": least}], weight)[0]


def tuned_trees(df: DataFrame, folds: DataFrame, features: list[str], label: str, grid: list[dict], weight: str | None = None, at_once: int = 4) -> tuple[DataFrame, DataFrame]:
    """MOD-10: scores (setting, fold, rank_ic, n) of each entry of the grid, and the predictions of the best.

    The best has the largest mean rank IC over folds, ties to the earlier entry. A grid is a few entries.
    """
    from .validation import test_rows

    folds = written(folds, "folds")
    made = grid_trees(df, folds, features, label, grid, weight, at_once)
    every = None
    for k, x in made.items():
        one = x.withColumn("setting", F.lit(k))
        every = one if every is None else every.unionByName(one)
    every = written(every, "tree_predictions")  # scored and returned
    scores = panel.pooled_rank_ic(test_rows(every, folds), "prediction", label, ("setting", "fold"))
    best = scores.groupBy("setting").agg(F.round(F.avg("rank_ic"), 9).alias("m")).orderBy(F.desc("m"), "setting").first()  # a row an entry
    return scores, every.where(F.col("setting") == (best["setting"] if best else 0)).drop("setting")


def preflight(table: DataFrame, features: list[str], label: str, least_rows: int = 1) -> DataFrame:
    """MOD-06: whether a modeling table can be trained on: its rows, labelled rows, missing columns, share of nulls, blockers. One row."""
    missing = [c for c in [*features, label, "date", "symbol"] if c not in table.columns]
    there = [F.col(c) for c in features if c in table.columns]
    labelled = F.count(label) if label in table.columns else F.lit(0)
    nulls = F.avg(sum((c.isNull().cast("double") for c in there), F.lit(0.0)) / max(1, len(there)))
    x = table.agg(F.count("*").alias("rows"), labelled.cast("bigint").alias("labelled"), F.coalesce(nulls, F.lit(1.0)).alias("null_share")).withColumn("missing", F.lit(",".join(sorted(missing))))
    blockers = reasons([("missing_columns", F.col("missing") != ""), ("too_few_labelled_rows", F.col("labelled") < least_rows), ("all_features_null", F.col("null_share") >= 1)])
    return x.withColumn("blockers", blockers).withColumn("ready", F.size("blockers") == 0)


def eligible_date(dates: DataFrame, weekday: int = 4) -> DataFrame:
    """SRT-05: the latest date on that weekday (Monday 0), else the latest of all. One row."""
    return dates.agg(F.coalesce(F.max(F.when(F.weekday("date") == weekday, F.col("date"))), F.max("date")).alias("date"))


def signals(scores: DataFrame, weekday: int = 4) -> DataFrame:
    """PF-07: the scores of the latest eligible date by rank."""
    x = scores.join(F.broadcast(eligible_date(scores, weekday)), "date", "left_semi")  # one row
    return x.select("date", "symbol", "score", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "symbol")).alias("rank"))


def cost_stress(daily: DataFrame, traded: DataFrame, multipliers: dict[str, float]) -> DataFrame:
    """AGG-36: gross return less costs times each multiplier. A row a setting."""
    gross = daily.agg((F.exp(F.sum(F.log1p("portfolio_return"))) - 1).alias("gross"))
    cost = traded.agg(F.sum("cost").alias("cost"))
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("setting"), F.lit(float(m)).alias("m")) for n, m in multipliers.items()))).alias("k")
    return gross.crossJoin(cost).select("gross", "cost", kinds).select("k.setting", (F.col("gross") - F.col("cost") * F.col("k.m")).alias("net_return"))


def benchmark(bars: DataFrame, wanted: DataFrame) -> DataFrame:
    """PRJ-23: the first wanted symbol (symbol, ord) that has bars. One row."""
    return wanted.join(bars.select("symbol").distinct(), "symbol", "left_semi").agg(F.min_by("symbol", "ord").alias("symbol"))


def relabeled(df: DataFrame, promotable: tuple[str, ...], routine: str = "ROUTINE_NO_EVENT", review: str = "NEEDS_REVIEW") -> DataFrame:
    """PRJ-21: a promotable event type that isn't marked material becomes routine if it is marked immaterial, else it needs review; warning tells from what. Other types stay."""
    wrong = F.col("event_type").isin(*promotable) & (F.coalesce("is_material_candidate", F.lit("")) != "yes")
    new = F.when(F.col("is_material_candidate") == "no", routine).otherwise(review)
    said = F.concat(F.lit("normalized_promotable_not_material:"), "event_type", F.lit("->"), new, F.lit(":material="), F.coalesce("is_material_candidate", F.lit("None")))
    return df.withColumns({"warning": F.when(wrong, said), "event_type": F.when(wrong, new).otherwise(F.col("event_type"))})


def promotable(classified: DataFrame, context: DataFrame, key: str, event: list[str]) -> DataFrame:
    """EVT-07, JOIN-23: promotable classifications with their context, one for each event: the surest, then the smallest key."""
    x = classified.where("event_type <> 'none'").join(context, key, "left")
    best = F.row_number().over(Window.partitionBy(*event).orderBy(F.desc("certainty"), key))
    every = F.array_sort(F.collect_set(key).over(Window.partitionBy(*event)))
    return x.withColumns({"_r": best, "keys": every}).where("_r = 1").drop("_r")


def promotable_counts(classified: DataFrame, pending: DataFrame, key: str, target: int) -> DataFrame:
    """AGG-49: promotable now, at most if all pending were, and whether the target is out of reach. One row."""
    a = classified.agg(F.count_if(F.col("event_type") != "none").alias("promotable"))
    b = pending.agg(F.count_distinct(key).alias("pending"))
    return a.crossJoin(b).select("promotable", (F.col("promotable") + F.col("pending")).alias("upper_bound"), ((F.col("promotable") + F.col("pending")) < target).alias("stop"))


def labelability(labels: DataFrame) -> DataFrame:
    """AGG-14: labels' blockers with the status that follows."""
    blockers = reasons([("no_entry", F.col("entry_date").isNull()), ("no_exit", F.col("entry_date").isNotNull() & F.col("ret_5d_net").isNull())])
    return labels.select("event_id", blockers.alias("blockers")).withColumn("status", F.when(F.size("blockers") == 0, "LABELABLE").otherwise("BLOCKED"))


def readiness(rows: DataFrame, needed: dict[str, int]) -> DataFrame:
    """AGG-44: blockers of a corpus from its datasets' row counts (dataset, rows). One row."""
    have = [F.coalesce(F.max(F.when(F.col("dataset") == n, F.col("rows"))), F.lit(0)).alias(n) for n in needed]
    x = rows.agg(*have)
    return x.select(reasons([(f"{n}<{k}", F.col(n) < k) for n, k in needed.items()]).alias("blockers")).withColumn("ready", F.size("blockers") == 0)


def market_coverage(wanted: DataFrame, bars: DataFrame) -> DataFrame:
    """AGG-45: per symbol requested and loaded dates, and a verdict."""
    x = wanted.join(bars.select("symbol", "date", F.lit(True).alias("got")), ["symbol", "date"], "left")
    g = x.groupBy("symbol").agg(F.count("*").alias("requested"), F.count("got").alias("loaded"))
    return g.withColumn("verdict", F.when(F.col("loaded") == F.col("requested"), "COMPLETE").when(F.col("loaded") > 0, "PARTIAL").otherwise("MISSING"))


def vintages(facts: DataFrame) -> DataFrame:
    """SRC-18: the distinct (series, vintage) pairs of a series-partitioned table, with the number of observations."""
    return facts.groupBy("series", "vintage").agg(F.count("*").alias("n"))
