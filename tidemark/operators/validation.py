"""Folds, out-of-sample tests, models from sums, portfolios and costs."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log_ratio, normal_cdf, unit_hash, with_mean_ranks
from ..sources.folders import written
from . import panel
from .moments import co_moments, merged, predicted, prefixes, ridge


def walk_forward_folds(dates: DataFrame, initial: int, step: int, purge: int = 5) -> DataFrame:
    """JOIN-18, MOD-07: fold, train_end, test_start, test_end of expanding folds over observed dates.

    Training takes the first initial + fold * step dates less the last `purge`, testing the next step dates. One row a fold.
    """
    d = written(dates.select("date").distinct(), "days").withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # one row a day, read four times
    n = d.agg((F.max("i") + 1).alias("n"))
    folds = n.select(F.explode(F.expr(f"CASE WHEN n > {initial} THEN sequence(0, (n - {initial} - 1) div {step}) ELSE array() END")).alias("fold"), "n").select(
        F.col("fold").cast("int").alias("fold"), (initial + F.col("fold") * step - purge - 1).alias("a"), (initial + F.col("fold") * step).alias("b"), F.least(initial + (F.col("fold") + 1) * step - 1, F.col("n") - 1).alias("c")
    )
    day = lambda at, out: d.select(F.col("i").alias(at), F.col("date").alias(out))
    return folds.join(day("a", "train_end"), "a").join(day("b", "test_start"), "b").join(day("c", "test_end"), "c").select("fold", "train_end", "test_start", "test_end")


def assign_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """JOIN-18: each row once for each fold that it trains or tests, with its part. Folds meet dates first, a row a day and fold; rows then join by date."""
    df = written(df, "rows")  # read for its dates too
    days = df.select("date").distinct()
    part = F.when(F.col("date") <= F.col("train_end"), "train").when(F.col("date").between(F.col("test_start"), F.col("test_end")), "test")
    near = days.join(folds, (F.col("date") <= F.col("train_end")) | F.col("date").between(F.col("test_start"), F.col("test_end"))).select("date", "fold", part.alias("part"))
    return df.join(near, "date")


def fold_sizes(df: DataFrame, folds: DataFrame) -> DataFrame:
    """JOIN-18: fold, part, n: how many rows each fold trains on and tests. Rows are counted by date before folds multiply anything."""
    daily = df.groupBy("date").agg(F.count("*").alias("_n"))
    return assign_folds(daily, folds).groupBy("fold", "part").agg(F.sum("_n").alias("n"))


def test_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """The rows that a fold tests, each with its fold; test windows don't overlap."""
    days = df.select("date").distinct().join(folds, F.col("date").between(F.col("test_start"), F.col("test_end"))).select("date", "fold")
    return df.join(F.broadcast(days), "date")  # a row a day


def with_blocks(df: DataFrame, n_blocks: int, embargo: int) -> DataFrame:
    """df with block (of n_blocks contiguous date blocks) and near, the sorted blocks that a row is in or within embargo calendar days of, if the row's symbol is in them."""
    every = Window.partitionBy(F.lit(0))  # a row a day
    block = Window.partitionBy("block")
    days = panel.date_blocks(df, n_blocks).withColumn("_span", F.struct("block", F.date_sub(F.min("date").over(block), embargo).alias("lo"), F.date_add(F.max("date").over(block), embargo).alias("hi")))
    days = days.withColumn("_near", F.filter(F.collect_set("_span").over(every), lambda b: F.col("date").between(b["lo"], b["hi"]))).select("date", "block", F.col("_near.block").alias("_near"))
    own = F.collect_set("block").over(Window.partitionBy("symbol"))
    return df.join(days, "date").withColumn("near", F.array_sort(F.array_intersect("_near", own))).drop("_near")


def _paths(n_blocks: int, n_test: int) -> F.Column:
    return F.array(*(F.struct(F.lit(i).alias("path"), F.array(*(F.lit(b) for b in c)).alias("blocks")) for i, c in enumerate(combinations(range(n_blocks), n_test))))


def purged_paths(df: DataFrame, n_blocks: int = 8, n_test: int = 2, embargo: int = 10) -> DataFrame:
    """MOD-08: per path of n_test of n_blocks date blocks its training and test rows: path, n_train, n_test.

    Rows of a test block's symbols within embargo calendar days of the block are purged from training.
    """
    x = with_blocks(df.select("date", "symbol"), n_blocks, embargo)
    counted = x.groupBy("block", "near").agg(F.count("*").alias("n")).select("*", F.explode(_paths(n_blocks, n_test)).alias("p"))  # few groups, before paths multiply them
    tests, trains = F.array_contains("p.blocks", F.col("block")), ~F.arrays_overlap("near", "p.blocks")
    return counted.groupBy(F.col("p.path").alias("path")).agg(F.sum(F.when(trains, F.col("n")).otherwise(0)).alias("n_train"), F.sum(F.when(tests, F.col("n")).otherwise(0)).alias("n_test"))


def purged_path_ridge(df: DataFrame, features: list[str], label: str, alpha: float = 1.0, n_blocks: int = 8, n_test: int = 2, embargo: int = 10) -> DataFrame:
    """MOD-08: ridge regression fitted and tested on each purged path: path, n_train, n_test, retention, rank_ic of its test rows.

    The co-moments of a path are those of the groups of (block, near blocks) that it trains on, merged: rows are read once
    for all fits, and once for the tests.
    """
    x = with_blocks(panel.clean_matrix(df, features).where(F.col(label).isNotNull()).select("date", "symbol", label, *features), n_blocks, embargo)
    x = written(x, "blocks")  # read for the co-moments and for the tests
    sets = written(co_moments(x, features, [label], ["block", "near"]), "co_moments")
    total = sets.agg(F.sum("n").alias("_total"))
    trained = sets.select("*", F.explode(_paths(n_blocks, n_test)).alias("p")).where(~F.arrays_overlap("near", "p.blocks")).withColumn("path", F.col("p.path"))
    models = ridge(merged(trained, ["path"], len(features), 1), len(features), [label], [alpha], ["path"])  # a row a path
    tested = F.explode(_paths(n_blocks, n_test)).alias("p")
    use = models.select("path", "coefficients", "intercept", "n").join(models.sparkSession.range(1).select(tested).select("p.path", F.explode("p.blocks").alias("block")), "path")
    y = x.select("block", label, *features).join(F.broadcast(use), "block").withColumn("prediction", predicted(features))  # n_test rows a path
    ic = panel.pooled_rank_ic(y, "prediction", label, ("path",))
    return ic.join(models.crossJoin(total).select("path", F.col("n").alias("n_train"), (F.col("n") / F.col("_total")).alias("retention")), "path").select("path", "n_train", F.col("n").alias("n_test"), "retention", "rank_ic")


def gram_sums(df: DataFrame, features: list[str], label: str, by: list[str]) -> DataFrame:
    """MOD-09: per group n, sums of x and y, of products x x and x y, for a report. Models use co_moments(), which keeps its digits at large means."""
    x = df.where(F.col(label).isNotNull()).na.drop(subset=features)
    f = [F.col(c) for c in features]
    pairs = [(i, j) for i in range(len(f)) for j in range(i, len(f))]
    y = F.col(label)
    return x.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(y).alias("sy"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(f)), *(F.sum(f[i] * f[j]).alias(f"s{i}_{j}") for i, j in pairs), *(F.sum(c * y).alias(f"sy{i}") for i, c in enumerate(f)),
    )


def _walk_forward_models(clean: DataFrame, folds: DataFrame, features: list[str], labels: list[str], alphas: list[float]) -> DataFrame:
    """fold, n, alpha, label, coefficients, intercept: a row for each fold, penalty and label. Products of features are shared by all labels."""
    p, q = len(features), len(labels)
    upto = prefixes(co_moments(clean, features, labels, ["date"]), "date", p, q)
    return ridge(upto.join(folds.select(F.col("train_end").alias("date"), "fold"), "date"), p, labels, alphas, ["fold"])


def walk_forward_ridge(df: DataFrame, folds: DataFrame, features: list[str], label: str, alphas: list[float]) -> tuple[DataFrame, DataFrame]:
    """MOD-07, MOD-09: ridge regression fitted for each fold and penalty, tested on the fold's test dates.

    Returns scores (alpha, fold, rank_ic, n) and the test rows with the prediction of the penalty of the best mean rank IC
    over folds (rounded to 9 digits, ties to the smaller one). Training sets are prefixes of the dates, so the co-moments of
    all folds come from one pass and one merge along the dates; the purge moves the prefix's end. df: a written table, read for
    the co-moments and for the tests. Features aren't moved or written again: of a test row only its label and its prediction
    by each penalty are.
    """
    clean = panel.clean_matrix(df, features).where(F.col(label).isNotNull())
    folds = written(folds, "folds")
    models = written(_walk_forward_models(clean, folds, features, [label], alphas), "models").select("fold", "alpha", "coefficients", "intercept")
    rows = test_rows(clean, folds)
    tested = rows.join(F.broadcast(models), "fold").withColumn("prediction", predicted(features)).drop("coefficients", "intercept")
    of_fold = models.groupBy("fold").agg(F.collect_list(F.struct("alpha", "coefficients", "intercept")).alias("_models"))  # a row a fold
    made = F.transform("_models", lambda m: F.struct(m["alpha"].alias("alpha"), predicted(features, m).alias("_p")))
    pairs = written(rows.join(F.broadcast(of_fold), "fold").select("fold", F.col(label).cast("double").alias("_l"), made.alias("_made")), "pairs")
    ranked = written(with_mean_ranks(pairs, {"_l": "_rank_l"}, ("fold",)).select("fold", "_rank_l", "_made"), "ranked")  # once for all penalties
    each = ranked.select("fold", "_rank_l", F.explode("_made").alias("_m")).select("_m.alpha", "fold", "_m._p", "_rank_l")
    scores = panel.correlated_ranks(with_mean_ranks(each, {"_p": "_rank_p"}, ("alpha", "fold")), "_rank_p", "_rank_l", ("alpha", "fold"))
    best = scores.groupBy("alpha").agg(F.round(F.avg("rank_ic"), 9).alias("mean_ic")).orderBy(F.desc("mean_ic"), "alpha").limit(1)  # a row a penalty
    return scores, tested.join(F.broadcast(best.select("alpha")), "alpha")


def fold_report(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """AGG-31: per fold the pooled rank IC, number and mean label."""
    ic = panel.rank_ic(df, prediction, label, ["fold"])
    return ic.join(df.where(F.col(label).isNotNull()).groupBy("fold").agg(F.avg(label).alias("mean_label"), F.min("date").alias("first_date"), F.max("date").alias("last_date")), "fold")


def deflated_sharpe(returns: DataFrame, column: str, by: list[str], trials: int) -> DataFrame:
    """AGG-29: normal CDF of the yearly Sharpe ratio less the expected maximum of so many trials; 0 without variation or with one row."""
    from statistics import NormalDist

    bar = NormalDist().inv_cdf(1 - 1 / max(trials, 2))
    g = returns.groupBy(*by).agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"), F.count(column).alias("n"))
    return g.select(*by, F.when((F.col("n") < 2) | (F.coalesce("s", F.lit(0.0)) == 0), 0.0).otherwise(normal_cdf(F.try_divide("m", "s") * F.sqrt(F.lit(252.0)) - bar)).alias("dsr"), "n")


def overfitting_probability(results: DataFrame) -> DataFrame:
    """AGG-30: of results (name, in_sample, out_of_sample) not below the median in sample, the share in the lower half out of sample. One row a result."""
    mid = results.agg(F.median("in_sample").alias("mid"), F.count("*").alias("n"))
    r = results.withColumn("pos", F.row_number().over(Window.orderBy("out_of_sample", "name")) - 1).crossJoin(mid)
    chosen = r.where("in_sample >= mid").agg(F.avg((F.try_divide(F.col("pos").cast("double"), F.greatest(F.col("n") - 1, F.lit(1)).cast("double")) < 0.5).cast("double")).alias("pbo"), F.max("n").alias("n"))
    one = results.agg(F.max((F.col("out_of_sample") < F.col("in_sample")).cast("double")).alias("single"))
    return chosen.crossJoin(one).select(F.when(F.col("n") < 2, F.col("single")).otherwise(F.col("pbo")).alias("pbo"), "n")


def feature_dependence(df: DataFrame, features: list[str], label: str, primary_score: float | None = None) -> DataFrame:
    """AGG-32: per feature the rank IC over all rows with nulls as 0, its absolute value and rank; and of all features the largest absolute value, its share of the primary score (at most 1), and what is left.

    Without a primary score the share is 0.
    """
    values = {f"_x{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)}
    x = written(df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_l"), *(v.alias(n) for n, v in values.items())), "features")
    x = with_mean_ranks(x, {"_l": "_rank_l"})  # once for all features
    long = x.select("_rank_l", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(n).alias("value")) for c, n in zip(features, values, strict=True)))).alias("x")).select("_rank_l", "x.*")
    ranked = with_mean_ranks(written(long, "values"), {"value": "_rank_x"}, ("feature",))
    ic = panel.correlated_ranks(ranked, "_rank_x", "_rank_l", ("feature",)).withColumn("abs_ic", F.abs("rank_ic"))
    every = Window.partitionBy(F.lit(0))  # a row a feature
    drop = F.least(F.lit(1.0), F.col("max_abs_ic") / abs(primary_score)) if primary_score else F.lit(0.0)
    x = ic.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("abs_ic"), "feature")), "max_abs_ic": F.max("abs_ic").over(every)}).withColumn("score_drop", drop)
    return x.select("feature", "rank_ic", "abs_ic", "rank", "max_abs_ic", "score_drop", (1 - F.col("score_drop")).alias("ablation_ratio"))


def _numbered(df: DataFrame, part: str, order: list, out: str) -> DataFrame:
    """df with the number of each row, from 0, in the order of (part, order), in two steps: within parts, and over the counts of parts (a row a part)."""
    counts = df.groupBy(part).agg(F.count("*").alias("_n"))
    bases = counts.select(part, F.coalesce(F.sum("_n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return df.withColumn("_inside", inside).join(F.broadcast(bases), part).withColumn(out, F.col("_base") + F.col("_inside")).drop("_inside", "_base")


def placebo_labels(df: DataFrame, label: str, seeds: list[int], part_rows: int = 100_000) -> DataFrame:
    """MOD-11: df with placebo_{seed}, the label permuted over the whole table, for each seed; date and symbol tell rows apart.

    The row that is n-th by date and symbol gets the label of the row that is n-th by a hash of seed, date and symbol. Both
    orders are numbered in parts (dates; ranges of hashes, of about part_rows rows), so no window holds the table. Only keys and
    labels move for each seed; the other columns move once, to meet the permuted labels.
    """
    x = written(_numbered(df.select("date", "symbol", label), "date", ["symbol"], "_row"), "numbered")  # read once for each seed
    parts = max(1, x.count() // part_rows)
    source = x.select("date", "symbol", F.col(label).alias("_label"))
    for s in seeds:
        hashed = source.withColumn("_h", unit_hash(F.lit(s), F.col("date"), F.col("symbol"))).withColumn("_part", F.floor(F.col("_h") * parts))
        x = x.join(_numbered(hashed, "_part", ["_h", "date", "symbol"], "_row").select("_row", F.col("_label").alias(f"placebo_{s}")), "_row")
    names = [f"placebo_{s}" for s in seeds]
    made = x.select(F.col("date").alias("_date"), F.col("symbol").alias("_symbol"), *names)
    return df.join(made, (df["date"] == made["_date"]) & df["symbol"].eqNullSafe(made["_symbol"])).select(*df.columns, *names)


def placebo_ridge(df: DataFrame, folds: DataFrame, features: list[str], label: str, seeds: list[int], alpha: float = 1.0) -> DataFrame:
    """MOD-11: seed, fold, rank_ic, n: ridge regressions fitted anew to permuted labels and tested on permuted labels; -1 is the real label.

    All seeds share one pass of co-moments: the products of features once, those with labels for each seed.
    """
    clean = panel.clean_matrix(df, features).where(F.col(label).isNotNull()).select("date", "symbol", *features, F.col(label).alias("placebo_-1"))
    names = ["placebo_-1", *(f"placebo_{s}" for s in seeds)]
    x, folds = written(placebo_labels(clean, "placebo_-1", seeds), "placebo"), written(folds, "folds")
    models = written(_walk_forward_models(x, folds, features, names, [alpha]), "models").select("fold", "label", "coefficients", "intercept")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.col(f"`{n}`").alias("actual")) for n in names))).alias("_y")
    tested = test_rows(x, folds).select("fold", *features, each).select("fold", *features, "_y.*")
    made = tested.join(F.broadcast(models), ["fold", "label"]).select("fold", F.substring_index("label", "_", -1).cast("int").alias("seed"), predicted(features).alias("prediction"), "actual")
    return panel.pooled_rank_ic(made, "prediction", "actual", ("seed", "fold")).select("seed", "fold", "rank_ic", "n")


def placebo_summary(ics: DataFrame, most: float = 0.1) -> DataFrame:
    """MOD-11: per seed the mean rank IC over folds, and whether a placebo stays within the bound."""
    g = ics.groupBy("seed").agg(F.avg("rank_ic").alias("mean_ic"), F.count("*").alias("folds"))
    return g.withColumn("passed", F.when(F.col("seed") >= 0, F.abs("mean_ic") <= most))


def shuffled_within_dates(df: DataFrame, column: str, seed: int) -> DataFrame:
    """MOD-11, AGG-33: the column permuted within each date by the order of a hash; the same whatever the partitions."""
    a = df.withColumn("_i", F.row_number().over(Window.partitionBy("date").orderBy("symbol")))
    b = df.select("date", F.col(column).alias("_v"), F.row_number().over(Window.partitionBy("date").orderBy(unit_hash(F.lit(seed), F.col("date"), F.col("symbol")), "symbol")).alias("_i"))
    return a.drop(column).join(b, ["date", "_i"]).withColumnRenamed("_v", column).drop("_i")


def permuted_symbols(df: DataFrame, seed: int) -> DataFrame:
    """AGG-33: symbol and other, the symbol after it in the order of a hash, the first one after the last. A row a symbol."""
    order = Window.orderBy(unit_hash(F.lit(seed), F.col("symbol")), "symbol")
    names = df.select("symbol").distinct().withColumns({"_next": F.lead("symbol").over(order), "_first": F.first("symbol").over(order)})
    return names.select("symbol", F.coalesce("_next", "_first").alias("other"))


def negative_controls(df: DataFrame, prediction: str, label: str, seed: int = 17) -> DataFrame:
    """AGG-33: mean per-date rank IC of the real label and of controls: shuffled labels, the next row's label, a random prediction, the predictions of other symbols, a leak."""
    df = written(df.select("date", "symbol", prediction, label), "predictions")  # read for each control
    noise = unit_hash(F.lit(seed), F.col("date"), F.col("symbol"))
    ahead = df.withColumn(label, F.lead(label, 1).over(panel.by_symbol()))
    other = df.select("date", F.col("symbol").alias("other"), F.col(prediction).alias("_p"))
    pair = lambda x, p, l: x.select("date", "symbol", F.col(p).alias("p"), F.col(l).alias("l"))  # noqa: E731, E741
    kinds = {
        "actual": pair(df, prediction, label),
        "shuffled": pair(shuffled_within_dates(df, label, seed), prediction, label),
        "date_shifted": pair(ahead, prediction, label),
        "random": pair(df.withColumn("_noise", noise), "_noise", label),
        "permuted_ticker": pair(df.join(permuted_symbols(df, seed), "symbol").join(other, ["date", "other"]), "_p", label),
        "future_leak": pair(df, label, label),
    }
    out = None
    for name, x in kinds.items():
        one = x.withColumn("control", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return panel.rank_ic(out, "p", "l", ["control", "date"]).groupBy("control").agg(F.avg("rank_ic").alias("mean_ic"), F.count("*").alias("n_dates"))


def sign_flip(df: DataFrame, prediction: str, label: str) -> DataFrame:
    """AGG-34: mean per-date rank IC of the prediction and of its negation."""
    both = df.select("date", "symbol", label, F.explode(F.array(F.struct(F.lit("as_is").alias("sign"), F.col(prediction).alias("p")), F.struct(F.lit("flipped").alias("sign"), (-F.col(prediction)).alias("p")))).alias("x"))
    return panel.rank_ic(both.select("date", "symbol", label, "x.*"), "p", label, ["sign", "date"]).groupBy("sign").agg(F.avg("rank_ic").alias("mean_ic"))


def sign_flip_canary(df: DataFrame, prediction: str, label: str, most: int = 10) -> DataFrame:
    """AGG-34: sign (original, flipped), year (null: all), rank_ic, n, mean_spread, preferred of the prediction and its negation.

    Rank IC over all rows, and over those of each year. mean_spread, for all years only, is the mean over dates of the top
    less the bottom bucket's label. Flipped is preferred if its rank IC is larger and its spread not smaller.
    """
    kept = written(df.where(F.col(prediction).isNotNull() & F.col(label).isNotNull()).select("date", "symbol", F.col(prediction).alias("p"), F.col(label).alias("l")), "predictions")
    both = kept.select(F.year("date").alias("year"), F.col("p").cast("double").alias("p"), F.col("l").cast("double").alias("l"))

    def of(by: tuple[str, ...]) -> DataFrame:
        """The negation's ranks are the prediction's from the other end, but for NaN, which is last in both."""
        there = both.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count_if(~F.isnan("p")).alias("_m"))  # a row a year
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.lit(True))
        x = with_mean_ranks(both, {"l": "_rank_l", "p": "_original"}, by).join(F.broadcast(there), same)
        x = x.withColumn("_flipped", F.when(F.isnan("p"), F.col("_original")).otherwise(F.col("_m") + 1 - F.col("_original")))
        g = x.groupBy(*by).agg(*(panel.correlation(f"_{s}", "_rank_l").alias(s) for s in ("original", "flipped")), F.count("*").alias("n"))
        return g.select(F.explode(F.array(*(F.struct(F.lit(s).alias("sign"), F.col(s).alias("rank_ic")) for s in ("original", "flipped")))).alias("x"), *by, "n").select("x.*", *by, "n")

    ic = of(()).where("n > 0").withColumn("year", F.lit(None).cast("int")).unionByName(of(("year",)))
    spread = lambda x, sign: panel.bucket_metrics(x, "p", "l", most).where("n > 1").agg(F.coalesce(F.avg("spread"), F.lit(0.0)).alias("mean_spread")).withColumn("sign", F.lit(sign))
    spreads = spread(kept, "original").unionByName(spread(kept.withColumn("p", -F.col("p")), "flipped"))
    x = written(ic.join(spreads, "sign"), "canary")  # a row a sign and year
    at = lambda c, sign: F.max(F.when(F.col("year").isNull() & (F.col("sign") == sign), F.col(c)))
    better = (at("rank_ic", "flipped") > at("rank_ic", "original")) & (at("mean_spread", "flipped") >= at("mean_spread", "original"))
    choice = x.agg(F.when(better, "flipped").otherwise("original").alias("preferred"))
    return x.crossJoin(choice).select("sign", "year", "rank_ic", "n", F.when(F.col("year").isNull(), F.col("mean_spread")).alias("mean_spread"), "preferred")


def pooled_buckets(df: DataFrame, score: str, label: str, most: int = 10, parts: int = 64) -> DataFrame:
    """AGG-08 over all rows: bucket (from 1), n, mean_label by quantile bucket of first-ranks; and spread (top less bottom) and hit_rate (share of labels above 0 on top). Equal scores are ordered by date and symbol.

    Rows are numbered within ranges of scores and over the ranges' counts: no window holds the table.
    """
    x = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select("date", "symbol", F.col(score).cast("double").alias("s"), F.col(label).alias("l"))
    x = written(x, "scored")
    bounds = sorted(set(x.approxQuantile("s", [k / parts for k in range(1, parts)], 1 / (2 * parts))))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("s"))) if bounds else F.lit(0)
    n = x.count()
    q = min(most, n)
    bucket = F.greatest(F.lit(0), F.ceil(F.col("_r") * q / max(n - 1, 1)) - 1) + 1
    g = _numbered(x.withColumn("_p", part), "_p", ["s", "date", "symbol"], "_r").groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.avg("l").alias("mean_label"), F.avg((F.col("l") > 0).cast("double")).alias("_hit"))
    every = Window.partitionBy(F.lit(0))  # a row a bucket
    top, low = F.max_by("mean_label", "bucket").over(every), F.min_by("mean_label", "bucket").over(every)
    return g.select("bucket", "n", "mean_label", (top - low).alias("spread"), F.max_by("_hit", "bucket").over(every).alias("hit_rate"))


def target_weights(scores: DataFrame, share_of: int = 5, weekday: int = 4, floor: float = 0.0, cap: float = 1.0, adv: str | None = None, exclude: str | None = None) -> DataFrame:
    """PF-01, PRJ-16, SRT-03: on the rebalance weekday (Monday 0) the top max(1, ceil(n / share_of)) scores, equally weighted up to cap. exclude: a column that is true where a symbol isn't to be held (earnings ahead)."""
    x = scores.where(F.weekday("date") == weekday)
    if exclude:
        x = x.where(~F.coalesce(exclude, F.lit(False)))
    if adv:
        x = x.where(F.coalesce(adv, F.lit(0.0)) >= floor)
    n = F.count(F.lit(1)).over(Window.partitionBy("date"))
    k = F.greatest(F.lit(1), F.ceil(n / share_of))
    x = x.withColumns({"_k": k, "_r": F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "symbol"))})
    return x.where("_r <= _k").select("date", "symbol", "score", F.least(1 / F.col("_k"), F.lit(cap)).alias("target_weight"))


def costs(trades: DataFrame, spread_bps: float = 5.0, impact: float = 0.0, stress: float = 1.0) -> DataFrame:
    """PF-02: spread and square-root impact of trades (trade_value, and adv if there is one); no impact without adv."""
    size = F.abs("trade_value")
    share = F.coalesce(F.try_divide(size, F.nullif(F.col("adv"), F.lit(0.0))), F.lit(0.0)) if "adv" in trades.columns else F.lit(0.0)
    x = trades.withColumn("spread_cost", size * (spread_bps / 10000) * stress).withColumn("impact_cost", size * impact * F.sqrt(share) * stress)
    return x.withColumn("cost", F.col("spread_cost") + F.col("impact_cost"))


def trades(weights: DataFrame) -> DataFrame:
    """PF-03, JOIN-14: weight changes between consecutive rebalance dates, dropped positions included."""
    days = weights.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))  # one row a rebalance date
    before = weights.join(days, "date").where("next IS NOT NULL").select(F.col("next").alias("date"), "symbol", F.col("target_weight").alias("old_weight"))
    x = weights.select("date", "symbol", "target_weight").join(before, ["date", "symbol"], "full")
    delta = F.coalesce("target_weight", F.lit(0.0)) - F.coalesce("old_weight", F.lit(0.0))
    return x.select("date", "symbol", F.coalesce("old_weight", F.lit(0.0)).alias("old_weight"), F.coalesce("target_weight", F.lit(0.0)).alias("new_weight"), delta.alias("trade_value"))


def orders_from_deltas(deltas: DataFrame, notional: float) -> DataFrame:
    """PRJ-22: side and rounded notional of each change above 1e-12; nothing is sent."""
    x = deltas.where(F.abs("trade_value") > 1e-12)
    return x.select("date", "symbol", F.when(F.col("trade_value") > 0, "buy").otherwise("sell").alias("side"), F.round(F.abs("trade_value") * notional, 2).alias("notional"))


def portfolio_returns(weights: DataFrame, bars: DataFrame) -> DataFrame:
    """PF-04: daily simple return of the held weights (those of the last rebalance date before the day) and the equity curve. One row a day."""
    days = bars.select("date").distinct()
    rebalances = weights.select(F.col("date").alias("held")).distinct()
    w = Window.orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, -1)
    marks = days.select("date", F.lit(0).alias("kind"), F.lit(None).cast("date").alias("held")).unionByName(rebalances.select(F.col("held").alias("date"), F.lit(1).alias("kind"), "held"))
    held = marks.withColumn("held", F.when(F.col("kind") == 0, F.last("held", ignorenulls=True).over(w))).where("kind = 0 AND held IS NOT NULL").select("date", "held")
    simple = bars.select("date", "symbol", (F.try_divide("close", F.lag("close").over(panel.by_symbol())) - 1).alias("r"))
    pos = held.join(weights.select(F.col("date").alias("held"), "symbol", "target_weight"), "held")
    daily = pos.join(simple, ["date", "symbol"], "left").groupBy("date").agg(F.sum(F.col("target_weight") * F.coalesce("r", F.lit(0.0))).alias("portfolio_return"))
    return daily.withColumn("equity", F.exp(F.sum(F.log1p("portfolio_return")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))))


def portfolio_summary(daily: DataFrame, traded: DataFrame) -> DataFrame:
    """PF-05, AGG-35: gross return, turnover, costs and net return. One row."""
    a = daily.agg((F.exp(F.sum(F.log1p("portfolio_return"))) - 1).alias("gross_return"), F.count("*").alias("n_days"))
    b = traded.agg(F.sum(F.abs("trade_value")).alias("turnover"), F.sum("cost").alias("total_cost"), F.count_distinct("date").alias("n_rebalances"))
    return a.crossJoin(b).withColumn("net_return", F.col("gross_return") - F.col("total_cost"))


def holding_returns(weights: DataFrame, bars: DataFrame, sessions: int) -> DataFrame:
    """JOIN-22, AGG-37: per rebalance date the weighted return to the close `sessions` of the symbol's bars later; null until all are mature."""
    x = bars.select("date", "symbol", "close", F.lead("close", sessions).over(panel.by_symbol()).alias("later"))
    y = weights.join(x, ["date", "symbol"], "left").withColumn("r", F.exp(log_ratio(F.col("later"), F.col("close"))) - 1)
    return y.groupBy("date").agg(F.when(F.count("r") == F.count("*"), F.sum(F.col("target_weight") * F.col("r"))).alias("holding_return"), F.count("*").alias("n_positions"))


def matured_pnl(weights: DataFrame, bars: DataFrame, horizon: int, benchmark, cost_bps: float = 5.0) -> DataFrame:
    """AGG-37: per signal date (weights: date, symbol, target_weight) the outcome once `horizon` later market dates are observed.

    status (available, pending_labels), available_future_dates, required_future_dates, mature_date, gross_return (weights
    times the change from the signal's to the mature date's close; 0 without both), turnover (sum of absolute weights),
    cost_drag, net_return, max_drawdown (the loss, if any), benchmark_return of the symbol `benchmark`, excess_return,
    positions. All but the counts are null while pending. Market dates are those of any bar.
    """
    market = bars.select("date").distinct().withColumn("_market", F.lit(1))
    signals = weights.select("date").distinct().withColumn("_signal", F.lit(True))
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    days = market.join(signals, "date", "full").withColumn("_i", F.coalesce(F.sum("_market").over(upto), F.lit(0)))
    total = market.agg(F.count("*").alias("_n"))
    later = days.where("_market = 1").select(F.col("_i").alias("_j"), F.col("date").alias("mature_date"))
    s = days.where("_signal").crossJoin(total).withColumns({"available_future_dates": F.col("_n") - F.col("_i"), "_j": F.col("_i") + horizon}).join(later, "_j", "left")
    s = written(s.select("date", "available_future_dates", "mature_date"), "signal_dates")  # a row a signal date
    price = lambda at, out: bars.select(F.col("date").alias(at), "symbol", F.col("close").alias(out))
    change = F.try_divide(F.col("_end"), F.col("_start")) - 1
    legs = weights.join(s, "date").join(price("date", "_start"), ["date", "symbol"], "left").join(price("mature_date", "_end"), ["mature_date", "symbol"], "left")
    w = F.coalesce("target_weight", F.lit(0.0))
    g = legs.groupBy("date").agg(F.sum(w * F.coalesce(change, F.lit(0.0))).alias("_gross"), F.sum(F.abs(w)).alias("_turnover"), F.count("*").alias("positions"))
    own = bars.where(F.col("symbol") == benchmark)
    b = s.join(own.select("date", F.col("close").alias("_start")), "date").join(own.select(F.col("date").alias("mature_date"), F.col("close").alias("_end")), "mature_date").select("date", change.alias("_benchmark"))
    x = s.join(g, "date").join(b, "date", "left")
    ready = F.col("mature_date").isNotNull()
    only = lambda c: F.when(ready, c)
    cost = F.col("_turnover") * (cost_bps / 10_000)
    net = F.col("_gross") - cost
    return x.select(
        "date", F.when(ready, "available").otherwise("pending_labels").alias("status"), "available_future_dates", F.lit(horizon).alias("required_future_dates"), "mature_date", only(F.col("_gross")).alias("gross_return"), only(F.col("_turnover")).alias("turnover"), only(cost).alias("cost_drag"),
        only(net).alias("net_return"), only(F.least(F.lit(0.0), net)).alias("max_drawdown"), only(F.col("_benchmark")).alias("benchmark_return"), only(net - F.col("_benchmark")).alias("excess_return"), "positions",
    )


def model_deltas(scores: DataFrame, report: str, model: str, score: str, base: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """AGG-38: per report the best model (ties by name), its score, best_minus_{base}, and {a}_minus_{b} of each pair; null where a model is missing."""
    at = lambda m: F.max(F.when(F.col(model) == m, F.col(score)))
    x = scores.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = F.min_by(model, F.struct(-F.col(score), F.col(model)))
    return x.groupBy(report).agg(best.alias("best_model"), F.max(score).alias("best_score"), (F.max(score) - at(base)).alias(f"best_minus_{base}"), *((at(a) - at(b)).alias(f"{a}_minus_{b}") for a, b in pairs))
