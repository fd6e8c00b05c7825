"""Hand-computed cases of the operators."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import average_rank, contains_any, normal_cdf, ordered_counts, quantiles
from tidemark.operators import asof, calendars, curation, modeling, panel, quality, validation
from tidemark.operators import filing_events as ev
from tidemark.sources import payloads

D = dt.date


def days(first: dt.date, n: int, weekdays: bool = True) -> list[dt.date]:
    out, d = [], first
    while len(out) < n:
        if not weekdays or d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(1)
    return out


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_forward_label_of_a_session_and_of_a_holiday(spark):
    s = days(D(2026, 6, 1), 60)
    holiday = frame(spark, [(D(2026, 7, 3),)], "date date")
    rows = [(d, "A", 100.0 + i) for i, d in enumerate([D(2026, 7, 2), D(2026, 7, 3), D(2026, 7, 6), D(2026, 7, 7)])]
    bars = frame(spark, rows, "date date, symbol string, close double")
    calendar = panel.sessions(frame(spark, [(d,) for d in s], "date date"), holiday)
    got = {r.date: r.raw_forward_return_1d for r in panel.build_labels(bars, calendar, 1).collect()}
    assert got[D(2026, 7, 3)] == pytest.approx(math.log(102 / 101)) and got[D(2026, 7, 2)] == pytest.approx(math.log(102 / 100))


def test_labels_sum_to_zero_per_date(spark):
    s = days(D(2026, 1, 5), 30)
    rows = [(d, k, 50.0 + 3 * k + (i * (k + 2)) % 7) for i, d in enumerate(s) for k in range(6)]
    bars = frame(spark, rows, "date date, symbol int, close double")
    sums = panel.build_labels(bars, panel.sessions(bars)).groupBy("date").agg(F.sum("label_5d").alias("s")).collect()
    assert len(sums) == 25 and all(abs(r.s) < 1e-10 for r in sums)


def test_features_do_not_see_the_future(spark):
    s = days(D(2024, 1, 1), 320)
    rows = [(d, k, 20.0 + (i * (k + 3)) % 11, 21.0 + (i * (k + 5)) % 13, 1000 + i) for i, d in enumerate(s) for k in range(4)]
    schema = "date date, symbol int, open double, close double, volume bigint"
    a = panel.build_features(frame(spark, rows, schema))
    b = panel.build_features(frame(spark, [r if r[0] < s[250] else (*r[:2], r[2] * 2, r[3] * 3, 5) for r in rows], schema))
    x = [r.asDict() for r in a.where(F.col("date") <= F.lit(s[250])).orderBy("date", "symbol").collect()]
    y = [r.asDict() for r in b.where(F.col("date") <= F.lit(s[250])).orderBy("date", "symbol").collect()]
    assert x == y and a.count() == len(rows) and len(panel.FEATURES) == 15
    assert a.where("reversal_5d <> -momentum_5d").count() == 0
    assert a.where(F.col("idio_vol_20d").isNotNull()).agg(F.min("date")).first()[0] == s[40]


def test_rank_normalize(spark):
    rows = [("d", f"s{i}", float(i) if i < 7 else None, float(i) if i < 2 else None) for i in range(10)]
    x = panel.rank_normalize(frame(spark, rows, "date string, symbol string, a double, b double"), ["a", "b"]).collect()
    assert all(-1 <= r.a <= 1 for r in x) and all(r.b is None for r in x) and sorted(r.a for r in x)[-1] == 1.0


def test_rank_ic_and_buckets(spark):
    flat = frame(spark, [(1, "a", 1.0, 2.0), (1, "b", 1.0, 3.0)], "date int, symbol string, p double, l double")
    assert panel.rank_ic(flat, "p", "l", ["date"]).first().rank_ic == 0.0
    x = frame(spark, [(1, s, p, v) for s, p, v in zip("abcd", (0.2, 0.2, 0.5, 0.1), (1.0, 2.0, 3.0, 4.0), strict=True)], "date int, symbol string, p double, l double")
    assert [r.bucket for r in panel.buckets(x, "p", 4).orderBy("symbol").collect()] == [1, 2, 3, 0]
    y = frame(spark, [(1, s, p, v) for s, p, v in zip("abcd", (0.1, 0.2, 0.3, 0.4), (-0.04, -0.01, 0.02, 0.05), strict=True)], "date int, symbol string, p double, l double")
    m = panel.bucket_metrics(y, "p", "l", 4).first()
    assert m.hit_rate == 1.0 and m.spread == pytest.approx(0.09)
    assert panel.pooled_rank_ic(y, "p", "l").first().rank_ic == pytest.approx(1.0)


def test_average_rank_shares_ties(spark):
    x = frame(spark, [(1, v) for v in (3.0, 1.0, 3.0, None, 2.0)], "g int, v double").withColumn("r", average_rank(F.col("v"), "g"))
    assert sorted(r.r for r in x.collect() if r.r is not None) == [1.0, 2.0, 3.5, 3.5]


def test_adjustment_by_split_and_dividend(spark):
    bars = frame(spark, [(D(2026, 1, d), "A", p, p, p, p, p, 10) for d, p in ((2, 100.0), (3, 50.0), (4, 49.0))], "date date, symbol string, open double, high double, low double, close double, vwap double, volume bigint")
    actions = frame(spark, [("A", D(2026, 1, 3), "split", 0.5, None), ("A", D(2026, 1, 4), "dividend", None, 1.0)], "symbol string, ex_date date, event_type string, ratio double, amount double")
    first = curation.adjust(bars, actions).orderBy("date").first()
    assert first.close == pytest.approx(49.0) and first.volume == pytest.approx(20.0)


def test_universe_waits_for_listing(spark):
    s = days(D(2026, 1, 1), 22)
    bars = frame(spark, [(d, k, 10.0, 100 + ord(k[0])) for d in s for k in ("A", "B")], "date date, symbol string, close double, volume bigint")
    listings = frame(spark, [("A", None, None), ("B", D(2026, 1, 10), None)], "symbol string, ipo_date date, delist_date date")
    assert {r.symbol for r in curation.active_on(listings, "2026-01-09").collect()} == {"A"}
    assert {r.symbol for r in curation.active_on(listings, "2026-01-30").collect()} == {"A", "B"}
    assert panel.universe(bars, listings, 5).count() == 0  # the month's first day has too few bars before it


def test_walk_forward_folds(spark):
    s = days(D(2020, 1, 1), 1300)
    got = validation.walk_forward_folds(frame(spark, [(d,) for d in s], "date date"), 520, 65).orderBy("fold").collect()
    assert len(got) == 12
    assert all(s.index(r.test_start) - s.index(r.train_end) == 6 for r in got) and got[-1].test_end == s[-1]


def test_purged_paths_keep_enough(spark):
    s = days(D(2020, 1, 1), 320)
    x = validation.purged_paths(frame(spark, [(d, k) for d in s for k in "AB"], "date date, symbol string")).collect()
    assert len(x) == 28 and all(r.n_test == 160 for r in x) and all(r.n_train >= 0.67 * 480 for r in x)


def test_ridge_from_co_moments(spark):
    import numpy as np

    from tidemark.operators import moments

    r = np.random.default_rng(0)
    x = r.normal(size=(200, 2))
    y = x @ [1.5, -2.0] + 0.3 + 0.1 * r.normal(size=200)
    df = frame(spark, [(int(i >= 100), float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "g int, a double, b double, y double")
    sets = moments.merged(moments.co_moments(df.repartition(5), ["a", "b"], ["y"], ["g"]).withColumn("m", F.lit(0)), ["m"], 2, 1)
    got = moments.ridge(sets, 2, ["y"], [1.0, 5.0], ["m"]).where("alpha = 1").first()
    xc = x - x.mean(0)
    want = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ (y - y.mean()))
    assert np.allclose(got.coefficients, want) and got.intercept == pytest.approx(y.mean() - x.mean(0) @ want) and got.n == 200 and got.label == "y"


@pytest.mark.parametrize("mean", [0.0, 1e9])
def test_ridge_keeps_its_digits_at_large_means(spark, mean):
    import numpy as np

    from tidemark.operators import moments

    r = np.random.default_rng(1)
    x = r.normal(size=2000)
    y = 0.5 * x + 0.01 * r.normal(size=2000)
    start = D(2020, 1, 1)
    rows = [(start + dt.timedelta(days=i // 20), f"S{i % 20}", mean + float(a), float(b), float(-b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = frame(spark, rows, "date date, symbol string, x double, y double, z double").repartition(7)
    sets = moments.co_moments(df, ["x"], ["y", "z"], ["date"])
    every = moments.merged(sets, [], 1, 2)
    slopes = {k.label: k.coefficients[0] for k in moments.ridge(every, 1, ["y", "z"], [1e-6], []).collect()}
    assert slopes["y"] == pytest.approx(0.5, abs=2e-3) and slopes["z"] == pytest.approx(-0.5, abs=2e-3)
    upto = {k.date: k for k in moments.prefixes(sets, "date", 1, 2).collect()}
    assert len(upto) == 100
    for d in (start, start + dt.timedelta(days=41), start + dt.timedelta(days=99)):
        n = 20 * ((d - start).days + 1)
        xc = x[:n] - x[:n].mean()
        assert upto[d].n == n and upto[d].xx[0] == pytest.approx(xc @ xc, rel=1e-5) and upto[d].xy[0] == pytest.approx(xc @ (y[:n] - y[:n].mean()), rel=1e-5)
    folds = validation.walk_forward_folds(df, 50, 25)
    scores, best = validation.walk_forward_ridge(df, folds, ["x"], "y", [1e-6, 1.0])
    assert {(r.alpha, r.fold) for r in scores.collect()} == {(a, k) for a in (1e-6, 1.0) for k in (0, 1)} and all(r.rank_ic > 0.99 for r in scores.collect())
    assert best.agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.1


def test_placebo_refits(spark):
    import numpy as np

    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 2))
    y = x @ [1.0, -0.5] + 0.2 * r.normal(size=3000)
    rows = [(D(2020, 1, 1) + dt.timedelta(days=i // 10), f"S{i % 10}", float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    df = frame(spark, rows, "date date, symbol string, a double, b double, y double")
    shuffled = validation.placebo_labels(df.repartition(5), "y", [1, 2], part_rows=500)
    got = shuffled.orderBy("date", "symbol").collect()
    unit = lambda s, k: hashlib.md5(f"{s}|{k[0]}|{k[1]}".encode()).hexdigest()[:13]
    for s in (1, 2):
        want = [k[4] for k in sorted(rows, key=lambda k, s=s: (unit(s, k), k[0], k[1]))]
        assert [g[f"placebo_{s}"] for g in got] == want
    ics = validation.placebo_ridge(df, validation.walk_forward_folds(df, 150, 50), ["a", "b"], "y", [1, 2, 3])
    by = {k.seed: k for k in validation.placebo_summary(ics).collect()}
    assert by[-1].mean_ic > 0.9 and by[-1].passed is None and all(by[s].passed and by[s].folds == 3 for s in (1, 2, 3))


def test_portfolio_of_five_names(spark):
    rows = [(D(2026, 1, 2), n, float(i)) for i, n in enumerate(["E", "D", "C", "B", "AAPL"])] + [(D(2026, 1, 5), "AAPL", 1.0)]
    w = validation.target_weights(frame(spark, rows, "date date, symbol string, score double")).collect()
    assert [(r.symbol, r.target_weight) for r in w] == [("AAPL", 1.0)]
    rows = [(D(2026, 1, 2), "A", 2.0, 5e6), (D(2026, 1, 2), "B", 1.0, 2e7)]
    w = validation.target_weights(frame(spark, rows, "date date, symbol string, score double, adv double"), floor=1e7, cap=0.05, adv="adv").collect()
    assert [(r.symbol, r.target_weight) for r in w] == [("B", 0.05)]


def test_costs(spark):
    x = frame(spark, [(10_000.0, 1e6), (-10_000.0, 0.0)], "trade_value double, adv double")
    assert [r.cost for r in validation.costs(x).collect()] == [5.0, 5.0]
    assert validation.costs(x, stress=2.0).first().cost == 10.0
    assert validation.costs(x, 0.0, 0.1).first().cost == pytest.approx(10_000 * 0.1 * 0.1)


def calendar(spark):
    rows = [(i, d, dt.datetime.combine(d, dt.time(13, 30)), dt.datetime.combine(d, dt.time(20, 0))) for i, d in enumerate(days(D(2025, 4, 1), 40))]
    return frame(spark, rows, "session_idx bigint, date date, open_at timestamp_ntz, close_at timestamp_ntz")


@pytest.mark.parametrize(("at", "want"), [((7, 12, 0), (7, 13, 35)), ((7, 15, 0), (7, 15, 5)), ((7, 20, 30), (8, 13, 35)), ((7, 19, 57), (8, 13, 30)), ((5, 15, 0), (7, 13, 35))])
def test_first_tradable_time(spark, at, want):
    events = frame(spark, [(dt.datetime(2025, 4, *at),)], "accepted_at timestamp_ntz")
    assert ev.first_tradable(events, calendar(spark)).first().tradable_at == dt.datetime(2025, 4, *want)


def test_event_labels(spark):
    s = days(D(2025, 4, 7), 10)
    bars = frame(spark, [(d, "X", 100.0, 110.0) for d in s], "date date, symbol string, open double, close double")
    bench = frame(spark, [(d, 200.0 + 2 * i) for i, d in enumerate(s)], "date date, close double")
    events = frame(spark, [("e", "X", dt.datetime(2025, 4, 7, 15, 5)), ("late", "X", dt.datetime(2026, 1, 1))], "event_id string, symbol string, tradable_at timestamp_ntz")
    got = {r.event_id: r for r in ev.event_labels(events, bars, panel.sessions(bars), (1,), 0.005, bench).collect()}
    assert got["e"].ret_1d_net == pytest.approx(math.log(110 / 100) - 0.005, abs=1e-12)
    assert got["e"].abret_1d_net == pytest.approx(math.log(110 / 100) - 0.005 - math.log(202 / 200), abs=1e-12)
    assert got["late"].label_blockers == ["missing_entry_bar"] and got["late"].label_status == "BLOCKED"


def test_as_of_joins_at_equal_times(spark):
    t0 = dt.datetime(2025, 1, 1, 10)
    q = frame(spark, [("A", t0), ("B", t0)], "k string, t timestamp_ntz")
    f = frame(spark, [("A", t0, 1), ("A", t0 + dt.timedelta(hours=1), 2), ("B", t0 + dt.timedelta(hours=5), 3)], "k string, t timestamp_ntz, v int")
    assert {r.k: r.v for r in asof.forward(q, f, ["k"], "t", "t", ["v"]).collect()} == {"A": 1, "B": 3}
    assert {r.k: r.v for r in asof.forward(q, f, ["k"], "t", "t", ["v"], "1 HOUR").collect()} == {"A": 1, "B": None}
    assert {r.k: r.v for r in asof.backward(q, f, ["k"], "t", "t", ["v"], ["v"]).collect()} == {"A": 1, "B": None}


def test_quality_verdicts(spark):
    x = frame(spark, [(D(2026, 1, 1), "A", 1.0), (D(2026, 1, 1), "A", None)], "date date, symbol string, v double")
    r = quality.quality_row(x, "x", ["date", "symbol"], ["v"]).first()
    assert (r.verdict, r.status, r.duplicate_keys, r.null_rate_max) == ("WARNING", "duplicate_keys", 2, 0.5)
    assert quality.quality_row(x, "x", ["date", "symbol"], ["w"]).first().status == "schema_mismatch"
    assert quality.quality_row(x.where("false"), "x", ["date", "symbol"], ["v"]).first().status == "zero_rows"
    assert quality.missing_columns(x, ["date", ("a", "symbol"), ("p", "q")]) == ["p or q"]


def test_normal_cdf(spark):
    got = spark.range(1).select(*(normal_cdf(F.lit(v)).alias(str(i)) for i, v in enumerate((-1.96, 0.0, 1.0)))).first()
    assert got[0] == pytest.approx(0.0249979, abs=1e-6) and got[1] == pytest.approx(0.5, abs=1e-6) and got[2] == pytest.approx(0.8413447, abs=1e-6)


def test_titles_and_tickers(spark):
    x = frame(spark, [("Class A Common Stock",), ("Common Stock Warrant",), (None,)], "t string")
    assert [r[0] for r in x.select(ev.common_title(F.col("t"))).collect()] == [True, False, False]
    f = ev.ticker_flags(F.col("t"))
    y = frame(spark, [("brk.b",), ("ABCDF",), ("not a ticker",)], "t string").select(f["invalid"], f["otc"]).collect()
    assert [tuple(r) for r in y] == [(False, False), (False, True), (True, False)]
    assert spark.range(1).select(contains_any(F.lit("A PIPE deal"), ev.PRIVATE_TERMS)).first()[0]


def test_payload_errors(spark):
    raw = [('x {"event_type": "merger", "is_material_candidate": "yes", "evidence": [{"quote": "abc"}]} y', "zabcz"), ("nothing", "a"), ('{"event_type": "merger", "is_material_candidate": "no", "evidence": [{"quote": "q"}]}', "a")]
    df = payloads.model_payloads(frame(spark, raw, "raw string, excerpt string"), "raw")
    assert [r[0] for r in df.select(payloads.contradictions("payload", "excerpt")).collect()] == [[], ["missing_payload"], ["promotable_not_material", "quote_not_in_excerpt"]]


def test_controls_find_no_signal_in_noise(spark):
    s = days(D(2024, 1, 1), 60)
    df = frame(spark, [(d, k, float((i * 7919 + k * 104729) % 1009)) for i, d in enumerate(s) for k in range(20)], "date date, symbol int, p double")
    df = df.withColumn("l", F.col("p") + F.pmod(F.xxhash64("date", "symbol"), F.lit(10)))
    got = {r.control: r.mean_ic for r in validation.negative_controls(df, "p", "l").collect()}
    assert got["future_leak"] == pytest.approx(1.0) and got["actual"] > 0.9 and abs(got["shuffled"]) < 0.1 and abs(got["random"]) < 0.1
    flip = {r.sign: r.mean_ic for r in validation.sign_flip(df, "p", "l").collect()}
    assert flip["as_is"] == pytest.approx(-flip["flipped"])


def test_bootstrap_brackets_the_mean(spark):
    df = frame(spark, [(f"e{i}", "f", float(i % 10)) for i in range(300)], "event_id string, family string, v double")
    r = ev.bootstrap_ci(df, "v", ["family"]).first()
    assert r.ci_low < 4.5 < r.ci_high and r.ci_high - r.ci_low < 1.5


def test_trees_predict_the_test_dates_of_every_fold(spark):
    from tidemark.operators import modeling

    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(35)]
    df = spark.createDataFrame([(x, s, float((k * 7 + s * 3) % 11), float((k * 7 + s * 3) % 11 > 5)) for k, x in enumerate(days) for s in range(4)], "date date, symbol int, f double, y double").persist()
    folds = validation.walk_forward_folds(df, 15, 10)
    got = modeling.walk_forward_trees(df, folds, ["f"], "y", rounds=1, depth=1).collect()
    assert folds.count() == 2 and sorted((r.date, r.symbol) for r in got) == [(x, s) for x in days[15:] for s in range(4)]
    assert all((r.prediction > 0.5) == (r.y > 0.5) for r in got)


def test_bootstrap_draws_as_often_as_the_study(spark):
    df = frame(spark, [(f"e{i}", "f", float(i % 10)) for i in range(40)], "event_id string, family string, v double")
    assert ev.bootstrap_ci(df, "v", ["family"]).collect() == ev.bootstrap_ci(df, "v", ["family"], iterations=1000).collect()
    assert ev.bootstrap_ci(df, "v", ["family"]).collect() != ev.bootstrap_ci(df, "v", ["family"], iterations=200).collect()


def test_forward_asof_of_one_long_key(spark):
    """200,000 rows of one key in one pass: every third is a query, and hits the first fact at or after it."""
    x = spark.range(200_000).select(F.lit("A").alias("k"), F.col("id").alias("t"))
    began = time.perf_counter()
    got = asof.forward(x.where("t % 3 = 0"), x.where("t % 3 <> 0").withColumnRenamed("t", "f").withColumn("v", F.col("f") * 2), ["k"], "t", "f", ["v"]).select("t", "f_hit", "v")
    assert got.where("f_hit <> t + 1 OR v <> 2 * f_hit").count() == 0 and got.where("f_hit IS NULL").count() == 0 and got.count() == 66_667
    assert time.perf_counter() - began < 60


def test_forward_asof_edges(spark):
    q = frame(spark, [("A", 5), ("A", 9), ("A", None), ("B", 1)], "k string, t int")
    f = frame(spark, [("A", 5, "x"), ("A", 7, "y"), ("A", None, "z")], "k string, f int, v string")
    assert sorted((r.k, r.t or 0, r.v) for r in asof.forward(q, f, ["k"], "t", "f", ["v"]).collect()) == [("A", 0, None), ("A", 5, "x"), ("A", 9, None), ("B", 1, None)]


def test_quantiles_and_counts_of_large_groups(spark):
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(int(g), float(v)) for g, v in zip(r.integers(0, 3, 2000), np.round(r.normal(size=2000), 2), strict=True)] + [(7, 1.0), (0, None)]
    df = frame(spark, rows, "g int, v double")
    for got in quantiles(df, "v", [0.0, 0.3, 0.5, 1.0], ("g",)).collect():
        assert np.allclose([got.q0, got.q1, got.q2, got.q3], np.quantile([v for g, v in rows if g == got.g and v is not None], [0, 0.3, 0.5, 1]))
    values = sorted(v for _, v in rows if v is not None)
    for c in ordered_counts(df, "v").collect():
        assert (c.before, c.n, c.total) == (sum(v < c.v for v in values), values.count(c.v), len(values))


def test_pooled_rank_ic_by_group(spark):
    import numpy as np

    r = np.random.default_rng(4)
    rows = [(int(g), float(a), float(b)) for g, a, b in zip(r.integers(0, 2, 900), r.integers(0, 40, 900), r.normal(size=900), strict=True)]
    df = frame(spark, rows, "g int, p double, l double")
    a = {x.g: (round(x.rank_ic, 9), x.n) for x in panel.pooled_rank_ic(df, "p", "l", ("g",)).collect()}
    assert a == {x.g: (round(x.rank_ic, 9), x.n) for x in panel.rank_ic(df, "p", "l", ["g"]).collect()}


def test_fingerprint_counts_rows_that_come_twice(spark):
    one, two = frame(spark, [(1, "a"), (1, "a"), (2, None)], "k int, v string"), frame(spark, [(1, "b"), (1, "b"), (2, None)], "k int, v string")
    by = lambda df: {r.g: (r.rows, r.content) for r in quality.fingerprint(df.withColumn("g", F.lit(0)), ["g"]).collect()}
    assert by(one) != by(two) and by(one) == by(one.orderBy(F.desc("k")))


def test_holders_of_needles_without_an_inner_word(spark):
    docs = frame(spark, [(1, "xfoo bar"), (2, "foo  bar"), (3, "a b c d"), (4, "zz"), (5, None)], "doc_id int, text string")
    needles = frame(spark, [(1, "foo bar"), (2, "b"), (3, "z"), (4, "a b c"), (5, "oo")], "item_id int, needle string")
    assert sorted(map(tuple, payloads.holders(docs.where("text IS NOT NULL"), needles).collect())) == [(1, 1), (1, 2), (1, 5), (2, 2), (2, 5), (3, 2), (3, 4), (4, 3)]


def test_preflight(spark):
    x = frame(spark, [(D(2026, 1, 1), "A", None, 1.0), (D(2026, 1, 2), "A", None, None)], "date date, symbol string, f double, label double")
    r = modeling.preflight(x, ["f", "g"], "label", 2).first()
    assert (r.rows, r.labelled, r.missing, r.ready) == (2, 1, "g", False) and r.blockers == ["all_features_null", "missing_columns", "too_few_labelled_rows"]
    assert modeling.preflight(x.withColumn("f", F.lit(1.0)), ["f"], "label").first().ready


def test_exchange_calendar(spark):
    cal = calendars.exchange_calendar(calendars.days_between(spark, "1990-01-01", "2026-12-31"))
    rows = {r.date: r for r in cal.collect()}
    off = lambda y: [d for d, r in sorted(rows.items()) if d.year == y and r.is_holiday]
    # The exchange's published holidays and early closes of some years.
    assert off(2024) == [D(2024, 1, 1), D(2024, 1, 15), D(2024, 2, 19), D(2024, 3, 29), D(2024, 5, 27), D(2024, 6, 19), D(2024, 7, 4), D(2024, 9, 2), D(2024, 11, 28), D(2024, 12, 25)]
    assert off(2021) == [D(2021, 1, 1), D(2021, 1, 18), D(2021, 2, 15), D(2021, 4, 2), D(2021, 5, 31), D(2021, 7, 5), D(2021, 9, 6), D(2021, 11, 25), D(2021, 12, 24)]
    assert off(2022)[0] == D(2022, 1, 17) and D(2022, 6, 20) in off(2022) and D(2022, 12, 26) in off(2022)  # New Year 2022 was a Saturday
    assert [d for d, r in sorted(rows.items()) if d.year == 2024 and r.is_early_close] == [D(2024, 7, 3), D(2024, 11, 29), D(2024, 12, 24)]
    assert {d for d in off(2001) if d.month == 9} == {D(2001, 9, 3), *(D(2001, 9, k) for k in (11, 12, 13, 14))}
    at = lambda *x: dt.datetime(*x)
    assert rows[D(2024, 3, 8)].market_open == at(2024, 3, 8, 14, 30) and rows[D(2024, 3, 11)].market_open == at(2024, 3, 11, 13, 30)  # summer time began on the 10th
    assert rows[D(2024, 11, 29)].market_close == at(2024, 11, 29, 18, 0) and rows[D(2024, 7, 3)].market_close == at(2024, 7, 3, 17, 0)
    assert rows[D(2024, 3, 9)].market_open is None and not rows[D(2024, 3, 9)].is_holiday and rows[D(2024, 3, 9)].session_idx is None
    easter = {1990: D(1990, 4, 15), 1991: D(1991, 3, 31), 2000: D(2000, 4, 23), 2008: D(2008, 3, 23), 2011: D(2011, 4, 24), 2025: D(2025, 4, 20), 1954: D(1954, 4, 18), 1981: D(1981, 4, 19), 2038: D(2038, 4, 25)}
    years = frame(spark, [(y,) for y in easter], "y int")
    assert {r.y: r.d for r in years.select("y", calendars.easter_sunday(F.col("y")).alias("d")).collect()} == easter
    idx = [r.session_idx for _, r in sorted(rows.items()) if r.session_idx is not None]
    assert idx == list(range(len(idx)))


def test_first_tradable_before_the_first_session(spark):
    cal = calendars.trading_hours(calendars.exchange_calendar(calendars.days_between(spark, "2024-01-01", "2024-01-05")))
    e = frame(spark, [(1, dt.datetime(2024, 1, 1, 9)), (2, dt.datetime(2023, 12, 29, 9)), (3, dt.datetime(2024, 1, 2, 21, 0))], "event_id int, ts timestamp_ntz")
    got = {r.event_id: (r.tradable_at, r.entry_session) for r in ev.first_tradable(e, cal, "ts").collect()}
    assert got[1] == got[2] == (dt.datetime(2024, 1, 2, 14, 35), D(2024, 1, 2)) and got[3] == (dt.datetime(2024, 1, 3, 14, 35), D(2024, 1, 3))


def test_range_and_distinct_counts_by_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(5)
    start = dt.datetime(2024, 1, 1)
    facts = [("AB"[int(r.integers(2))], start + dt.timedelta(hours=12 * int(r.integers(0, 240))), [None, "x", "y", "z"][int(r.integers(4))]) for _ in range(150)] + [("A", None, "x")]
    grid = [(D(2024, 1, 1) + dt.timedelta(days=i), s) for i in range(-2, 130) for s in "ABC"]
    windows = {"w1": (1, 0), "w7": (7, 0), "w37": (37, 7)}
    got = asof.range_counts(frame(spark, grid, "date date, symbol string"), frame(spark, facts, "symbol string, at timestamp_ntz, v string"), "symbol", "at", windows, {"d7": ("v", 7), "d40": ("v", 40)}).collect()
    want = {}
    for d, s in grid:
        t = dt.datetime(d.year, d.month, d.day)
        mine = [(a, v) for k, a, v in facts if k == s and a is not None and a <= t]
        if mine:
            near = lambda a, b, mine=mine, t=t: [v for x, v in mine if t - dt.timedelta(days=a) <= x <= t - dt.timedelta(days=b)]
            want[d, s] = (*(len(near(*w)) for w in windows.values()), len(set(near(7, 0))), len(set(near(40, 0))), (t - max(x for x, _ in mine)).days)
    assert {(k.date, k.symbol): (k.w1, k.w7, k.w37, k.d7, k.d40, k.days_since_last) for k in got} == want


def test_range_counts_of_a_busy_key_are_linear(spark):
    facts = spark.range(200_000).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 13).alias("at"), (F.col("id") % 50).cast("string").alias("v"))
    grid = spark.sql("SELECT explode(sequence(DATE '2024-01-02', DATE '2024-02-10')) AS date, 'A' AS symbol")
    asof.range_counts(grid, facts.limit(100), "symbol", "at", {"n": (30, 0)}, {"d": ("v", 7)}).count()
    began = time.time()
    rows = asof.range_counts(grid, facts, "symbol", "at", {"n": (30, 0)}, {"d": ("v", 7)}).collect()
    assert time.time() - began < 30 and len(rows) == 40  # quadratic work took minutes
    assert {k.date: k.n for k in rows}[D(2024, 2, 10)] == sum(1 for i in range(200_000) if 10 * 86400 <= i * 13 <= 40 * 86400) and {k.d for k in rows} <= {0, 50}
