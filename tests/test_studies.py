"""Gates, study packets, variants, months of inputs and validation reports against hand-made cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates, modeling, studies, validation
from tidemark.sources import payloads, tables

D = dt.date


def test_gates_from_one_table(spark):
    rows = [
        ("good", "event_study", "n", 400.0), ("good", "event_study", "mean", 0.01), ("good", "event_study", "median", 0.001), ("few", "event_study", "n", 20.0), ("few", "event_study", "mean", -1.0), ("none", "event_study", "n", 0.0),
        ("bare", "rework_variant", "n", 100.0), ("a", "backtest", "net_return", 0.1), ("a", "backtest", "cost_total", 0.0), ("a", "backtest", "turnover", None), ("x", "no_such_family", "n", 1.0),
        ("p", "predictive", "rank_ic", 0.03), ("p", "predictive", "least_year_ic", 0.01), ("p", "predictive", "coverage", 0.99), ("p", "predictive", "pbo", float("nan")),
    ]
    rules = gates.rule_table(spark)
    got = {(r.subject, r.family): r for r in gates.evaluate(spark.createDataFrame(rows, "subject string, family string, metric string, value double"), ["subject"], rules).collect()}
    assert len(got) == 6
    good, few, none = got["good", "event_study"], got["few", "event_study"], got["none", "event_study"]
    assert (good.decision, good.status, good.failures) == ("CONTINUE", "PASS", [])
    assert few.decision == "COLLECT_MORE_HISTORY" and few.failures == ["mean_abret_5d_net<=50bps", "sample_size<300"] and few.status == "NOT_PROMOTABLE"
    assert none.decision == "BLOCKED_DATA_COVERAGE" and none.failures == ["sample_size<300"]
    assert got["bare", "rework_variant"].failures == ["mean_abret_5d_net<=50bps", "mechanical_acquisition_codes_separation<=75bps", "median_abret_5d_net<=0", "sales_placebo_separation<=75bps"]
    assert got["bare", "rework_variant"].by_objective["false_discovery"] == ["mechanical_acquisition_codes_separation<=75bps", "sales_placebo_separation<=75bps"]
    assert got["a", "backtest"].failures == ["cost_total<=0"] and got["a", "backtest"].decision == "REJECT"
    assert got["p", "predictive"].decision == "PROMOTE"
    n = {(r.family, r.objective, r.failure): r.n for r in gates.failure_counts(gates.evaluate(spark.createDataFrame(rows, "subject string, family string, metric string, value double"), ["subject"], rules)).collect()}
    assert n["event_study", "predictive", "sample_size<300"] == 2


def test_autopsies(spark):
    runs = [("weak", 0.01, 1.0, None, None), ("cost", 0.1, -1.0, None, None), ("robust", 0.1, 1.0, None, None), ("unstable", 0.1, 1.0, None, None), ("overfit", 0.1, 1.0, 0.9, None), ("other", 0.1, 1.0, 0.1, 0.1), ("fine", 0.1, 1.0, 0.9, -1.0), ("infra", 0.1, 1.0, None, None)]
    verdicts = [(r, [f]) for r, f in (("weak", "dsr<1"), ("cost", "dsr<1"), ("robust", "abs(placebo)>0.1"), ("unstable", "dsr<1"), ("overfit", "dsr<1"), ("other", "dsr<1"), ("infra", "report.missing"))]
    periods = [(r[0], "year", str(y), (0.01 if r[0] != "unstable" or y != 2021 else -0.02) + y / 1e6) for r in runs for y in range(2018, 2026)]
    got = {
        r.run: r
        for r in gates.autopsies(
            spark.createDataFrame(runs, "run string, score double, cost_net double, pbo double, cpcv_mean double"), spark.createDataFrame(verdicts, "run string, failures array<string>"), spark.createDataFrame(periods, "run string, kind string, period string, rank_ic double"), "run"
        ).collect()
    }
    assert {k: v.classification for k, v in got.items()} == {
        "weak": "weak_rejected", "cost": "strong_cost_failed", "robust": "strong_robustness_failed", "unstable": "strong_unstable", "overfit": "strong_overfit_risk", "other": "weak_rejected", "fine": "promotable", "infra": "infra_invalid",
    }
    assert [w.period for w in got["unstable"].worst] == ["2021", "2018", "2019", "2020", "2022"]
    lanes = spark.createDataFrame([("a", 3, True)], "lane string, complexity_tier int, promotable boolean")
    x = {r.lane: r for r in gates.adjusted_scores(spark.createDataFrame([("a", 0.5), ("b", 0.5)], "lane string, score double"), lanes, 0.01).collect()}
    assert x["a"].adjusted_score == pytest.approx(0.47) and x["b"].adjusted_score == 0.5 and not x["b"].promotable


def test_study_packet(spark):
    rows = [(f, f"{f}{i}", float(i), "LABELED" if i % 10 else "PARTIAL", (i % 7 - 2) / 100 + shift, i / 1000 + shift) for f, shift in (("primary", 0.02), ("sales_placebo", 0.0)) for i in range(1, 401)]
    labels = spark.createDataFrame([(*r, r[4], r[5]) for r in rows], "family string, event_id string, strength double, label_status string, ret_1d_net double, abret_1d_net double, ret_5d_net double, abret_5d_net double")
    got = {(r.family, r.horizon, r.kind): r for r in studies.study_packet(labels, (1, 5), gates.rule_table(spark), iterations=50).collect()}
    assert len(got) == 8
    p, c = got["primary", 5, "abnormal_net"], got["sales_placebo", 5, "abnormal_net"]
    assert p.n == 360 and p.ci_low < p.mean < p.ci_high and c.mean_difference == pytest.approx(0.02) and p.mean_difference is None and c.decision is None
    assert p.q4_minus_q1 == pytest.approx(0.3, abs=0.01) and p.decision == "CONTINUE" and p.failures == []
    kept = [r for r in rows if r[0] == "primary" and r[3] == "LABELED"]
    assert p.mean == pytest.approx(sum(r[5] for r in kept) / 360) and p.hit_rate == 1.0


def test_variants_stand_on_the_clean_base(spark):
    base = dict(eligible=True, days_to_report=1, flags=[], exclusion_reasons=[], n_officers=0, n_directors=0, chief_buy=False, n_insiders=1, n_strict=1, total_value=1.0)
    cases = [dict(), dict(eligible=False), dict(days_to_report=3), dict(days_to_report=None), dict(flags=["mixed_p_and_s"]), dict(exclusion_reasons=["otc_symbol"]), dict(n_officers=2), dict(n_directors=1), dict(chief_buy=True), dict(n_insiders=2), dict(n_strict=3), dict(total_value=50.0), dict(total_value=90.0, eligible=False), dict(total_value=None)]
    kind = "eligible boolean, days_to_report int, flags array<string>, exclusion_reasons array<string>, n_officers int, n_directors int, chief_buy boolean, n_insiders int, n_strict int, total_value double, i int"
    df = spark.createDataFrame([(*{**base, **c}.values(), i) for i, c in enumerate(cases)], kind)
    got = {r.i: r.variants[1:] for r in studies.variants(df).collect()}
    q4 = "large_purchase_q4"  # the edge of the clean ones is 1.0
    assert got == {0: [q4], 6: ["officer_director_only", q4], 7: ["officer_director_only", q4], 8: ["ceo_cfo_only", q4], 9: ["clustered_buyers", q4], 10: ["clustered_buyers", q4], 11: [q4], 13: []}
    assert studies.variants(df.where("false")).count() == 0


def test_months_of_inputs(spark):
    day = lambda *d: spark.createDataFrame([(x,) for x in d], "date date")
    inputs = {"eligible": day(D(2024, 1, 5), D(2024, 1, 6), D(2024, 4, 1)), "labeled": day(D(2024, 1, 9)), "bars": day(D(2023, 12, 1), D(2024, 1, 1), D(2024, 4, 2), D(2024, 5, 2), None)}
    m = studies.monthly_matrix(inputs)
    got = {r.month: (r.n_eligible, r.n_labeled, r.n_bars, r.coverage) for r in m.collect()}
    assert got == {D(2023, 12, 1): (0, 0, 1, "NO_EVENTS"), D(2024, 1, 1): (2, 1, 1, "PARTIAL"), D(2024, 2, 1): (0, 0, 0, "NO_INPUT"), D(2024, 3, 1): (0, 0, 0, "NO_INPUT"), D(2024, 4, 1): (1, 0, 1, "UNLABELED"), D(2024, 5, 1): (0, 0, 1, "NO_EVENTS")}
    gaps = sorted((r["input"], r["first"], r["last"], r["months"]) for r in studies.month_gaps(m, ["bars", "eligible"]).collect())
    assert gaps == [("bars", D(2024, 2, 1), D(2024, 3, 1), 2), ("eligible", D(2023, 12, 1), D(2023, 12, 1), 1), ("eligible", D(2024, 2, 1), D(2024, 3, 1), 2), ("eligible", D(2024, 5, 1), D(2024, 5, 1), 1)]


def test_matured_pnl(spark):
    days = [D(2024, 1, k) for k in (2, 3, 4, 5, 8)]
    bars = spark.createDataFrame([(d, s, float(p + i)) for i, d in enumerate(days) for s, p in (("A", 100), ("B", 50), ("SPY", 400)) if (s, i) != ("B", 2)], "date date, symbol string, close double")
    w = spark.createDataFrame([(days[0], "A", 0.5), (days[0], "B", 0.25), (days[2], "A", 1.0), (days[4], "A", 1.0), (D(2024, 1, 6), "A", 0.1)], "date date, symbol string, target_weight double")
    got = {r.date: r for r in validation.matured_pnl(w, bars, 2, "SPY").collect()}
    first, second = got[days[0]], got[days[2]]
    assert first.status == "available" and first.mature_date == days[2] and first.positions == 2 and first.available_future_dates == 4
    assert first.gross_return == pytest.approx(0.5 * 0.02) and first.turnover == 0.75 and first.cost_drag == pytest.approx(0.75 * 5e-4) and first.net_return == pytest.approx(0.01 - 0.000375) and first.max_drawdown == 0  # B has no close on the mature date
    assert first.benchmark_return == pytest.approx(0.005) and first.excess_return == pytest.approx(0.01 - 0.000375 - 0.005) and second.mature_date == days[4]
    pending = got[days[4]]
    assert pending.status == "pending_labels" and pending.available_future_dates == 0 and pending.required_future_dates == 2 and pending.net_return is None and pending.mature_date is None
    assert got[D(2024, 1, 6)].available_future_dates == 1 and got[D(2024, 1, 6)].status == "pending_labels"


def test_sign_flip_prefers_the_better_direction(spark):
    rows = [(D(2020 + k % 2, 1, 1 + k // 2 % 28), f"S{s}", float(s), float(-s) + (k % 3) / 10) for k in range(56) for s in range(20)]
    got = validation.sign_flip_canary(spark.createDataFrame(rows, "date date, symbol string, p double, l double"), "p", "l").collect()
    assert {r.preferred for r in got} == {"flipped"} and len(got) == 6
    by = {(r["sign"], r["year"]): r for r in got}
    assert by["original", None].rank_ic == pytest.approx(-by["flipped", None].rank_ic) and by["original", None].mean_spread == pytest.approx(-18, abs=0.5) and by["flipped", 2020].mean_spread is None


def test_relabels_only_promotable_types(spark):
    rows = [("CUSTOMER_LOSS", "no"), ("CUSTOMER_LOSS", "unknown"), ("CUSTOMER_LOSS", None), ("CUSTOMER_LOSS", "yes"), ("NEEDS_REVIEW", "no"), (None, "no")]
    got = [(r.event_type, r.warning) for r in modeling.relabeled(spark.createDataFrame(rows, "event_type string, is_material_candidate string"), payloads.PROMOTABLE_TYPES).collect()]
    assert [g[0] for g in got] == ["ROUTINE_NO_EVENT", "NEEDS_REVIEW", "NEEDS_REVIEW", "CUSTOMER_LOSS", "NEEDS_REVIEW", None]
    assert got[0][1] == "normalized_promotable_not_material:CUSTOMER_LOSS->ROUTINE_NO_EVENT:material=no" and got[3][1] is None and got[4][1] is None


def test_partition_report(spark, tmp_path):
    root = str(tmp_path / "a")
    spark.createDataFrame([("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-02", 3)], "date string, v int").repartition(1).write.partitionBy("date").parquet(root)
    (tmp_path / "a" / "date=2024-01-03").mkdir()
    (tmp_path / "a" / "date=2024-01-03" / "part-0.parquet").write_text("not parquet")
    (tmp_path / "a" / "date=2024-01-02" / "part-9.parquet").write_text("not parquet")
    expected = spark.createDataFrame([("2024-01-01",), ("2024-01-05",)], "part string")
    got = {(r.root == root, r.part): (r.files, r.read_files, r.rows, r.status) for r in tables.partition_report(spark, [root, str(tmp_path / "none")], spark.createDataFrame([], "v int").schema, expected=expected).collect()}
    assert got == {
        (True, "2024-01-01"): (1, 1, 2, "read"), (True, "2024-01-02"): (2, 1, 1, "partly"), (True, "2024-01-03"): (1, 0, 0, "skipped"), (True, "2024-01-05"): (0, 0, 0, "missing"), (False, "2024-01-01"): (0, 0, 0, "missing"), (False, "2024-01-05"): (0, 0, 0, "missing"),
    }


def test_pooled_buckets_and_dependence(spark):
    rows = [(D(2024, 1, 1 + i % 25), f"S{i}", float(i // 3), float(i % 2) + i) for i in range(103)]
    df = spark.createDataFrame(rows, "date date, symbol string, s double, l double")
    got = sorted(validation.pooled_buckets(df, "s", "l", parts=7).collect())
    order = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    want: dict = {}
    for k, r in enumerate(order):
        want.setdefault(max(0, -(-k * 10 // 102) - 1) + 1, []).append(r[3])
    assert [(g.bucket, g.n, pytest.approx(g.mean_label)) for g in got] == [(b, len(v), sum(v) / len(v)) for b, v in sorted(want.items())]
    assert got[0].spread == pytest.approx(got[-1].mean_label - got[0].mean_label) and got[0].hit_rate == 1.0
    dep = {r.feature: r for r in validation.feature_dependence(df.withColumn("none", F.lit(None).cast("double")), ["s", "none"], "l", 2.0).collect()}
    assert dep["none"].rank_ic == 0 and dep["s"].rank == 1 and dep["s"].score_drop == pytest.approx(dep["s"].abs_ic / 2) and dep["none"].ablation_ratio == pytest.approx(1 - dep["s"].abs_ic / 2)
