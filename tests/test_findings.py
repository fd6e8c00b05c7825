"""Queries at the sizes and on the inputs that a reviewer found them to fail at, made small."""

from __future__ import annotations

import math

import duckdb
import pytest

from tidemark.plans import ORACLE, QUERIES


@pytest.fixture
def tables(spark, tmp_path):
    """Writes a table and gives the folder."""

    def write(**frames) -> str:
        for name, df in frames.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_the_best_run_is_that_of_sql_for_keys_beyond_a_hundred_thousand(spark, tables):
    d = tables(customer=spark.createDataFrame([(250_000, 100.0, "A"), (1, 100.01, "A"), (2, 50.0, "A"), (300_000, -5.0, "B")], "c_custkey bigint, c_acctbal double, c_mktsegment string"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{d}/customer.parquet/*.parquet'")
    want = con.execute(f"SELECT c_mktsegment, n_runs, best_run, best_score, lead FROM ({ORACLE['agg_38_39_experiments']}) ORDER BY 1").fetchall()
    got = QUERIES["agg_38_39_experiments"](spark, d).select("c_mktsegment", "n_runs", "best_run", "best_score", "lead").orderBy("c_mktsegment").collect()
    assert [tuple(r) for r in got] == want
    assert got[0]["best_run"] == 250_000


def test_features_by_symbol_equal_the_windows_they_stand_for(spark):
    """Nulls, zeros, NaN, constant prices, short symbols: the same as the operators composed."""
    import datetime as dt

    import random

    from tidemark.operators import panel

    rnd, rows = random.Random(3), []
    for s in range(6):
        for i in range({0: 5, 1: 21}.get(s, 150)):
            close = 7.0 if s == 2 else rnd.uniform(1, 9)
            if s == 3 and i in (40, 90):
                close = None if i == 40 else 0.0
            if s == 4 and i == 30:
                close = math.nan
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(i), s, None if s == 5 and i == 9 else rnd.uniform(1, 9), close, 0 if s == 5 and i == 50 else rnd.randrange(1, 99)))
    bars = spark.createDataFrame(rows, "date date, symbol int, open double, close double, volume bigint")
    x = panel.idiosyncratic_vol(bars).drop("mkt_ret", "residual", "ret_1d")
    x = panel.liquidity(x).drop("dollar_volume", "illiquidity", "ret_1d")
    x = panel.lagged(panel.realized_vol(panel.overnight_gap(panel.drawdown(panel.reversal(panel.momentum(x))))), panel.FEATURES).select("date", "symbol", *panel.FEATURES)
    plain = lambda df: [tuple("null" if v is None else "nan" if isinstance(v, float) and math.isnan(v) else f"{v + 0.0:.9f}" if isinstance(v, float) else v for v in r) for r in df.orderBy("symbol", "date").collect()]
    assert plain(panel.build_features(bars)) == plain(x)


def test_ranks_take_no_sort_for_each_column(spark):
    from tidemark.operators import panel

    df = spark.createDataFrame([("d", i, float(i % 3), None if i == 4 else math.nan if i == 2 else -float(i)) for i in range(6)], "date string, symbol int, a double, b double")
    x = panel.rank_normalize(df, ["a", "b"])
    assert x._jdf.queryExecution().sparkPlan().toString().count("Window") == 0
    got = {r["symbol"]: (r["a"], r["b"]) for r in x.collect()}
    assert got[0][0] == got[3][0] == 2 * 1.5 / 6 - 1 and got[4][1] == 0.0 and got[2][1] == 1.0


def test_parts_of_documents_parse_as_in_the_whole_and_once(spark):
    from pyspark.sql import functions as F

    from tidemark.sources import ownership

    note, owner = '<footnotes><footnote id="F1"> a\n b </footnote></footnotes>', "<reportingOwner><reportingOwnerId><rptOwnerCik>7</rptOwnerCik></reportingOwnerId></reportingOwner>"
    texts = [
        f"<SEC>é</ownershipDocument><ownershipDocument>{note}{owner}</ownershipDocument><ownershipDocument>{owner}</ownershipDocument>", f'x<ownershipDocument a="1">{owner}{owner}{note}</ownershipDocument>é', f"<ownershipDocument>{note}",
        f"<ownershipDocument>{owner}<remarks></b>{note}</ownershipDocument>", "", None, "no document", f"<ownershipDocument>{owner}<nonDerivativeTable/><footnotes/></ownershipDocument>",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, xml string")
    whole = df.select("k", F.from_xml(F.regexp_extract("xml", r"(?s)(<ownershipDocument.*?</ownershipDocument>)", 1), "struct<" + ", ".join(f"{f}: {kind}" for f, kind in ownership._FIELDS.items()) + ">").alias("doc"))
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(ownership.parsed(df, ["k"], "xml")) == rows(whole)
    assert rows(ownership.owners(ownership.parsed(df, ["k"], "xml", ("reportingOwner",)), ["k"])) == rows(ownership.owners(whole, ["k"]))
    assert rows(ownership.footnotes(ownership.parsed(df, ["k"], "xml", ("footnotes",)), ["k"])) == rows(ownership.footnotes(whole, ["k"]))
    made = ownership.submissions(ownership.parsed(df, ["k"], "xml"), ["k"])
    assert rows(made) == rows(ownership.submissions(whole, ["k"]))
    assert made._jdf.queryExecution().executedPlan().toString().count("from_xml") + made._jdf.queryExecution().executedPlan().toString().count("xmltostructs") == 1


def test_co_moments_of_many_columns_take_a_short_plan(spark):
    """one condition on 19 columns had 2 ** 19 forms for the optimizer."""
    from tidemark.operators import moments

    names = [f"c{i}" for i in range(19)]
    rows = [(1, *(float(i * k % 7) for i in range(19))) for k in range(40)] + [(1, *([None] + [1.0] * 18)), (1, *([1.0] * 18 + [math.nan]))]
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"{c} double" for c in names))
    x = moments.co_moments(df, names[:15], names[15:], ["g"])
    plan = x._jdf.queryExecution().optimizedPlan()
    sizes = []
    while plan.children().size():
        sizes.append(plan.constraints().size())
        plan = plan.children().head()
    assert max(sizes) < 1000
    assert [r["n"] for r in x.collect()] == [40]


def test_co_moments_of_tasks_without_rows(spark):
    """a task that got no row, or only rows with nulls, failed."""
    from tidemark.operators import moments

    assert len(moments._Held(2, 1).frame(["g"])) == 0
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, 2.0, 1.0, 5.0), (2, None, 1.0, 5.0)], "g int, a double, b double, y double").repartition(4, "g")
    got = {r["g"]: r["n"] for r in moments.co_moments(df, ["a", "b"], ["y"], ["g"]).collect()}
    assert got == {1: 1, 2: 1}


def test_mean_ranks_of_frequent_values_need_no_window_of_them(spark):
    """ranks by ranges of values equal plain ones, with ties, NaN, infinities and groups unlike one another."""
    import random

    from tidemark.functions.columns import with_mean_ranks
    from tidemark.operators import panel

    rnd = random.Random(5)
    odd = [math.nan, math.inf, -math.inf, -0.0, 0.0]
    rows = [(g, rnd.choice([0.0, 0.0, 7.0, rnd.gauss(0, 1), rnd.choice(odd)]) * (1 if g else 1e-9), float(rnd.randrange(30)) if g else rnd.gauss(0, 1)) for g in (0, 1, None) for _ in range(700)] + [(2, 1.0, 1.0), (3, math.nan, 1.0)]
    df = spark.createDataFrame(rows, "g int, p double, l double").localCheckpoint()
    x = with_mean_ranks(df, {"p": "rp", "l": "rl"}, ("g",), 8)
    want = panel.average_rank
    y = df.select("*", want(df["p"], "g").alias("rp"), want(df["l"], "g").alias("rl"))
    plain = lambda t: sorted(str(tuple(r)) for r in t.select("g", "p", "l", "rp", "rl").collect())
    assert plain(x) == plain(y)
    assert plain(with_mean_ranks(df, {"p": "rp", "l": "rl"}, (), 8)) == plain(df.select("*", want(df["p"]).alias("rp"), want(df["l"]).alias("rl")))
    windows = with_mean_ranks(df, {"p": "rp"}, ("g",), 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "_spread" in windows


def test_bootstrap_hashes_an_event_once_for_all_its_groups(spark):
    """the weights equal those of unit_hash, from one hash an event and iteration."""
    from pyspark.sql import functions as F

    from tidemark.functions.columns import unit_hash
    from tidemark.operators import filing_events as ev

    df = spark.createDataFrame([(g, f"e{i}", float(i * (2 if g == "a" else 3) % 11)) for g in "ab" for i in range(9)], "g string, event_id string, v double")
    got = ev.bootstrap_ci(df, "v", ["g"], 40)
    x = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("u", unit_hash(F.lit(7), F.col("event_id"), F.col("i")))
    x = x.withColumn("w", sum((F.col("u") > p).cast("int") for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)))
    want = x.groupBy("g", "i").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m")).groupBy("g").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    assert sorted((r[0], round(r[1], 9), round(r[2], 9)) for r in got.collect()) == sorted((r[0], round(r[1], 9), round(r[2], 9)) for r in want.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and "lambda" not in plan


@pytest.mark.parametrize("name", ["agg_13_month_gaps", "snk_07_artifacts"])
def test_bars_are_made_once(spark, monkeypatch, name):
    """F21, F22."""
    from tidemark.plans import tables as t

    made, plain = [], t.bars
    monkeypatch.setattr(t, "bars", lambda *a: made.append(1) or plain(*a))
    QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_the_modeling_table_moves_wide_rows_once(spark):
    """features by symbol, then ranks and labels by date; features don't move again to meet labels."""
    plan = QUERIES["mod_06_join_02_modeling_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 2 and "hashpartitioning(symbol" not in plan and "SortMergeJoin" not in plan


def test_the_modeling_table_of_odd_bars_equals_ranks_joined_to_labels(spark):
    """nulls, zeros, dates that are no session, symbols without a name or with few rows."""
    import datetime as dt
    import random

    from tidemark.operators import modeling, panel

    rnd, rows = random.Random(4), []
    for s in (1, 2, 3, 4, 5, None):
        for i in range({4: 9}.get(s, 190)):
            close = 0.0 if s == 2 and i == 80 else None if s == 3 and i == 100 else rnd.choice([5.0, rnd.uniform(1, 9)])
            if rnd.random() < 0.9:
                rows.append((dt.date(2020, 1, 1) + dt.timedelta(i), s, rnd.uniform(1, 9), close, rnd.randrange(1, 99)))
    bars = spark.createDataFrame(rows, "date date, symbol int, open double, close double, volume bigint")
    days = panel.sessions(bars.select("date"))
    want = panel.rank_normalize(panel.build_features(bars), panel.FEATURES).join(panel.mature(panel.build_labels(bars, days), "label_5d", "2020-06-01"), ["date", "symbol"])
    plain = lambda df: sorted(tuple(f"{v + 0.0:.9f}" if isinstance(v, float) else str(v) for v in r) for r in df.select("date", "symbol", *panel.FEATURES, "target_date", "raw_forward_return_5d", "label_5d").collect())
    got = plain(modeling.modeling_table(bars, days, 5, "2020-06-01"))
    assert got == plain(want) and len(got) > 500


def _tables_written(spark, monkeypatch, f) -> dict:
    """Columns of the tables that f writes, by name."""
    from tidemark.operators import modeling, panel, validation
    from tidemark.plans import model_queries, ridge_queries
    from tidemark.sources import folders

    seen, plain = [], folders.written
    for module in (modeling, panel, validation, model_queries, ridge_queries):
        if hasattr(module, "written"):
            monkeypatch.setattr(module, "written", lambda df, name: seen.append((name, len(df.columns))) or plain(df, name))
    f()
    return dict(seen)


def test_ridge_folds_write_no_features_again(spark, monkeypatch):
    """the features were written as panel and as test rows, and moved with the labels' ranks."""
    from tidemark.plans import QUERIES

    seen = _tables_written(spark, monkeypatch, lambda: QUERIES["mod_09_ridge_all_features"](spark, "/root/testdata/sf0.001"))
    assert [n for n, columns in seen.items() if columns > 15] == ["modeling"]


def test_permuted_labels_move_without_features(spark, monkeypatch):
    """the features were written with their rows' numbers and moved for each seed."""
    from tidemark.operators import validation

    df = spark.range(400).selectExpr("date_add(DATE '2020-01-01', CAST(id div 8 AS INT)) AS date", "CASE WHEN id % 8 > 0 THEN id % 8 END AS symbol", "CAST(id AS DOUBLE) AS y", *(f"CAST(id * {i} AS DOUBLE) AS f{i}" for i in range(15)))
    out = []
    seen = _tables_written(spark, monkeypatch, lambda: out.append(validation.placebo_labels(df, "y", [1, 2, 3], 100)))
    assert seen["numbered"] == 4
    rows = out[0].collect()
    assert len(rows) == 400 and all(r["f3"] == 3 * r["y"] for r in rows) and all(sorted(r[f"placebo_{s}"] for r in rows) == [float(i) for i in range(400)] for s in (1, 2, 3))


def test_trees_write_no_features_again(spark, monkeypatch):
    """the matrix was written twice, and the features once more with the predictions of each setting."""
    import datetime as dt

    from tidemark.operators import modeling, validation

    rows = [(dt.date(2020, 1, 1) + dt.timedelta(k), s, float((k * 7 + s * 3) % 11), float((k * 7 + s * 3) % 11 > 5)) for k in range(30) for s in range(4)]
    df = spark.createDataFrame(rows, "date date, symbol int, f double, y double").persist()
    folds, out = validation.walk_forward_folds(df, 15, 15), []
    seen = _tables_written(spark, monkeypatch, lambda: out.append(modeling.tuned_trees(df, folds, ["f"], "y", [{"rounds": 1, "depth": 1}])))
    assert "matrix" not in seen and "f" not in out[0][1].columns
    assert sorted((r.date, r.symbol) for r in out[0][1].collect()) == sorted((r[0], r[1]) for r in rows[60:])


def test_trees_have_the_rounds_of_the_study():
    """F8: three and five rounds were fitted, of depth two and three."""
    import inspect

    from tidemark.operators import modeling
    from tidemark.plans import model_queries

    plain = {k: p.default for k, p in inspect.signature(modeling.boosted_trees).parameters.items()}
    assert plain["rounds"] == 100 and plain["depth"] == 5
    assert len(model_queries._TREES) > 1 and all(g["rounds"] == 100 and g["depth"] == 5 for g in model_queries._TREES)


def test_ownership_documents_move_as_plain_columns(spark):
    """the texts of lines and owners moved by order; and submissions parsed fields that they don't read."""
    from tidemark.sources import ownership

    for name in ("src_15_submissions", "src_15_transactions"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "nonDerivativeTransaction" not in plan[plan.index("RepartitionByExpression [l_orderkey") :] and plan.count("from_xml") == 1
        assert ("transactionShares,StructType" in plan) == (name == "src_15_transactions")
    df = spark.createDataFrame([(1, "<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerCik>7</rptOwnerCik><rptOwnerName>N</rptOwnerName></reportingOwnerId></reportingOwner><remarks>r</remarks></ownershipDocument>"), (2, "<ownershipDocument><remarks></b></ownershipDocument>"), (3, None)], "k int, xml string")
    rows = lambda fields: sorted(map(str, ownership.submissions(ownership.parsed(df, ["k"], "xml", *fields), ["k"]).collect()))
    assert rows(()) == rows((ownership.SUBMISSION,))
