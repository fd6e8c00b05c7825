"""Gates of several families from one rule table, with an oracle that spells every rule out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates
from . import tables as t
from .tables import query, rounded


def _metrics(spark, d):
    """subject, family, metric, value of four families."""
    o, li, s, c = (t.table(spark, d, n) for n in ("orders", "lineitem", "supplier", "customer"))
    study = o.groupBy(F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("subject")).agg(F.count("*").alias("n"), (F.avg("o_totalprice") / 1e7 - 0.02).alias("mean"), (F.median("o_totalprice") / 1e7 - 0.02).alias("median"), F.when(F.count("*") % 2 == 0, F.count("*") / 1e5).alias("q4_minus_q1"))
    back = li.groupBy(F.concat_ws("/", "l_returnflag", F.col("l_suppkey").cast("string")).alias("subject")).agg(F.round(F.avg(F.col("l_discount") - F.col("l_tax")), 6).alias("net_return"), F.sum(F.when(F.col("l_linenumber") == 7, 1).otherwise(0)).alias("cost_total"), F.round(F.avg("l_linenumber") - 2, 6).alias("turnover"))
    model = s.select(F.col("s_suppkey").cast("string").alias("subject"), (F.col("s_acctbal") / 1e5).alias("rank_ic"), (F.col("s_suppkey") % 5 - 1).alias("least_year_ic"), F.when(F.col("s_suppkey") % 3 == 0, 0.2).alias("max_abs_placebo_ic"), (F.col("s_suppkey") % 7 - 2).alias("cost_stress_net_return"), F.when(F.col("s_suppkey") % 4 > 0, 1.0).alias("coverage"))
    paper = c.select(F.col("c_custkey").cast("string").alias("subject"), F.when(F.col("c_custkey") % 9 > 0, F.col("c_acctbal") / 1e5).alias("net_return"), (F.col("c_custkey") % 13 / 100).alias("drawdown"), (F.col("c_custkey") % 4 * 0.9).alias("turnover"))
    parts = [
        gates.long_metrics(study, ["subject"], "event_study", ["n", "mean", "median", "q4_minus_q1"]), gates.long_metrics(back, ["subject"], "backtest", ["net_return", "cost_total", "turnover"]),
        gates.long_metrics(model, ["subject"], "predictive", ["rank_ic", "least_year_ic", "max_abs_placebo_ic", "cost_stress_net_return", "coverage"]), gates.long_metrics(paper, ["subject"], "paper_evidence", ["net_return", "drawdown", "turnover"]),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _verdicts(spark, d):
    return gates.evaluate(_metrics(spark, d), ["subject"], gates.rule_table(spark))


_CASES = """
study AS (SELECT concat_ws('/', o_orderstatus, o_orderpriority) AS subject, count(*) AS n, avg(o_totalprice) / 1e7 - 0.02 AS mean, median(o_totalprice) / 1e7 - 0.02 AS median, CASE WHEN count(*) % 2 = 0 THEN count(*) / 1e5 END AS q FROM orders GROUP BY 1),
back AS (SELECT concat_ws('/', l_returnflag, l_suppkey) AS subject, round(avg(l_discount - l_tax), 6) AS net, sum(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS cost, round(avg(l_linenumber) - 2, 6) AS turnover FROM lineitem GROUP BY 1),
f0 AS (
  SELECT 'event_study' AS family, subject, [CASE WHEN n < 300 THEN 'predictive:sample_size<300' END, CASE WHEN mean <= 0.005 THEN 'predictive:mean_abret_5d_net<=50bps' END, CASE WHEN median <= 0 THEN 'predictive:median_abret_5d_net<=0' END, CASE WHEN q <= 0.0075 THEN 'predictive:q4_minus_q1<=75bps' END] AS f,
    CASE WHEN n < 300 THEN 'COLLECT_MORE_HISTORY' ELSE 'KILL_OR_REWORK' END AS bad, 'CONTINUE' AS good FROM study
  UNION ALL SELECT 'backtest', subject, [CASE WHEN net < 0 THEN 'cost:net_return<0' END, CASE WHEN cost <= 0 THEN 'cost:cost_total<=0' END, CASE WHEN turnover > 2 THEN 'cost:turnover>2' END], 'REJECT', 'SHORTLIST' FROM back
  UNION ALL SELECT 'predictive', CAST(s_suppkey AS VARCHAR), [CASE WHEN s_acctbal / 1e5 < 0.02 THEN 'predictive:rank_ic<0.02' END, CASE WHEN s_suppkey % 5 <= 1 THEN 'stability:not all yearly IC values are positive' END, CASE WHEN s_suppkey % 3 = 0 THEN 'robustness:abs(placebo)>0.1' END,
    CASE WHEN s_suppkey % 7 < 2 THEN 'cost:cost_stress_net_return<0' END, CASE WHEN s_suppkey % 4 = 0 THEN 'robustness:coverage<0.98' END], 'REJECT', 'PROMOTE' FROM supplier
  UNION ALL SELECT 'paper_evidence', CAST(c_custkey AS VARCHAR), [CASE WHEN c_custkey % 9 = 0 OR c_acctbal < 0 THEN 'cost:paper_net_return<0.0' END, CASE WHEN c_custkey % 13 > 5 THEN 'robustness:paper_drawdown>0.05' END, CASE WHEN c_custkey % 4 = 3 THEN 'cost:paper_turnover>2.0' END], 'failing', 'positive' FROM customer),
v AS (SELECT family, subject, list_filter(f, lambda x: x IS NOT NULL) AS f, bad, good FROM f0)
"""


@query(f"""WITH {_CASES}
SELECT family, subject, array_to_string(list_sort(list_transform(f, lambda x: substr(x, strpos(x, ':') + 1))), ',') AS failures, array_to_string(list_sort(f), ',') AS by_objective, CASE WHEN len(f) = 0 THEN good ELSE bad END AS decision, CASE WHEN len(f) = 0 THEN 'PASS' ELSE 'NOT_PROMOTABLE' END AS status FROM v
""")
def agg_41_gate_families(spark, d):
    pairs = F.flatten(F.transform(F.map_entries("by_objective"), lambda e: F.transform(e["value"], lambda f: F.concat(e["key"], F.lit(":"), f))))
    return _verdicts(spark, d).select("family", "subject", F.array_join("failures", ",").alias("failures"), F.array_join(F.array_sort(pairs), ",").alias("by_objective"), "decision", "status")


@query(f"WITH {_CASES} SELECT family, substr(x, 1, strpos(x, ':') - 1) AS objective, substr(x, strpos(x, ':') + 1) AS failure, count(*) AS n FROM (SELECT family, unnest(f) AS x FROM v) GROUP BY ALL")
def agg_42_failures_by_objective(spark, d):
    return gates.failure_counts(_verdicts(spark, d))


@query("""
WITH r AS (SELECT s_suppkey AS run, s_nationkey % 4 AS lane, s_acctbal / 1e5 AS score FROM supplier)
SELECT run, lane, round(score, 8) + 0.0 AS score, CAST(CASE lane WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 0 END AS INTEGER) AS complexity_tier, lane IN (0, 1) AS promotable, round(score - 0.002 * CASE lane WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 ELSE 0 END, 8) + 0.0 AS adjusted_score FROM r
""")
def agg_42_complexity(spark, d):
    lanes = spark.createDataFrame([(0, 1, True), (1, 2, True), (2, 5, False)], "lane bigint, complexity_tier int, promotable boolean")
    runs = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("run"), (F.col("s_nationkey") % 4).cast("bigint").alias("lane"), (F.col("s_acctbal") / 1e5).alias("score"))
    return rounded(gates.adjusted_scores(runs, lanes, 0.002), 8)


@query(f"""WITH {_CASES},
p AS (SELECT CAST(l_suppkey AS VARCHAR) AS run, 'year' AS kind, CAST(year(l_shipdate) AS VARCHAR) AS period, round(avg(l_discount) - 0.048, 8) AS rank_ic FROM lineitem GROUP BY ALL UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 'quarter', year(l_shipdate) || 'Q' || quarter(l_shipdate), round(avg(l_discount) - 0.02, 8) FROM lineitem GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY rank_ic, kind, period) AS rn FROM p), g AS (SELECT run, min(rank_ic) > 0 AS positive, string_agg(kind || ' ' || period, ',' ORDER BY rn) FILTER (rn <= 5) AS worst FROM w GROUP BY 1),
x AS (SELECT v.subject AS run, s_acctbal / 1e5 AS score, s_suppkey % 7 - 2 AS cost, (s_suppkey % 10) / 10.0 AS pbo, list_transform(f, lambda x: substr(x, strpos(x, ':') + 1)) AS f FROM v JOIN supplier ON subject = CAST(s_suppkey AS VARCHAR) WHERE family = 'predictive')
SELECT x.run, CASE WHEN len(f) = 0 THEN 'promotable' WHEN score < 0.05 THEN 'weak_rejected' WHEN cost < 0 OR list_contains(f, 'cost_stress_net_return<0') THEN 'strong_cost_failed' WHEN list_contains(f, 'abs(placebo)>0.1') THEN 'strong_robustness_failed'
  WHEN NOT coalesce(positive, false) THEN 'strong_unstable' WHEN pbo > 0.5 THEN 'strong_overfit_risk' ELSE 'weak_rejected' END AS classification, coalesce(worst, '') AS worst FROM x LEFT JOIN g ON g.run = x.run
""")
def agg_42_autopsies(spark, d):
    li, key = t.table(spark, d, "lineitem"), F.col("l_suppkey").cast("string").alias("run")
    by = lambda kind, period, less: li.groupBy(key, F.lit(kind).alias("kind"), period.alias("period")).agg(F.round(F.avg("l_discount") - less, 8).alias("rank_ic"))
    periods = by("year", F.year("l_shipdate").cast("string"), 0.048).unionByName(by("quarter", F.concat(F.year("l_shipdate"), F.lit("Q"), F.quarter("l_shipdate")), 0.02))
    runs = t.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("run"), (F.col("s_acctbal") / 1e5).alias("score"), (F.col("s_suppkey") % 7 - 2).cast("double").alias("cost_net"), (F.col("s_suppkey") % 10 / 10).alias("pbo"), F.lit(None).cast("double").alias("cpcv_mean"))
    verdicts = _verdicts(spark, d).where("family = 'predictive'").withColumnRenamed("subject", "run")
    x = gates.autopsies(runs, verdicts, periods, "run")
    return x.select("run", "classification", F.array_join(F.transform("worst", lambda w: F.concat_ws(" ", w["kind"], w["period"])), ",").alias("worst"))
