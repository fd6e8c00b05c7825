"""Study packets, variants and monthly inputs, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filing_events as ev
from ..operators import gates, studies
from ..sources.folders import written
from . import tables as t
from .study_queries import _CANDIDATES, _LABELS, _UNIT, _candidates, _labels
from .tables import query, rounded

_ITERATIONS = 100
_FAMILIES = """q AS (SELECT 'primary' AS family, event_id, strength, issuer % 100 AS symbol, accepted_at AS tradable_at, CAST(accepted_at AS DATE) AS d0 FROM candidates WHERE len(exclusion_reasons) = 0
  UNION ALL SELECT family, 'ctl_' || substr(sha256(family || '|' || accession), 1, 16), ln(1 + coalesce(total_value, 0)), issuer % 100, accepted_at, CAST(accepted_at AS DATE)
  FROM (SELECT CASE WHEN code = 'S' THEN 'sales_placebo' ELSE 'mechanical_acquisition_codes' END AS family, accession, issuer, accepted_at, CAST(sum(CAST(shares * price AS DECIMAL(38,6))) AS DOUBLE) AS total_value FROM transactions WHERE code IN ('A', 'M', 'F', 'S') GROUP BY 1, 2, 3, 4)),"""
_OF_ALL = _LABELS.replace(_LABELS[_LABELS.index("q AS (") : _LABELS.index("en AS (")], _FAMILIES + "\n").replace("any_value(strength) AS strength", "any_value(strength) AS strength, any_value(family) AS family")


def _family_labels(spark, d):
    c = _candidates(spark, d).where("eligible").select(F.lit("primary").alias("family"), "event_id", "strength", "issuer", "accepted_at")
    k = ev.control_events(t.transactions(spark, d)).withColumn("family", F.when(F.col("family") == "sales", gates.CONTROLS[1]).otherwise(gates.CONTROLS[0]))
    event_id = F.concat(F.lit("ctl_"), F.substring(F.sha2(F.concat_ws("|", "family", F.col("accession").cast("string")), 256), 1, 16))
    k = k.select("family", event_id.alias("event_id"), F.log1p(F.coalesce("total_value", F.lit(0.0))).alias("strength"), "issuer", "accepted_at")
    events = written(c.unionByName(k), "study_events")
    b = written(t.bars(spark, d).select("date", "symbol", "open", "close"), "bars")
    x = ev.event_labels(events.select("event_id", (F.col("issuer") % 100).alias("symbol"), F.col("accepted_at").alias("tradable_at")), b, t.panel.sessions(b.select("date")), (1, 5), 0.005, b.groupBy("date").agg(F.avg("close").alias("close")))
    return x.join(events.select("event_id", "family", "strength"), "event_id")


@query(f"""WITH {_CANDIDATES}, {_OF_ALL},
x AS MATERIALIZED (SELECT family, event_id, strength, k.h AS horizon, k.kind, k.v FROM (SELECT * FROM done WHERE len(blockers) = 0), LATERAL (VALUES (1, 'net', ret_1d_net), (1, 'abnormal_net', abret_1d_net), (5, 'net', ret_5d_net), (5, 'abnormal_net', abret_5d_net)) k(h, kind, v) WHERE k.v IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY family, horizon, kind ORDER BY abs(v) DESC, event_id) AS rn FROM x),
s AS (SELECT family, horizon, kind, count(*) AS n, avg(v) AS mean, median(v) AS median, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, sum(abs(v)) FILTER (rn <= 5) / sum(abs(v)) AS top5_share FROM r GROUP BY ALL),
bw AS (SELECT family, horizon, kind, i, v, {_UNIT.format("'7|' || event_id || '|' || i")} AS u FROM x CROSS JOIN (SELECT unnest(generate_series(1, {_ITERATIONS})) AS i)),
bm AS (SELECT family, horizon, kind, i, sum(w * v) / nullif(sum(w), 0) AS m FROM (SELECT *, (u > 0.36787944)::INT + (u > 0.73575888)::INT + (u > 0.91969860)::INT + (u > 0.98101184)::INT + (u > 0.99634015)::INT + (u > 0.99940582)::INT + (u > 0.99991676)::INT AS w FROM bw) GROUP BY ALL),
ci AS (SELECT family, horizon, kind, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM bm GROUP BY ALL),
e AS (SELECT family, horizon, kind, quantile_cont(strength, [0.25, 0.5, 0.75]) AS e FROM x GROUP BY ALL),
qs AS (SELECT family, horizon, kind, avg(v) FILTER (strength <= e[1]) AS q1, avg(v) FILTER (strength > e[3]) AS q4 FROM x JOIN e USING (family, horizon, kind) GROUP BY ALL),
p AS (SELECT s.*, ci_low, ci_high, q4 - q1 AS spread, CASE WHEN family <> 'primary' THEN (SELECT mean FROM s z WHERE z.family = 'primary' AND z.horizon = s.horizon AND z.kind = s.kind) - mean END AS diff FROM s JOIN ci USING (family, horizon, kind) LEFT JOIN qs USING (family, horizon, kind)),
g AS (SELECT p.*, list_filter([CASE WHEN mean <= 0.005 THEN 'mean_abret_5d_net<=50bps' END, CASE WHEN (SELECT diff FROM p z WHERE z.family = 'mechanical_acquisition_codes' AND z.horizon = p.horizon AND z.kind = p.kind) <= 0.0075 THEN 'mechanical_acquisition_codes_separation<=75bps' END,
  CASE WHEN median <= 0 THEN 'median_abret_5d_net<=0' END, CASE WHEN spread <= 0.0075 THEN 'q4_minus_q1<=75bps' END, CASE WHEN (SELECT diff FROM p z WHERE z.family = 'sales_placebo' AND z.horizon = p.horizon AND z.kind = p.kind) <= 0.0075 THEN 'sales_placebo_separation<=75bps' END, CASE WHEN n < 300 THEN 'sample_size<300' END], lambda x: x IS NOT NULL) AS f FROM p)
SELECT family, CAST(horizon AS INTEGER) AS horizon, kind, n, round(mean, 6) + 0.0 AS mean, round(median, 6) + 0.0 AS median, round(hit_rate, 6) AS hit_rate, round(top5_share, 6) AS top5_share, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high, round(spread, 6) + 0.0 AS q4_minus_q1, round(diff, 6) + 0.0 AS mean_difference,
  CASE WHEN family = 'primary' THEN array_to_string(list_sort(f), ',') END AS failures, CASE WHEN family = 'primary' THEN CASE WHEN n < 300 THEN 'COLLECT_MORE_HISTORY' WHEN len(f) > 0 THEN 'KILL_OR_REWORK' ELSE 'CONTINUE' END END AS decision FROM g
""")
def evt_04_study_packet(spark, d):
    """EVT-04: purchases against two control families, two horizons, net and abnormal."""
    rules = gates.rule_table(spark).where("family = 'event_study'")
    x = studies.study_packet(_family_labels(spark, d), (1, 5), rules, iterations=_ITERATIONS)
    return rounded(x.drop("q1_mean", "q2_mean", "q3_mean", "q4_mean", "status").withColumn("failures", F.array_join("failures", ",")))


@query(f"""WITH {_CANDIDATES}, k AS (SELECT accession, abs(CAST(max(delay) AS INTEGER)) % 5 AS days, max(n_strict) AS n FROM candidates GROUP BY 1),
v AS (SELECT c.*, k.days, chief_buy AS officer, director_buy AS director FROM candidates c JOIN k USING (accession) WHERE len(exclusion_reasons) = 0 AND k.days <= 2), e AS (SELECT quantile_cont(total_value, 0.75) AS e FROM v)
SELECT variant, count(*) AS n, round(sum(total_value), 2) AS total_value FROM (SELECT total_value, unnest(['clean_timely_unmixed', CASE WHEN director OR officer THEN 'officer_director_only' END, CASE WHEN chief_buy THEN 'ceo_cfo_only' END, CASE WHEN n_insiders > 1 OR n_strict > 1 THEN 'clustered_buyers' END, CASE WHEN total_value >= e.e THEN 'large_purchase_q4' END]) AS variant FROM v, e) WHERE variant IS NOT NULL GROUP BY 1
""")
def prj_11_clean_variants(spark, d):
    """PRJ-11: the five variants on the clean, timely, unmixed base."""
    tx = t.transactions(spark, d)
    delay = tx.groupBy("accession").agg((F.abs(F.max(F.datediff("traded_on", F.col("accepted_at").cast("date")))) % 5).alias("days_to_report"))
    c = _candidates(spark, d).join(delay, "accession").withColumns({"flags": F.array().cast("array<string>"), "n_officers": F.col("chief_buy").cast("int"), "n_directors": F.col("director_buy").cast("int")})
    x = studies.variants(c).select("total_value", F.explode("variants").alias("variant"))
    return x.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.sum("total_value"), 2).alias("total_value"))


_MATRIX = f"""{_CANDIDATES}, {_LABELS},
u AS (SELECT CAST(accepted_at AS DATE) AS date, 'candidates' AS i FROM candidates UNION ALL SELECT CAST(accepted_at AS DATE), 'eligible' FROM candidates WHERE len(exclusion_reasons) = 0 UNION ALL SELECT CAST(tradable_at AS DATE), 'labeled' FROM done WHERE len(blockers) = 0
  UNION ALL SELECT date, 'bars' FROM bars WHERE month(date) <> 5 UNION ALL SELECT CAST(ts AS DATE), 'news' FROM events),
c9 AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) FILTER (i = 'candidates') AS n_candidates, count(*) FILTER (i = 'eligible') AS n_eligible, count(*) FILTER (i = 'labeled') AS n_labeled, count(*) FILTER (i = 'bars') AS n_bars, count(*) FILTER (i = 'news') AS n_news FROM u GROUP BY 1),
sp AS (SELECT CAST(unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month FROM c9),
mx AS (SELECT sp.month, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_eligible, 0) AS n_eligible, coalesce(n_labeled, 0) AS n_labeled, coalesce(n_bars, 0) AS n_bars, coalesce(n_news, 0) AS n_news FROM sp LEFT JOIN c9 USING (month))"""


def _matrix(spark, d):
    c = written(_candidates(spark, d).select("event_id", "issuer", "accepted_at", "eligible"), "candidates")  # three of the inputs read it
    b = written(t.bars(spark, d).select("date", "symbol", "open", "close"), "bars")
    done = _labels(spark, d, c=c, b=b).where("label_status = 'LABELED'")
    day = lambda df, c: df.select(F.to_date(c).alias("date"))
    inputs = {"candidates": day(c, "accepted_at"), "eligible": day(c.where("eligible"), "accepted_at"), "labeled": day(done, "tradable_at"), "bars": b.where(F.month("date") != 5).select("date"), "news": day(t.table(spark, d, "events"), "ts")}
    return studies.monthly_matrix(inputs)


@query(f"""WITH {_MATRIX}
SELECT *, concat_ws(',', CASE WHEN n_candidates = 0 THEN 'candidates' END, CASE WHEN n_eligible = 0 THEN 'eligible' END, CASE WHEN n_labeled = 0 THEN 'labeled' END, CASE WHEN n_bars = 0 THEN 'bars' END, CASE WHEN n_news = 0 THEN 'news' END) AS missing, round(n_labeled / nullif(n_eligible, 0), 8) AS label_ratio,
  CASE WHEN n_candidates + n_eligible + n_labeled + n_bars + n_news = 0 THEN 'NO_INPUT' WHEN n_candidates = 0 OR n_bars = 0 OR n_news = 0 THEN 'MISSING_INPUTS' WHEN n_eligible = 0 THEN 'NO_EVENTS' WHEN n_labeled / n_eligible >= 0.8 THEN 'COVERED' WHEN n_labeled > 0 THEN 'PARTIAL' ELSE 'UNLABELED' END AS coverage FROM mx
""")
def agg_13_monthly_matrix(spark, d):
    """AGG-13: five inputs, every month from the first to the last of any."""
    return rounded(_matrix(spark, d).withColumn("missing", F.array_join("missing", ",")), 8)


@query(f"""WITH {_MATRIX}, z AS (SELECT month, k.i AS input, k.n, row_number() OVER (PARTITION BY k.i ORDER BY month) AS r FROM mx, LATERAL (VALUES ('bars', n_bars), ('news', n_news), ('labeled', n_labeled)) k(i, n)), y AS (SELECT *, r - row_number() OVER (PARTITION BY input ORDER BY month) AS run FROM z WHERE n = 0)
SELECT input, min(month) AS first, max(month) AS last, count(*) AS months FROM y GROUP BY input, run
""")
def agg_13_month_gaps(spark, d):
    return studies.month_gaps(_matrix(spark, d), ["bars", "news", "labeled"])
