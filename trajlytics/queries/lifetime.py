"""Lifetime-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.operators import features as X
from trajlytics.operators import intervals as H
from trajlytics.operators import isotonic as I
from trajlytics.operators import lifetime as M
from trajlytics.operators import splits as S
from trajlytics.operators.scoring import regression_metrics
from trajlytics.queries.registry import register
from trajlytics.queries.scoring import POOL_SQL, pool_flags
from trajlytics.session import cut_lineage
from trajlytics.sources import adapters as A
from trajlytics.sources.adapters import table, with_ctes

FEATURES = ["capacity_initial_ah", "capacity_delta_10_to_n_ah", "log10_capacity_diff_variance", "temperature_avg_c", "charge_time_avg_s"]


def cells(spark, sf_dir):
    """Early features with a lifetime that depends on them, so that the fits have something to find."""
    f = X.early_cycle_features(A.cycles(spark, sf_dir), A.cell_labels(spark, sf_dir))
    life = F.exp(6.5 + 2.0 * F.col("capacity_delta_10_to_n_ah") - 0.05 * (F.col("temperature_avg_c") - 27.0) + (F.col("cycle_life") - 1000.0) / 2000.0)
    return cut_lineage(f.withColumn("cycle_life", life))


# Customers: a large table for the one-feature model with an exact closed form.
_CUST = "cu AS (SELECT c_custkey, c_mktsegment, LN(5e2 + ABS(c_acctbal) / 1e1) AS y, c_nationkey / 1e1 AS x FROM customer)"


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.expr("5e2 + ABS(c_acctbal) / 1e1").alias("life"), F.expr("c_nationkey / 1e1").alias("x"), (F.col("c_nationkey") % 4 == 0).alias("cens"), F.lit(False).alias("none"))


@register("f1_lifetime_baselines", "split model n_rows:i mae:d3 rmse:d3 mape_pct:d3")
def f1_lifetime_baselines(spark, sf_dir):
    df = S.stable_group_split(cells(spark, sf_dir), ["protocol_id"])
    return M.lifetime_baselines(df, FEATURES, ["batch_id"], "cycle_life", log10_target=True)


@register("f2_aft_uncensored", "intercept:d5 coef:d5 sigma:d5 n_events:i", with_ctes("", """
    SELECT REGR_INTERCEPT(y, x) AS intercept, REGR_SLOPE(y, x) AS coef, SQRT((REGR_SYY(y, x) - POWER(REGR_SXY(y, x), 2) / REGR_SXX(y, x)) / COUNT(*)) AS sigma, COUNT(*) AS n_events FROM cu""", _CUST))
def f2_aft_uncensored(spark, sf_dir):
    m = M.fit_aft(_customers(spark, sf_dir), ["x"], "life", "none", models={"m": (None, 0.0)})["m"]
    return spark.createDataFrame([(m.intercept, m.coef[0], m.sigma, m.n_events)], "intercept double, coef double, sigma double, n_events long")


@register("f2_aft_censored", "model intercept:d4 coef:d4 sigma:d4 n_events:i n_censored:i")
def f2_aft_censored(spark, sf_dir):
    fits = M.fit_aft(_customers(spark, sf_dir), ["x"], "life", "cens", models={"weak": (None, 1e-4), "strong": (None, 10.0)})
    return spark.createDataFrame([(n, m.intercept, m.coef[0], m.sigma, m.n_events, m.n_censored) for n, m in fits.items()], "model string, intercept double, coef double, sigma double, n_events long, n_censored long")


@register("f3_aft_predictions", "c_custkey:i log_location:d4 p10:d2 p50:d2 p90:d2 survival_800:d4 nll:d4")
def f3_aft_predictions(spark, sf_dir):
    df = _customers(spark, sf_dir)
    m = M.fit_aft(df, ["x"], "life", "cens", models={"m": (None, 1e-4)})["m"]
    return M.predict_aft(df, m, survival_times=[800.0]).withColumn("nll", M.aft_nll(F.col("log_location"), F.lit(m.sigma), F.col("life"), F.col("cens")))


@register("f4_select_l2", "l2_penalty:d n_groups:i mean_group_nll:d4 selected:b")
def f4_select_l2(spark, sf_dir):
    df = cut_lineage(S.stable_group_folds(cells(spark, sf_dir), "protocol_id"))
    return M.select_l2(df, FEATURES, "cycle_life", "is_censored", group="protocol_id", fold="fold", folds=list(range(5)), penalties=[1e-4, 1.0, 100.0])


@register("f5_probabilistic_experiment", "split n_rows:i mae:d2 rmse:d2 mape_pct:d3 radius:d4 radius_status n_calibration:i")
def f5_probabilistic_experiment(spark, sf_dir):
    df = cut_lineage(S.stable_group_split(cells(spark, sf_dir), ["protocol_id"]))
    m = M.fit_aft(df.filter("split = 'train'"), FEATURES, "cycle_life", "is_censored", models={"m": (None, 1e-4)})["m"]
    pred = M.predict_aft(df, m)
    scores = H.log_scores(pred.filter("split = 'validation'"), "cycle_life", "p50", "is_censored")
    radius = H.group_max_radius(scores, ["split"], "protocol_id", 0.8).select("radius", F.col("status").alias("radius_status"), "n_calibration")
    censored = pred.filter("split <> 'train' and is_censored").limit(1).count() > 0
    metrics = regression_metrics(pred.filter("split <> 'train'"), ["split"], "cycle_life", "p50")
    joined = M.attach_one_row(metrics, radius)
    if censored:  # coverage cannot be calibrated on censored lifetimes
        joined = joined.withColumns({"radius": F.lit(None).cast("double"), "radius_status": F.lit("unavailable_censored")})
    return joined


_RADII = """ls AS (SELECT cell_id, ABS(LN(truth) - LN(p50)) AS score FROM quantile_rows WHERE route = 'A' AND NOT is_censored),
    sc AS (SELECT 'row' AS kind, score FROM ls UNION ALL SELECT 'group_max', MAX(score) FROM ls GROUP BY cell_id),
    rd AS (SELECT kind, COUNT(*) AS n, (LIST(score ORDER BY score))[CAST(CEIL((COUNT(*) + 1) * 0.8e0) AS BIGINT)] AS r FROM sc GROUP BY 1),
    cv AS (SELECT kind, route, r, n, cell_id, COUNT(*) FILTER (WHERE NOT is_censored) AS m, COUNT(*) FILTER (WHERE is_censored) AS c, COUNT(*) FILTER (WHERE NOT is_censored AND truth BETWEEN p50 / EXP(r) AND p50 * EXP(r)) AS k,
      SUM(p50 * EXP(r) - p50 / EXP(r)) FILTER (WHERE NOT is_censored) AS w FROM quantile_rows, rd WHERE route <> 'A' GROUP BY 1, 2, 3, 4, 5)"""


@register("f5_interval_evaluation", "kind route n_calibration:i radius:d status n_rows:i n_censored:i n_groups:i coverage:d mean_width:d3 group_coverage:d", with_ctes("quant", """
    SELECT kind, route, n AS n_calibration, r AS radius, 'finite_order_statistic' AS status, SUM(m) AS n_rows, SUM(c) AS n_censored, COUNT(*) FILTER (WHERE m > 0) AS n_groups, SUM(k) / SUM(m) AS coverage, SUM(w) / SUM(m) AS mean_width,
      COUNT(*) FILTER (WHERE m > 0 AND k = m) / COUNT(*) FILTER (WHERE m > 0) AS group_coverage FROM cv GROUP BY 1, 2, 3, 4""", _RADII))
def f5_interval_evaluation(spark, sf_dir):
    """Radii of one route's rows, judged on the other routes: predictions that SQL can recompute."""
    return H.radius_evaluation(A.quantile_rows(spark, sf_dir), split="route", calibration="A", train=None, group="cell_id", truth="truth", median="p50", censored="is_censored", coverage=0.8)


@register("f5_experiment_intervals", "kind split n_calibration:i radius:d4 status n_rows:i n_censored:i n_groups:i coverage:d4 mean_width:d2 group_coverage:d4")
def f5_experiment_intervals(spark, sf_dir):
    """The interval half of the probabilistic experiment: radii of the validation groups on the test groups."""
    df = cut_lineage(S.stable_group_split(cells(spark, sf_dir), ["protocol_id"]))
    m = M.fit_aft(df.filter("split = 'train'"), FEATURES, "cycle_life", "is_censored", models={"m": (None, 1e-4)})["m"]
    return H.radius_evaluation(M.predict_aft(df, m), split="split", calibration="validation", train="train", group="protocol_id", truth="cycle_life", median="p50", censored="is_censored", coverage=0.8)


_OFF = """rs AS (SELECT c_mktsegment, c_custkey, y - 6.8e0 AS r FROM cu),
    rr AS (SELECT c_mktsegment, rep, c_custkey, r, ROW_NUMBER() OVER (PARTITION BY c_mktsegment, rep ORDER BY sha256(concat_ws('|', 11, c_mktsegment, rep, c_custkey)), c_custkey) AS rk FROM rs, range(4) AS t(rep))"""


@register("f6_offset_posteriors", "c_mktsegment repeat_index:i k:i n_references:i shrunk_mean:d shrunk_sd:d flat_mean:d flat_sd:d", with_ctes("", """
    SELECT c_mktsegment, rep AS repeat_index, k, COUNT(*) AS n_references, (SUM(r) / 0.09e0) / (1 / 0.04e0 + COUNT(*) / 0.09e0) AS shrunk_mean, SQRT(1 / (1 / 0.04e0 + COUNT(*) / 0.09e0)) AS shrunk_sd, AVG(r) AS flat_mean, 0.3e0 / SQRT(COUNT(*)) AS flat_sd
    FROM rr, (VALUES (1), (3), (10)) AS t(k) WHERE rk <= k GROUP BY 1, 2, 3""", _CUST, _OFF))
def f6_offset_posteriors(spark, sf_dir):
    df = _customers(spark, sf_dir)
    parts = S.nested_reference_partition(df, domain="c_mktsegment", entity="c_custkey", max_k=10, repeats=4, seed=11).filter("role = 'reference'")
    refs = parts.join(df.select("c_custkey", (F.ln("life") - 6.8).alias("r")), "c_custkey")
    return M.offset_posteriors(refs, ["c_mktsegment", "repeat_index"], "r", "reference_rank", [1, 3, 10], residual_sigma=0.3, prior_sd=0.2)


def _reference(spark, sf_dir, multipliers):
    return M.reference_experiment(cells(spark, sf_dir), FEATURES, "cycle_life", batch="batch_id", batches=["0", "1", "2"], entity="cell_id", ks=[1, 3, 5], repeats=10, seed=42, prior_multipliers=multipliers)


@register("f7_reference_experiment", "batch_id multiplier:d k:i method n_rows:i mean_nll:d4 mae:d2 mape_pct:d3 p10_p90_coverage:d4")
def f7_reference_experiment(spark, sf_dir):
    return _reference(spark, sf_dir, [1.0])


@register("f8_prior_sensitivity", "batch_id multiplier:d k:i method n_rows:i mean_nll:d4 mae:d2 mape_pct:d3 p10_p90_coverage:d4")
def f8_prior_sensitivity(spark, sf_dir):
    return _reference(spark, sf_dir, [0.25, 1.0, 4.0])


def _external(spark, sf_dir):
    df = cells(spark, sf_dir)
    return M.external_predictions(df.filter("batch_id <> '2'"), df.filter("batch_id = '2'").drop("cycle_life"), "capacity_delta_10_to_n_ah", "cycle_life", "cell_id")


@register("f9_external_predictions", "cell_id model log_location:d4 sigma:d4 p10:d2 p50:d2 p90:d2")
def f9_external_predictions(spark, sf_dir):
    return _external(spark, sf_dir)[0]


@register("f9_external_shift", "n_source:i n_target:i mean_shift_in_source_sd:d4 n_below_source:i n_above_source:i n_identity_overlap:i")
def f9_external_shift(spark, sf_dir):
    return _external(spark, sf_dir)[1]


@register("f10_logistic_danger", "cluster_id:i danger_score:d3 danger_probability:d3")
def f10_logistic_danger(spark, sf_dir):
    return M.logistic_danger(pool_flags(spark, sf_dir), ["disagreement", "iae"], "catastrophic")


_ISOTONIC = """lv AS (SELECT x, COUNT(*) AS w, SUM(y) AS s, ROW_NUMBER() OVER (ORDER BY x) AS k FROM lab GROUP BY x),
    cu AS (SELECT *, SUM(w) OVER (ORDER BY k) AS cw, SUM(s) OVER (ORDER BY k) AS cs FROM lv),
    fr AS (SELECT i.k AS i, j.k AS k, MIN((j.cs - i.cs + i.s) / (j.cw - i.cw + i.w)) OVER (PARTITION BY i.k ORDER BY j.k DESC) AS low FROM cu i JOIN cu j ON j.k >= i.k),
    fit AS (SELECT x, MAX(low) AS p FROM fr JOIN lv USING (k) GROUP BY x)"""


@register("f11_isotonic_probability", "cluster_id:i disagreement:d calibrated_probability:d", with_ctes("pool", """
    SELECT cluster_id, disagreement, p AS calibrated_probability FROM pf JOIN fit ON x = disagreement""", POOL_SQL, "lab AS (SELECT disagreement AS x, CASE WHEN catastrophic THEN 1e0 ELSE 0e0 END AS y FROM pf)", _ISOTONIC))
def f11_isotonic_probability(spark, sf_dir):
    return I.isotonic_probability(pool_flags(spark, sf_dir).withColumn("catastrophic", F.col("catastrophic").cast("double")), "disagreement", "catastrophic")


@register("f11_isotonic_partitions", "o_totalprice:d calibrated_probability:d", with_ctes("", "SELECT x AS o_totalprice, p AS calibrated_probability FROM fit",
    "lab AS (SELECT FLOOR(o_totalprice / 5e2) AS x, CASE WHEN o_orderstatus = 'F' OR o_totalprice % 3 < 1 THEN 1e0 ELSE 0e0 END AS y FROM orders)", _ISOTONIC))
def f11_isotonic_partitions(spark, sf_dir):
    """Many levels over small range partitions: blocks settle in several passes."""
    orders = table(spark, sf_dir, "orders").select(F.floor(F.col("o_totalprice") / 5e2).cast("double").alias("o_totalprice"), F.expr("CASE WHEN o_orderstatus = 'F' OR o_totalprice % 3 < 1 THEN 1e0 ELSE 0e0 END").alias("late"))
    return I.isotonic_probability(orders, "o_totalprice", "late", partition_blocks=40).select("o_totalprice", "calibrated_probability").distinct()
