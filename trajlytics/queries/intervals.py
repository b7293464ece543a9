"""Interval, conformal, issuance and survival queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.operators import intervals as H
from trajlytics.operators import survival as V
from trajlytics.queries import packs as P
from trajlytics.queries.closed_form import BASE_SQL, HORIZON, prefix
from trajlytics.operators import closed_form as K
from trajlytics.queries.features import retention
from trajlytics.queries.registry import register
from trajlytics.sources import adapters as A
from trajlytics.sources.adapters import table, with_ctes

_LS = "ls AS (SELECT *, ABS(LN(truth) - LN(p50)) AS score FROM quantile_rows WHERE NOT is_censored)"


def radius_sql(src: str, by: str, c: float, score: str = "score") -> str:
    return f"""SELECT {by}, n AS n_calibration, rk AS rank, MAX(CASE WHEN r = rk THEN s END) AS radius,
        CASE WHEN rk > n THEN 'unavailable_finite_sample' ELSE 'finite_order_statistic' END AS status
      FROM (SELECT {by}, {score} AS s, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY {score}) AS r, COUNT(*) OVER (PARTITION BY {by}) AS n,
        CEIL((COUNT(*) OVER (PARTITION BY {by}) + 1) * {c}::DOUBLE) AS rk FROM {src}) GROUP BY ALL"""


@register("h1_conformal_radius", "route n_calibration:i rank:i radius:d status", with_ctes("quant", radius_sql("ls", "route", 0.8), _LS))
def h1_conformal_radius(spark, sf_dir):
    return H.conformal_radius(H.log_scores(A.quantile_rows(spark, sf_dir), "truth", "p50", "is_censored"), ["route"], 0.8)


@register("h2_group_max_radius", "route n_calibration:i rank:i radius:d status", with_ctes("quant", radius_sql("mx", "route", 0.9), _LS,
          "mx AS (SELECT route, cell_id, MAX(score) AS score FROM ls GROUP BY 1, 2)"))
def h2_group_max_radius(spark, sf_dir):
    scores = H.log_scores(A.quantile_rows(spark, sf_dir), "truth", "p50", "is_censored")
    return H.group_max_radius(scores, ["route"], "cell_id", 0.9)


SD = "(2e-1 + 5e-2 * SQRT(elapsed_days))"
ROUTE = "CASE WHEN condition_id % 3 = 0 THEN 'specialist' ELSE 'fallback' END"
_CS = f"""pts AS (SELECT condition_id, checkup_index, elapsed_days, {ROUTE} AS route, predicted AS mean, {SD} AS sd, capacity_retention_pct AS truth,
        temperature_c < 50 AS domain_supported, elapsed_days < 29.5 AS residual_supported, ABS(predicted - 1e2) > 6 AS residual_capped FROM pred WHERE method = 'prefix_sqrt'),
    cs AS (SELECT condition_id, route, MAX(ABS(mean - truth) / sd) AS score FROM pts GROUP BY 1, 2)"""


def interval_points(spark, sf_dir):
    return P.with_error(spark, sf_dir).filter("method = 'prefix_sqrt'").select(
        "condition_id", "checkup_index", "elapsed_days", F.expr(ROUTE).alias("route"), F.col("predicted").alias("mean"), F.expr(SD).alias("sd"),
        F.col("capacity_retention_pct").alias("truth"), F.expr("temperature_c < 50").alias("domain_supported"),
        F.expr("elapsed_days < 29.5").alias("residual_supported"), F.expr("ABS(predicted - 1e2) > 6").alias("residual_capped"))


def _route_scores(points):
    return points.groupBy("condition_id", "route").agg(F.max(F.abs(F.col("mean") - F.col("truth")) / F.col("sd")).alias("score"))


_ROUTES = ["fallback", "specialist", "unused"]


def routes_sql(covs: list[float]) -> str:
    parts = [f"""SELECT g.route, {c}::DOUBLE AS coverage, COALESCE(n_calibration, 0) AS n_calibration, COALESCE(rank, 1) AS rank, radius AS multiplier, COALESCE(status, 'empty_route') AS status
      FROM (SELECT UNNEST(['fallback', 'specialist', 'unused']) AS route) g LEFT JOIN ({radius_sql('cs', 'route', c)}) q ON g.route = q.route""" for c in covs]
    return " UNION ALL ".join(parts)


@register("h3_route_quantiles", "route coverage:d n_calibration:i rank:i multiplier:d status", with_ctes("cal", routes_sql([0.8, 0.99]), P.pred_sql(), _CS))
def h3_route_quantiles(spark, sf_dir):
    return H.route_quantiles(_route_scores(interval_points(spark, sf_dir)), _ROUTES, [0.8, 0.99])


@register("h5_calibration_half_widths", "model_id forecast_cycle:i n_calibration:i quantile_level:d half_width:d5", with_ctes("cycles", """
    SELECT model_id, forecast_cycle, n AS n_calibration, lv AS quantile_level, MAX(CASE WHEN r = CEIL(lv * (n - 1)) + 1 THEN a END) AS half_width
    FROM (SELECT *, LEAST(1, CEIL((n + 1) * 0.8::DOUBLE) / n) AS lv FROM (SELECT model_id, forecast_cycle, ABS(predicted - retention) AS a,
        ROW_NUMBER() OVER (PARTITION BY model_id, forecast_cycle ORDER BY ABS(predicted - retention)) AS r, COUNT(*) OVER (PARTITION BY model_id, forecast_cycle) AS n
      FROM fc JOIN ret ON ret.cell_id = fc.cell_id AND ret.cycle_index = fc.forecast_cycle)) GROUP BY 1, 2, 3, 4""", *BASE_SQL))
def h5_calibration_half_widths(spark, sf_dir):
    fc = K.base_forecasts(K.base_fits(prefix(spark, sf_dir), ["cell_id"]), ["cell_id"], HORIZON)
    truth = retention(spark, sf_dir).select("cell_id", F.col("cycle_index").alias("forecast_cycle"), "retention")
    resid = fc.join(truth, ["cell_id", "forecast_cycle"]).withColumn("residual", F.col("predicted") - F.col("retention"))
    return H.calibration_half_widths(resid, ["model_id", "forecast_cycle"], "residual", 0.8)


_BOUNDS = "bd AS (SELECT *, mean - sd AS lower, mean + sd AS upper FROM pts)"
_SIM = "sm AS (SELECT route, condition_id, MAX(GREATEST(lower - truth, truth - upper, 0)) AS score FROM bd GROUP BY 1, 2)"


def _bounded(spark, sf_dir):
    return interval_points(spark, sf_dir).withColumns({"lower": F.col("mean") - F.col("sd"), "upper": F.col("mean") + F.col("sd")})


@register("h6_conformal_expansion", "route n_calibration:i rank:i expansion_pp:d status", with_ctes(
    "cal", f"SELECT route, n_calibration, rank, radius AS expansion_pp, status FROM ({radius_sql('sm', 'route', 0.9)})", P.pred_sql(), _CS, _BOUNDS, _SIM))
def h6_conformal_expansion(spark, sf_dir):
    return H.conformal_expansion(_bounded(spark, sf_dir), ["condition_id"], ["route"], "lower", "upper", "truth", 0.9)


@register("h6_expanded_intervals", "condition_id:i checkup_index:i lower:d upper:d", with_ctes(
    "cal", f"SELECT condition_id, checkup_index, lower - radius AS lower, upper + radius AS upper FROM bd JOIN ({radius_sql('sm', 'route', 0.9)}) USING (route)", P.pred_sql(), _CS, _BOUNDS, _SIM))
def h6_expanded_intervals(spark, sf_dir):
    pts = _bounded(spark, sf_dir)
    return H.expand(pts, H.conformal_expansion(pts, ["condition_id"], ["route"], "lower", "upper", "truth", 0.9), ["route"], "lower", "upper")


@register("h7_predictive_sd", "condition_id:i checkup_index:i power_sd:d activation_sd:d", with_ctes("cal", """
    SELECT condition_id, checkup_index, GREATEST(SQRT(GREATEST(g1 * g1 * 0.01e0 + 2 * g1 * g2 * 0.002e0 + g2 * g2 * 0.004e0, 0) + 0.0225e0), 0.1) AS power_sd,
      GREATEST(SQRT(GREATEST(g1 * g1 * 0.01e0 + 2 * g1 * g2 * 0.002e0 + g2 * g2 * 0.004e0 + 2 * g1 * g3 * 0.001e0 + g3 * g3 * 0.05e0, 0) + 0.0225e0), 0.1) AS activation_sd
    FROM (SELECT *, loss AS g1, loss * LN(elapsed_days) AS g2, -(1 - EXP(-elapsed_days / 7e0)) AS g3 FROM (SELECT *, EXP(-1.2e0) * POWER(elapsed_days, 0.4e0 + 0.02e0 * (condition_id % 6)) AS loss
      FROM calendar_obs WHERE elapsed_days > 0))"""))
def h7_predictive_sd(spark, sf_dir):
    obs = A.calendar_obs(spark, sf_dir).filter("elapsed_days > 0")
    d, la, ex = F.col("elapsed_days"), F.lit(-1.2), 0.4 + 0.02 * (F.col("condition_id") % 6)
    L = F.lit
    c2 = [[L(0.01), L(0.002)], [L(0.002), L(0.004)]]
    c3 = [[L(0.01), L(0.002), L(0.001)], [L(0.002), L(0.004), L(0.0)], [L(0.001), L(0.0), L(0.05)]]
    return obs.select("condition_id", "checkup_index", H.predictive_sd(H.power_gradient(la, ex, d), c2, L(0.15), 0.1).alias("power_sd"),
                      H.predictive_sd(H.activation_gradient(la, ex, d, 7.0), c3, L(0.15), 0.1).alias("activation_sd"))


@register("h8_h9_interval_score", "condition_id:i checkup_index:i lower:d upper:d interval_score:d", with_ctes("cal", """
    SELECT condition_id, checkup_index, lo AS lower, hi AS upper, hi - lo + 10 * GREATEST(lo - truth, 0) + 10 * GREATEST(truth - hi, 0) AS interval_score FROM (
      SELECT *, CASE WHEN m IS NULL THEN 0 ELSE LEAST(GREATEST(mean - m * sd, 0), 100) END AS lo, CASE WHEN m IS NULL THEN 100 ELSE LEAST(GREATEST(mean + m * sd, 0), 100) END AS hi
      FROM (SELECT *, CASE WHEN condition_id % 5 = 0 THEN NULL ELSE 1.5e0 END AS m FROM pts))""", P.pred_sql(), _CS))
def h8_h9_interval_score(spark, sf_dir):
    m = F.expr("CASE WHEN condition_id % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE 1.5e0 END")
    lo, hi = H.physical_interval(F.col("mean"), F.col("sd"), m)
    return interval_points(spark, sf_dir).withColumns({"lower": lo, "upper": hi}).withColumn(
        "interval_score", H.interval_score(F.col("truth"), F.col("lower"), F.col("upper"), 0.8))


WILSON = ("GREATEST((k / n + 3.8414588206941254e0 / (2 * n) - 1.959963984540054e0 * SQRT(k / n * (1 - k / n) / n + 3.8414588206941254e0 / (4 * n * n))) / (1 + 3.8414588206941254e0 / n), 0)",
          "LEAST((k / n + 3.8414588206941254e0 / (2 * n) + 1.959963984540054e0 * SQRT(k / n * (1 - k / n) / n + 3.8414588206941254e0 / (4 * n * n))) / (1 + 3.8414588206941254e0 / n), 1)")


@register("h10_quantile_evaluation", "route quantile:d n_rows:i n_censored:i pinball:d4 empirical_cdf:d calibration_error:d ci_lower:d ci_upper:d", with_ctes("quant", f"""
    SELECT route, q AS quantile, n AS n_rows, nc AS n_censored, pinball, k / n AS empirical_cdf, k / n - q AS calibration_error, {WILSON[0]} AS ci_lower, {WILSON[1]} AS ci_upper FROM (
      SELECT route, q, COUNT(*) FILTER (WHERE NOT is_censored) AS n, COUNT(*) FILTER (WHERE is_censored) AS nc, COUNT(*) FILTER (WHERE NOT is_censored AND truth <= v) AS k,
        AVG(GREATEST(q * (truth - v), (q - 1) * (truth - v))) FILTER (WHERE NOT is_censored) AS pinball
      FROM (SELECT *, 1e-1 AS q, p10 AS v FROM quantile_rows UNION ALL SELECT *, 9e-1, p90 FROM quantile_rows) GROUP BY 1, 2)"""))
def h10_quantile_evaluation(spark, sf_dir):
    df = A.quantile_rows(spark, sf_dir)
    return H.evaluate_quantile(df, ["route"], "truth", "p10", 0.1, "is_censored").unionByName(
        H.evaluate_quantile(df, ["route"], "truth", "p90", 0.9, "is_censored"))


@register("h11_interval_evaluation", "route n_rows:i n_censored:i coverage:d coverage_error:d ci_lower:d ci_upper:d mean_width:d4 mean_relative_width:d", with_ctes("quant", f"""
    SELECT route, n AS n_rows, nc AS n_censored, k / n AS coverage, k / n - 0.8 AS coverage_error, {WILSON[0]} AS ci_lower, {WILSON[1]} AS ci_upper, mean_width, mean_relative_width FROM (
      SELECT route, COUNT(*) FILTER (WHERE NOT is_censored) AS n, COUNT(*) FILTER (WHERE is_censored) AS nc, COUNT(*) FILTER (WHERE NOT is_censored AND truth BETWEEN p10 AND p90) AS k,
        AVG(p90 - p10) FILTER (WHERE NOT is_censored) AS mean_width, AVG((p90 - p10) / truth) FILTER (WHERE NOT is_censored) AS mean_relative_width FROM quantile_rows GROUP BY 1)"""))
def h11_interval_evaluation(spark, sf_dir):
    return H.evaluate_interval(A.quantile_rows(spark, sf_dir), ["route"], "truth", "p10", "p90", 0.8, "is_censored")


@register("h12_group_coverage", "route n_groups:i n_rows:i n_covered:i coverage:d coverage_error:d ci_lower:d ci_upper:d", with_ctes("quant", f"""
    SELECT route, n AS n_groups, nr AS n_rows, k AS n_covered, k / n AS coverage, k / n - 0.8 AS coverage_error, {WILSON[0]} AS ci_lower, {WILSON[1]} AS ci_upper FROM (
      SELECT route, COUNT(*) AS n, SUM(c) AS nr, COUNT(*) FILTER (WHERE a) AS k FROM (SELECT route, row_id, COUNT(*) AS c, bool_and(truth BETWEEN p10 AND p90) AS a
        FROM quantile_rows WHERE NOT is_censored GROUP BY 1, 2) GROUP BY 1)"""))
def h12_group_coverage(spark, sf_dir):
    return H.evaluate_group_interval(A.quantile_rows(spark, sf_dir), ["route"], "row_id", "truth", "p10", "p90", 0.8, "is_censored")


_COV = "cv AS (SELECT route, condition_id, bool_and(truth BETWEEN lower AND upper) AS covered, MAX(upper - lower) AS width FROM bd GROUP BY 1, 2)"


def _covered(spark, sf_dir):
    return _bounded(spark, sf_dir).groupBy("route", "condition_id").agg(
        F.bool_and(F.col("truth").between(F.col("lower"), F.col("upper"))).alias("covered"), F.max(F.col("upper") - F.col("lower")).alias("width"))


@register("h13_coverage_summary", "route n_units:i n_covered:i coverage:d median_max_width:d p95_max_width:d", with_ctes("cal", """
    SELECT route, COUNT(*) AS n_units, COUNT(*) FILTER (WHERE covered) AS n_covered, COUNT(*) FILTER (WHERE covered) / COUNT(*) AS coverage, MEDIAN(width) AS median_max_width,
      QUANTILE_CONT(width, 0.95) AS p95_max_width FROM cv GROUP BY 1""", P.pred_sql(), _CS, _BOUNDS, _COV))
def h13_coverage_summary(spark, sf_dir):
    return H.coverage_summary(_covered(spark, sf_dir), ["route"], "covered", "width")


def exact_bound_sql(k: str, n: str, alpha: float, *, upper: bool = False) -> str:
    """Exact binomial bound by fifty halvings: the tail of k of n successes has probability alpha at the bound."""
    mid = "((s.lo + s.hi) / 2)"
    counts = f"range(0, {k} + 1)" if upper else f"range({k}, {n} + 1)"
    log_choose = f"lgamma({n} + 1e0) - lgamma(j + 1e0) - lgamma({n} - j + 1e0)"
    tail = f"list_sum(list_transform({counts}, lambda j: exp({log_choose} + j * ln({mid}) + ({n} - j) * ln(1 - {mid}))))"
    return f"""list_reduce(list_transform(range(50), lambda i: {{'lo': 0e0, 'hi': 1e0}}), lambda s, x:
        CASE WHEN {tail} {'>' if upper else '<'} {alpha} THEN {{'lo': {mid}, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': {mid}}} END).lo"""


@register("h13_exact_bounds", "route n_units:i n_covered:i cp_lower:d cp_upper:d", with_ctes("cal", f"""
    SELECT route, n AS n_units, k AS n_covered, CASE WHEN k = 0 THEN 0e0 ELSE {exact_bound_sql('k', 'n', 0.05)} END AS cp_lower, 1e0 AS cp_upper
    FROM (SELECT route, COUNT(*) AS n, COUNT(*) FILTER (WHERE covered) AS k FROM cv GROUP BY 1)""", P.pred_sql(), _CS, _BOUNDS, _COV))
def h13_exact_bounds(spark, sf_dir):
    summary = H.coverage_summary(_covered(spark, sf_dir), ["route"], "covered", "width")
    return H.with_clopper_pearson(summary, "n_covered", "n_units")


DECISION_EXPRS = {
    "order_id": "o_orderkey", "gate_ready": "o_orderstatus <> 'P'", "specialist_ok": "o_custkey % 7 <> 0", "fallback_ok": "o_custkey % 5 <> 0",
    "residual_supported": "o_totalprice < 4e5", "residual_capped": "o_totalprice > 3.5e5", "multiplier": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice / 1e5 END",
    "calibration_independent": "o_orderpriority <> '1-URGENT'", "same_route_calibrated": "o_custkey % 3 <> 0", "horizon_matched": "o_orderkey % 4 <> 0", "domain_supported": "o_custkey % 11 <> 0",
    "evidence_required": "o_orderstatus = 'F'", "evidence_available": "o_custkey % 2 = 0", "interval_width": "CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE o_totalprice / 5e4 - 5e-1 END",
}


@register("h14_issuance_decisions", "order_id:i mean_route fallback_text abstention_text issuance_status", with_ctes("", """
    SELECT order_id, CASE WHEN NOT bl THEN 'specialist' WHEN fallback_ok THEN 'fallback' ELSE 'unavailable' END AS mean_route,
      concat_ws(';', CASE WHEN NOT gate_ready THEN 'specialist_gate_not_ready' END, CASE WHEN NOT specialist_ok THEN 'specialist_fit_failed' END,
        CASE WHEN NOT residual_supported THEN 'residual_outside_support' END, CASE WHEN residual_capped THEN 'residual_cap_hit' END, CASE WHEN bl AND NOT fallback_ok THEN 'fallback_fit_failed' END) AS fallback_text,
      ab AS abstention_text, CASE WHEN ab = '' THEN 'issued' ELSE 'abstained' END AS issuance_status
    FROM (SELECT *, concat_ws(';', CASE WHEN bl AND NOT fallback_ok THEN 'mean_unavailable' END, CASE WHEN multiplier IS NULL THEN 'calibration_unavailable' END,
        CASE WHEN NOT calibration_independent THEN 'calibration_evidence_not_independent' END, CASE WHEN NOT same_route_calibrated THEN 'insufficient_same_route_calibration' END,
        CASE WHEN NOT horizon_matched THEN 'horizon_mismatch' END, CASE WHEN NOT domain_supported THEN 'domain_unsupported' END,
        CASE WHEN evidence_required AND NOT evidence_available THEN 'independent_long_term_evidence_missing' END, CASE WHEN NOT residual_supported THEN 'residual_outside_support' END,
        CASE WHEN residual_capped THEN 'residual_cap_hit' END, CASE WHEN interval_width IS NULL OR interval_width < 0 THEN 'interval_width_invalid' END,
        CASE WHEN interval_width > 6 THEN 'interval_too_wide' END) AS ab
      FROM (SELECT *, NOT gate_ready OR NOT specialist_ok OR NOT residual_supported OR residual_capped AS bl FROM dec))""", f"dec AS (SELECT {A._sql(DECISION_EXPRS)} FROM orders)"))
def h14_issuance_decisions(spark, sf_dir):
    flags = table(spark, sf_dir, "orders").select(*A._select(DECISION_EXPRS))
    return H.issuance_decision(flags, max_width=6.0).withColumns({
        "fallback_text": F.array_join("fallback_reasons", ";"), "abstention_text": F.array_join("abstention_reasons", ";")})


_H15 = f"""qs AS ({routes_sql([0.8])}),
    ip AS (SELECT *, CASE WHEN m IS NULL THEN 0 ELSE LEAST(GREATEST(mean - m * sd, 0), 100) END AS lo, CASE WHEN m IS NULL THEN 100 ELSE LEAST(GREATEST(mean + m * sd, 0), 100) END AS hi
      FROM (SELECT pts.*, multiplier AS m FROM pts LEFT JOIN qs USING (route))),
    cm0 AS (SELECT condition_id, route, MAX(m) AS multiplier, bool_and(truth BETWEEN lo AND hi) AS sim, AVG(CASE WHEN truth BETWEEN lo AND hi THEN 1e0 ELSE 0e0 END) AS pt, AVG(hi - lo) AS mw, MAX(hi - lo) AS xw,
      AVG(hi - lo + 10 * GREATEST(lo - truth, 0) + 10 * GREATEST(truth - hi, 0)) AS isc, concat_ws(';', CASE WHEN MAX(m) IS NULL THEN 'insufficient_same_route_calibration' END,
      CASE WHEN NOT bool_and(domain_supported) THEN 'domain_unsupported' END, CASE WHEN NOT bool_and(residual_supported) THEN 'residual_outside_support' END,
      CASE WHEN bool_or(residual_capped) THEN 'residual_cap_hit' END) AS reasons FROM ip GROUP BY 1, 2),
    cm AS (SELECT condition_id, route, 0.8e0 AS coverage, multiplier, reasons, reasons = '' AS available, CASE WHEN reasons = '' THEN sim END AS simultaneously_covered,
      CASE WHEN reasons = '' THEN pt END AS pointwise_coverage, CASE WHEN reasons = '' THEN mw END AS mean_width, CASE WHEN reasons = '' THEN xw END AS max_width, CASE WHEN reasons = '' THEN isc END AS interval_score FROM cm0)"""


def _condition_metrics(spark, sf_dir):
    pts = interval_points(spark, sf_dir)
    return H.condition_interval_metrics(pts, H.route_quantiles(_route_scores(pts), _ROUTES, [0.8]), entity="condition_id", coverage=0.8)


@register("h15_condition_intervals", "condition_id:i route multiplier:d reasons available:b simultaneously_covered:b pointwise_coverage:d mean_width:d max_width:d interval_score:d",
          with_ctes("cal", "SELECT * FROM cm", P.pred_sql(), _CS, _H15))
def h15_condition_intervals(spark, sf_dir):
    return _condition_metrics(spark, sf_dir)


@register("h15_route_summary", "route coverage:d n_conditions:i n_available:i n_covered:i mean_width:d max_width:d interval_score:d coverage_among_available:d all_available_and_covered:b", with_ctes("cal", """
    SELECT route, coverage, COUNT(*) AS n_conditions, COUNT(*) FILTER (WHERE available) AS n_available, COUNT(*) FILTER (WHERE simultaneously_covered) AS n_covered, AVG(mean_width) AS mean_width,
      MAX(max_width) AS max_width, AVG(interval_score) AS interval_score, COUNT(*) FILTER (WHERE simultaneously_covered) / NULLIF(COUNT(*) FILTER (WHERE available), 0) AS coverage_among_available,
      COUNT(*) FILTER (WHERE available) = COUNT(*) AND COUNT(*) FILTER (WHERE simultaneously_covered) = COUNT(*) AS all_available_and_covered FROM cm GROUP BY 1, 2""", P.pred_sql(), _CS, _H15))
def h15_route_summary(spark, sf_dir):
    return H.route_interval_summary(_condition_metrics(spark, sf_dir))


KM = """km0 AS (SELECT stratum, time, COUNT(*) AS n, COUNT(*) FILTER (WHERE NOT event) AS n_censored FROM survival_units GROUP BY 1, 2),
    km1 AS (SELECT *, SUM(n) OVER (PARTITION BY stratum ORDER BY time DESC) AS n_at_risk FROM km0),
    km AS (SELECT stratum, time, n_at_risk, n_censored, CASE WHEN MIN(f) OVER w <= 0 THEN 0 ELSE EXP(SUM(CASE WHEN f > 0 THEN LN(f) ELSE 0 END) OVER w) END AS survival,
      COALESCE(CASE WHEN MIN(f) OVER p <= 0 THEN 0 ELSE EXP(SUM(CASE WHEN f > 0 THEN LN(f) ELSE 0 END) OVER p) END, 1) AS survival_before
      FROM (SELECT *, 1 - n_censored / n_at_risk AS f FROM km1)
      WINDOW w AS (PARTITION BY stratum ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY stratum ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
TB = "FLOOR(time / 32)"
GRID = [100.0, 200.0, 300.0, 400.0]


def curve(spark, sf_dir):
    return V.censoring_curve(A.survival_units(spark, sf_dir), ["stratum"], "time", "event", TB)


@register("k1_censoring_curve", "stratum time:d n_at_risk:i n_censored:i survival:d survival_before:d", with_ctes("surv", "SELECT * FROM km", KM))
def k1_censoring_curve(spark, sf_dir):
    return curve(spark, sf_dir)


@register("k2_survival_lookup", "unit_id:i at:d s_left:d s_right:d".replace(" at:d", " at_time:d"), with_ctes("surv", """
    SELECT unit_id, scale AS at_time, COALESCE((SELECT ARG_MAX(survival, time) FROM km WHERE km.stratum = u.stratum AND km.time < u.scale), 1) AS s_left,
      COALESCE((SELECT ARG_MAX(survival, time) FROM km WHERE km.stratum = u.stratum AND km.time <= u.scale), 1) AS s_right FROM survival_units u""", KM))
def k2_survival_lookup(spark, sf_dir):
    km = curve(spark, sf_dir)
    left = A.survival_units(spark, sf_dir).select("stratum", "unit_id", F.col("scale").alias("at_time"))
    one = V.survival_lookup(left, km, ["stratum"], "at_time", "time", left_limit=True, bucket="FLOOR(_t / 32)", name="s_left")
    return V.survival_lookup(one, km, ["stratum"], "at_time", "time", left_limit=False, bucket="FLOOR(_t / 32)", name="s_right")


def survival_probability():
    return F.exp(-F.col("evaluation_time") / F.col("scale"))


_BR = f"""ev AS (SELECT UNNEST({GRID}::DOUBLE[]) AS evaluation_time),
    st AS (SELECT stratum, evaluation_time, COALESCE(ARG_MAX(survival, time) FILTER (WHERE time <= evaluation_time), 1) AS st FROM km, ev GROUP BY 1, 2),
    rw AS (SELECT u.stratum, evaluation_time, st, event AND u.time <= evaluation_time AS hap, u.time > evaluation_time AS al, EXP(-evaluation_time / scale) AS p,
      CASE WHEN event AND u.time <= evaluation_time THEN 1 / NULLIF(survival_before, 0) WHEN u.time > evaluation_time THEN 1 / NULLIF(st, 0) ELSE 0 END AS w
      FROM survival_units u JOIN km ON km.stratum = u.stratum AND km.time = u.time JOIN st ON st.stratum = u.stratum),
    br AS (SELECT *, CASE WHEN rs = '' THEN 'passed' ELSE 'failed' END AS gate_status FROM (SELECT *, concat_ws(';', CASE WHEN censor_survival < 0.1 THEN 'censor_survival_low' END, CASE WHEN effective_sample_size < 30 THEN 'effective_sample_size_low' END,
        CASE WHEN effective_sample_size / n_units < 0.5 THEN 'effective_sample_fraction_low' END, CASE WHEN n_events < 5 THEN 'too_few_events' END, CASE WHEN n_alive < 5 THEN 'too_few_alive' END,
        CASE WHEN n_clipped / n_units > 0.01 THEN 'too_many_clipped' END) AS rs FROM (SELECT stratum, evaluation_time, COUNT(*) AS n_units, SUM(w * POWER(CAST(al AS INT) - p, 2)) / COUNT(*) AS brier,
        SUM(LEAST(w, 10) * POWER(CAST(al AS INT) - p, 2)) / COUNT(*) AS clipped_brier, MAX(st) AS censor_survival, COUNT(*) FILTER (WHERE hap) AS n_events, COUNT(*) FILTER (WHERE al) AS n_alive, MAX(w) AS max_weight,
        SUM(w) * SUM(w) / SUM(w * w) AS effective_sample_size, COUNT(*) FILTER (WHERE w > 10) AS n_clipped FROM rw GROUP BY 1, 2)))"""


def _brier(spark, sf_dir):
    units = A.survival_units(spark, sf_dir)
    return V.ipcw_brier(units, curve(spark, sf_dir), ["stratum"], "time", "event", GRID, survival_probability())


@register("k3_ipcw_brier", "stratum evaluation_time:d n_units:i brier:d clipped_brier:d censor_survival:d n_events:i n_alive:i max_weight:d effective_sample_size:d n_clipped:i reasons gate_status",
          with_ctes("surv", "SELECT *, rs AS reasons FROM br", KM, _BR))
def k3_ipcw_brier(spark, sf_dir):
    return _brier(spark, sf_dir).withColumn("reasons", F.array_join("gate_reasons", ";"))


@register("k3_integrated_brier", "stratum integrated_brier:d clipped_integrated_brier:d status", with_ctes("surv", """
    SELECT stratum, SUM((brier + pb) / 2 * dt) / (MAX(evaluation_time) - MIN(evaluation_time)) AS integrated_brier, SUM((clipped_brier + pc) / 2 * dt) / (MAX(evaluation_time) - MIN(evaluation_time)) AS clipped_integrated_brier,
      CASE WHEN bool_and(gate_status = 'passed') THEN 'passed' ELSE 'failed' END AS status
    FROM (SELECT *, LAG(brier) OVER w AS pb, LAG(clipped_brier) OVER w AS pc, evaluation_time - LAG(evaluation_time) OVER w AS dt FROM br WINDOW w AS (PARTITION BY stratum ORDER BY evaluation_time)) GROUP BY 1""", KM, _BR))
def k3_integrated_brier(spark, sf_dir):
    return V.integrated_brier(_brier(spark, sf_dir), ["stratum"])


@register("k4_policy_violations", "stratum evaluation_time:d survival:d issue", with_ctes("surv", """
    SELECT * FROM (SELECT stratum, evaluation_time, COALESCE(ARG_MAX(survival, time) FILTER (WHERE time <= evaluation_time), 1) AS survival,
      CASE WHEN evaluation_time > MAX(time) THEN 'beyond_follow_up' WHEN COALESCE(ARG_MAX(survival, time) FILTER (WHERE time <= evaluation_time), 1) <= 0 THEN 'zero_censoring_survival' END AS issue
      FROM km, (SELECT UNNEST([100e0, 499e0, 500e0, 900e0]) AS evaluation_time) GROUP BY 1, 2) WHERE issue IS NOT NULL""", KM))
def k4_policy_violations(spark, sf_dir):
    return V.policy_violations(curve(spark, sf_dir), A.survival_units(spark, sf_dir), ["stratum"], "time", [100.0, 499.0, 500.0, 900.0])


@register("k5_reference_brier", "stratum evaluation_time:d n_known:i naive_brier:d full_truth_brier:d", with_ctes("surv", f"""
    SELECT stratum, t AS evaluation_time, COUNT(*) FILTER (WHERE time > t OR event) AS n_known, AVG(POWER(CAST(time > t AS INT) - EXP(-t / scale), 2)) FILTER (WHERE time > t OR event) AS naive_brier,
      AVG(POWER(CAST((CASE WHEN event THEN time ELSE time * 1.5e0 END) > t AS INT) - EXP(-t / scale), 2)) AS full_truth_brier FROM survival_units, (SELECT UNNEST({GRID}::DOUBLE[]) AS t) GROUP BY 1, 2"""))
def k5_reference_brier(spark, sf_dir):
    units = A.survival_units(spark, sf_dir).withColumn("true_time", F.expr("CASE WHEN event THEN time ELSE time * 1.5e0 END"))
    return V.reference_brier(units, ["stratum"], "time", "event", GRID, survival_probability())
