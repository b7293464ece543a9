"""Feature-extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.operators import features as X
from trajlytics.queries.registry import register
from trajlytics.sources import adapters as A
from trajlytics.sources.adapters import table, with_ctes

RET = """ret AS (SELECT c.*, 1e2 * discharge_capacity_ah / m AS retention, 99e-2 - 1e-5 * cycle_index - temperature_avg_c / 1e4 AS energy_efficiency
    FROM cycles c JOIN (SELECT cell_id, MEDIAN(discharge_capacity_ah) AS m FROM cycles WHERE cycle_index BETWEEN 1 AND 5 GROUP BY 1 HAVING COUNT(*) = 5) USING (cell_id))"""


def normalised(cycles):
    return X.with_retention(cycles).withColumn("energy_efficiency", F.expr("99e-2 - 1e-5 * cycle_index - temperature_avg_c / 1e4"))


def retention(spark, sf_dir):
    return normalised(A.cycles(spark, sf_dir))


@register("d1_early_cycle_features", """dataset_id cell_id batch_id protocol_id observed_cycle_count:i capacity_initial_ah:d capacity_cycle_10_ah:d
    capacity_cycle_50_ah:d capacity_cycle_n_ah:d capacity_delta_10_to_n_ah:d capacity_slope_ah_per_cycle:d8 log10_capacity_diff_variance:d
    resistance_initial_ohm:d8 resistance_slope_ohm_per_cycle:d10 temperature_avg_c:d temperature_max_c:d charge_time_avg_s:d cycle_life:d is_censored:b""", with_ctes("cycles labels_", """
    SELECT f.*, capacity_cycle_n_ah - capacity_cycle_10_ah AS capacity_delta_10_to_n_ah, l.cycle_life, l.is_censored FROM (
      SELECT dataset_id, cell_id, ARG_MIN(batch_id, cycle_index) AS batch_id, ARG_MIN(protocol_id, cycle_index) AS protocol_id, COUNT(*) AS observed_cycle_count,
        MEDIAN(discharge_capacity_ah) FILTER (WHERE pos <= 5) AS capacity_initial_ah,
        ARG_MAX(discharge_capacity_ah, cycle_index) FILTER (WHERE cycle_index <= 10) AS capacity_cycle_10_ah,
        ARG_MAX(discharge_capacity_ah, cycle_index) FILTER (WHERE cycle_index <= 50) AS capacity_cycle_50_ah,
        ARG_MAX(discharge_capacity_ah, cycle_index) AS capacity_cycle_n_ah, REGR_SLOPE(discharge_capacity_ah, cycle_index) AS capacity_slope_ah_per_cycle,
        LOG10(GREATEST(VAR_SAMP(d), 1e-16)) AS log10_capacity_diff_variance, MEDIAN(internal_resistance_ohm) FILTER (WHERE pos <= 5) AS resistance_initial_ohm,
        REGR_SLOPE(internal_resistance_ohm, cycle_index) AS resistance_slope_ohm_per_cycle, AVG(temperature_avg_c) AS temperature_avg_c,
        MAX(temperature_max_c) AS temperature_max_c, AVG(charge_time_s) AS charge_time_avg_s
      FROM (SELECT *, discharge_capacity_ah - LAG(discharge_capacity_ah) OVER w AS d, ROW_NUMBER() OVER w AS pos FROM cycles WHERE cycle_index <= 100
            WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_index)) GROUP BY 1, 2 HAVING COUNT(*) >= 20) f JOIN cell_labels l USING (dataset_id, cell_id)"""))
def d1_early_cycle_features(spark, sf_dir):
    return X.early_cycle_features(A.cycles(spark, sf_dir), A.cell_labels(spark, sf_dir))


@register("d2_group_slope", "cell_id n_finite:i slope:d8", with_ctes("cycles", """SELECT cell_id, COUNT(y) AS n_finite, REGR_SLOPE(y, cycle_index) AS slope
    FROM (SELECT cell_id, cycle_index, CASE WHEN temperature_avg_c > 31 THEN NULL ELSE internal_resistance_ohm END AS y FROM cycles) GROUP BY 1"""))
def d2_group_slope(spark, sf_dir):
    df = A.cycles(spark, sf_dir).withColumn("y", F.expr("CASE WHEN temperature_avg_c > 31 THEN CAST('NaN' AS DOUBLE) ELSE internal_resistance_ohm END"))
    return X.group_slope(df, ["cell_id"], "cycle_index", "y")


POINTS = 200


def resample_sql(source: str, points: int, minimum: int = 50, distinct: int = 2) -> list[str]:
    """Grid points joined to the neighbouring voltages: a second formulation, by range lookup."""
    step = f"(1.5e0 / {points - 1})"
    return [
        f"""med AS (SELECT test_id, cycle_number, voltage_V AS v, MEDIAN(coulomb_count_Ah) AS q, COUNT(*) AS n FROM {source}
            WHERE step_type = 'discharge' AND voltage_V BETWEEN 1.98 AND 3.6 GROUP BY 1, 2, 3)""",
        f"usable AS (SELECT test_id, cycle_number FROM med GROUP BY 1, 2 HAVING SUM(n) >= {minimum} AND COUNT(*) >= {distinct} AND MIN(v) <= 2.0 AND MAX(v) >= 3.5)",
        "nb AS (SELECT *, LEAD(v) OVER w AS nv, LEAD(q) OVER w AS nq FROM med SEMI JOIN usable USING (test_id, cycle_number) WINDOW w AS (PARTITION BY test_id, cycle_number ORDER BY v))",
        f"""grid AS (SELECT test_id, cycle_number, k, 2e0 + k * {step} AS voltage_V, CASE WHEN nv IS NULL THEN q ELSE q + (2e0 + k * {step} - v) / (nv - v) * (nq - q) END AS q
            FROM nb, range({points}) AS r(k) WHERE v <= 2e0 + k * {step} + 1e-10 AND (nv IS NULL OR nv > 2e0 + k * {step} + 1e-10))""",
    ]


@register("d3_resample_curves", "test_id cycle_number:i k:i voltage_V:d q:d", with_ctes("curves", "SELECT * FROM grid", *resample_sql("curve_samples", POINTS)))
def d3_resample_curves(spark, sf_dir):
    return X.resample_curves(A.curve_samples(spark, sf_dir).filter("step_type = 'discharge'"), points=POINTS)


DQ_SPEC = """test_id delta_q_min_ah:d delta_q_max_ah:d delta_q_mean_ah:d delta_q_variance_ah2:d8 log10_delta_q_variance:d5 delta_q_skewness:d5 delta_q_kurtosis:d4
    delta_q_abs_area_ah_v:d q_early_mean_ah:d q_late_mean_ah:d temperature_mean_c:d"""


def dq_sql(points: int) -> str:
    return f"""SELECT s.*, temperature_mean_c FROM (SELECT test_id, MIN(d) AS delta_q_min_ah, MAX(d) AS delta_q_max_ah, AVG(d) AS delta_q_mean_ah, VAR_POP(d) AS delta_q_variance_ah2,
        LOG10(GREATEST(VAR_POP(d), 1e-16)) AS log10_delta_q_variance, SKEWNESS(d) AS delta_q_skewness, KURTOSIS(d) AS delta_q_kurtosis,
        SUM((ABS(d) + ABS(pd)) / 2 * 1.5e0 / {points - 1}) AS delta_q_abs_area_ah_v, AVG(qe) AS q_early_mean_ah, AVG(ql) AS q_late_mean_ah
      FROM (SELECT *, LAG(d) OVER (PARTITION BY test_id ORDER BY k) AS pd FROM (
        SELECT a.test_id, a.k, a.q AS qe, b.q AS ql, b.q - a.q AS d FROM grid a JOIN grid b ON a.test_id = b.test_id AND a.k = b.k AND a.cycle_number = 10 AND b.cycle_number = 100)) GROUP BY 1) s
      JOIN (SELECT test_id, AVG(temperature_C) AS temperature_mean_c FROM curve_samples WHERE step_type = 'discharge' GROUP BY 1) USING (test_id)"""


@register("d4_delta_q_features", DQ_SPEC, with_ctes("curves", dq_sql(POINTS), *resample_sql("curve_samples", POINTS)))
def d4_delta_q_features(spark, sf_dir):
    return X.delta_q_features(A.curve_samples(spark, sf_dir), points=POINTS)


def _external_tests(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter("s_nationkey <> 4").select(
        F.expr("CAST(CASE WHEN s_nationkey = 5 THEN s_suppkey + 100000 ELSE s_suppkey END AS STRING)").alias("test_id"))


_EXT = "ext AS (SELECT CAST(CASE WHEN s_nationkey = 5 THEN s_suppkey + 100000 ELSE s_suppkey END AS VARCHAR) AS test_id FROM supplier WHERE s_nationkey <> 4)"


@register("d5_external_delta_q", DQ_SPEC, with_ctes("curves", f"SELECT * FROM ({dq_sql(POINTS)}) SEMI JOIN ext USING (test_id)", _EXT,
                                                    *resample_sql("curve_samples", POINTS, 50, 48)))
def d5_external_delta_q(spark, sf_dir):
    return X.external_delta_q(A.curve_samples(spark, sf_dir), _external_tests(spark, sf_dir), points=POINTS, minimum_distinct=48)[0]


@register("d5_external_issues", "test_id issue", with_ctes("curves", """
    SELECT test_id, CASE WHEN e.test_id IS NULL THEN 'unexpected_test' WHEN c IS NULL THEN 'missing_test' WHEN c < 2 THEN 'missing_cycle' ELSE 'insufficient_samples_or_coverage' END AS issue
    FROM ext e FULL JOIN (SELECT test_id, COUNT(DISTINCT cycle_number) AS c FROM curve_samples WHERE step_type = 'discharge' GROUP BY 1) USING (test_id)
    LEFT JOIN (SELECT test_id, COUNT(*) AS ok FROM usable GROUP BY 1) USING (test_id)
    WHERE e.test_id IS NULL OR c IS NULL OR c < 2 OR COALESCE(ok, 0) < 2""", _EXT, *resample_sql("curve_samples", POINTS, 50, 48)))
def d5_external_issues(spark, sf_dir):
    return X.external_delta_q(A.curve_samples(spark, sf_dir), _external_tests(spark, sf_dir), points=POINTS, minimum_distinct=48)[1]


CKEY = ["test_id"]
# A bucket of the order holds at most 100,000 samples of a test (times are whole seconds), and a test of 600 samples has few of them:
# with a bucket per sample or so, the bucket table would be as large as the samples.
CBUCKET = "FLOOR(timestamp_s / 1e5)"
# Time-ordered samples: one row per (test, time), voltage falling on average over the run.
_TRACE = """trace AS (SELECT test_id, timestamp_s, ANY_VALUE(current_A) AS current_A, AVG(voltage_V) AS v0, MAX(temperature_C) AS temperature_C FROM curve_samples GROUP BY 1, 2),
    tr AS (SELECT test_id, timestamp_s, -(1e0 + temperature_C / 1e2) AS current_A, 4.2e0 - timestamp_s / 1.5e5 + v0 / 2e1 AS voltage_V, temperature_C FROM trace),
    lagged AS (SELECT *, LAG(timestamp_s) OVER w AS pt, LAG(current_A) OVER w AS pi, LAG(voltage_V) OVER w AS pv FROM tr WINDOW w AS (PARTITION BY test_id ORDER BY timestamp_s)),
    integ AS (SELECT *, COALESCE(0.5 * (ABS(current_A) + ABS(pi)) * (timestamp_s - pt) / 3600, 0) AS ah,
        COALESCE(0.5 * (pv * ABS(pi) + voltage_V * ABS(current_A)) * (timestamp_s - pt) / 3600, 0) AS wh FROM lagged),
    cum AS (SELECT *, SUM(ah) OVER (PARTITION BY test_id ORDER BY timestamp_s) AS cumulative_ah FROM integ)"""


def _trace(spark, sf_dir):
    raw = A.curve_samples(spark, sf_dir).groupBy("test_id", "timestamp_s").agg(F.avg("voltage_V").alias("v0"), F.max("temperature_C").alias("temperature_C"))
    return raw.select("test_id", "timestamp_s", F.expr("-(1e0 + temperature_C / 1e2)").alias("current_A"),
                      F.expr("4.2e0 - timestamp_s / 1.5e5 + v0 / 2e1").alias("voltage_V"), "temperature_C")


@register("d6_cumulative_charge", "test_id timestamp_s:d cumulative_ah:d", with_ctes("curves", "SELECT * FROM cum", _TRACE))
def d6_cumulative_charge(spark, sf_dir):
    return X.integrate_curve(_trace(spark, sf_dir), CKEY, CBUCKET)


@register("d6_curve_totals", "test_id sample_count:i duration_s:d capacity_ah:d energy_wh:d temperature_rise_c:d", with_ctes("curves", """
    SELECT test_id, COUNT(*) AS sample_count, MAX(timestamp_s) - MIN(timestamp_s) AS duration_s, SUM(ah) AS capacity_ah, SUM(wh) AS energy_wh,
      MAX(temperature_C) - ARG_MIN(temperature_C, timestamp_s) AS temperature_rise_c FROM integ GROUP BY 1""", _TRACE))
def d6_curve_totals(spark, sf_dir):
    return X.curve_totals(X.integrate_curve(_trace(spark, sf_dir), CKEY, CBUCKET), CKEY)


@register("d7_first_crossings", "test_id threshold:d crossing_s:d status", with_ctes("curves", """
    SELECT test_id, threshold, CASE WHEN hit.pt IS NULL OR ABS(hit.pv - hit.voltage_V) <= 1e-12 THEN hit.timestamp_s
        ELSE hit.pt + LEAST(GREATEST((hit.pv - threshold) / (hit.pv - hit.voltage_V), 0), 1) * (hit.timestamp_s - hit.pt) END - t0 AS crossing_s,
      CASE WHEN hit IS NULL THEN 'not_reached' ELSE 'ok' END AS status
    FROM (SELECT test_id, threshold, ARG_MIN(l, l.timestamp_s) FILTER (WHERE l.voltage_V <= threshold) AS hit, MIN(l.timestamp_s) AS t0
          FROM lagged l, (VALUES (4.26e0), (4.0e0), (3.0e0), (1.0e0)) AS th(threshold) GROUP BY 1, 2)""", _TRACE))
def d7_first_crossings(spark, sf_dir):
    return X.first_downward_crossings(_trace(spark, sf_dir), CKEY, CBUCKET, [4.26, 4.0, 3.0, 1.0])


@register("d8_voltage_at_charge", "test_id voltage_at_0:d voltage_at_1:d mean_dv_dq:d", with_ctes("curves", """
    SELECT test_id, MAX(CASE WHEN p = 5 THEN val END) AS voltage_at_0, MAX(CASE WHEN p = 20 THEN val END) AS voltage_at_1,
      (MAX(CASE WHEN p = 20 THEN val END) - MAX(CASE WHEN p = 5 THEN val END)) / 15.0 AS mean_dv_dq
    FROM (SELECT test_id, p, CASE WHEN h.pq IS NULL THEN h.voltage_V ELSE h.pv2 + LEAST((p - h.pq) / (h.cumulative_ah - h.pq), 1) * (h.voltage_V - h.pv2) END AS val
      FROM (SELECT test_id, p, ARG_MIN(r, r.timestamp_s) FILTER (WHERE r.cumulative_ah >= p - 1e-9) AS h
        FROM (SELECT *, LAG(cumulative_ah) OVER w AS pq, LAG(voltage_V) OVER w AS pv2 FROM cum WHERE ah > 1e-12 OR cumulative_ah = 0 WINDOW w AS (PARTITION BY test_id ORDER BY timestamp_s)) r,
        (VALUES (5e0), (20e0)) AS t(p) GROUP BY 1, 2)) GROUP BY 1""", _TRACE))
def d8_voltage_at_charge(spark, sf_dir):
    return X.voltage_at_charge(X.integrate_curve(_trace(spark, sf_dir), CKEY, CBUCKET), CKEY, [5.0, 20.0])


@register("d9_retention", "cell_id cycle_index:i retention:d", with_ctes("cycles", "SELECT cell_id, cycle_index, retention FROM ret", RET))
def d9_retention(spark, sf_dir):
    return retention(spark, sf_dir)


@register("d10_eol_labels", "dataset_id cell_id cycle_life:i event_observed:b is_censored:b last_observed_cycle:i", with_ctes("cycles", """
    SELECT dataset_id, cell_id, COALESCE(MIN(cycle_index) FILTER (WHERE discharge_capacity_ah <= 1.1e0 * 7.3e-1), MAX(cycle_index)) AS cycle_life,
      bool_or(discharge_capacity_ah <= 1.1e0 * 7.3e-1) AS event_observed, NOT bool_or(discharge_capacity_ah <= 1.1e0 * 7.3e-1) AS is_censored, MAX(cycle_index) AS last_observed_cycle
    FROM cycles GROUP BY 1, 2"""))
def d10_eol_labels(spark, sf_dir):
    return X.eol_labels(A.cycles(spark, sf_dir), nominal_ah=1.1, fraction=0.73)


_SIG_BASE = """SELECT *, retention - LAG(retention) OVER w AS dr, ROW_NUMBER() OVER w AS pos, ROW_NUMBER() OVER (PARTITION BY cell_id ORDER BY cycle_index DESC) AS rk,
    REGR_SLOPE(retention, cycle_index) OVER (PARTITION BY cell_id) AS b, REGR_INTERCEPT(retention, cycle_index) OVER (PARTITION BY cell_id) AS a
    FROM ret WHERE cycle_index <= 100 WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_index)"""


@register("d11_capacity_signature", """cell_id capacity_full_slope:d8 capacity_recent_slope:d8 capacity_slope_disagreement:d8 capacity_residual_std:d capacity_recovery_fraction:d
    log_resistance_slope:d8 temperature_max_slope:d8 log_duration_slope:d8 efficiency_slope:d10""", with_ctes("cycles", f"""
    SELECT *, ABS(capacity_full_slope - capacity_recent_slope) AS capacity_slope_disagreement FROM (SELECT cell_id, MAX(b) AS capacity_full_slope,
      REGR_SLOPE(retention, cycle_index) FILTER (WHERE rk <= 20) AS capacity_recent_slope, SQRT(AVG(POWER(retention - (a + b * cycle_index), 2))) AS capacity_residual_std,
      AVG(CASE WHEN dr > 0.1 THEN 1e0 WHEN dr IS NOT NULL THEN 0e0 END) AS capacity_recovery_fraction,
      REGR_SLOPE(LN(GREATEST(internal_resistance_ohm, 1e-6)), cycle_index) AS log_resistance_slope, REGR_SLOPE(temperature_max_c, cycle_index) AS temperature_max_slope,
      REGR_SLOPE(LN(GREATEST(charge_time_s, 1e-3)), cycle_index) AS log_duration_slope, REGR_SLOPE(energy_efficiency, cycle_index) AS efficiency_slope
    FROM ({_SIG_BASE}) GROUP BY 1)""", RET))
def d11_capacity_signature(spark, sf_dir):
    return X.capacity_signature(retention(spark, sf_dir).filter("cycle_index <= 100"), ["cell_id"])


CURVE_COLS = {
    "voltage_window_s": "charge_time_s - 5e2", "voltage_at_1ah": "3.4e0 - 1e-4 * cycle_index + internal_resistance_ohm",
    "temperature_rise_c": "temperature_avg_c - 24e0", "cutoff_voltage_v": "2.7e0 - internal_resistance_ohm",
}


@register("d12_curve_signature", """cell_id capacity_full_slope:d8 capacity_recent_slope:d8 capacity_slope_disagreement:d8 capacity_residual_std:d capacity_recovery_fraction:d
    voltage_window_slope:d voltage_at_1ah_slope_mv:d8 temperature_rise_slope:d8 cutoff_voltage_v:d8""", with_ctes("cycles", f"""
    SELECT s.*, t.slope AS capacity_recent_slope, ABS(capacity_full_slope - t.slope) AS capacity_slope_disagreement FROM (SELECT cell_id, MAX(b) AS capacity_full_slope,
      SQRT(AVG(POWER(retention - (a + b * cycle_index), 2))) AS capacity_residual_std, AVG(CASE WHEN dr > 0.1 THEN 1e0 WHEN dr IS NOT NULL THEN 0e0 END) AS capacity_recovery_fraction,
      REGR_SLOPE(1e2 * (charge_time_s - 5e2) / w0, cycle_index) AS voltage_window_slope, REGR_SLOPE(1e3 * (3.4e0 - 1e-4 * cycle_index + internal_resistance_ohm), cycle_index) AS voltage_at_1ah_slope_mv,
      REGR_SLOPE(temperature_avg_c - 24e0, cycle_index) AS temperature_rise_slope, ARG_MIN(2.7e0 - internal_resistance_ohm, cycle_index) AS cutoff_voltage_v
      FROM (SELECT *, MEDIAN(CASE WHEN pos <= 5 THEN charge_time_s - 5e2 END) OVER (PARTITION BY cell_id) AS w0 FROM ({_SIG_BASE})) GROUP BY 1) s
    JOIN (SELECT x.cell_id, LEAST(MEDIAN((y.retention - x.retention) / (y.cycle_index - x.cycle_index)), 0) AS slope FROM ret x JOIN ret y
      ON x.cell_id = y.cell_id AND y.cycle_index > x.cycle_index AND x.cycle_index BETWEEN 89 AND 100 AND y.cycle_index BETWEEN 89 AND 100 GROUP BY 1) t USING (cell_id)""", RET))
def d12_curve_signature(spark, sf_dir):
    df = retention(spark, sf_dir).filter("cycle_index <= 100")
    return X.curve_signature(df.withColumns({n: F.expr(e) for n, e in CURVE_COLS.items()}), ["cell_id"], window=12)


@register("d13_stress_features", "condition_id:i x0:d x1:d x2:d x3:d x4:d", with_ctes("cal", """SELECT condition_id, 1e0 AS x0, i AS x1, s AS x2, s * s AS x3, i * s AS x4
    FROM (SELECT DISTINCT condition_id, 1000 * (1 / 298.15e0 - 1 / (temperature_c + 273.15e0)) AS i, storage_soc_fraction - 0.5e0 AS s FROM calendar_obs)"""))
def d13_stress_features(spark, sf_dir):
    prof = A.calendar_obs(spark, sf_dir).select("condition_id", "temperature_c", "storage_soc_fraction").distinct()
    return prof.select("condition_id", *[c.alias(n) for n, c in X.stress_features("temperature_c", "storage_soc_fraction").items()])


@register("d15_leave_last_out_error", "condition_id:i leave_last_out_error:d", with_ctes("cal", """
    SELECT condition_id, ABS(1e2 - LEAST(GREATEST(COALESCE(SUM(SQRT(d / 365.25e0) * (1e2 - r)) FILTER (WHERE d <= 15) / NULLIF(SUM(d / 365.25e0) FILTER (WHERE d <= 15), 0), 0), 0), 5) * SQRT(20 / 365.25e0)
      - MAX(r) FILTER (WHERE d = 20)) AS leave_last_out_error
    FROM (SELECT condition_id, CAST(FLOOR(elapsed_days) AS DOUBLE) AS d, AVG(capacity_retention_pct) AS r FROM calendar_obs GROUP BY 1, 2) GROUP BY 1"""))
def d15_leave_last_out_error(spark, sf_dir):
    daily = A.calendar_obs(spark, sf_dir).groupBy("condition_id", F.floor("elapsed_days").cast("double").alias("elapsed_days")).agg(
        F.avg("capacity_retention_pct").alias("capacity_retention_pct"))
    return X.leave_last_out_sqrt_error(daily, ["condition_id"], fit_until=15.0, score_at=20.0)
