"""Scoring and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.operators import scoring as G
from trajlytics.operators import slices as Z
from trajlytics.queries import packs as P
from trajlytics.queries.contracts import FIT_EXPRS
from trajlytics.queries.registry import register
from trajlytics.sources import adapters as A
from trajlytics.sources.adapters import table, with_ctes

PRED, SCORE = P.pred_sql(), P.score_sql()
PAIRS = [("prefix_linear", "persistence"), ("prefix_sqrt", "persistence"), ("prefix_sqrt", "prefix_linear")]
PAIR_SQL = """pairs AS (SELECT a.condition_id, a.method AS candidate, b.method AS comparator, a.iae AS candidate_value, b.iae AS comparator_value, a.iae - b.iae AS delta
    FROM score a JOIN score b USING (condition_id) WHERE (a.method, b.method) IN (('prefix_linear', 'persistence'), ('prefix_sqrt', 'persistence'), ('prefix_sqrt', 'prefix_linear')))"""
SUMMARY_SQL = """SELECT candidate, comparator, COUNT(*) AS n_units, AVG(candidate_value) AS candidate_mean, AVG(comparator_value) AS comparator_mean, AVG(delta) AS mean_delta,
    100 * (AVG(comparator_value) - AVG(candidate_value)) / AVG(comparator_value) AS relative_gain_pct, COUNT(*) FILTER (WHERE delta < -0.01) AS n_better,
    COUNT(*) FILTER (WHERE delta > 0.01) AS n_worse, COUNT(*) FILTER (WHERE ABS(delta) <= 0.01) AS n_equal, MAX(delta) AS worst_delta, ARG_MAX(condition_id, delta) AS worst_unit FROM pairs GROUP BY 1, 2"""
SUMMARY_SPEC = "candidate comparator n_units:i candidate_mean:d comparator_mean:d mean_delta:d relative_gain_pct:d n_better:i n_worse:i n_equal:i worst_delta:d worst_unit:i"


@register("g1_trajectory_scores", "condition_id:i method n_points:i iae:d mae:d rmse:d final_error:d final_abs_error:d", with_ctes("cal", "SELECT * FROM score", PRED, SCORE))
def g1_trajectory_scores(spark, sf_dir):
    return P.scored(spark, sf_dir)


@register("g2_method_summary", "method n_units:i mean_iae:d median_iae:d final_mae:d final_rmse:d final_bias:d final_max:d", with_ctes("cal", """
    SELECT method, COUNT(*) AS n_units, AVG(iae) AS mean_iae, MEDIAN(iae) AS median_iae, AVG(ABS(final_error)) AS final_mae, SQRT(AVG(final_error * final_error)) AS final_rmse,
      AVG(final_error) AS final_bias, MAX(ABS(final_error)) AS final_max FROM score GROUP BY 1""", PRED, SCORE))
def g2_method_summary(spark, sf_dir):
    return G.method_summary(P.scored(spark, sf_dir), ["method"])


_SHIFTED_TARGET = "condition_id + CASE WHEN condition_id % 13 = 5 THEN 1000000 ELSE 0 END"
_SHIFTED_INDEX = """checkup_index + CASE WHEN storage_soc_fraction = 0.5 AND checkup_index = 12 THEN 1000
      WHEN condition_id % 11 = 0 AND method = 'persistence' THEN 1 ELSE 0 END"""
_DIRTY = f"""dirty AS (SELECT {_SHIFTED_TARGET} AS condition_id, method, {_SHIFTED_INDEX} AS checkup_index,
      elapsed_days + CASE WHEN checkup_index = 15 THEN 1e-3 ELSE 0e0 END AS elapsed_days, CASE WHEN checkup_index = 20 THEN NULL ELSE predicted END AS predicted,
      checkup_index = 40 AS is_final FROM pred),
    tr AS (SELECT condition_id, checkup_index, elapsed_days, checkup_index = MAX(checkup_index) OVER (PARTITION BY condition_id) AS fin FROM calendar_obs WHERE checkup_index >= 10),
    ex AS (SELECT * FROM tr, (SELECT DISTINCT method FROM dirty)),
    fj AS (SELECT d.predicted, d.is_final, d.elapsed_days AS td, e.elapsed_days AS te, e.fin, d.condition_id IS NOT NULL AS has_d, e.condition_id IS NOT NULL AS has_e
      FROM ex e FULL JOIN dirty d ON e.condition_id = d.condition_id AND e.checkup_index = d.checkup_index AND e.method = d.method)"""


@register("g3_validate_predictions", "rule violations:i", with_ctes("cal", """
    SELECT 'coordinate_without_truth' AS rule, COUNT(*) AS violations FROM fj WHERE NOT has_e UNION ALL SELECT 'future_coordinate_missing', COUNT(*) FROM fj WHERE NOT has_d
    UNION ALL SELECT 'time_axis_changed', COUNT(*) FROM fj WHERE has_d AND has_e AND ABS(td - te) > 1e-9 UNION ALL SELECT 'final_flag_wrong', COUNT(*) FROM fj WHERE has_d AND has_e AND is_final <> fin
    UNION ALL SELECT 'prediction_not_finite', COUNT(*) FROM fj WHERE has_d AND predicted IS NULL
    UNION ALL SELECT 'duplicate_prediction', COUNT(*) FROM (SELECT 1 FROM dirty GROUP BY condition_id, checkup_index, method HAVING COUNT(*) > 1)
    UNION ALL SELECT 'target_missing', COUNT(*) FROM (SELECT DISTINCT condition_id, method FROM ex EXCEPT SELECT condition_id, method FROM dirty)""", PRED, _DIRTY))
def g3_validate_predictions(spark, sf_dir):
    obs = P.observations(spark, sf_dir)
    dirty = P.predictions(obs).select(
        F.expr(_SHIFTED_TARGET).alias("condition_id"), "method", F.expr(_SHIFTED_INDEX).alias("checkup_index"),
        F.expr("elapsed_days + CASE WHEN checkup_index = 15 THEN 1e-3 ELSE 0e0 END").alias("elapsed_days"),
        F.expr("CASE WHEN checkup_index = 20 THEN NULL ELSE predicted END").alias("predicted"), F.expr("checkup_index = 40").alias("is_final"))
    truth = obs.filter("checkup_index >= 10").select("condition_id", "checkup_index", "elapsed_days")
    return G.validate_predictions(dirty, truth, entity=["condition_id"], method="method", index="checkup_index", time="elapsed_days", predicted="predicted")


@register("g4_regression_metrics", "route n_rows:i mae:d4 rmse:d4 mape_pct:d4", with_ctes("quant", """
    SELECT route, COUNT(*) AS n_rows, AVG(ABS(p50 - truth)) AS mae, SQRT(AVG(POWER(p50 - truth, 2))) AS rmse, 100 * AVG(ABS(p50 - truth) / truth) AS mape_pct FROM quantile_rows GROUP BY 1"""))
def g4_regression_metrics(spark, sf_dir):
    return G.regression_metrics(A.quantile_rows(spark, sf_dir), ["route"], "truth", "p50")


@register("g5_lognormal_metrics", "route n_groups:i n_rows:i nll:d ape_pct:d4 coverage:d", with_ctes("quant", """
    SELECT route, COUNT(*) AS n_groups, SUM(n) AS n_rows, AVG(nll) AS nll, AVG(ape) AS ape_pct, AVG(cov) AS coverage FROM (
      SELECT route, protocol_id, COUNT(*) AS n, AVG(LN(truth) + LN(sg) + 0.9189385332046727e0 + z * z / 2) AS nll, AVG(1e2 * ABS(p50 - truth) / truth) AS ape,
        AVG(CASE WHEN ABS(z) <= 1.2815515655446004e0 THEN 1e0 ELSE 0e0 END) AS cov
      FROM (SELECT *, 5e-1 AS sg, (LN(truth) - LN(p50)) / 5e-1 AS z FROM quantile_rows) GROUP BY 1, 2) GROUP BY 1"""))
def g5_lognormal_metrics(spark, sf_dir):
    rows = G.lognormal_rows(A.quantile_rows(spark, sf_dir), "truth", "p50", F.lit(0.5))
    return G.two_level_metrics(rows, ["protocol_id"], ["route"])


LANDMARKS = [6, 10, 20]


def _landmark_pack(spark, sf_dir):
    obs = P.observations(spark, sf_dir)
    out = None
    for p in LANDMARKS:
        part = P.predictions(obs, p).withColumn("landmark", F.lit(p))
        out = part if out is None else out.unionByName(part)
    return obs, out


def _landmark_scores(spark, sf_dir):
    obs, pack = _landmark_pack(spark, sf_dir)
    window = G.common_support(pack, "landmark", ["condition_id"], "checkup_index", max(LANDMARKS))
    keyed = window.withColumn("landmark_method", F.concat_ws("|", F.col("landmark").cast("string"), "method"))
    scores = G.score_trajectories(keyed, obs, entity=["condition_id"], method="landmark_method", time="elapsed_days",
                                  predicted="predicted", observed="capacity_retention_pct", bucket=P.DAY_BUCKET)
    return scores.withColumns({"landmark": F.split("landmark_method", r"\|")[0].cast("int"), "method": F.split("landmark_method", r"\|")[1]})


_LAND = [P.pred_sql(p, f"p{p}") for p in LANDMARKS] + [
    "lpred AS (" + " UNION ALL ".join(f"SELECT *, {p} AS landmark FROM p{p} WHERE checkup_index >= 20" for p in LANDMARKS) + ")",
    P.score_sql("lpred", "lscore", "landmark, condition_id, method")]


@register("g6_common_support_scores", "landmark:i condition_id:i method n_points:i iae:d final_error:d", with_ctes("cal", "SELECT * FROM lscore", *_LAND))
def g6_common_support_scores(spark, sf_dir):
    return _landmark_scores(spark, sf_dir)


def _paired(spark, sf_dir):
    return G.pair_methods(P.scored(spark, sf_dir), ["condition_id"], "method", "iae", PAIRS)


@register("g7_paired_methods", "condition_id:i candidate comparator candidate_value:d comparator_value:d delta:d", with_ctes("cal", "SELECT * FROM pairs", PRED, SCORE, PAIR_SQL))
def g7_paired_methods(spark, sf_dir):
    return _paired(spark, sf_dir)


@register("g8_comparison_summary", SUMMARY_SPEC, with_ctes("cal", SUMMARY_SQL, PRED, SCORE, PAIR_SQL))
def g8_comparison_summary(spark, sf_dir):
    return G.comparison_summary(_paired(spark, sf_dir), ["candidate", "comparator"], "condition_id", tolerance=0.01)


@register("g9_scenario_gates", "candidate comparator improvement_ok:b error_ok:b status", with_ctes("cal", f"""
    SELECT candidate, comparator, relative_gain_pct >= 5 AS improvement_ok, candidate_mean <= 0.5 AS error_ok,
      CASE WHEN relative_gain_pct >= 5 AND candidate_mean <= 0.5 THEN 'passed' ELSE 'failed' END AS status FROM ({SUMMARY_SQL})""", PRED, SCORE, PAIR_SQL))
def g9_scenario_gates(spark, sf_dir):
    summary = G.comparison_summary(_paired(spark, sf_dir), ["candidate", "comparator"], "condition_id", tolerance=0.01)
    return G.scenario_gates(summary, min_gain_pct=5.0, max_candidate=0.5)


@register("g10_suffix_strata", "temperature_c:d storage_soc_fraction:d method grouping_level:i n_rows:i mean_abs_error:d mean_error:d", with_ctes("cal", """
    SELECT temperature_c, storage_soc_fraction, method, GROUPING(temperature_c, storage_soc_fraction, method) AS grouping_level, COUNT(*) AS n_rows,
      AVG(ABS(error)) AS mean_abs_error, AVG(error) AS mean_error FROM pred GROUP BY GROUPING SETS ((method), (temperature_c, method), (storage_soc_fraction, method), (temperature_c, storage_soc_fraction, method))""", PRED))
def g10_suffix_strata(spark, sf_dir):
    sets = [["method"], ["temperature_c", "method"], ["storage_soc_fraction", "method"], ["temperature_c", "storage_soc_fraction", "method"]]
    return G.grouped_scores(P.with_error(spark, sf_dir), sets, ["temperature_c", "storage_soc_fraction", "method"], {
        "n_rows": F.count(F.lit(1)), "mean_abs_error": F.avg(F.abs("error")), "mean_error": F.avg("error")})


@register("g11_cell_day_deltas", "soc:d day:i grouping_level:i n_pairs:i mean_delta:d n_better:i", with_ctes("cal", """
    SELECT soc, day, GROUPING(soc, day) AS grouping_level, COUNT(*) AS n_pairs, AVG(delta) AS mean_delta, COUNT(*) FILTER (WHERE delta < 0) AS n_better
    FROM (SELECT a.storage_soc_fraction AS soc, CAST(FLOOR(a.elapsed_days) AS BIGINT) AS day, ABS(a.error) - ABS(b.error) AS delta FROM pred a JOIN pred b
      ON a.condition_id = b.condition_id AND a.checkup_index = b.checkup_index AND a.method = 'prefix_sqrt' AND b.method = 'prefix_linear')
    GROUP BY GROUPING SETS ((), (soc), (day), (soc, day))""", PRED))
def g11_cell_day_deltas(spark, sf_dir):
    pack = P.with_error(spark, sf_dir).withColumns({"soc": F.col("storage_soc_fraction"), "day": F.floor("elapsed_days"), "abs_error": F.abs("error")})
    paired = G.pair_methods(pack, ["condition_id", "checkup_index", "soc", "day"], "method", "abs_error", [("prefix_sqrt", "prefix_linear")])
    return G.grouped_scores(paired, [[], ["soc"], ["day"], ["soc", "day"]], ["soc", "day"], {
        "n_pairs": F.count(F.lit(1)), "mean_delta": F.avg("delta"), "n_better": F.count(F.when(F.col("delta") < 0, 1))})


@register("g12_day_metrics", "slice method day:i n_rows:i n_finite:i mean_abs_error:d median_abs_error:d p90_abs_error:d", with_ctes("cal", """
    SELECT slice, method, day, COUNT(*) AS n_rows, COUNT(*) AS n_finite, AVG(a) AS mean_abs_error, MEDIAN(a) AS median_abs_error, QUANTILE_CONT(a, 0.9) AS p90_abs_error
    FROM (SELECT UNNEST(['__all__', 'T' || CAST(temperature_c AS BIGINT)]) AS slice, method, CAST(FLOOR(elapsed_days) AS BIGINT) AS day, ABS(error) AS a FROM pred) GROUP BY 1, 2, 3""", PRED))
def g12_day_metrics(spark, sf_dir):
    pack = P.with_error(spark, sf_dir).withColumns({"day": F.floor("elapsed_days"), "family": F.concat(F.lit("T"), F.col("temperature_c").cast("bigint").cast("string"))})
    return Z.day_metrics(pack, family="family", model="method", day="day", error="error")


POOL_FLAGS = {"eligible": "disagreement < 1.9e1", "issued": "disagreement < 9e0 AND danger < 8e-1", "catastrophic": "endpoint_error >= 2e0"}


def pool_flags(spark, sf_dir):
    return A.pool(spark, sf_dir).withColumns({n: F.expr(e) for n, e in POOL_FLAGS.items()})


POOL_SQL = "pf AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in POOL_FLAGS.items()) + " FROM pool)"


@register("g12_family_metrics", "slice n_clusters:i n_eligible:i n_issued:i pool_rate:d issued_rate:d mean_iae:d median_score:d risk_reduction:d reversal:b", with_ctes("pool", """
    SELECT slice, COUNT(*) AS n_clusters, COUNT(*) FILTER (WHERE eligible) AS n_eligible, COUNT(*) FILTER (WHERE issued) AS n_issued,
      AVG(c) FILTER (WHERE eligible) AS pool_rate, AVG(c) FILTER (WHERE issued) AS issued_rate, AVG(iae) AS mean_iae, MEDIAN(disagreement) AS median_score,
      1 - AVG(c) FILTER (WHERE issued) / AVG(c) FILTER (WHERE eligible) AS risk_reduction, AVG(c) FILTER (WHERE issued) > AVG(c) FILTER (WHERE eligible) AS reversal
    FROM (SELECT *, UNNEST(['__all__', family]) AS slice, CASE WHEN catastrophic THEN 1e0 ELSE 0e0 END AS c FROM pf) GROUP BY 1""", POOL_SQL))
def g12_family_metrics(spark, sf_dir):
    return Z.family_metrics(pool_flags(spark, sf_dir), family="family", eligible="eligible", issued="issued", catastrophic="catastrophic", iae="iae", score="disagreement")


_NOISY = "capacity_retention_pct + 2e-1 * (checkup_index % 3 - 1)"
_WIDE = f"""wide AS (SELECT condition_id, elapsed_days, capacity_retention_pct AS latent, {_NOISY} AS noisy, l AS m_persistence, 1e2 - k * SQRT(elapsed_days) AS m_sqrt
      FROM calendar_obs JOIN pred_fit USING (condition_id) WHERE checkup_index >= 10),
    lg AS (SELECT condition_id, method, elapsed_days, predicted - latent AS el, predicted - noisy AS en FROM (SELECT *, UNNEST([{{'method': 'm_persistence', 'predicted': m_persistence}},
      {{'method': 'm_sqrt', 'predicted': m_sqrt}}], recursive := true) FROM wide)),
    mm AS (SELECT condition_id, method AS model_id, SUM((ABS(el) + ABS(pl)) / 2 * dt) / (MAX(elapsed_days) - MIN(elapsed_days)) AS iae_latent, ABS(ARG_MAX(el, elapsed_days)) AS endpoint_latent,
      SUM((ABS(en) + ABS(pn)) / 2 * dt) / (MAX(elapsed_days) - MIN(elapsed_days)) AS iae_noisy, ABS(ARG_MAX(en, elapsed_days)) AS endpoint_noisy,
      ABS(ARG_MAX(el, elapsed_days)) >= 0.5 AS catastrophic, ABS(ARG_MAX(en, elapsed_days)) >= 0.5 AS noisy_catastrophic
      FROM (SELECT *, LAG(el) OVER w AS pl, LAG(en) OVER w AS pn, elapsed_days - LAG(elapsed_days) OVER w AS dt FROM lg WINDOW w AS (PARTITION BY condition_id, method ORDER BY elapsed_days)) GROUP BY 1, 2)"""


def _model_metrics(spark, sf_dir):
    obs = P.observations(spark, sf_dir)
    pack = P.predictions(obs)
    wide = pack.groupBy("condition_id", "checkup_index").agg(
        F.max(F.when(F.col("method") == "persistence", F.col("predicted"))).alias("m_persistence"),
        F.max(F.when(F.col("method") == "prefix_sqrt", F.col("predicted"))).alias("m_sqrt"))
    points = obs.select("condition_id", "checkup_index", "elapsed_days", F.col("capacity_retention_pct").alias("latent"), F.expr(_NOISY).alias("noisy")).join(
        wide, ["condition_id", "checkup_index"])
    return Z.model_metrics(points, entity=["condition_id"], day="elapsed_days", models=["m_persistence", "m_sqrt"], latent="latent", noisy="noisy",
                           bucket=P.DAY_BUCKET, catastrophic_pp=0.5)


@register("g13_model_metrics", "condition_id:i model_id iae_latent:d endpoint_latent:d iae_noisy:d endpoint_noisy:d catastrophic:b noisy_catastrophic:b",
          with_ctes("cal", "SELECT * FROM mm", PRED, _WIDE))
def g13_model_metrics(spark, sf_dir):
    return _model_metrics(spark, sf_dir)


@register("g14_strongest_baseline", "selected mean_value:d status", with_ctes("cal", """
    SELECT CASE WHEN ok THEN m END AS selected, CASE WHEN ok THEN v END AS mean_value, CASE WHEN ok THEN 'selected' ELSE 'incomplete_baseline' END AS status FROM (
      SELECT ARG_MIN(method, v) AS m, MIN(v) AS v, COUNT(*) = 3 AND MIN(n) = (SELECT COUNT(DISTINCT condition_id) FROM score) AS ok FROM (SELECT method, AVG(iae) AS v, COUNT(iae) AS n FROM score GROUP BY 1))""", PRED, SCORE))
def g14_strongest_baseline(spark, sf_dir):
    return G.strongest_baseline(P.scored(spark, sf_dir), "method", "iae", "condition_id", P.METHODS)


@register("g15_stability_quantiles", "candidate comparator n:i mean_delta:d median_delta:d p05_delta:d p95_delta:d favourable_fraction:d", with_ctes("cal", """
    SELECT candidate, comparator, COUNT(*) AS n, AVG(delta) AS mean_delta, MEDIAN(delta) AS median_delta, QUANTILE_CONT(delta, 0.05) AS p05_delta, QUANTILE_CONT(delta, 0.95) AS p95_delta,
      AVG(CASE WHEN delta < -1e-9 THEN 1e0 ELSE 0e0 END) AS favourable_fraction FROM pairs GROUP BY 1, 2""", PRED, SCORE, PAIR_SQL))
def g15_stability_quantiles(spark, sf_dir):
    return G.stability_quantiles(_paired(spark, sf_dir), ["candidate", "comparator"], "delta", tolerance=1e-9)


@register("g16_coefficient_stability", "coefficient n_folds:i mean_value:d sd_value:d min_value:d max_value:d sign_consistent:b dominant_sign_fraction:d", with_ctes("cal", """
    SELECT coefficient, COUNT(*) AS n_folds, AVG(v) AS mean_value, STDDEV_SAMP(v) AS sd_value, MIN(v) AS min_value, MAX(v) AS max_value, MIN(v) > 0 OR MAX(v) < 0 AS sign_consistent,
      GREATEST(COUNT(*) FILTER (WHERE v > 0), COUNT(*) FILTER (WHERE v < 0)) / COUNT(*) AS dominant_sign_fraction
    FROM (SELECT UNNEST([{'coefficient': 'slope', 'v': REGR_SLOPE(capacity_loss_pct, SQRT(elapsed_days))}, {'coefficient': 'intercept', 'v': REGR_INTERCEPT(capacity_loss_pct, SQRT(elapsed_days))}], recursive := true)
      FROM calendar_obs GROUP BY condition_id) GROUP BY 1"""))
def g16_coefficient_stability(spark, sf_dir):
    root, loss = F.sqrt("elapsed_days"), F.col("capacity_loss_pct")
    fits = A.calendar_obs(spark, sf_dir).groupBy("condition_id").agg(F.regr_slope(loss, root).alias("slope"), F.regr_intercept(loss, root).alias("intercept"))
    long = fits.unpivot(["condition_id"], ["slope", "intercept"], "coefficient", "v")
    return G.coefficient_stability(long, "coefficient", "v")


@register("g17_rank_correlation", "partition_id n_rows:i rank_correlation:d", with_ctes("pool", """
    SELECT partition_id, COUNT(*) AS n_rows, CORR(ra, rb) AS rank_correlation FROM (SELECT partition_id,
      RANK() OVER (PARTITION BY partition_id ORDER BY danger) + (COUNT(*) OVER (PARTITION BY partition_id, danger) - 1) / 2.0e0 AS ra,
      RANK() OVER (PARTITION BY partition_id ORDER BY disagreement) + (COUNT(*) OVER (PARTITION BY partition_id, disagreement) - 1) / 2.0e0 AS rb FROM pool) GROUP BY 1"""))
def g17_rank_correlation(spark, sf_dir):
    return G.rank_correlation(A.pool(spark, sf_dir), ["partition_id"], "danger", "disagreement", bucket_a="FLOOR(danger * 100)", bucket_b="FLOOR(disagreement * 10)")


@register("g18_landmark_summary", "landmark:i n_units:i candidate_mean:d comparator_mean:d max_regression:d n_better:i n_worse:i n_equal:i all_scenarios_gain:b", with_ctes("cal", """
    SELECT landmark, SUM(n) AS n_units, SUM(c) / SUM(n) AS candidate_mean, SUM(k) / SUM(n) AS comparator_mean, MAX(w) AS max_regression, SUM(b) AS n_better, SUM(x) AS n_worse,
      SUM(n) - SUM(b) - SUM(x) AS n_equal, bool_and(m < 0) AS all_scenarios_gain FROM (
      SELECT landmark, condition_id % 6 AS scenario, COUNT(*) AS n, SUM(a.iae) AS c, SUM(z.iae) AS k, MAX(a.iae - z.iae) AS w, AVG(a.iae - z.iae) AS m,
        COUNT(*) FILTER (WHERE a.iae - z.iae < -1e-9) AS b, COUNT(*) FILTER (WHERE a.iae - z.iae > 1e-9) AS x
      FROM (SELECT * FROM lscore WHERE method = 'prefix_sqrt') a JOIN (SELECT * FROM lscore WHERE method = 'persistence') z USING (landmark, condition_id) GROUP BY 1, 2) GROUP BY 1""", *_LAND))
def g18_landmark_summary(spark, sf_dir):
    scores = _landmark_scores(spark, sf_dir).withColumn("scenario", F.col("condition_id") % 6)
    return Z.landmark_summary(scores, landmark="landmark", scenario="scenario", unit="condition_id", method="method", candidate="prefix_sqrt", comparator="persistence")


@register("g19_noise_sensitivity", "slice model_id n_units:i mean_iae_latent:d mean_iae_noisy:d iae_shift:d endpoint_shift:d catastrophic_rate_shift:d", with_ctes("cal", """
    SELECT slice, model_id, COUNT(*) AS n_units, AVG(iae_latent) AS mean_iae_latent, AVG(iae_noisy) AS mean_iae_noisy, AVG(iae_noisy) - AVG(iae_latent) AS iae_shift,
      AVG(endpoint_noisy) - AVG(endpoint_latent) AS endpoint_shift, AVG(CASE WHEN noisy_catastrophic THEN 1e0 ELSE 0e0 END) - AVG(CASE WHEN catastrophic THEN 1e0 ELSE 0e0 END) AS catastrophic_rate_shift
    FROM (SELECT *, UNNEST(['__all__', CAST(condition_id % 6 AS VARCHAR)]) AS slice FROM mm) GROUP BY 1, 2""", PRED, _WIDE))
def g19_noise_sensitivity(spark, sf_dir):
    return Z.noise_sensitivity(_model_metrics(spark, sf_dir).withColumn("family", (F.col("condition_id") % 6).cast("string")), "family")


@register("g20_failure_summary", "partition_id family credible_families:i status n_clusters:i n_failed_fits:i", with_ctes("", """
    SELECT partition_id, family, credible_families, CASE WHEN f = 0 THEN 'all_succeeded' WHEN f = n THEN 'all_failed' ELSE 'some_failed' END AS status, COUNT(*) AS n_clusters, SUM(f) AS n_failed_fits
    FROM (SELECT o_orderpriority AS partition_id, o_orderstatus AS family, cluster_id, COUNT(DISTINCT CASE WHEN credible_variant THEN model_id END) AS credible_families,
        COUNT(*) FILTER (WHERE fit_status <> 'ok') AS f, COUNT(*) AS n FROM fits JOIN orders ON o_orderkey = cluster_id GROUP BY 1, 2, 3) GROUP BY 1, 2, 3, 4""",
    f"fits AS (SELECT {A._sql(FIT_EXPRS)} FROM lineitem)"))
def g20_failure_summary(spark, sf_dir):
    fits = table(spark, sf_dir, "lineitem").select(*A._select(FIT_EXPRS))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cluster_id"), F.col("o_orderpriority").alias("partition_id"), F.col("o_orderstatus").alias("family"))
    return Z.failure_summary(fits.join(orders, "cluster_id"), partition="partition_id", family="family", entity="cluster_id")


@register("g21_cohort_summary", "temperature_c:d method n_cells:i mean_iae:d sd_iae:d min_iae:d max_iae:d mean_final_error:d", with_ctes("cal", """
    SELECT temperature_c, method, COUNT(*) AS n_cells, AVG(iae) AS mean_iae, STDDEV_SAMP(iae) AS sd_iae, MIN(iae) AS min_iae, MAX(iae) AS max_iae, AVG(final_error) AS mean_final_error
    FROM score JOIN (SELECT DISTINCT condition_id, temperature_c FROM calendar_obs) USING (condition_id) GROUP BY 1, 2""", PRED, SCORE))
def g21_cohort_summary(spark, sf_dir):
    profile = P.observations(spark, sf_dir).select("condition_id", "temperature_c").distinct()
    scores = P.scored(spark, sf_dir).join(profile, "condition_id")
    return Z.cohort_summary(scores, ["temperature_c"], "method")


@register("g22_residual_drilldown", "condition_id:i checkup_index:i source predicted:d observed:d residual:d relative_residual_pct:d", with_ctes("cal", """
    SELECT condition_id, checkup_index, method AS source, predicted, capacity_retention_pct AS observed, error AS residual, 1e2 * error / capacity_retention_pct AS relative_residual_pct
    FROM pred WHERE temperature_c = 40 AND storage_soc_fraction = 0.5""", PRED))
def g22_residual_drilldown(spark, sf_dir):
    obs = P.observations(spark, sf_dir)
    pack = P.predictions(obs)
    target = (F.col("temperature_c") == 40.0) & (F.col("storage_soc_fraction") == 0.5)
    truth = obs.select("condition_id", "checkup_index", "temperature_c", "storage_soc_fraction", "capacity_retention_pct")
    return Z.residual_drilldown({m: pack.filter(F.col("method") == m) for m in P.METHODS}, truth,
                                on=["condition_id", "checkup_index"], target=target, predicted="predicted", observed="capacity_retention_pct")
