"""What must hold of iterative fits, whose values SQL cannot recompute: row counts by SQL, violations expected to be none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.operators import hierarchical as B
from trajlytics.operators import isotonic as I
from trajlytics.operators import lifetime as M
from trajlytics.plans.scan import previous, value_bucket
from trajlytics.queries import hierarchical as HQ
from trajlytics.queries import lifetime as LQ
from trajlytics.queries import packs as P
from trajlytics.queries.registry import register
from trajlytics.queries.scoring import POOL_SQL, pool_flags
from trajlytics.sources.adapters import with_ctes

L = HQ.L


def count_if(condition: Column) -> Column:
    """Rows on which the condition holds or cannot be decided."""
    return F.count(F.when(F.coalesce(condition, F.lit(True)), 1))


@register("e12_rate_moments", "n_conditions:i n_moments_off:i", with_ctes("cal", """
    SELECT COUNT(DISTINCT condition_id) AS n_conditions, 0 AS n_moments_off FROM calendar_obs"""))
def e12_rate_moments(spark, sf_dir):
    """Residuals of the log rates are orthogonal to every stress feature at an inner least-squares solution."""
    obs = P.observations(spark, sf_dir).withColumn("elapsed_hours", F.col("elapsed_days") * 24)
    beta = B.stress_surface(obs).first()
    rows = B.stress_rows(obs)
    fitted = sum(F.lit(beta[f"beta{i}"]) * F.col(x) for i, x in enumerate(B.X))
    moments = [F.abs(F.sum((F.col("log_k") - fitted) * F.col(x))) > 1e-6 * F.sum(F.abs(F.col(x)) + 1) for x in B.X]
    off = sum(F.when(m, 1).otherwise(0) for m in moments)
    return rows.agg(F.count(F.lit(1)).alias("n_conditions"), off.alias("n_moments_off"))


@register("e17_convergence", "variant n_targets:i n_not_converged:i n_outside:i", with_ctes("cal", f"""
    SELECT variant, COUNT(DISTINCT condition_id) AS n_targets, 0 AS n_not_converged, 0 AS n_outside
    FROM calendar_obs, (VALUES ('power'), ('activation')) AS v(variant) WHERE checkup_index < {L} AND elapsed_days > 0 GROUP BY 1"""))
def e17_convergence(spark, sf_dir):
    obs = P.observations(spark, sf_dir)
    pre = obs.filter(F.col("checkup_index") < L)
    power = B.map_update(pre, B.hierarchical_prior(B.power_parameters(obs), ["log_amplitude", "exponent"]))
    three = B.hierarchical_prior(B.activation_parameters(obs, 7.0), ["log_amplitude", "exponent", "offset_pp"])
    activation = B.map_update(pre, three, timescale=7.0)

    def checks(post: DataFrame, variant: str, m: int) -> DataFrame:
        lo, hi = B.BOUNDS[m]
        outside = F.lit(False)
        for i in range(m):
            outside = outside | ~F.element_at("theta", i + 1).between(lo[i] - 1e-9, hi[i] + 1e-9)
        return post.agg(
            F.lit(variant).alias("variant"), F.count(F.lit(1)).alias("n_targets"),
            count_if(~F.col("converged")).alias("n_not_converged"), count_if(outside).alias("n_outside"),
        )

    return checks(power, "power", 2).unionByName(checks(activation, "activation", 3))


_FUTURE = f"""fu AS (SELECT * FROM calendar_obs WHERE checkup_index >= {L} AND condition_id IN
    (SELECT condition_id FROM calendar_obs WHERE checkup_index < {L} AND elapsed_days > 0))"""


@register("e19_routed_rows", "method n_rows:i n_targets:i n_not_finite:i", with_ctes("cal", """
    SELECT method, COUNT(*) AS n_rows, COUNT(DISTINCT condition_id) AS n_targets, 0 AS n_not_finite
    FROM fu, (VALUES ('sqrt'), ('hierarchical_power'), ('target_activation'), ('hierarchical_activation'),
      ('gated_target_activation'), ('gated_hierarchical_activation')) AS m(method) GROUP BY 1""", _FUTURE))
def e19_routed_rows(spark, sf_dir):
    obs = P.observations(spark, sf_dir)
    coords = obs.filter(F.col("checkup_index") >= L).select("condition_id", "checkup_index", "elapsed_days")
    routed = B.routed_predictions(B.routed_states(obs, landmark=L, margin_pp=0.05), coords)
    bad = F.col("predicted").isNull() | F.isnan("predicted")
    return routed.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("condition_id").alias("n_targets"), count_if(bad).alias("n_not_finite")
    )


@register("e21_residual_rows", "n_rows:i n_conditions:i n_inconsistent:i n_bad_sd:i n_not_future:i", with_ctes("cal", """
    SELECT COUNT(*) AS n_rows, COUNT(DISTINCT condition_id) AS n_conditions, 0 AS n_inconsistent, 0 AS n_bad_sd, 0 AS n_not_future FROM fu""", _FUTURE))
def e21_residual_rows(spark, sf_dir):
    obs = P.observations(spark, sf_dir)
    found = B.cross_fitted_residuals(obs, landmark=L).join(obs.select("condition_id", "checkup_index", "capacity_retention_pct"), ["condition_id", "checkup_index"])
    apart = F.abs(F.col("capacity_retention_pct") - F.col("predicted") - F.col("residual_pp")) > 1e-9
    return found.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("condition_id").alias("n_conditions"), count_if(apart).alias("n_inconsistent"),
        count_if(~(F.col("predictive_sd") >= 0.05)).alias("n_bad_sd"), count_if(~(F.col("horizon_days") >= 0)).alias("n_not_future"),
    )


@register("h4_score_rows", "n_conditions:i n_points:i n_bad_scores:i", with_ctes("cal", """
    SELECT COUNT(DISTINCT condition_id) AS n_conditions, COUNT(*) AS n_points, 0 AS n_bad_scores FROM fu WHERE checkup_index < 40""", _FUTURE))
def h4_score_rows(spark, sf_dir):
    scores = B.calibration_scores(B.cross_fitted_residuals(P.observations(spark, sf_dir), landmark=L), first=L, last=40)
    bad = ~(F.col("score") >= 0) | F.isnan("score")
    return scores.agg(F.count(F.lit(1)).alias("n_conditions"), F.sum("n_points").alias("n_points"), count_if(bad).alias("n_bad_scores"))


@register("f2_convergence", "model n_events:i n_censored:i converged:b", with_ctes("", """
    SELECT model, COUNT(*) FILTER (WHERE c_nationkey % 4 <> 0) AS n_events, COUNT(*) FILTER (WHERE c_nationkey % 4 = 0) AS n_censored, TRUE AS converged
    FROM customer, (VALUES ('weak'), ('strong')) AS m(model) GROUP BY 1"""))
def f2_convergence(spark, sf_dir):
    fits = M.fit_aft(LQ._customers(spark, sf_dir), ["x"], "life", "cens", models={"weak": (None, 1e-4), "strong": (None, 10.0)})
    rows = [(n, m.n_events, m.n_censored, m.converged) for n, m in fits.items()]
    return spark.createDataFrame(rows, "model string, n_events long, n_censored long, converged boolean")


@register("f3_prediction_order", "n_rows:i n_quantiles_out_of_order:i n_survival_outside:i n_median_off:i", """
    SELECT COUNT(*) AS n_rows, 0 AS n_quantiles_out_of_order, 0 AS n_survival_outside, 0 AS n_median_off FROM customer""")
def f3_prediction_order(spark, sf_dir):
    found = LQ.f3_aft_predictions(spark, sf_dir)
    ordered = (F.col("p10") < F.col("p50")) & (F.col("p50") < F.col("p90"))
    # by the definition of the median, survival at 800 is above one half exactly where the median is above 800
    side = (F.col("survival_800") > 0.5) == (F.col("p50") > 800.0)
    return found.agg(
        F.count(F.lit(1)).alias("n_rows"), count_if(~ordered).alias("n_quantiles_out_of_order"),
        count_if(~F.col("survival_800").between(0.0, 1.0) | ~side).alias("n_survival_outside"),
        count_if(F.abs(F.col("p50") - F.exp("log_location")) > 1e-6 * F.col("p50")).alias("n_median_off"),
    )


@register("f4_selection_rule", "n_penalties:i n_selected:i n_better_left:i", """
    SELECT 3 AS n_penalties, 1 AS n_selected, 0 AS n_better_left FROM (SELECT COUNT(*) FROM lineitem)""")
def f4_selection_rule(spark, sf_dir):
    """Exactly one penalty is selected and none of the others has a lower mean loss."""
    table = LQ.f4_select_l2(spark, sf_dir)
    chosen = F.min(F.when(F.col("selected"), F.col("mean_group_nll")))
    return table.agg(
        F.count(F.lit(1)).alias("n_penalties"), count_if(F.col("selected")).alias("n_selected"),
        F.when(F.min("mean_group_nll") < chosen, 1).otherwise(0).alias("n_better_left"),
    )


@register("f7_reference_rows", "batch_id k:i method n_rows:i n_bad_coverage:i", """
    SELECT CAST(b AS VARCHAR) AS batch_id, k, method, 10 * (n - 5) AS n_rows, 0 AS n_bad_coverage
    FROM (SELECT s_nationkey % 3 AS b, COUNT(*) AS n FROM supplier GROUP BY 1), (VALUES (1), (3), (5)) AS t(k),
      (VALUES ('zero_shot'), ('shrunk_offset'), ('unshrunk_offset'), ('source_control')) AS m(method) WHERE n > 5""")
def f7_reference_rows(spark, sf_dir):
    found = LQ.f7_reference_experiment(spark, sf_dir)
    bad = ~F.col("p10_p90_coverage").between(0.0, 1.0)
    return found.groupBy("batch_id", "k", "method").agg(F.sum("n_rows").alias("n_rows"), count_if(bad).alias("n_bad_coverage"))


_POOL_COUNT = "SELECT COUNT(*) AS n_rows, 0 AS n_outside, 0 AS n_order_violations, TRUE AS mean_is_prevalence FROM pf"


def _probability_checks(scored: DataFrame, score: str, probability: str, tolerance: float) -> DataFrame:
    """Probabilities lie in [0, 1], never fall along the score, and average to the share of positives."""
    levels = scored.groupBy(score).agg(F.min(probability).alias("_lo"), F.max(probability).alias("_hi"))
    steps = previous(levels, [], value_bucket(score), [score], {"_before": "_hi"})
    falls = steps.agg(F.count(F.when(F.col("_lo") < F.col("_before") - 1e-9, 1)).alias("n"))
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"), count_if(~F.col(probability).between(0.0, 1.0)).alias("n_outside"),
        (F.abs(F.avg(probability) - F.avg(F.col("catastrophic").cast("double"))) < tolerance).alias("mean_is_prevalence"),
    ).withColumn("n_order_violations", falls.select("n").scalar())


@register("f10_probability_checks", "n_rows:i n_outside:i n_order_violations:i mean_is_prevalence:b", with_ctes("pool", _POOL_COUNT, POOL_SQL))
def f10_probability_checks(spark, sf_dir):
    pool = pool_flags(spark, sf_dir)
    scored = M.logistic_danger(pool, ["disagreement", "iae"], "catastrophic").select("cluster_id", "danger_score", "danger_probability")
    return _probability_checks(scored.join(pool.select("cluster_id", "catastrophic"), "cluster_id"), "danger_score", "danger_probability", 1e-3)


@register("f11_probability_checks", "n_rows:i n_outside:i n_order_violations:i mean_is_prevalence:b", with_ctes("pool", _POOL_COUNT, POOL_SQL))
def f11_probability_checks(spark, sf_dir):
    pool = pool_flags(spark, sf_dir)
    scored = I.isotonic_probability(pool.withColumn("catastrophic", F.col("catastrophic").cast("double")), "disagreement", "catastrophic").select("cluster_id", "calibrated_probability")
    joined = scored.join(pool.select("cluster_id", "disagreement", "catastrophic"), "cluster_id")
    return _probability_checks(joined, "disagreement", "calibrated_probability", 1e-3)
