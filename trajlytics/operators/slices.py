"""Sliced error reports over prediction packs (survey rows G6, G12, G13, G18-G22)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.functions.columns import div, is_finite
from trajlytics.operators.scoring import pair_methods, score_trajectories
from trajlytics.plans.scan import dealt_rows, order_statistics

ALL = "__all__"


def with_all_slice(df: DataFrame, family: str) -> DataFrame:
    """Every row once under its family and once under the overall slice."""
    both = F.array(F.lit(ALL), F.col(family).cast("string"))
    return df.withColumn("slice", F.explode(both))


def day_metrics(pack: DataFrame, *, family: str, model: str, day: str, error: str) -> DataFrame:
    """Absolute error per slice x model x horizon day: counts, mean, exact median and P90."""
    sliced = with_all_slice(pack, family).withColumn("_a", F.abs(error))
    keys = ["slice", model, day]
    agg = sliced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(is_finite("_a"), 1)).alias("n_finite"),
        F.avg(F.when(is_finite("_a"), F.col("_a"))).alias("mean_abs_error"))
    q = order_statistics(sliced.filter(is_finite("_a")), keys, "_a", {"median_abs_error": ("linear", 0.5), "p90_abs_error": ("linear", 0.9)})
    return agg.join(q.drop("n"), keys, "left")


def family_metrics(pool: DataFrame, *, family: str, eligible: str, issued: str, catastrophic: str, iae: str, score: str) -> DataFrame:
    """Issued risk against pool risk per family and overall, with the reversal flag."""
    sliced = with_all_slice(pool, family)
    cat = F.col(catastrophic).cast("double")
    agg = sliced.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n_clusters"), F.count(F.when(F.col(eligible), 1)).alias("n_eligible"), F.count(F.when(F.col(issued), 1)).alias("n_issued"),
        F.avg(F.when(F.col(eligible), cat)).alias("pool_rate"), F.avg(F.when(F.col(issued), cat)).alias("issued_rate"), F.avg(iae).alias("mean_iae"))
    q = order_statistics(sliced, ["slice"], score, {"median_score": ("linear", 0.5)}).drop("n")
    reduction = F.when(F.col("pool_rate") > 0, 1.0 - F.col("issued_rate") / F.col("pool_rate"))
    return agg.join(q, "slice").withColumns({
        "risk_reduction": reduction, "reversal": F.coalesce(F.col("issued_rate") > F.col("pool_rate"), F.lit(False))})


def model_metrics(
    points: DataFrame, *, entity: Sequence[str], day: str, models: Sequence[str], latent: str, noisy: str,
    bucket: str | Column, catastrophic_pp: float = 5.0,
) -> DataFrame:
    """Forecast columns to rows, then endpoint and integrated errors against both truths."""
    ids = [*entity, day, latent, noisy]
    long = points.unpivot([F.col(c) for c in ids], [F.col(m) for m in models], "model_id", "forecast")
    truth = points.select(*entity, day, latent, noisy)
    base = long.select(*entity, day, "model_id", "forecast")
    lat = score_trajectories(base, truth, entity=entity, method="model_id", time=day, predicted="forecast", observed=latent, bucket=bucket)
    noi = score_trajectories(base, truth, entity=entity, method="model_id", time=day, predicted="forecast", observed=noisy, bucket=bucket)
    keys = [*entity, "model_id"]
    return lat.select(*keys, F.col("iae").alias("iae_latent"), F.col("final_abs_error").alias("endpoint_latent")).join(
        noi.select(*keys, F.col("iae").alias("iae_noisy"), F.col("final_abs_error").alias("endpoint_noisy")), keys).withColumns({
        "catastrophic": F.col("endpoint_latent") >= catastrophic_pp, "noisy_catastrophic": F.col("endpoint_noisy") >= catastrophic_pp})


def noise_sensitivity(metrics: DataFrame, family: str) -> DataFrame:
    """Noisy minus latent error and catastrophic rate per family and overall."""
    return with_all_slice(metrics, family).groupBy("slice", "model_id").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.avg("iae_latent").alias("mean_iae_latent"), F.avg("iae_noisy").alias("mean_iae_noisy"),
        (F.avg("iae_noisy") - F.avg("iae_latent")).alias("iae_shift"),
        (F.avg("endpoint_noisy") - F.avg("endpoint_latent")).alias("endpoint_shift"),
        (F.avg(F.col("noisy_catastrophic").cast("double")) - F.avg(F.col("catastrophic").cast("double"))).alias("catastrophic_rate_shift"))


def landmark_summary(scores: DataFrame, *, landmark: str, scenario: str, unit: str, method: str, candidate: str, comparator: str, tolerance: float = 1e-9) -> DataFrame:
    """Per landmark: paired means over units, worst regression, counts, and whether every scenario gains."""
    paired = pair_methods(scores, [landmark, scenario, unit], method, "iae", [(candidate, comparator)])
    d = F.col("delta")
    per = paired.groupBy(landmark, scenario).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("candidate_value").alias("_c"), F.sum("comparator_value").alias("_k"), F.max(d).alias("_w"), F.avg(d).alias("_m"),
        F.count(F.when(d < -tolerance, 1)).alias("_b"), F.count(F.when(d > tolerance, 1)).alias("_x"))
    return per.groupBy(landmark).agg(
        F.sum("_n").alias("n_units"), (F.sum("_c") / F.sum("_n")).alias("candidate_mean"), (F.sum("_k") / F.sum("_n")).alias("comparator_mean"),
        F.max("_w").alias("max_regression"), F.sum("_b").alias("n_better"), F.sum("_x").alias("n_worse"),
        (F.sum("_n") - F.sum("_b") - F.sum("_x")).alias("n_equal"), F.bool_and(F.col("_m") < 0).alias("all_scenarios_gain"))


def failure_summary(fits: DataFrame, *, partition: str, family: str, entity: str) -> DataFrame:
    """Clusters per partition x family x number of credible families x failure status."""
    dealt = dealt_rows(fits.select(partition, family, entity, "credible_variant", "model_id", "fit_status"), [entity])
    per = dealt.groupBy(partition, family, entity).agg(
        F.countDistinct(F.when(F.col("credible_variant"), F.col("model_id"))).alias("credible_families"),
        F.count(F.when(F.col("fit_status") != "ok", 1)).alias("_f"), F.count(F.lit(1)).alias("_n"))
    status = F.when(F.col("_f") == 0, "all_succeeded").when(F.col("_f") == F.col("_n"), "all_failed").otherwise("some_failed")
    return per.withColumn("status", status).groupBy(partition, family, "credible_families", "status").agg(
        F.count(F.lit(1)).alias("n_clusters"), F.sum("_f").alias("n_failed_fits"))


def cohort_summary(scores: DataFrame, by: Sequence[str], method: str) -> DataFrame:
    return scores.groupBy(*by, method).agg(
        F.count(F.lit(1)).alias("n_cells"), F.avg("iae").alias("mean_iae"), F.stddev_samp("iae").alias("sd_iae"),
        F.min("iae").alias("min_iae"), F.max("iae").alias("max_iae"), F.avg("final_error").alias("mean_final_error"))


def residual_drilldown(packs: dict[str, DataFrame], truth: DataFrame, *, on: Sequence[str], target: Column, predicted: str, observed: str) -> DataFrame:
    """Residuals of the selected targets under several prediction sources, side by side."""
    out = None
    for name, pack in packs.items():
        part = pack.filter(target).select(*on, F.lit(name).alias("source"), F.col(predicted).alias("predicted"))
        out = part if out is None else out.unionByName(part)
    joined = out.join(truth.filter(target).select(*on, F.col(observed).alias("observed")), list(on))
    r = F.col("predicted") - F.col("observed")
    return joined.withColumns({"residual": r, "relative_residual_pct": 100.0 * div(r, "observed")})
