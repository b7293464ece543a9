"""Truth joins, trajectory scores and paired comparison (survey rows G1-G22)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.functions.columns import attach_one_row, div, is_finite, normal_quantile
from trajlytics.plans.scan import order_statistics, previous


def score_trajectories(
    predictions: DataFrame, truth: DataFrame, *, entity: Sequence[str], method: str, time: str,
    predicted: str, observed: str, bucket: str | Column,
) -> DataFrame:
    """Truth join on the coordinates, then ``score_errors`` per (entity, method)."""
    on = [*entity, time]
    joined = predictions.join(truth.select(*on, observed), on).withColumn("_e", F.col(predicted) - F.col(observed))
    return score_errors(joined, [*entity, method], time, "_e", bucket)


def score_errors(errors: DataFrame, keys: Sequence[str], time: str, error: str, bucket: str | Column) -> DataFrame:
    """Per key: integrated absolute error over the span, MAE, RMSE and the final error."""
    return score_error_columns(errors, keys, time, [error], bucket).select(*keys, "n_points", f"{error}.*")


def score_error_columns(errors: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], bucket: str | Column, *, rows: int | None = None) -> DataFrame:
    """Scores of several errors of the same points: one row per key with ``n_points`` and a struct of scores per column.

    A point travels once for all columns; methods, runs or variants become rows only after they are scored. ``rows``: see `previous`."""
    errs = {c: (f"_e{i}", f"_pe{i}") for i, c in enumerate(columns)}
    seg = previous(errors.select(*keys, time, *[F.col(c).alias(e) for c, (e, _) in errs.items()]), keys, bucket, [time], {"_pt": time, **{p: e for e, p in errs.values()}}, rows=rows)
    aggs = []
    for i, (name, prior) in enumerate(errs.values()):
        e = F.col(name)
        area = 0.5 * (F.abs(e) + F.abs(prior)) * (F.col(time) - F.col("_pt"))
        aggs += [F.sum(area).alias(f"_area{i}"), F.avg(F.abs(e)).alias(f"_mae{i}"), F.sqrt(F.avg(e * e)).alias(f"_rmse{i}"), F.max_by(e, F.col(time)).alias(f"_final{i}")]
    agg = seg.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.min(time).alias("_t0"), F.max(time).alias("_t1"), *aggs)

    def scores(i: int) -> Column:
        final = F.col(f"_final{i}")
        iae = F.coalesce(div(f"_area{i}", F.col("_t1") - F.col("_t0")), F.abs(final))
        return F.struct(iae.alias("iae"), F.col(f"_mae{i}").alias("mae"), F.col(f"_rmse{i}").alias("rmse"), final.alias("final_error"), F.abs(final).alias("final_abs_error"))

    return agg.select(*keys, "n_points", *[scores(i).alias(c) for i, c in enumerate(columns)])


def method_summary(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and exact median of the trajectory scores per method."""
    e = F.col("final_error")
    means = scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_units"), F.avg("iae").alias("mean_iae"), F.avg(F.abs(e)).alias("final_mae"),
        F.sqrt(F.avg(e * e)).alias("final_rmse"), F.avg(e).alias("final_bias"), F.max(F.abs(e)).alias("final_max"))
    return means.join(order_statistics(scores, by, "iae", {"median_iae": ("linear", 0.5)}).drop("n"), list(by))


def validate_predictions(
    predictions: DataFrame, truth: DataFrame, *, entity: Sequence[str], method: str, index: str, time: str, predicted: str
) -> DataFrame:
    """Issues of a prediction pack against truth coordinates: (rule, violations).

    Every method of the pack is expected at every truth coordinate; target_missing counts the (entity, method) pairs without
    any prediction, whose coordinates also count as missing."""
    on = [*entity, index]
    marked = truth.groupBy(*entity).agg(F.max(index).alias("_last"))
    t = truth.join(marked, list(entity)).select(*on, F.col(time).alias("_tt"), (F.col(index) == F.col("_last")).alias("_final"))
    methods = predictions.agg(F.collect_set(method).alias("_methods"))  # as short as the list of methods
    expected = attach_one_row(t, methods).withColumn(method, F.explode("_methods")).drop("_methods")
    known = predictions.select(*entity, method).distinct()
    targets = attach_one_row(truth.select(*entity).distinct(), methods).withColumn(method, F.explode("_methods"))
    missing = targets.join(known, [*entity, method], "left_anti").agg(F.count(F.lit(1)).alias("v"))
    p = predictions.withColumn("_hit", F.lit(1))
    full = expected.join(p, [*on, method], "full_outer")
    absent, extra = F.col("_hit").isNull(), F.col("_tt").isNull()
    both = ~absent & ~extra
    count = lambda c: F.count(F.when(c, 1))
    rules = {
        "coordinate_without_truth": count(extra), "future_coordinate_missing": count(absent),
        "time_axis_changed": count(both & (F.abs(F.col(time) - F.col("_tt")) > 1e-9)),
        "final_flag_wrong": count(both & (F.col("is_final") != F.col("_final"))),
        "prediction_not_finite": count(~absent & ~is_finite(predicted)),
    }
    one = full.agg(*[v.alias(k) for k, v in rules.items()])
    dup = predictions.groupBy(*on, method).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").agg(F.count(F.lit(1)).alias("v"))
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("r")).select("r.*")
    return rows.unionByName(dup.select(F.lit("duplicate_prediction").alias("rule"), F.col("v").alias("violations"))).unionByName(
        missing.select(F.lit("target_missing").alias("rule"), F.col("v").alias("violations"))
    )


def regression_metrics(df: DataFrame, by: Sequence[str], truth: str, predicted: str) -> DataFrame:
    e = F.col(predicted) - F.col(truth)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (100.0 * F.avg(F.abs(e) / F.greatest(F.abs(F.col(truth)), F.lit(1e-12)))).alias("mape_pct"))


def lognormal_rows(df: DataFrame, truth: str, median: str, sigma: Column) -> DataFrame:
    """Row negative log-likelihood, absolute percentage error and central 80 % coverage."""
    y, m = F.col(truth), F.col(median)
    z = (F.ln(y) - F.ln(m)) / sigma
    half = normal_quantile(0.9)
    return df.withColumns({
        "nll": F.ln(y) + F.ln(sigma) + F.lit(0.9189385332046727) + 0.5 * z * z,
        "ape_pct": 100.0 * F.abs(m - y) / y,
        "covered": F.abs(z) <= half,
    })


def two_level_metrics(rows: DataFrame, inner: Sequence[str], outer: Sequence[str]) -> DataFrame:
    """Means per inner group, then the unweighted mean over inner groups."""
    per = rows.groupBy(*outer, *inner).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("nll").alias("_nll"), F.avg("ape_pct").alias("_ape"), F.avg(F.col("covered").cast("double")).alias("_cov"))
    return per.groupBy(*outer).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("_n").alias("n_rows"), F.avg("_nll").alias("nll"), F.avg("_ape").alias("ape_pct"), F.avg("_cov").alias("coverage"))


def common_support(predictions: DataFrame, landmark: str, entity: Sequence[str], index: str, first_common: int) -> DataFrame:
    """Predictions of all landmarks on the window that every landmark can still predict."""
    landmarks = predictions.select(landmark).distinct().count()  # number of declared landmarks
    window = predictions.filter(F.col(index) >= first_common)
    complete = window.groupBy(*entity, index).agg(F.countDistinct(landmark).alias("_l")).filter(F.col("_l") == landmarks).drop("_l")
    return window.join(complete, [*entity, index], "left_semi")


def pair_methods(scores: DataFrame, units: Sequence[str], method: str, metric: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Candidate against comparator per unit; delta below zero favours the candidate."""
    wanted = sorted({m for p in pairs for m in p})
    wide = scores.filter(F.col(method).isin(wanted)).groupBy(*units).agg(
        *[F.max(F.when(F.col(method) == m, F.col(metric))).alias(f"_m{i}") for i, m in enumerate(wanted)])
    at = {m: F.col(f"_m{i}") for i, m in enumerate(wanted)}
    entries = F.array(*[F.struct(F.lit(a).alias("candidate"), F.lit(b).alias("comparator"), at[a].alias("candidate_value"), at[b].alias("comparator_value")) for a, b in pairs])
    return wide.select(*units, F.explode(entries).alias("p")).select(*units, "p.*").filter(
        "candidate_value is not null and comparator_value is not null").withColumn("delta", F.col("candidate_value") - F.col("comparator_value"))


def comparison_summary(paired: DataFrame, by: Sequence[str], unit: str, *, tolerance: float = 1e-9) -> DataFrame:
    d = F.col("delta")
    return paired.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_units"), F.avg("candidate_value").alias("candidate_mean"), F.avg("comparator_value").alias("comparator_mean"),
        F.avg(d).alias("mean_delta"), (100.0 * div(F.avg("comparator_value") - F.avg("candidate_value"), F.avg("comparator_value"))).alias("relative_gain_pct"),
        F.count(F.when(d < -tolerance, 1)).alias("n_better"), F.count(F.when(d > tolerance, 1)).alias("n_worse"),
        F.count(F.when(F.abs(d) <= tolerance, 1)).alias("n_equal"),
        F.max(d).alias("worst_delta"), F.max(F.struct(d.alias("d"), F.col(unit).alias("u")))["u"].alias("worst_unit"))


def scenario_gates(summary: DataFrame, *, min_gain_pct: float, max_candidate: float) -> DataFrame:
    gain, err = F.col("relative_gain_pct") >= min_gain_pct, F.col("candidate_mean") <= max_candidate
    return summary.select("*", gain.alias("improvement_ok"), err.alias("error_ok"),
                          F.when(gain & err, "passed").otherwise("failed").alias("status"))


def grouped_scores(rows: DataFrame, sets: Sequence[Sequence[str]], columns: Sequence[str], metrics: dict[str, Column]) -> DataFrame:
    """One aggregation per declared stratum list (grouping sets), absent strata shown as null."""
    cols = [F.col(c) for c in columns]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols)
    return grouped.agg(F.grouping_id(*columns).alias("grouping_level"), *[v.alias(k) for k, v in metrics.items()])


def strongest_baseline(scores: DataFrame, method: str, metric: str, units: str, baselines: Sequence[str]) -> DataFrame:
    """Baseline with the lowest mean; none at all when any baseline misses a finite unit."""
    n_units = scores.select(units).distinct().agg(F.count(F.lit(1)).alias("_units"))
    per = scores.filter(F.col(method).isin(list(baselines))).groupBy(method).agg(
        F.avg(metric).alias("_mean"), F.countDistinct(F.when(is_finite(metric), F.col(units))).alias("_ok"))
    stats = per.agg(
        F.count(F.lit(1)).alias("_methods"), F.min("_ok").alias("_min_ok"),
        F.min(F.struct(F.col("_mean"), F.col(method).alias("m"))).alias("_best"))
    joined = stats.withColumn("_units", n_units.scalar())
    ok = (F.col("_methods") == len(baselines)) & (F.col("_min_ok") == F.col("_units"))
    return joined.select(F.when(ok, F.col("_best.m")).alias("selected"), F.when(ok, F.col("_best._mean")).alias("mean_value"),
                         F.when(ok, "selected").otherwise("incomplete_baseline").alias("status"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, *, bucket: str | Column) -> DataFrame:
    """Average rank of ties: ranks are computed on distinct values, then joined back."""
    from trajlytics.plans.scan import running
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = running(counts, keys, bucket, [value], {"_cum": ("sum", F.col("_c").cast("double"))})
    ranks = cum.select(*keys, value, (F.col("_cum") - (F.col("_c") - 1) / 2.0).alias(name))
    return df.join(ranks, [*keys, value])


def rank_correlation(df: DataFrame, keys: Sequence[str], a: str, b: str, *, bucket_a: str | Column, bucket_b: str | Column) -> DataFrame:
    ranked = average_ranks(average_ranks(df, keys, a, "_ra", bucket=bucket_a), keys, b, "_rb", bucket=bucket_b)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.corr("_ra", "_rb").alias("rank_correlation"))


def stability_quantiles(wide: DataFrame, by: Sequence[str], delta: str, *, tolerance: float = 0.0) -> DataFrame:
    """Mean, median, 5 % and 95 % of a delta and the share of favourable (negative) values."""
    agg = wide.groupBy(*by).agg(
        F.avg(delta).alias("mean_delta"), F.avg((F.col(delta) < -tolerance).cast("double")).alias("favourable_fraction"))
    q = order_statistics(wide, by, delta, {"median_delta": ("linear", 0.5), "p05_delta": ("linear", 0.05), "p95_delta": ("linear", 0.95)})
    return agg.join(q, list(by))


def coefficient_stability(coefs: DataFrame, coefficient: str, value: str) -> DataFrame:
    v = F.col(value)
    return coefs.groupBy(coefficient).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg(v).alias("mean_value"), F.stddev_samp(v).alias("sd_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        ((F.min(v) > 0) | (F.max(v) < 0)).alias("sign_consistent"),
        (F.greatest(F.count(F.when(v > 0, 1)), F.count(F.when(v < 0, 1))) / F.count(F.lit(1))).alias("dominant_sign_fraction"))
