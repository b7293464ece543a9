"""Conformal radii, interval scores and issuance decisions (survey rows H1-H3, H5-H15)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.functions.columns import attach_one_row, clip, div, is_finite
from trajlytics.plans.scan import order_statistics

Z95 = 1.959963984540054


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """95 % Wilson bounds of a proportion, in [0, 1]."""
    n, p = trials.cast("double"), successes / trials
    den = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / den
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / den
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def log_scores(df: DataFrame, truth: str, median: str, censored: str | None = None) -> DataFrame:
    """Absolute log error of uncensored rows."""
    seen = df.filter(~F.col(censored)) if censored else df
    return seen.withColumn("score", F.abs(F.ln(truth) - F.ln(median)))


def conformal_radius(scores: DataFrame, by: Sequence[str], coverage: float, *, score: str = "score", bucket: Column | None = None) -> DataFrame:
    """Split-conformal order statistic per group with an honest status: rank ceil((n+1)c), and no
    value at all (never infinity) when the rank exceeds the number of scores. A group with a score that is NaN or
    infinite has no radius: its status is invalid_scores, and n_not_finite counts them."""
    q = order_statistics(scores, by, score, {"radius": ("rank", coverage)}, bucket=bucket, count_not_finite=True)
    invalid = F.col("n_not_finite") > 0
    status = (
        F.when(invalid, "invalid_scores")
        .when(F.col("radius").isNull(), "unavailable_finite_sample")
        .otherwise("finite_order_statistic")
    )
    rank = F.ceil((F.col("n") + 1) * F.lit(coverage))
    radius = F.when(~invalid, F.col("radius"))
    return q.select(
        *by, F.col("n").alias("n_calibration"), "n_not_finite", rank.alias("rank"), radius.alias("radius"), status.alias("status")
    )


def group_max_radius(scores: DataFrame, by: Sequence[str], group: str, coverage: float) -> DataFrame:
    """Calibrate on the largest score of each group, for coverage of whole new groups."""
    worst = scores.groupBy(*by, group).agg(F.max("score").alias("score"))
    return conformal_radius(worst, by, coverage)


def route_quantiles(scores: DataFrame, routes: Sequence[str], coverages: Sequence[float], *, route: str = "route", score: str = "score") -> DataFrame:
    """Multiplier per declared route and coverage; a route without scores keeps its row."""
    out = None
    grid = scores.sparkSession.createDataFrame([(r,) for r in routes], f"{route} string")
    for c in coverages:
        q = conformal_radius(scores, [route], c, score=score)
        part = grid.join(q, route, "left").select(
            route, F.lit(c).alias("coverage"), F.coalesce("n_calibration", F.lit(0)).alias("n_calibration"),
            F.coalesce("rank", F.ceil(F.lit(c))).alias("rank"), F.col("radius").alias("multiplier"),
            F.coalesce("status", F.lit("empty_route")).alias("status"))
        out = part if out is None else out.unionByName(part)
    return out


def calibration_half_widths(residuals: DataFrame, by: Sequence[str], residual: str, coverage: float) -> DataFrame:
    """Half-width per (prefix, model, horizon): 'higher' quantile at the finite-sample level."""
    scored = residuals.withColumn("_a", F.abs(residual))
    q = order_statistics(scored, by, "_a", {"half_width": ("higher_rank", coverage)}, count_not_finite=True)
    level = F.least(F.lit(1.0), F.ceil((F.col("n") + 1) * F.lit(coverage)) / F.nullif(F.col("n"), F.lit(0)))
    usable = F.when(F.col("n_not_finite") == 0, F.col("half_width"))  # no width from residuals that are not numbers
    return q.select(*by, F.col("n").alias("n_calibration"), "n_not_finite", level.alias("quantile_level"), usable.alias("half_width"))


def simultaneous_scores(points: DataFrame, entity: Sequence[str], lower: str, upper: str, truth: str) -> DataFrame:
    """Largest interval violation over the horizon of each trajectory (zero when covered)."""
    v = F.greatest(F.col(lower) - F.col(truth), F.col(truth) - F.col(upper), F.lit(0.0))
    return points.groupBy(*entity).agg(F.max(v).alias("score"), F.count(F.lit(1)).alias("n_points"))


def conformal_expansion(points: DataFrame, entity: Sequence[str], by: Sequence[str], lower: str, upper: str, truth: str, coverage: float) -> DataFrame:
    scores = simultaneous_scores(points, [*by, *entity], lower, upper, truth)
    return conformal_radius(scores, by, coverage).withColumnRenamed("radius", "expansion_pp")


def expand(points: DataFrame, expansion: DataFrame, by: Sequence[str], lower: str, upper: str) -> DataFrame:
    joined = points.join(expansion.select(*by, "expansion_pp"), list(by))
    return joined.withColumns({lower: F.col(lower) - F.col("expansion_pp"), upper: F.col(upper) + F.col("expansion_pp")})


def predictive_sd(gradient: Sequence[Column], covariance: Sequence[Sequence[Column]], observation_scale: Column, floor: float) -> Column:
    """Delta method: sqrt(g' C g + s^2), with the quadratic form clipped at zero and a floor."""
    quad = F.lit(0.0)
    for i, gi in enumerate(gradient):
        for j, gj in enumerate(gradient):
            quad = quad + gi * gj * covariance[i][j]
    return F.greatest(F.sqrt(F.greatest(quad, F.lit(0.0)) + observation_scale * observation_scale), F.lit(floor))


def power_gradient(log_amplitude: Column, exponent: Column, days: Column) -> list[Column]:
    loss = F.exp(log_amplitude) * F.pow(days, exponent)
    return [loss, loss * F.ln(days)]


def activation_gradient(log_amplitude: Column, exponent: Column, days: Column, timescale: float) -> list[Column]:
    return [*power_gradient(log_amplitude, exponent, days), -(1.0 - F.exp(-days / timescale))]


def physical_interval(mean: Column, sd: Column, multiplier: Column, bounds: tuple[float, float] = (0.0, 100.0)) -> tuple[Column, Column]:
    """Clipped interval; the whole physical range when no multiplier is available."""
    lo, hi = bounds
    return (
        F.when(multiplier.isNull(), F.lit(lo)).otherwise(clip(mean - multiplier * sd, lo, hi)),
        F.when(multiplier.isNull(), F.lit(hi)).otherwise(clip(mean + multiplier * sd, lo, hi)),
    )


def interval_score(truth: Column, lower: Column, upper: Column, coverage: float) -> Column:
    """Winkler score."""
    k = 2.0 / (1.0 - coverage)
    return (upper - lower) + k * F.greatest(lower - truth, F.lit(0.0)) + k * F.greatest(truth - upper, F.lit(0.0))


def evaluate_quantile(df: DataFrame, by: Sequence[str], truth: str, quantile: str, p: float, censored: str) -> DataFrame:
    """Pinball loss and empirical CDF with Wilson bounds over uncensored rows."""
    seen = ~F.col(censored)
    e = F.col(truth) - F.col(quantile)
    agg = df.groupBy(*by).agg(
        F.count(F.when(seen, 1)).alias("n_rows"), F.count(F.when(~seen, 1)).alias("n_censored"),
        F.avg(F.when(seen, F.greatest(p * e, (p - 1) * e))).alias("pinball"), F.count(F.when(seen & (e <= 0), 1)).alias("_below"))
    lo, hi = wilson(F.col("_below"), F.col("n_rows"))
    cdf = F.col("_below") / F.col("n_rows")
    return agg.select(*by, F.lit(p).alias("quantile"), "n_rows", "n_censored", "pinball", cdf.alias("empirical_cdf"), (cdf - p).alias("calibration_error"),
                      lo.alias("ci_lower"), hi.alias("ci_upper"))


def evaluate_interval(df: DataFrame, by: Sequence[str], truth: str, lower: str, upper: str, nominal: float, censored: str) -> DataFrame:
    seen = ~F.col(censored)
    y, a, b = F.col(truth), F.col(lower), F.col(upper)
    agg = df.groupBy(*by).agg(
        F.count(F.when(seen, 1)).alias("n_rows"), F.count(F.when(~seen, 1)).alias("n_censored"),
        F.count(F.when(seen & y.between(a, b), 1)).alias("_cov"), F.avg(F.when(seen, b - a)).alias("mean_width"), F.avg(F.when(seen, (b - a) / y)).alias("mean_relative_width"))
    lo, hi = wilson(F.col("_cov"), F.col("n_rows"))
    cov = F.col("_cov") / F.col("n_rows")
    return agg.select(*by, "n_rows", "n_censored", cov.alias("coverage"), (cov - nominal).alias("coverage_error"), lo.alias("ci_lower"), hi.alias("ci_upper"), "mean_width", "mean_relative_width")


def evaluate_group_interval(df: DataFrame, by: Sequence[str], group: str, truth: str, lower: str, upper: str, nominal: float, censored: str) -> DataFrame:
    """Share of groups whose uncensored rows are all covered."""
    seen = df.filter(~F.col(censored))
    per = seen.groupBy(*by, group).agg(F.bool_and(F.col(truth).between(F.col(lower), F.col(upper))).alias("_all"), F.count(F.lit(1)).alias("_n"))
    agg = per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("_n").alias("n_rows"), F.count(F.when(F.col("_all"), 1)).alias("n_covered"))
    lo, hi = wilson(F.col("n_covered"), F.col("n_groups"))
    cov = F.col("n_covered") / F.col("n_groups")
    return agg.select(*by, "n_groups", "n_rows", "n_covered", cov.alias("coverage"), (cov - nominal).alias("coverage_error"), lo.alias("ci_lower"), hi.alias("ci_upper"))


def radius_evaluation(pred: DataFrame, *, split: str, calibration: str, train: str | None, group: str, truth: str, median: str, censored: str, coverage: float) -> DataFrame:
    """Log radii from the calibration split, of rows and of the worst row of each group, and how they do on every other split:
    row and whole-group coverage and width of [median / e^r, median e^r].

    One row per radius kind and evaluated split. A radius that the calibration split cannot give leaves coverage and width null
    and says why; censored rows are counted and take no part.
    """
    scores = log_scores(pred.filter(F.col(split) == calibration), truth, median, censored).withColumn("_all", F.lit(0))
    rows = conformal_radius(scores, ["_all"], coverage).withColumn("kind", F.lit("row"))
    groups = group_max_radius(scores, ["_all"], group, coverage).withColumn("kind", F.lit("group_max"))
    radii = rows.unionByName(groups).agg(F.collect_list(F.struct("kind", "radius", "n_calibration", "status")).alias("_radii"))  # two rows
    rest = pred.filter((F.col(split) != calibration) & (F.col(split) != train if train is not None else F.lit(True)))
    tried = attach_one_row(rest, radii).withColumn("_r", F.explode("_radii")).withColumns({"kind": F.col("_r.kind"), "_up": F.exp(F.col("_r.radius"))})
    tried = tried.withColumns({"_lo": F.col(median) / F.col("_up"), "_hi": F.col(median) * F.col("_up"), "radius": F.col("_r.radius"), "n_calibration": F.col("_r.n_calibration"), "status": F.col("_r.status")})
    keys = ["kind", split, "radius", "n_calibration", "status"]
    seen, known = ~F.col(censored), F.col("radius").isNotNull()
    inside = F.col(truth).between(F.col("_lo"), F.col("_hi"))
    per = tried.groupBy(*keys, group).agg(
        F.count(F.when(seen, 1)).alias("_n"), F.count(F.when(~seen, 1)).alias("_c"), F.count(F.when(seen & inside, 1)).alias("_k"), F.sum(F.when(seen, F.col("_hi") - F.col("_lo"))).alias("_w"))
    agg = per.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.sum("_c").alias("n_censored"), F.sum("_k").alias("_covered"), F.sum("_w").alias("_width"),
        F.count(F.when(F.col("_n") > 0, 1)).alias("n_groups"), F.count(F.when((F.col("_n") > 0) & (F.col("_k") == F.col("_n")), 1)).alias("_whole"))
    value = lambda c: F.when(known, c)
    return agg.select(*keys, "n_rows", "n_censored", "n_groups", value(div("_covered", "n_rows")).alias("coverage"), value(div("_width", "n_rows")).alias("mean_width"),
                      value(div("_whole", "n_groups")).alias("group_coverage"))


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 10000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + num * d)
            c = 1.0 + num / c
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


def clopper_pearson(successes: int, trials: int, confidence: float, *, two_sided: bool = False) -> tuple[float, float]:
    """Exact binomial bounds; one-sided: (lower, 1)."""
    tail = (1 - confidence) / (2 if two_sided else 1)

    def solve(a: float, b: float, target: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(200):
            mid = 0.5 * (lo + hi)
            lo, hi = (mid, hi) if beta_cdf(a, b, mid) < target else (lo, mid)
        return 0.5 * (lo + hi)

    lower = 0.0 if successes == 0 else solve(successes, trials - successes + 1, tail)
    upper = 1.0 if successes == trials or not two_sided else solve(successes + 1, trials - successes, 1 - tail)
    return lower, upper


def with_clopper_pearson(summary: DataFrame, successes: str, trials: str, confidence: float = 0.95, *, two_sided: bool = False) -> DataFrame:
    """Bounds on an already aggregated summary (one short call per summary row)."""
    @F.pandas_udf("lower double, upper double")
    def bounds(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(a), int(b), confidence, two_sided=two_sided) for a, b in zip(k, n)], columns=["lower", "upper"])

    out = summary.withColumn("_cp", bounds(F.col(successes), F.col(trials)))
    return out.select(*summary.columns, F.col("_cp.lower").alias("cp_lower"), F.col("_cp.upper").alias("cp_upper"))


def coverage_summary(df: DataFrame, by: Sequence[str], covered: str, width: str) -> DataFrame:
    """Covered share and exact median / 95 % of the maximal width (bounds: ``with_clopper_pearson``)."""
    agg = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_units"), F.count(F.when(F.col(covered), 1)).alias("n_covered"))
    q = order_statistics(df, by, width, {"median_max_width": ("linear", 0.5), "p95_max_width": ("linear", 0.95)}).drop("n")
    return agg.join(q, list(by)).withColumn("coverage", F.col("n_covered") / F.col("n_units"))


# Reason labels of the issuance decision.
FALLBACK_REASONS = ["specialist_gate_not_ready", "specialist_fit_failed", "residual_outside_support", "residual_cap_hit", "fallback_fit_failed"]
ABSTENTION_REASONS = [
    "mean_unavailable", "calibration_unavailable", "calibration_evidence_not_independent", "insufficient_same_route_calibration",
    "horizon_mismatch", "domain_unsupported", "independent_long_term_evidence_missing", "residual_outside_support",
    "residual_cap_hit", "interval_width_invalid", "interval_too_wide",
]


def issuance_decision(df: DataFrame, *, max_width: float | None = None) -> DataFrame:
    """Mean route with its fallback reasons and, independently, the interval's abstention reasons.

    Input flags: gate_ready, specialist_ok, fallback_ok, residual_supported, residual_capped, multiplier,
    calibration_independent, same_route_calibrated, horizon_matched, domain_supported,
    evidence_required, evidence_available, interval_width.
    """
    c = F.col
    blocked = [~c("gate_ready"), ~c("specialist_ok"), ~c("residual_supported"), c("residual_capped")]
    any_blocked = blocked[0] | blocked[1] | blocked[2] | blocked[3]
    unavailable = any_blocked & ~c("fallback_ok")
    route = F.when(~any_blocked, "specialist").when(c("fallback_ok"), "fallback").otherwise("unavailable")
    width_ok = is_finite("interval_width") & (c("interval_width") >= 0)
    too_wide = width_ok & (c("interval_width") > max_width) if max_width is not None else F.lit(False)
    stops = [
        unavailable, ~(is_finite("multiplier") & (c("multiplier") >= 0)), ~c("calibration_independent"), ~c("same_route_calibrated"),
        ~c("horizon_matched"), ~c("domain_supported"), c("evidence_required") & ~c("evidence_available"), ~c("residual_supported"),
        c("residual_capped"), F.coalesce(~width_ok, F.lit(True)), F.coalesce(too_wide, F.lit(False)),
    ]
    fallback = F.array_compact(F.array(*[F.when(f, F.lit(n)) for f, n in zip([*blocked, unavailable], FALLBACK_REASONS)]))
    abstain = F.array_compact(F.array(*[F.when(F.coalesce(f, F.lit(True)), F.lit(n)) for f, n in zip(stops, ABSTENTION_REASONS)]))
    return df.withColumns({"mean_route": route, "fallback_reasons": fallback, "abstention_reasons": abstain}).withColumn(
        "issuance_status", F.when(F.size("abstention_reasons") == 0, "issued").otherwise("abstained"))


def condition_interval_metrics(points: DataFrame, quantiles: DataFrame, *, entity: str, coverage: float) -> DataFrame:
    """Per condition: available interval or reasons, simultaneous and pointwise coverage, widths, score.

    points: entity, route, mean, sd, truth, domain_supported, residual_supported, residual_capped.
    """
    q = quantiles.filter(F.col("coverage") == coverage).select("route", "multiplier")
    joined = points.join(q, "route", "left")
    lo, hi = physical_interval(F.col("mean"), F.col("sd"), F.col("multiplier"))
    scored = joined.withColumns({"_lo": lo, "_hi": hi}).withColumn("_in", F.col("truth").between(F.col("_lo"), F.col("_hi")))
    agg = scored.groupBy(entity, "route").agg(
        F.max("multiplier").alias("multiplier"), F.bool_and("domain_supported").alias("_dom"), F.bool_and("residual_supported").alias("_sup"), F.bool_or("residual_capped").alias("_cap"),
        F.bool_and("_in").alias("_sim"), F.avg(F.col("_in").cast("double")).alias("_pt"), F.avg(F.col("_hi") - F.col("_lo")).alias("_mw"), F.max(F.col("_hi") - F.col("_lo")).alias("_xw"),
        F.avg(interval_score(F.col("truth"), F.col("_lo"), F.col("_hi"), coverage)).alias("_is"))
    reasons = F.array_compact(F.array(
        F.when(F.col("multiplier").isNull(), F.lit("insufficient_same_route_calibration")), F.when(~F.col("_dom"), F.lit("domain_unsupported")),
        F.when(~F.col("_sup"), F.lit("residual_outside_support")), F.when(F.col("_cap"), F.lit("residual_cap_hit"))))
    ok = F.size(reasons) == 0
    return agg.select(entity, "route", F.lit(coverage).alias("coverage"), "multiplier", F.array_join(reasons, ";").alias("reasons"), ok.alias("available"),
                      F.when(ok, F.col("_sim")).alias("simultaneously_covered"), F.when(ok, F.col("_pt")).alias("pointwise_coverage"),
                      F.when(ok, F.col("_mw")).alias("mean_width"), F.when(ok, F.col("_xw")).alias("max_width"), F.when(ok, F.col("_is")).alias("interval_score"))


def route_interval_summary(metrics: DataFrame) -> DataFrame:
    avail = F.col("available")
    return metrics.groupBy("route", "coverage").agg(
        F.count(F.lit(1)).alias("n_conditions"), F.count(F.when(avail, 1)).alias("n_available"),
        F.count(F.when(avail & F.col("simultaneously_covered"), 1)).alias("n_covered"), F.avg("mean_width").alias("mean_width"), F.max("max_width").alias("max_width"),
        F.avg("interval_score").alias("interval_score")).withColumns({
        "coverage_among_available": F.when(F.col("n_available") > 0, F.col("n_covered") / F.col("n_available")),
        "all_available_and_covered": (F.col("n_available") == F.col("n_conditions")) & (F.col("n_covered") == F.col("n_conditions"))})
