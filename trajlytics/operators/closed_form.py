"""Closed-form forecasters: one aggregate pass per trajectory prefix (survey rows E1-E7, E9, E13-E15, E18).

Inputs are prefixes (cut at a landmark), so one trajectory contributes at most the landmark's number
of rows; fits are sums, residual medians are windows over those few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlytics.functions.columns import attach_one_row, clip, div
from trajlytics.operators.features import theil_sen

# Model ids in registry order (ties are broken by this order).
BASE_MODELS = [
    "target_prefix_persistence", "target_prefix_full_linear",
    "target_prefix_robust_recent_linear", "target_prefix_constrained_sqrt_linear",
]


def nnls2(s11: Column, s12: Column, s22: Column, s1y: Column, s2y: Column) -> tuple[Column, Column]:
    """Non-negative least squares in two variables from the five normal-equation sums.

    Four active sets: both free, only one free, none. The single-variable optimum with the larger
    explained sum of squares wins when the joint solution leaves the quadrant.
    """
    det = s11 * s22 - s12 * s12
    singular = det <= F.lit(1e-12) * s11 * s22
    b1, b2 = div(s1y * s22 - s2y * s12, det), div(s2y * s11 - s1y * s12, det)
    only1, only2 = F.greatest(F.coalesce(div(s1y, s11), F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce(div(s2y, s22), F.lit(0.0)), F.lit(0.0))
    gain1, gain2 = only1 * only1 * s11, only2 * only2 * s22
    joint = ~singular & (b1 >= 0) & (b2 >= 0)
    first = gain1 >= gain2
    return (
        F.when(joint, b1).when(first, only1).otherwise(F.lit(0.0)),
        F.when(joint, b2).when(first, F.lit(0.0)).otherwise(only2),
    )


def linear_fit(prefix: DataFrame, keys: Sequence[str], x: str, y: str, *, non_positive: bool = True) -> DataFrame:
    xs, ys = F.col(x).cast("double"), F.col(y)
    agg = prefix.groupBy(*keys).agg(F.regr_slope(ys, xs).alias("_b"), F.avg(xs).alias("_mx"), F.avg(ys).alias("_my"))
    slope = F.least(F.col("_b"), F.lit(0.0)) if non_positive else F.col("_b")
    return agg.select(*keys, slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"))


def huber_sqrt_linear(prefix: DataFrame, keys: Sequence[str], x: str, y: str, *, rounds: int = 3, delta_mad: float = 1.5, shift: float = 1.0) -> DataFrame:
    """Loss = c1 sqrt(x - shift) + c2 (x - shift), both non-negative, Huber weights by MAD.

    All rounds share one partitioning by trajectory, so the whole loop is a single shuffle.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    z = F.greatest(F.col(x).cast("double") - shift, F.lit(0.0))
    cur = prefix.select(*keys, F.sqrt(z).alias("_r"), z.alias("_z"), (100.0 - F.col(y)).alias("_y"), F.lit(1.0).alias("_w"))
    for i in range(rounds):
        if i:
            cur = cur.withColumn("_e", F.col("_y") - F.col("_c1") * F.col("_r") - F.col("_c2") * F.col("_z"))
            cur = cur.withColumn("_d", F.abs(F.col("_e") - F.median("_e").over(w)))
            cur = cur.withColumn("_cut", delta_mad * F.greatest(1.4826 * F.median("_d").over(w), F.lit(1e-9)))
            cur = cur.withColumn("_w", F.when(F.col("_d") > F.col("_cut"), F.col("_cut") / F.col("_d")).otherwise(F.lit(1.0)))
        sums = {n: F.sum(F.col("_w") * a * b).over(w) for n, a, b in [
            ("_s11", F.col("_r"), F.col("_r")), ("_s12", F.col("_r"), F.col("_z")), ("_s22", F.col("_z"), F.col("_z")),
            ("_s1y", F.col("_r"), F.col("_y")), ("_s2y", F.col("_z"), F.col("_y"))]}
        cur = cur.withColumns(sums)
        c1, c2 = nnls2(*[F.col(n) for n in sums])
        cur = cur.withColumns({"_c1": c1, "_c2": c2}).drop(*sums)
    return cur.groupBy(*keys).agg(F.max("_c1").alias("c_sqrt"), F.max("_c2").alias("c_linear"))


def base_fits(prefix: DataFrame, keys: Sequence[str], *, window: int = 12, rounds: int = 3, delta_mad: float = 1.5) -> DataFrame:
    """Parameters of the four target-only models, one row per trajectory prefix."""
    keys = list(keys)
    last = prefix.groupBy(*keys).agg(F.max_by("retention", "cycle_index").alias("last_value"), F.max("cycle_index").alias("last_cycle"))
    lin = linear_fit(prefix, keys, "cycle_index", "retention").withColumnsRenamed({"slope": "lin_b", "intercept": "lin_a"})
    rob = theil_sen(prefix, keys, "cycle_index", "retention", window).select(*keys, F.col("slope").alias("rob_b"), F.col("intercept").alias("rob_a"))
    sq = huber_sqrt_linear(prefix, keys, "cycle_index", "retention", rounds=rounds, delta_mad=delta_mad)
    return last.join(lin, keys).join(rob, keys).join(sq, keys)


def base_values(h: Column) -> dict[str, Column]:
    """Forecast of each base model at cycle ``h`` from the columns of ``base_fits``."""
    z = F.greatest(h.cast("double") - 1.0, F.lit(0.0))
    raw = {
        BASE_MODELS[0]: F.col("last_value"),
        BASE_MODELS[1]: F.col("lin_a") + F.col("lin_b") * h,
        BASE_MODELS[2]: F.col("rob_a") + F.col("rob_b") * h,
        BASE_MODELS[3]: 100.0 - F.col("c_sqrt") * F.sqrt(z) - F.col("c_linear") * z,
    }
    return {m: clip(v, 0.0, 110.0) for m, v in raw.items()}


def base_forecasts(fits: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """Long forecasts for the next ``horizon`` cycles of every prefix."""
    ahead = fits.withColumn("forecast_cycle", F.explode(F.sequence(F.col("last_cycle") + 1, F.col("last_cycle") + horizon)))
    values = [F.struct(F.lit(m).alias("model_id"), v.alias("predicted")) for m, v in base_values(F.col("forecast_cycle")).items()]
    return ahead.select(*keys, "last_cycle", "forecast_cycle", F.explode(F.array(*values)).alias("m")).select(
        *keys, "last_cycle", "forecast_cycle", "m.model_id", "m.predicted")


def anchored_trends(prefix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slopes of retention on x and on sqrt(x), capped at zero, anchored at the last value."""
    x, y = F.col("cycle_index").cast("double"), F.col("retention")
    return prefix.groupBy(*keys).agg(
        F.max_by(y, x).alias("last_value"), F.max(x).alias("last_cycle"),
        F.least(F.coalesce(F.regr_slope(y, x), F.lit(0.0)), F.lit(0.0)).alias("linear_slope"),
        F.least(F.coalesce(F.regr_slope(y, F.sqrt(x)), F.lit(0.0)), F.lit(0.0)).alias("sqrt_slope"))


def anchored_forecasts(fits: DataFrame, keys: Sequence[str], end_cycle: int) -> DataFrame:
    h, p = F.col("cycle_index").cast("double"), F.col("last_cycle")
    ahead = fits.filter(F.col("last_cycle") < end_cycle).withColumn("cycle_index", F.explode(F.sequence(p.cast("int") + 1, F.lit(end_cycle))))
    values = {
        "target_prefix_persistence": F.col("last_value"),
        "nonpositive_linear_trend": F.col("last_value") + F.col("linear_slope") * (h - p),
        "constrained_sqrt_loss_trend": F.col("last_value") + F.col("sqrt_slope") * (F.sqrt(h) - F.sqrt(p)),
    }
    entries = F.array(*[F.struct(F.lit(m).alias("model_id"), clip(v, 0.0, 110.0).alias("predicted")) for m, v in values.items()])
    return ahead.select(*keys, "cycle_index", F.explode(entries).alias("m")).select(*keys, "cycle_index", "m.*")


_T, _Y = "elapsed_days", "capacity_loss_pct"


def sqrt_rate(df: DataFrame, keys: Sequence[str], *, time: str = _T) -> DataFrame:
    """k of loss = k sqrt(t) over positive times, not below zero."""
    pos = F.col(time) > 0
    root = F.sqrt(F.col(time))
    return df.filter(pos).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_positive"),
        F.greatest(div(F.sum(root * F.col(_Y)), F.sum(F.col(time))), F.lit(0.0)).alias("k"))


def bounded_variants(prefix: DataFrame, keys: Sequence[str], *, year: float = 365.25, cap: float = 5.0) -> DataFrame:
    """Persistence and bounded square-root variants with prefix RMSE and largest residual."""
    keys = list(keys)
    root = F.sqrt(F.col(_T) / year)
    fit = prefix.groupBy(*keys).agg(
        F.max_by("capacity_retention_pct", _T).alias("_last"),
        clip(F.coalesce(div(F.sum(root * F.col(_Y)), F.sum(F.col(_T) / year)), F.lit(0.0)), 0.0, cap).alias("_c"))
    resid = prefix.join(fit, keys).select(
        *keys, "_last", "_c", (F.col("_last") - F.col("capacity_retention_pct")).alias("_e0"),
        (100.0 - F.col("_c") * root - F.col("capacity_retention_pct")).alias("_e1"))
    stats = resid.groupBy(*keys).agg(F.array(*[
        F.struct(F.lit(m).alias("model_id"), F.max(v).alias("parameter"), F.sqrt(F.avg(F.col(e) * F.col(e))).alias("prefix_rmse_pp"),
                 F.max(F.abs(e)).alias("max_abs_residual_pp"))
        for m, v, e in [("target_prefix_persistence", "_last", "_e0"), ("target_prefix_sqrt_time", "_c", "_e1")]]).alias("v"))
    return stats.select(*keys, F.explode("v").alias("m")).select(*keys, "m.*")


def sqrt_linear(df: DataFrame, keys: Sequence[str], *, scale_days: float = 365.0, cap: float = 100.0) -> DataFrame:
    """Loss = c1 sqrt(t/scale) + c2 t/scale with non-negative, capped coefficients."""
    z = F.col(_T) / scale_days
    r, y = F.sqrt(z), F.col(_Y)
    sums = df.filter(F.col(_T) > 0).groupBy(*keys).agg(
        F.sum(z).alias("_s11"), F.sum(r * z).alias("_s12"), F.sum(z * z).alias("_s22"), F.sum(r * y).alias("_s1y"), F.sum(z * y).alias("_s2y"))
    c1, c2 = nnls2(*[F.col(n) for n in ["_s11", "_s12", "_s22", "_s1y", "_s2y"]])
    return sums.select(*keys, F.least(c1, F.lit(cap)).alias("c_sqrt"), F.least(c2, F.lit(cap)).alias("c_linear"))


def condition_agnostic_k(df: DataFrame) -> DataFrame:
    """One square-root rate for all conditions, each condition weighing the same."""
    t, y = F.col("elapsed_hours"), F.col(_Y)
    per = df.filter(t > 0).groupBy("condition_id").agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.sqrt(t) * y).alias("_ty"), F.sum(t).alias("_tt"))
    return per.agg(
        F.count(F.lit(1)).alias("n_conditions"),
        F.greatest(div(F.sum(F.col("_ty") / F.col("_n")), F.sum(F.col("_tt") / F.col("_n"))), F.lit(0.0)).alias("k"))


def empirical_bayes_ridge(prefix: DataFrame, base: Column, *, bounds: tuple[float, float] = (0.01, 100.0)) -> DataFrame:
    """Residual variance over between-condition variance of the scale of ``base`` (one row).

    The residual sum of squares of each condition follows from its three sums.
    """
    y = F.col(_Y)
    per = prefix.filter(F.col(_T) > 0).withColumn("_base", base).groupBy("condition_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("_base") * y).alias("_by"),
        F.sum(F.col("_base") * F.col("_base")).alias("_bb"), F.sum(y * y).alias("_yy"),
    ).filter("_bb > 0").withColumn("_s", F.greatest(F.col("_by") / F.col("_bb"), F.lit(0.0)))
    rss = F.col("_yy") - 2 * F.col("_s") * F.col("_by") + F.col("_s") * F.col("_s") * F.col("_bb")
    agg = per.agg(
        F.count(F.lit(1)).alias("n_conditions"),
        F.greatest(F.sum(rss) / F.sum("_n"), F.lit(1e-8)).alias("residual_variance"),
        F.var_samp("_s").alias("_vs"), F.avg(1.0 / F.col("_bb")).alias("_inv"))
    between = F.greatest(F.col("_vs") - F.col("residual_variance") * F.col("_inv"), F.lit(1e-6))
    return agg.select("n_conditions", "residual_variance", between.alias("between_condition_variance")).withColumn(
        "raw_ridge", F.col("residual_variance") / F.col("between_condition_variance")).withColumn(
        "ridge", clip(F.col("raw_ridge"), *bounds))


def target_scale(prefix: DataFrame, ridge: DataFrame, base: Column, *, bounds: tuple[float, float] = (0.0, 4.0)) -> DataFrame:
    """Posterior scale of each target under a unit prior mean with the pooled ridge. A target with fewer than two positive
    times keeps its row with a null scale and the status that says so."""
    pos = F.col(_T) > 0
    per = prefix.withColumn("_base", base).groupBy("condition_id").agg(
        F.sum(F.when(pos, F.col("_base") * F.col(_Y))).alias("_by"), F.sum(F.when(pos, F.col("_base") * F.col("_base"))).alias("_bb"), F.count(F.when(pos, 1)).alias("n_positive"))
    enough = F.col("n_positive") >= 2
    scale = clip((F.col("_by") + F.col("ridge")) / (F.col("_bb") + F.col("ridge")), *bounds)
    return attach_one_row(per, ridge.select("ridge")).select(
        "condition_id", "n_positive", F.when(enough, scale).alias("scale"), F.when(enough, "ok").otherwise("too_few_positive_times").alias("status"))


def activation_gate(prefix: DataFrame, keys: Sequence[str], *, minimum_points: int = 7, margin_pp: float | Column = 0.0) -> DataFrame:
    """Ready when a positive-time loss lies strictly below minus the margin and enough points exist."""
    pos = F.col(_T) > 0
    m = margin_pp if isinstance(margin_pp, Column) else F.lit(float(margin_pp))
    agg = prefix.groupBy(*keys).agg(F.count(F.when(pos, 1)).alias("n_positive"), F.min(F.when(pos, F.col(_Y))).alias("minimum_loss_pct"))
    neg = F.coalesce(F.col("minimum_loss_pct") < -m, F.lit(False))
    return agg.withColumn("negative_evidence", neg).withColumn("gate_ready", neg & (F.col("n_positive") >= minimum_points))
