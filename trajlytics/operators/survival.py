"""Censoring-weighted survival evaluation (survey rows K1-K5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlytics.functions.columns import div
from trajlytics.plans.joins import asof_join
from trajlytics.plans.scan import running


def censoring_curve(units: DataFrame, keys: Sequence[str], time: str, event: str, bucket: str | Column) -> DataFrame:
    """Reverse Kaplan-Meier: at-risk and censor counts per distinct time, survival after and before it.

    The product is a running sum of logarithms; a time at which everyone at risk is censored is
    carried as a zero flag instead of the logarithm of zero.
    """
    keys = list(keys)
    per = units.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(~F.col(event), 1)).alias("n_censored"))
    before = running(
        per, keys, bucket, [time],
        {"_before": ("sum", F.col("_n").cast("double")), "_total": ("total_sum", "_n")},
        exclusive=True,
    )
    risk = before.withColumn("n_at_risk", (F.col("_total") - F.col("_before")).cast("bigint"))
    factor = 1.0 - F.col("n_censored") / F.col("n_at_risk")
    logs = risk.withColumns({"_log": F.when(factor > 0, F.ln(factor)).otherwise(F.lit(0.0)), "_zero": (factor <= 0).cast("int")})
    out = running(logs, keys, bucket, [time], {"_s": ("sum", "_log"), "_z": ("max", "_zero")})
    after = F.when(F.col("_z") == 1, F.lit(0.0)).otherwise(F.exp("_s"))
    prior = F.when((F.col("_z") == 1) & (F.col("_zero") == 0), F.lit(0.0)).otherwise(F.exp(F.col("_s") - F.col("_log")))
    return out.select(*keys, time, "n_at_risk", "n_censored", after.alias("survival"), prior.alias("survival_before"))


def survival_lookup(left: DataFrame, curve: DataFrame, keys: Sequence[str], at: str, time: str, *, left_limit: bool, bucket: str | Column, name: str) -> DataFrame:
    """Step-function value at (or just before) each time; one before the first step."""
    hit = asof_join(left, curve.select(*keys, time, F.col("survival").alias(name)), keys=keys, left_on=at, right_on=time, values=[name], bucket=bucket, strict=left_limit)
    return hit.withColumn(name, F.coalesce(name, F.lit(1.0)))


def policy_violations(curve: DataFrame, units: DataFrame, keys: Sequence[str], time: str, grid: Sequence[float]) -> DataFrame:
    """Evaluation times that the censoring reference cannot support, per key: rows (time, issue)."""
    if len(grid) < 2 or any(b <= a for a, b in zip(grid, grid[1:])):
        raise ValueError("evaluation times must increase and number at least two")
    limit = units.groupBy(*keys).agg(F.max(time).alias("_max"))
    at = curve_at(curve, keys, time, grid).join(limit, list(keys))
    issue = F.when(F.col("evaluation_time") > F.col("_max"), "beyond_follow_up").when(F.col("survival") <= 0, "zero_censoring_survival")
    return at.select(*keys, "evaluation_time", "survival", issue.alias("issue")).filter("issue is not null")


def curve_at(curve: DataFrame, keys: Sequence[str], time: str, grid: Sequence[float]) -> DataFrame:
    """Survival at a short literal grid: one aggregate per grid point, no join."""
    hits = F.array(*[F.struct(F.lit(float(t)).alias("evaluation_time"), F.coalesce(F.max_by("survival", F.when(F.col(time) <= t, F.col(time))), F.lit(1.0)).alias("survival")) for t in grid])
    return curve.groupBy(*keys).agg(hits.alias("h")).select(*keys, F.explode("h").alias("h")).select(*keys, "h.*")


def ipcw_brier(
    units: DataFrame, curve: DataFrame, keys: Sequence[str], time: str, event: str, grid: Sequence[float], predicted: Column, *,
    min_survival: float = 0.10, max_weight: float = 10.0, min_ess: float = 30.0, min_ess_fraction: float = 0.5,
    min_events: int = 5, min_alive: int = 5, max_clipped_fraction: float = 0.01,
) -> DataFrame:
    """Inverse-probability-of-censoring Brier score per evaluation time with gate reasons.

    ``predicted``: survival probability from the unit's columns and ``evaluation_time``. The unit's own
    left limit comes from an equality join, because every unit time is a step of the curve.
    """
    keys = list(keys)
    own = units.join(curve.select(*keys, time, "survival_before"), [*keys, time], "left").withColumn("survival_before", F.coalesce("survival_before", F.lit(1.0)))
    rows = own.withColumn("evaluation_time", F.explode(F.array(*[F.lit(float(t)) for t in grid]))).join(
        curve_at(curve, keys, time, grid).withColumnRenamed("survival", "_st"), [*keys, "evaluation_time"])
    happened = F.col(event) & (F.col(time) <= F.col("evaluation_time"))
    alive = F.col(time) > F.col("evaluation_time")
    weighted = rows.withColumns({
        "_w": F.when(happened, div(F.lit(1.0), "survival_before")).when(alive, div(F.lit(1.0), "_st")).otherwise(F.lit(0.0)),
        "_e2": F.pow(alive.cast("double") - predicted, F.lit(2.0)), "_ev": happened, "_al": alive,
    })
    w = F.col("_w")
    agg = weighted.groupBy(*keys, "evaluation_time").agg(
        F.count(F.lit(1)).alias("n_units"), (F.sum(w * F.col("_e2")) / F.count(F.lit(1))).alias("brier"),
        (F.sum(F.least(w, F.lit(max_weight)) * F.col("_e2")) / F.count(F.lit(1))).alias("clipped_brier"), F.max("_st").alias("censor_survival"),
        F.count(F.when(F.col("_ev"), 1)).alias("n_events"), F.count(F.when(F.col("_al"), 1)).alias("n_alive"), F.max(w).alias("max_weight"),
        (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_sample_size"), F.count(F.when(w > max_weight, 1)).alias("n_clipped"))
    n = F.col("n_units")
    reasons = [
        (F.col("censor_survival") < min_survival, "censor_survival_low"), (F.col("effective_sample_size") < min_ess, "effective_sample_size_low"),
        (F.col("effective_sample_size") / n < min_ess_fraction, "effective_sample_fraction_low"), (F.col("n_events") < min_events, "too_few_events"),
        (F.col("n_alive") < min_alive, "too_few_alive"), (F.col("n_clipped") / n > max_clipped_fraction, "too_many_clipped"),
    ]
    return agg.withColumn("gate_reasons", F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in reasons]))).withColumn(
        "gate_status", F.when(F.size("gate_reasons") == 0, "passed").otherwise("failed"))


def integrated_brier(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trapezoid of the scores over the evaluation grid (a short literal grid per key)."""
    w = Window.partitionBy(*keys).orderBy("evaluation_time")
    dt = F.col("evaluation_time") - F.lag("evaluation_time").over(w)
    seg = points.withColumns({
        "_a": 0.5 * (F.col("brier") + F.lag("brier").over(w)) * dt, "_c": 0.5 * (F.col("clipped_brier") + F.lag("clipped_brier").over(w)) * dt})
    span = F.max("evaluation_time") - F.min("evaluation_time")
    return seg.groupBy(*keys).agg((F.sum("_a") / span).alias("integrated_brier"), (F.sum("_c") / span).alias("clipped_integrated_brier"),
                                  F.when(F.bool_and(F.col("gate_status") == "passed"), "passed").otherwise("failed").alias("status"))


def reference_brier(units: DataFrame, keys: Sequence[str], time: str, event: str, grid: Sequence[float], predicted: Column) -> DataFrame:
    """Brier score on rows of known status only, and on the full truth (``true_time``)."""
    rows = units.withColumn("evaluation_time", F.explode(F.array(*[F.lit(float(t)) for t in grid])))
    t, alive = F.col("evaluation_time"), F.col(time) > F.col("evaluation_time")
    known = alive | (F.col(event) & (F.col(time) <= t))
    truth = (F.col("true_time") > t).cast("double")
    return rows.groupBy(*keys, "evaluation_time").agg(
        F.count(F.when(known, 1)).alias("n_known"), F.avg(F.when(known, F.pow(alive.cast("double") - predicted, F.lit(2.0)))).alias("naive_brier"),
        F.avg(F.pow(truth - predicted, F.lit(2.0))).alias("full_truth_brier"))
