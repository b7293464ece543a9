"""Batch prefix inference over a table of requests (survey row E34).

`fit_state` turns reference observations into one row of model state: pooled priors of both routes, the residual correction
with its support, and the conformal multiplier of each route. `predict_requests` meets requests with that row: every request
gets exactly one decision, malformed ones included, and numbers only where its stress, prefix and horizon are supported.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlytics.functions.columns import attach_one_row, is_finite
from trajlytics.operators import hierarchical as B
from trajlytics.operators.closed_form import activation_gate
from trajlytics.operators.features import stress_features
from trajlytics.operators.intervals import issuance_decision, physical_interval, route_quantiles
from trajlytics.operators.splits import in_convex_hull, local_slice_reference
from trajlytics.plans.scan import null_safe_join
from trajlytics.session import cut_lineage

THETA = {"fallback": ["log_amplitude", "exponent"], "specialist": ["log_amplitude", "exponent", "offset_pp"]}
ROUTES = list(THETA)
FLOORS = (0.1, 0.05, 0.1)
STATUSES = (
    "rejected_invalid_request", "rejected_domain_unsupported", "rejected_prefix_outside_support", "rejected_model_fit_failed",
    "rejected_horizon_mismatch", "forecast_abstained", "forecast_issued",
)


@dataclass(frozen=True)
class Policy:
    """What a forecast must meet. `evidence_required`: a forecast beyond the last reference day needs long-term evidence."""

    points: int
    coverage: float = 0.8
    timescale: float = 7.0
    minimum_points: int = 7
    margin_pp: float = 0.0
    residual_ridge: float = 1.0
    cap_pp: float = 1.0
    point_margin: float = 0.5
    step_margin: float = 0.5
    max_width: float | None = None
    evidence_required: bool = True
    sd_floor: float = 0.05
    observation_floor: float = 0.1


def request_issues(requests: DataFrame, points: int) -> DataFrame:
    """Requests that cannot be evaluated, one row each: missing or repeated id, wrong prefix length, bad order, values that are
    missing, not finite or out of range, no future or one before the landmark.

    requests: request_id, temperature_c, storage_soc_fraction, prefix array<struct<observation_index,
    elapsed_days, capacity_retention_pct>>, future_days array<double>.
    """
    p = F.col("prefix")
    bad_values = F.exists(p, lambda r: r.isNull() | ~(is_finite(r["elapsed_days"]) & is_finite(r["capacity_retention_pct"])))
    steps = F.zip_with(F.slice(p, F.lit(2), F.size(p)), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: b["elapsed_days"] > a["elapsed_days"])
    last = F.try_element_at(p, F.lit(-1))["elapsed_days"]
    stress_ok = is_finite("temperature_c") & is_finite("storage_soc_fraction") & F.col("storage_soc_fraction").between(0.0, 1.0) & F.col("temperature_c").between(-40.0, 100.0)
    copies = requests.groupBy("request_id").agg(F.count(F.lit(1)).alias("_copies"))
    issue = (
        F.when(F.col("request_id").isNull(), "request_id_missing").when(F.col("_copies") > 1, "request_id_repeated")
        .when(p.isNull() | (F.size(p) != points), "prefix_length").when(bad_values, "non_finite_prefix").when(~F.forall(steps, lambda s: s), "prefix_time_not_increasing")
        .when(~F.coalesce(stress_ok, F.lit(False)), "stress_out_of_range")
        .when(F.col("future_days").isNull() | (F.size("future_days") == 0), "future_missing").when(F.exists("future_days", lambda d: ~is_finite(d)), "non_finite_future")
        .when(F.exists("future_days", lambda d: d <= last), "future_before_landmark"))
    return null_safe_join(requests, copies, ["request_id"]).select("request_id", issue.alias("issue")).filter("issue is not null")


def _prior_sums(params: DataFrame, theta: Sequence[str], tag: str) -> list[Column]:
    m = len(theta)
    return [
        B._array_sum("_xx", 25).alias(f"{tag}_xx"), B._array_sum("_xt", 5 * m).alias(f"{tag}_xt"), B._array_sum("_tt", m).alias(f"{tag}_tt"),
        F.count(F.lit(1)).cast("double").alias(f"{tag}_n"), F.sqrt(F.sum("sse") / F.sum("n_points")).alias(f"{tag}_obs"),
    ]


def population_priors(obs: DataFrame, policy: Policy) -> DataFrame:
    """One row: what the priors of both routes need, summed over all training conditions."""
    one = None
    for route, theta in THETA.items():
        params = B.power_parameters(obs) if route == "fallback" else B.activation_parameters(obs, policy.timescale)
        sums = params.withColumns(stress_features("temperature_c", "storage_soc_fraction")).withColumns(B._moments(theta)).agg(*_prior_sums(params, theta, route))
        one = sums if one is None else attach_one_row(one, sums)
    return one


def target_priors(targets: DataFrame, priors: DataFrame, route: str, policy: Policy) -> DataFrame:
    """Prior of each target (condition_id, stress) from the population sums of a route."""
    m, floors = len(THETA[route]), np.asarray(FLOORS[: len(THETA[route])])
    rows = attach_one_row(targets.withColumns(stress_features("temperature_c", "storage_soc_fraction")), priors.select(*[c for c in priors.columns if c.startswith(route)]))

    @F.pandas_udf("struct<mean:array<double>,scale:array<double>>")
    def solve(x: pd.Series, xx: pd.Series, xt: pd.Series, tt: pd.Series, n: pd.Series) -> pd.DataFrame:
        A, T = np.stack([np.reshape(v, (5, 5)) for v in xx]), np.stack([np.reshape(v, (5, m)) for v in xt])
        beta = np.linalg.solve(A + np.diag([0.0, 1.0, 1.0, 1.0, 1.0]), T)
        sq = np.stack(list(tt)) - 2 * np.einsum("nij,nij->nj", beta, T) + np.einsum("nij,nik,nkj->nj", beta, A, beta)
        mean_r = (T[:, 0, :] - np.einsum("nk,nkj->nj", A[:, 0, :], beta)) / n.to_numpy()[:, None]
        sc = np.sqrt(np.maximum(sq / n.to_numpy()[:, None] - mean_r**2, 0) * (n / (n - 1)).to_numpy()[:, None])
        return pd.DataFrame({"mean": list(np.einsum("ni,nij->nj", np.stack(list(x)), beta)), "scale": list(np.maximum(sc, floors))})

    out = rows.withColumn("_s", solve(F.array(*[F.col(c) for c in B.X]), *[F.col(f"{route}_{c}") for c in ("xx", "xt", "tt", "n")]))
    return out.select("condition_id", F.col("_s.mean").alias("prior_mean"), F.col("_s.scale").alias("prior_scale"), F.greatest(f"{route}_obs", F.lit(policy.observation_floor)).alias("observation_scale"))


def target_states(prefix: DataFrame, priors: DataFrame, policy: Policy) -> DataFrame:
    """Per target of the prefix rows: posteriors of both routes, gate, which fits are usable, and the route of the mean."""
    targets = prefix.groupBy("condition_id").agg(F.min("temperature_c").alias("temperature_c"), F.min("storage_soc_fraction").alias("storage_soc_fraction"), F.max("elapsed_days").alias("landmark_days"))
    out = targets.select("condition_id", "landmark_days")
    for route in ROUTES:
        fit = B.map_update(prefix, target_priors(targets, priors, route, policy), timescale=policy.timescale if route == "specialist" else None)
        ok = B._finite_theta("theta") & F.col("converged")
        part = fit.select("condition_id", F.col("theta").alias(f"{route}_theta"), F.col("covariance").alias(f"{route}_cov"), F.col("observation_scale").alias(f"{route}_scale"), ok.alias(f"{route}_ok"))
        out = out.join(part, "condition_id", "left").withColumn(f"{route}_ok", F.coalesce(f"{route}_ok", F.lit(False)))
    gate = activation_gate(prefix, ["condition_id"], minimum_points=policy.minimum_points, margin_pp=policy.margin_pp).select("condition_id", "gate_ready")
    out = out.join(gate, "condition_id", "left").withColumn("gate_ready", F.coalesce("gate_ready", F.lit(False)))
    route = F.when(F.col("gate_ready") & F.col("specialist_ok"), "specialist").when(F.col("fallback_ok"), "fallback")
    return out.withColumn("route", route)


def with_means(coords: DataFrame, policy: Policy) -> DataFrame:
    """coords (target state and elapsed_days) with the uncorrected forecast and predictive SD of the target's route."""
    d, special = F.col("elapsed_days"), F.col("route") == "specialist"
    loss = F.when(special, B.loss_at("specialist_theta", d, policy.timescale)).otherwise(B.loss_at("fallback_theta", d, None))
    sd = F.when(special, B.sd_at("specialist_theta", "specialist_cov", F.col("specialist_scale"), d, policy.timescale, policy.sd_floor)).otherwise(
        B.sd_at("fallback_theta", "fallback_cov", F.col("fallback_scale"), d, None, policy.sd_floor))
    return coords.withColumns({"base": 100.0 - loss, "predictive_sd": sd, "horizon_days": d - F.col("landmark_days")})


def _scored(obs: DataFrame, priors: DataFrame, policy: Policy) -> DataFrame:
    """Future rows of observed conditions with their forecast, as requests would get it."""
    prefix = obs.filter(F.col("checkup_index") < policy.points)
    future = obs.filter(F.col("checkup_index") >= policy.points).select("condition_id", "checkup_index", "elapsed_days", "capacity_retention_pct")
    return with_means(future.join(target_states(prefix, priors, policy).filter("route is not null"), "condition_id"), policy)


def fit_state(training: DataFrame, calibration: DataFrame, policy: Policy) -> DataFrame:
    """One row of model state. Observations: condition_id, checkup_index, stress, elapsed_days, capacity_loss_pct,
    capacity_retention_pct. Calibration conditions that also train are counted, and then no evidence is independent."""
    priors = cut_lineage(population_priors(training, policy))
    residuals = B.cross_fitted_residuals(training, landmark=policy.points)
    correction = B.residual_correction(residuals, ridge=policy.residual_ridge)
    scored = attach_one_row(_scored(calibration, priors, policy), correction)
    step = with_correction(scored, policy)
    error = F.abs(F.col("capacity_retention_pct") - F.col("predicted")) / F.col("predictive_sd")
    worst = step.filter("supported").groupBy("condition_id", "route").agg(F.max(error).alias("score"))
    quantiles = route_quantiles(worst, ROUTES, [policy.coverage])
    routes = quantiles.agg(F.sort_array(F.collect_list(F.struct("route", "n_calibration", "rank", "multiplier"))).alias("routes"))  # two routes
    ids = calibration.select("condition_id").distinct().join(training.select("condition_id").distinct(), "condition_id", "left_semi").agg(F.count(F.lit(1)).alias("n_shared"))
    days = training.select("elapsed_days").union(calibration.select("elapsed_days")).agg(F.max("elapsed_days").alias("reference_days"))
    state = priors
    for part in (correction, routes, ids, days):
        state = attach_one_row(state, part)
    return cut_lineage(state)


def with_correction(rows: DataFrame, policy: Policy) -> DataFrame:
    """Residual correction of each row inside the support of the fit, capped; `predicted` is the corrected forecast."""
    h, s = F.col("horizon_days"), F.col("support_days")
    b1, b2 = B.anchored_bases(F.greatest(F.least(h, s), F.lit(0.0)), s)
    raw = F.col("c1") * b1 + F.col("c2") * b2
    capped = F.greatest(F.least(raw, F.lit(policy.cap_pp)), F.lit(-policy.cap_pp))
    supported = (h >= -1e-9) & (h <= s + 1e-9)
    out = rows.withColumns({"supported": F.coalesce(supported, F.lit(False)), "correction": F.when(supported, capped), "cap_hit": F.coalesce(supported & (F.abs(raw) > policy.cap_pp), F.lit(False))})
    return out.withColumn("predicted", F.col("base") + F.col("correction"))


def predict_requests(requests: DataFrame, training: DataFrame, state: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """(forecast rows, decisions). Decisions have one row per request row, repeated and null ids included."""
    requests = cut_lineage(requests.withColumn("_row", F.monotonically_increasing_id()))
    issues = request_issues(requests, policy.points).distinct()
    judged = null_safe_join(requests.select("request_id", "_row"), issues, ["request_id"], "left")
    valid = requests.join(judged.filter("issue is null").select("_row"), "_row", "left_semi").drop("_row")
    prefix = valid.select("request_id", "temperature_c", "storage_soc_fraction", F.explode("prefix").alias("r")).select(
        F.col("request_id").alias("condition_id"), "temperature_c", "storage_soc_fraction", F.col("r.observation_index").alias("checkup_index"), F.col("r.elapsed_days").alias("elapsed_days"),
        (100.0 - F.col("r.capacity_retention_pct")).alias("capacity_loss_pct"))
    profile = training.select("condition_id", "temperature_c", "storage_soc_fraction").distinct()
    known = valid.select("request_id", "temperature_c", "storage_soc_fraction")
    domain = in_convex_hull(known, profile, "temperature_c", "storage_soc_fraction").select("request_id", F.col("in_hull").alias("domain_supported"))
    ordered = lambda v: F.transform(F.sort_array(F.collect_list(F.struct("checkup_index", v))), lambda p: p[v])
    ref = training.filter(F.col("checkup_index") < policy.points).groupBy("temperature_c", "storage_soc_fraction", "checkup_index").agg(F.avg("capacity_retention_pct").alias("v")).groupBy(
        "temperature_c", "storage_soc_fraction").agg(ordered("v").alias("prefix"))
    asked = valid.select("request_id", "temperature_c", "storage_soc_fraction", F.transform("prefix", lambda r: r["capacity_retention_pct"]).alias("prefix"))
    support = local_slice_reference(asked, ref, point_margin=policy.point_margin, step_margin=policy.step_margin).select("request_id", "prefix_supported", "reference_mode")
    fits = target_states(prefix, state, policy).withColumnRenamed("condition_id", "request_id")
    rows = attach_one_row(valid.select("request_id", F.explode("future_days").alias("elapsed_days")).join(fits, "request_id"), state.select("support_days", "c1", "c2", "routes", "n_shared", "reference_days"))
    rows = with_correction(with_means(rows, policy), policy)
    own_route = F.filter("routes", lambda r: r["route"] == F.col("route"))
    rows = rows.withColumn("_q", F.get(own_route, F.lit(0)))
    lower, upper = physical_interval(F.col("predicted"), F.col("predictive_sd"), F.col("_q.multiplier"))
    rows = rows.withColumns({"lower": lower, "upper": upper})
    per = Window.partitionBy("request_id")  # the coordinates of one request
    flags = {
        "horizon_matched": F.bool_and("supported").over(per), "residual_capped": F.bool_or("cap_hit").over(per), "interval_width": F.max(F.col("upper") - F.col("lower")).over(per),
        "last_day": F.max("elapsed_days").over(per), "n_future": F.count(F.lit(1)).over(per),
    }
    facts = rows.withColumns(flags).join(domain, "request_id", "left").join(support, "request_id", "left")
    facts = facts.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("domain_supported", "prefix_supported")})
    status = (
        F.when(~F.col("domain_supported"), STATUSES[1]).when(~F.col("prefix_supported"), STATUSES[2])
        .when(F.col("route").isNull(), STATUSES[3]).when(~F.col("horizon_matched"), STATUSES[4]))
    facts = cut_lineage(facts.withColumns({
        "status": status, "multiplier": F.col("_q.multiplier"), "specialist_ok": F.col("specialist_ok"), "residual_supported": F.col("horizon_matched"),
        "same_route_calibrated": F.col("_q.multiplier").isNotNull(), "calibration_independent": F.col("n_shared") == 0,
        "evidence_required": F.lit(policy.evidence_required), "evidence_available": F.col("last_day") <= F.col("reference_days")}))
    shown = facts.filter("status is null")
    usable = F.col("same_route_calibrated") & ~F.col("residual_capped")
    forecast = shown.select(
        "request_id", "elapsed_days", "horizon_days", F.col("route").alias("mean_route"), "predicted", "predictive_sd", "correction",
        F.when(usable, F.col("lower")).alias("lower"), F.when(usable, F.col("upper")).alias("upper"))
    once = facts.dropDuplicates(["request_id"])
    decided = issuance_decision(once.withColumn("fallback_ok", F.col("route").isNotNull()), max_width=policy.max_width)
    final = F.coalesce("status", F.when(F.col("issuance_status") == "issued", STATUSES[6]).otherwise(STATUSES[5]))
    decided = decided.select(
        "request_id", final.alias("status"), F.col("route").alias("mean_route"), "gate_ready", "domain_supported", "prefix_supported", "reference_mode", "horizon_matched",
        F.array_join("fallback_reasons", ";").alias("fallback_reasons"), F.array_join("abstention_reasons", ";").alias("abstention_reasons"), "n_future",
        F.col("_q.n_calibration").alias("n_calibration"), F.col("_q.rank").alias("calibration_rank"), "multiplier", "interval_width")
    hidden = F.col("status").isin(*STATUSES[:5])
    decided = decided.withColumns({c: F.when(~hidden, F.col(c)) for c in ("multiplier", "interval_width")})
    joined = judged.join(decided, "request_id", "left")
    return forecast, joined.withColumn("status", F.when(F.col("issue").isNotNull(), STATUSES[0]).otherwise(F.col("status"))).drop("_row")
