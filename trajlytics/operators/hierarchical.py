"""Pooled priors and target updates (survey rows E12, E16, E17, E19-E21, E34, H4).

Folds are leave-one-condition-out and never copy data: every matrix of a fold is the total over all
conditions minus the condition's own part. The solves are a handful of numbers per row and run
vectorised over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.functions.columns import attach_one_row, clip
from trajlytics.operators.closed_form import activation_gate, sqrt_rate
from trajlytics.operators.features import stress_features
from trajlytics.operators.grid import activation_power_law, pack_prefix, power_law

X = ["x0", "x1", "x2", "x3", "x4"]
_T, _Y = "elapsed_days", "capacity_loss_pct"
BOUNDS = {2: ([-12.0, 0.05], [5.0, 1.5]), 3: ([-12.0, 0.05, 0.0], [5.0, 1.5, 10.0])}


def _moments(theta: Sequence[str]) -> dict[str, Column]:
    """Own contribution of one condition: vec(x x'), vec(x theta'), vec(theta theta'), sum of squares, count."""
    m = len(theta)
    return {
        "_xx": F.array(*[F.col(a) * F.col(b) for a in X for b in X]),
        "_xt": F.array(*[F.col(a) * F.col(t) for a in X for t in theta]),
        "_tt": F.array(*[F.col(theta[i]) * F.col(theta[i]) for i in range(m)]),
    }


def _array_sum(name: str, size: int) -> Column:
    return F.array(*[F.sum(F.element_at(name, i + 1)) for i in range(size)])


def stress_rows(df: DataFrame, *, time: str = "elapsed_hours") -> DataFrame:
    """Log rate of the square-root law and the stress features of every condition."""
    profile = df.groupBy("condition_id").agg(F.min("temperature_c").alias("temperature_c"), F.min("storage_soc_fraction").alias("storage_soc_fraction"))
    rates = sqrt_rate(df, ["condition_id"], time=time).withColumn("log_k", F.ln(F.greatest("k", F.lit(1e-5))))
    return rates.join(profile, "condition_id").withColumns(stress_features("temperature_c", "storage_soc_fraction"))


def stress_surface(df: DataFrame, *, time: str = "elapsed_hours") -> DataFrame:
    """log k = beta . features over conditions, k from the square-root law (one row of coefficients).

    Coefficients are clipped to the physical box.
    """
    own = stress_rows(df, time=time).withColumns(_moments(["log_k"]))
    total = own.agg(F.count(F.lit(1)).alias("n_conditions"), _array_sum("_xx", 25).alias("xx"), _array_sum("_xt", 5).alias("xt"))

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xt: pd.Series) -> pd.Series:
        lo, hi = np.array([-12.0] * 5), np.array([2.0] + [12.0] * 4)
        return pd.Series([np.clip(np.linalg.pinv(np.reshape(a, (5, 5)), hermitian=True) @ np.asarray(b), lo, hi) for a, b in zip(xx, xt)])

    solved = total.withColumn("beta", solve("xx", "xt"))
    return solved.select("n_conditions", *[F.element_at("beta", i + 1).alias(f"beta{i}") for i in range(5)])


def hierarchical_prior(params: DataFrame, theta: Sequence[str], *, ridge: float = 1.0, scale_floors: Sequence[float] = (0.1, 0.05, 0.1), observation_floor: float = 0.1) -> DataFrame:
    """Leave-one-condition-out prior of every condition: mean of its parameters, their scales, observation scale.

    params: condition_id, temperature_c, storage_soc_fraction, the columns in ``theta``, sse, n_points.
    """
    m = len(theta)
    rows = params.withColumns(stress_features("temperature_c", "storage_soc_fraction"))
    own = rows.withColumns(_moments(theta))
    total = own.agg(_array_sum("_xx", 25).alias("_Txx"), _array_sum("_xt", 5 * m).alias("_Txt"), _array_sum("_tt", m).alias("_Ttt"), F.sum("sse").alias("_Tsse"), F.sum("n_points").alias("_Tn"), F.count(F.lit(1)).alias("_Tc"))
    minus = lambda t, o: F.zip_with(t, o, lambda a, b: a - b)
    fold = attach_one_row(own, total).select(
        "condition_id", F.array(*[F.col(x) for x in X]).alias("x"), minus("_Txx", "_xx").alias("xx"), minus("_Txt", "_xt").alias("xt"), minus("_Ttt", "_tt").alias("tt"),
        (F.col("_Tc") - 1).cast("double").alias("n"), F.greatest(F.sqrt((F.col("_Tsse") - F.col("sse")) / (F.col("_Tn") - F.col("n_points"))), F.lit(observation_floor)).alias("observation_scale"))
    floors = np.asarray(scale_floors[:m])

    @F.pandas_udf("struct<mean:array<double>,scale:array<double>>")
    def solve(x: pd.Series, xx: pd.Series, xt: pd.Series, tt: pd.Series, n: pd.Series) -> pd.DataFrame:
        A = np.stack([np.reshape(v, (5, 5)) for v in xx])
        B = np.stack([np.reshape(v, (5, m)) for v in xt])
        S, k, xs = np.stack(list(tt)), n.to_numpy()[:, None], np.stack(list(x))
        beta = np.linalg.solve(A + ridge * np.diag([0.0, 1.0, 1.0, 1.0, 1.0]), B)
        sum_sq = S - 2 * np.einsum("nij,nij->nj", beta, B) + np.einsum("nij,nik,nkj->nj", beta, A, beta)
        sum_r = B[:, 0, :] - np.einsum("nk,nkj->nj", A[:, 0, :], beta)
        scale = np.sqrt(np.maximum(sum_sq - sum_r**2 / k, 0.0) / (k - 1))
        return pd.DataFrame({"mean": list(np.einsum("ni,nij->nj", xs, beta)), "scale": list(np.maximum(scale, floors))})

    return fold.withColumn("_s", solve("x", "xx", "xt", "tt", "n")).select("condition_id", F.col("_s.mean").alias("prior_mean"), F.col("_s.scale").alias("prior_scale"), "observation_scale")


def power_parameters(df: DataFrame) -> DataFrame:
    profile = df.groupBy("condition_id").agg(F.min("temperature_c").alias("temperature_c"), F.min("storage_soc_fraction").alias("storage_soc_fraction"))
    return power_law(df, ["condition_id"]).join(profile, "condition_id")


def activation_parameters(df: DataFrame, timescale: float) -> DataFrame:
    profile = df.groupBy("condition_id").agg(F.min("temperature_c").alias("temperature_c"), F.min("storage_soc_fraction").alias("storage_soc_fraction"))
    return activation_power_law(df, ["condition_id"], timescales=[timescale]).join(profile, "condition_id")


#: A fit has converged when no free parameter can move by more than this share of its prior scale.
CONVERGED = 1e-6


def _posterior(
    t: np.ndarray, y: np.ndarray, w: np.ndarray, mu: np.ndarray, sc: np.ndarray, obs: np.ndarray, tau: float | None, rounds: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Damped Newton rounds for a batch of short prefixes; returns parameters, covariances and the largest Newton step that is
    left, in prior scales (parameters held by a bound do not count)."""
    m = mu.shape[1]
    lo, hi = (np.asarray(b) for b in BOUNDS[m])
    mu = np.clip(mu, lo, hi)
    theta, damp = mu.copy(), np.full(len(mu), 1e-3)
    logt = np.log(np.where(w > 0, t, 1.0))

    def terms(th):
        loss = np.exp(th[:, :1] + th[:, 1:2] * logt)
        jac = [loss, loss * logt]
        pred = loss
        if m == 3:
            act = 1.0 - np.exp(-t / tau)
            pred, jac = loss - th[:, 2:3] * act, [*jac, -act]
        r = w * (pred - y) / obs[:, None]
        pr = (th - mu) / sc
        bend = np.zeros((len(th), m, m))  # residuals times second derivatives, which only the power term has
        pull = r * w / obs[:, None] * loss
        bend[:, 0, 0], bend[:, 1, 1] = pull.sum(1), (pull * logt * logt).sum(1)
        bend[:, 0, 1] = bend[:, 1, 0] = (pull * logt).sum(1)
        return r, np.stack(jac, axis=2) * (w / obs[:, None])[:, :, None], pr, (r**2).sum(1) + (pr**2).sum(1), bend

    near = 1e-9 * sc  # a parameter so close to a bound that pulls it stands on the bound

    def gradient(th, J, r, pr):
        g = np.einsum("npi,np->ni", J, r) + pr / sc
        held = ((th <= lo + near) & (g > 0)) | ((th >= hi - near) & (g < 0))
        H = np.einsum("npi,npj->nij", J, J) + np.einsum("ni,ij->nij", 1 / sc**2, np.eye(m))
        return g, held, H, np.abs(np.where(held, 0.0, g) / np.einsum("nii->ni", H) / sc).max(axis=1)

    r, J, pr, cost, bend = terms(theta)
    for _ in range(rounds):
        g, held, H, left = gradient(theta, J, r, pr)
        free = ~held  # the others stay at their bound
        diag = np.einsum("nii->ni", H)
        inner, at_bound = free[:, :, None] & free[:, None, :], np.einsum("ni,ij->nij", held, np.eye(m))
        damped = H + np.einsum("ni,ij->nij", diag * damp[:, None], np.eye(m))
        system = (damped + bend) * inner + at_bound
        convex = np.linalg.eigvalsh(system)[:, 0] > 0  # elsewhere a Newton step may climb
        system = np.where(convex[:, None, None], system, damped * inner + at_bound)
        step = (np.linalg.pinv(system, hermitian=True) @ np.where(free, g, 0.0)[:, :, None])[:, :, 0]
        trial = np.clip(np.where(held, np.where(g > 0, np.minimum(theta, lo), np.maximum(theta, hi)), theta - step), lo, hi)
        r2, J2, pr2, cost2, bend2 = terms(trial)
        # a large cost hides the last steps in its rounding: there the gradient decides
        level = (cost2 <= cost * (1 + 1e-12)) & (gradient(trial, J2, r2, pr2)[3] < left)
        ok = (cost2 <= cost) | level
        theta = np.where(ok[:, None], trial, theta)
        r, pr, cost = np.where(ok[:, None], r2, r), np.where(ok[:, None], pr2, pr), np.where(ok, cost2, cost)
        J, bend = np.where(ok[:, None, None], J2, J), np.where(ok[:, None, None], bend2, bend)
        damp = np.clip(np.where(ok, damp * 0.3, damp * 5.0), 1e-12, 1e8)
    _, _, H, left = gradient(theta, J, r, pr)
    return theta, np.linalg.pinv(H, hermitian=True), left


def map_update(prefix: DataFrame, prior: DataFrame, *, timescale: float | None = None, rounds: int = 60) -> DataFrame:
    """Posterior mode and covariance of each target's parameters from its own prefix and its fold's prior.

    Two parameters (power law), or three with an activation timescale. The prefix is packed per target. ``converged`` tells
    whether the rounds were enough, ``step_left`` how far the mode could still move.
    """
    packed = pack_prefix(prefix.filter(F.col(_T) > 0), ["condition_id"]).join(prior, "condition_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            size = max(len(v) for v in b["_t"])
            pad = lambda col, fill: np.stack([np.pad(np.asarray(v, float), (0, size - len(v)), constant_values=fill) for v in col])
            w = np.stack([np.pad(np.ones(len(v)), (0, size - len(v))) for v in b["_t"]])
            given = (pad(b["_t"], 1.0), pad(b["_y"], 0.0), w, np.stack(list(b["prior_mean"])), np.stack(list(b["prior_scale"])), b["observation_scale"].to_numpy())
            theta, cov, left = _posterior(*given, timescale, rounds)
            slow = ~(left < CONVERGED)
            if slow.any():  # few: a long curved valley takes more rounds
                theta[slow], cov[slow], left[slow] = _posterior(*[x[slow] for x in given], timescale, 10 * rounds)
            yield pd.DataFrame({"condition_id": b["condition_id"], "theta": list(theta), "covariance": list(cov.reshape(len(cov), -1)), "observation_scale": b["observation_scale"],
                                "step_left": left, "converged": left < CONVERGED})

    id_type = dict(prefix.dtypes)["condition_id"]
    return packed.select("condition_id", "_t", "_y", "prior_mean", "prior_scale", "observation_scale").mapInPandas(
        run, f"condition_id {id_type}, theta array<double>, covariance array<double>, observation_scale double, step_left double, converged boolean")


def loss_at(theta: str, days: Column, timescale: float | None) -> Column:
    t = lambda i: F.element_at(theta, i)
    base = F.exp(t(1)) * F.pow(days, t(2))
    return base if timescale is None else base - t(3) * (1.0 - F.exp(-days / timescale))


def sd_at(theta: str, cov: str, observation: Column, days: Column, timescale: float | None, floor: float) -> Column:
    """Delta-method predictive SD from packed parameters and covariance."""
    t = lambda i: F.element_at(theta, i)
    loss = F.exp(t(1)) * F.pow(days, t(2))
    g = [loss, loss * F.ln(days)] + ([] if timescale is None else [-(1.0 - F.exp(-days / timescale))])
    m = len(g)
    quad = F.lit(0.0)
    for i in range(m):
        for j in range(m):
            quad = quad + g[i] * g[j] * F.element_at(cov, i * m + j + 1)
    return F.greatest(F.sqrt(F.greatest(quad, F.lit(0.0)) + observation * observation), F.lit(floor))


# The six methods of the routed backtest.
ROUTED_METHODS = ["sqrt", "hierarchical_power", "target_activation", "hierarchical_activation", "gated_target_activation", "gated_hierarchical_activation"]


def routed_states(obs: DataFrame, *, landmark: int, timescale: float = 7.0, minimum_points: int = 7, margin_pp: float = 0.0) -> DataFrame:
    """Per target: both posteriors, the target-only activation fit, the square-root rate and the gate.

    Priors come from the full histories of the other conditions; the target contributes its prefix only.
    """
    pre = obs.filter(F.col("checkup_index") < landmark)
    power = map_update(pre, hierarchical_prior(power_parameters(obs), ["log_amplitude", "exponent"])).select(
        "condition_id", F.col("theta").alias("p_theta"), F.col("covariance").alias("p_cov"), F.col("observation_scale").alias("p_obs"))
    act = map_update(pre, hierarchical_prior(activation_parameters(obs, timescale), ["log_amplitude", "exponent", "offset_pp"]), timescale=timescale).select(
        "condition_id", F.col("theta").alias("a_theta"), F.col("covariance").alias("a_cov"), F.col("observation_scale").alias("a_obs"))
    own = activation_power_law(pre, ["condition_id"], timescales=[timescale]).select("condition_id", F.array("log_amplitude", "exponent", "offset_pp").alias("t_theta"), F.col("n_points").alias("t_points"))
    gate = activation_gate(pre, ["condition_id"], minimum_points=minimum_points, margin_pp=margin_pp).select("condition_id", "gate_ready")
    return power.join(act, "condition_id").join(own, "condition_id", "left").join(sqrt_rate(pre, ["condition_id"]).select("condition_id", "k"), "condition_id").join(gate, "condition_id")


def _finite_theta(c: str) -> Column:
    return F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))


def routed_predictions(states: DataFrame, coords: DataFrame, *, timescale: float = 7.0, minimum_fit_points: int = 3) -> DataFrame:
    """Six forecasts per future coordinate; a failed or missing specialist falls back to the power law."""
    d = F.col(_T)
    ok_t = _finite_theta("t_theta") & (F.col("t_points") >= minimum_fit_points)
    ok_a = _finite_theta("a_theta")
    j = coords.join(states, "condition_id")
    power, target, act = 100.0 - loss_at("p_theta", d, None), 100.0 - loss_at("t_theta", d, timescale), 100.0 - loss_at("a_theta", d, timescale)
    ready = F.col("gate_ready")
    reason = lambda ok: F.when(~ready, "gate_not_ready").when(~ok, "specialist_fit_failed").otherwise("none")
    values = [100.0 - F.col("k") * F.sqrt(d), power, F.when(ok_t, target).otherwise(power), F.when(ok_a, act).otherwise(power),
              F.when(ready & ok_t, target).otherwise(power), F.when(ready & ok_a, act).otherwise(power)]
    reasons = [F.lit("none")] * 2 + [F.when(ok_t, "none").otherwise("specialist_fit_failed"), F.when(ok_a, "none").otherwise("specialist_fit_failed"), reason(ok_t), reason(ok_a)]
    entries = F.array(*[F.struct(F.lit(m).alias("method"), v.alias("predicted"), r.alias("fallback_reason")) for m, v, r in zip(ROUTED_METHODS, values, reasons)])
    return j.select(*coords.columns, "gate_ready", F.explode(entries).alias("m")).select(*coords.columns, "gate_ready", "m.*")


def cross_fitted_residuals(obs: DataFrame, *, landmark: int) -> DataFrame:
    """Residual (truth minus forecast) of every condition at its future check-ups, prior from the others only."""
    pre = obs.filter(F.col("checkup_index") < landmark)
    state = map_update(pre, hierarchical_prior(power_parameters(obs), ["log_amplitude", "exponent"]))
    mark = pre.groupBy("condition_id").agg(F.max(_T).alias("landmark_days"))
    fut = obs.filter(F.col("checkup_index") >= landmark).join(state, "condition_id").join(mark, "condition_id")
    pred = 100.0 - loss_at("theta", F.col(_T), None)
    return fut.select("condition_id", "checkup_index", (F.col(_T) - F.col("landmark_days")).alias("horizon_days"), pred.alias("predicted"), (F.col("capacity_retention_pct") - pred).alias("residual_pp"),
                      sd_at("theta", "covariance", F.col("observation_scale"), F.col(_T), None, 0.05).alias("predictive_sd"))


def anchored_bases(horizon: Column, support: Column) -> tuple[Column, Column]:
    """Two bases that vanish at the landmark."""
    z = horizon / support
    return z, 1.0 - F.exp(-3.0 * z)


def residual_correction(residuals: DataFrame, *, ridge: float) -> DataFrame:
    """Ridge fit of the two anchored bases: one row (c1, c2, support_days)."""
    support = residuals.agg(F.max("horizon_days").alias("support_days"))
    j = attach_one_row(residuals, support)
    b1, b2 = anchored_bases(F.col("horizon_days"), F.col("support_days"))
    r = F.col("residual_pp")
    s = j.agg(F.max("support_days").alias("support_days"), (F.sum(b1 * b1) + ridge).alias("_11"), F.sum(b1 * b2).alias("_12"), (F.sum(b2 * b2) + ridge).alias("_22"), F.sum(b1 * r).alias("_1"), F.sum(b2 * r).alias("_2"))
    det = F.col("_11") * F.col("_22") - F.col("_12") * F.col("_12")
    return s.select("support_days", ((F.col("_1") * F.col("_22") - F.col("_2") * F.col("_12")) / det).alias("c1"), ((F.col("_2") * F.col("_11") - F.col("_1") * F.col("_12")) / det).alias("c2"))


def apply_residual_correction(coords: DataFrame, fit: DataFrame, *, cap_pp: float) -> DataFrame:
    """Capped correction per horizon; outside [0, support] there is none and the flag says so."""
    j = attach_one_row(coords, fit)
    h, s = F.col("horizon_days"), F.col("support_days")
    supported = (h >= -1e-9) & (h <= s + 1e-9)
    b1, b2 = anchored_bases(F.greatest(F.least(h, s), F.lit(0.0)), s)
    raw = F.col("c1") * b1 + F.col("c2") * b2
    return j.select(*coords.columns, F.when(supported, raw).alias("raw_correction"), F.when(supported, clip(raw, -cap_pp, cap_pp)).alias("correction"),
                    F.coalesce(supported & (F.abs(raw) > cap_pp), F.lit(False)).alias("cap_hit"), supported.alias("supported"))


def calibration_scores(residuals: DataFrame, *, first: int, last: int) -> DataFrame:
    """Largest standardised error of each condition within the check-up window."""
    window = residuals.filter((F.col("checkup_index") >= first) & (F.col("checkup_index") < last))
    return window.groupBy("condition_id").agg(F.count(F.lit(1)).alias("n_points"), F.max(F.abs(F.col("residual_pp")) / F.col("predictive_sd")).alias("score"))
