"""Fits against known parameters and brute force; leakage and contract behaviour on hand-made frames."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajlytics.operators import closed_form as K
from trajlytics.operators import contracts as C
from trajlytics.operators import grid as Y
from trajlytics.operators import hierarchical as B
from trajlytics.operators import lifetime as M
from trajlytics.operators import resampling as R
from trajlytics.operators import selective as Q
from trajlytics.operators.features import theil_sen, with_retention


def test_cycle_contract_counts_every_violation(spark):
    rows = [("d", "c", 1.0, 1.0, "b", "p", 25.0), ("d", "c", 1.0, 1.0, "b", "p", 25.0), ("d", None, 2.0, 1.0, "b", "p", 25.0), ("d", "c", 2.5, 1.0, "b", "p", 25.0), ("d", "c", 0.0, 1.0, "b", "p", 25.0),
            ("d", "c", 4.0, float("nan"), "b", "p", 25.0), ("d", "c", 5.0, float("inf"), "b", "p", 25.0), ("d", "c", 6.0, 0.0, None, "p", 200.0)]
    df = spark.createDataFrame(rows, "dataset_id string, cell_id string, cycle_index double, discharge_capacity_ah double, batch_id string, protocol_id string, temperature_avg_c double")
    got = {r["rule"]: r["violations"] for r in C.cycle_contract(df).collect()}
    assert got == {"null_key": 1, "cycle_index_not_integer": 1, "cycle_index_below_one": 1, "capacity_not_finite": 2, "capacity_not_positive": 1, "null_batch_or_protocol": 1, "temperature_out_of_range": 1, "duplicate_key": 2}
    with pytest.raises(C.ContractError, match="duplicate_key"):
        C.enforce(C.cycle_contract(df))


def test_label_contract_wants_booleans(spark):
    df = spark.createDataFrame([("d", "c", 10.0, 1, 1.0)], "dataset_id string, cell_id string, cycle_life double, is_censored int, eol_threshold double")
    got = {r["rule"]: r["violations"] for r in C.label_contract(df).collect()}
    assert got["censor_not_boolean"] == 1 and got["threshold_out_of_range"] == 1


def test_protected_columns():
    class Frame:
        columns = ["Cell_ID", "EOL threshold", "r_10", "rate", "internal_resistance_ohm", "cycle_life_x", "is_censored", "voltage", "SOH"]

    assert C.protected_columns(Frame) == sorted(["EOL threshold", "r_10", "internal_resistance_ohm", "cycle_life_x", "is_censored", "SOH"])


def cycles(spark, n=60, shock=0.0, after=10**9):
    rng = np.random.default_rng(1)
    rows = [(f"c{c}", i, float(1.1 - 0.001 * i - 0.0005 * c * np.sqrt(i) + 0.002 * rng.normal() - (shock if i > after else 0.0))) for c in range(6) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "cell_id string, cycle_index int, discharge_capacity_ah double")


def test_forecasts_do_not_see_the_future(spark):
    out = []
    for shock in (0.0, 0.4):
        df = with_retention(cycles(spark, shock=shock, after=40))
        fc = K.base_forecasts(K.base_fits(df.filter("cycle_index <= 40"), ["cell_id"]), ["cell_id"], 10)
        out.append(fc.toPandas().sort_values(["cell_id", "forecast_cycle", "model_id"]).predicted.to_numpy())
    np.testing.assert_allclose(out[0], out[1], atol=1e-9)


def test_theil_sen_matches_brute_force(spark):
    df = with_retention(cycles(spark)).filter("cycle_index <= 30")
    got = theil_sen(df, ["cell_id"], "cycle_index", "retention", 12).toPandas().set_index("cell_id")
    for k, g in df.toPandas().groupby("cell_id"):
        g = g.sort_values("cycle_index").tail(12)
        s = min(np.median([(b.retention - a.retention) / (b.cycle_index - a.cycle_index) for a, b in itertools.combinations(list(g.itertuples()), 2)]), 0.0)
        assert got.loc[k, "slope"] == pytest.approx(s)
        assert got.loc[k, "intercept"] == pytest.approx(np.median(g.retention - s * g.cycle_index))


@pytest.mark.parametrize("y", [[1.0, 2.0, 3.0, 4.0], [-1.0, -2.0, -3.0, -4.0], [3.0, 2.0, 1.0, 0.5], [0.1, 0.5, 2.0, 6.0]])
def test_nnls2_is_optimal(spark, y):
    x = np.array([1.0, 2.0, 3.0, 4.0])
    X, y = np.column_stack([np.sqrt(x), x]), np.array(y)
    s = [X[:, 0] @ X[:, 0], X[:, 0] @ X[:, 1], X[:, 1] @ X[:, 1], X[:, 0] @ y, X[:, 1] @ y]
    r = spark.range(1).select(*K.nnls2(*[F.lit(float(v)) for v in s])).first()
    loss = lambda a, b: ((X @ [a, b] - y) ** 2).sum()
    grid = min(loss(a, b) for a in np.linspace(0, 4, 161) for b in np.linspace(0, 4, 161))
    assert r[0] >= 0 and r[1] >= 0 and loss(r[0], r[1]) <= grid + 1e-9


def calendar(spark, conditions=12, days=30, sd=0.0):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(conditions):
        a, b, o = 0.2 + 0.02 * c, 0.45 + 0.02 * (c % 3), (0.8 if c % 2 else 0.0)
        for i, t in enumerate(np.linspace(0, days, 31)):
            rows.append((c, i, 10.0 * (c % 4), (c % 5) / 4.0, float(t), float(a * t**b - o * (1 - np.exp(-t / 7.0)) + sd * rng.normal()) if t else 0.0))
    df = spark.createDataFrame(rows, "condition_id int, checkup_index int, temperature_c double, storage_soc_fraction double, elapsed_days double, capacity_loss_pct double")
    return df.withColumn("capacity_retention_pct", 100.0 - F.col("capacity_loss_pct"))


def test_grid_fits_recover_parameters(spark):
    df = calendar(spark)
    power = Y.power_law(df.filter("condition_id % 2 = 0"), ["condition_id"]).toPandas().set_index("condition_id")
    act = Y.activation_power_law(df, ["condition_id"]).toPandas().set_index("condition_id")
    for c in range(12):
        a, b, o = 0.2 + 0.02 * c, 0.45 + 0.02 * (c % 3), (0.8 if c % 2 else 0.0)
        if c % 2 == 0:
            assert power.loc[c, "exponent"] == pytest.approx(b, abs=0.006) and np.exp(power.loc[c, "log_amplitude"]) == pytest.approx(a, rel=0.02)
        assert act.loc[c, "sse"] < 0.05 and act.loc[c, "offset_pp"] == pytest.approx(o, abs=0.25)


def test_map_update_is_the_posterior_mode(spark):
    df = calendar(spark, sd=0.02)
    prior = B.hierarchical_prior(B.power_parameters(df), ["log_amplitude", "exponent"])
    pre = df.filter("checkup_index < 8")
    post = {r["condition_id"]: r for r in B.map_update(pre, prior).collect()}
    pr = {r["condition_id"]: r for r in prior.collect()}
    for c, g in pre.filter("elapsed_days > 0").toPandas().groupby("condition_id"):
        t, y = g.elapsed_days.to_numpy(), g.capacity_loss_pct.to_numpy()
        mu, sc, s = np.clip(pr[c]["prior_mean"], [-12, 0.05], [5, 1.5]), np.array(pr[c]["prior_scale"]), pr[c]["observation_scale"]
        cost = lambda th: (((np.exp(th[0]) * t ** th[1] - y) / s) ** 2).sum() + (((th - mu) / sc) ** 2).sum()
        best = np.array(post[c]["theta"])
        for da, db in itertools.product([-1e-3, 0, 1e-3], repeat=2):
            assert cost(best) <= cost(np.clip(best + [da, db], [-12, 0.05], [5, 1.5])) + 1e-9


def test_loco_prior_equals_refit_without_the_condition(spark):
    df = calendar(spark, sd=0.02)
    params = B.power_parameters(df).toPandas().sort_values("condition_id").reset_index(drop=True)
    got = {r["condition_id"]: r for r in B.hierarchical_prior(spark.createDataFrame(params), ["log_amplitude", "exponent"]).collect()}
    inv = 1000 * (1 / 298.15 - 1 / (params.temperature_c + 273.15))
    s = params.storage_soc_fraction - 0.5
    X = np.column_stack([np.ones(len(s)), inv, s, s**2, inv * s])
    T = params[["log_amplitude", "exponent"]].to_numpy()
    for c in range(len(params)):
        keep = np.arange(len(params)) != c
        beta = np.linalg.solve(X[keep].T @ X[keep] + np.diag([0.0, 1, 1, 1, 1]), X[keep].T @ T[keep])
        np.testing.assert_allclose(got[c]["prior_mean"], X[c] @ beta, rtol=1e-8)
        np.testing.assert_allclose(got[c]["prior_scale"], np.maximum(np.std(T[keep] - X[keep] @ beta, axis=0, ddof=1), [0.1, 0.05]), rtol=1e-8)


def test_aft_recovers_censored_parameters_and_left_out_fold(spark):
    rng = np.random.default_rng(4)
    n = 4000
    x1, x2 = rng.normal(2, 3, n), rng.normal(0, 1, n)
    logt = 5.0 + 0.3 * x1 - 0.5 * x2 + 0.4 * rng.normal(size=n)
    cut = np.quantile(logt, 0.7)
    pdf = pd.DataFrame({"x1": x1, "x2": x2, "t": np.exp(np.minimum(logt, cut)), "c": logt > cut, "f": np.arange(n) % 4})
    fits = M.fit_aft(spark.createDataFrame(pdf), ["x1", "x2"], "t", "c", models={"all": (None, 1e-4), "wo0": (0, 1e-4)}, fold="f")
    m = fits["all"]
    assert m.intercept == pytest.approx(5.0, abs=0.06) and m.coef[0] == pytest.approx(0.3, abs=0.02) and m.coef[1] == pytest.approx(-0.5, abs=0.03) and m.sigma == pytest.approx(0.4, abs=0.02)
    alone = M.fit_aft(spark.createDataFrame(pdf[pdf.f != 0]), ["x1", "x2"], "t", "c", models={"m": (None, 1e-4)})["m"]
    assert fits["wo0"].sigma == pytest.approx(alone.sigma, rel=1e-6) and fits["wo0"].coef == pytest.approx(alone.coef, rel=1e-5)


def test_sign_tests(spark):
    df = spark.createDataFrame([("a", -1.0)] * 5 + [("a", 1.0)] + [("z", 0.0)] * 3, "g string, d double")
    got = {r["g"]: r for r in R.exact_sign_test(df, ["g"], "d").collect()}
    assert got["a"]["two_sided_p"] == pytest.approx(2 * (1 + 6) / 64) and got["z"]["two_sided_p"] == 1.0
    flip = {r["g"]: r for r in R.exact_sign_flip(df, ["g"], "d").collect()}
    vals = np.array([-1.0] * 5 + [1.0])
    p = np.mean([abs((vals * np.array(s)).sum()) >= abs(vals.sum()) - 1e-12 for s in itertools.product([-1, 1], repeat=6)])
    assert flip["a"]["two_sided_p"] == pytest.approx(p) and flip["z"]["n_patterns"] == 1
    assert R.exact_sign_flip(df, ["g"], "d", cap=3).filter("g = 'a'").first()["status"] == "above_exact_cap"


def test_quota_larger_than_pool_and_duplicate_hash(spark):
    df = spark.createDataFrame([("p", 1.0, "aa", 1), ("p", 1.0, "aa", 2), ("p", 0.5, "ff", 3)], "p string, s double, h string, o int")
    got = {r["o"]: (r["rank"], r["issued"]) for r in Q.rank_for_issuance(df, ["p"], score="s", tie="h", ordinal="o", fraction=1.0).collect()}
    assert got == {3: (1, True), 1: (2, True), 2: (3, True)}


def test_forward_fill_and_support(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, float("nan")), ("b", 1, 1.0), ("b", 3, 2.0)], "k string, i int, v double")
    filled, ledger = C.forward_fill(df, "k", "i", ["v"])
    assert {(r["k"], r["i"]): r["v"] for r in filled.collect()} == {("a", 1): None, ("a", 2): 5.0, ("a", 3): 5.0, ("b", 1): 1.0, ("b", 3): 2.0}
    assert {(r["i"], r["leading_null"]) for r in ledger.collect()} == {(1, True), (3, False)}
    assert [r["k"] for r in C.contiguous_support(df, "k", "i", 3).collect()] == ["a"]


@pytest.mark.parametrize("n", [8, 9])
def test_leave_one_out_robust_scales(spark, n):
    from trajlytics.operators.neighbors import robust_scales_loo

    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"id": range(n), "x": rng.normal(size=n), "y": np.round(rng.normal(size=n))})
    got = {r["id"]: r["scales"] for r in robust_scales_loo(spark.createDataFrame(pdf), "id", ["x", "y"], [1e-6, 0.3]).collect()}
    for i in range(n):
        rest = pdf[pdf.id != i]
        want = [max(1.4826 * np.median(np.abs(rest[f] - np.median(rest[f]))), fl) for f, fl in (("x", 1e-6), ("y", 0.3))]
        np.testing.assert_allclose(got[i], want, atol=1e-12)


def test_posterior_mode_ends_at_bounds_and_under_large_residuals():
    """Prefixes with one value 50 points off: the mode lies on a bound, or its cost hides the last steps in rounding."""
    rng = np.random.default_rng(5)
    n, points = 4000, 9
    t = np.sort(rng.uniform(0.5, 40.0, (n, points)), axis=1)
    y = 0.4 * np.sqrt(t) + rng.normal(0, 0.3, (n, points)) - 0.8 * (1 - np.exp(-t / 7.0))
    y[:, 3] += 50.0
    mean = np.column_stack([rng.normal(-0.9, 0.3, n), rng.uniform(0.1, 0.7, n), rng.uniform(0.0, 2.0, n)])
    scale = np.tile([0.5, 0.2, 1.0], (n, 1)) * rng.uniform(0.3, 2.0, (n, 1))
    theta, _, left = B._posterior(t, y, np.ones((n, points)), mean, scale, rng.uniform(0.1, 0.6, n), 7.0, 60)
    lo, hi = B.BOUNDS[3]
    assert (left < B.CONVERGED).all(), (left >= B.CONVERGED).sum()
    assert ((theta >= lo) & (theta <= hi)).all()


def test_a_lowered_point_leaves_the_gate_of_its_request(spark):
    """Requests off their reference prefix keep the readiness of the measured one, also where a single point decides it."""
    from trajlytics.queries import hierarchical as H

    losses = {3: {5: -0.2}, 15: {4: -0.2}, 27: {4: -0.2, 7: -0.3}, 39: {}}
    rows = [(c, k, 30.0, 0.5, float(k), at.get(k, 0.1 * k)) for c, at in losses.items() for k in range(12)]
    obs = spark.createDataFrame(rows, "condition_id long, checkup_index int, temperature_c double, storage_soc_fraction double, elapsed_days double, capacity_loss_pct double")
    asked = H.requests(obs.withColumn("capacity_retention_pct", 100.0 - F.col("capacity_loss_pct"))).select(F.col("request_id").alias("condition_id"), F.explode("prefix").alias("r"))
    prefix = asked.select("condition_id", F.col("r.elapsed_days").alias("elapsed_days"), (100.0 - F.col("r.capacity_retention_pct")).alias("capacity_loss_pct"))
    gate = {r["condition_id"]: r["gate_ready"] for r in K.activation_gate(prefix, ["condition_id"], margin_pp=H.POLICY.margin_pp).collect()}
    assert gate == {3: True, 15: True, 27: True, 39: False}
    assert {r["condition_id"]: r["count"] for r in prefix.filter("capacity_loss_pct > 40").groupBy("condition_id").count().collect()} == dict.fromkeys(losses, 1)
