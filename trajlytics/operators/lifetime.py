"""Supervised lifetime models (survey rows F1-F11).

The log-normal accelerated-failure-time fit keeps its data distributed: uncensored rows enter through
one pass of sums per fold, censored rows through one Arrow-batched pass of gradient and curvature sums
per Newton step. Only sums of the size of the feature list reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.functions.columns import attach_one_row, normal_cdf, normal_log_sf, normal_quantile
from trajlytics.operators.scoring import regression_metrics
from trajlytics.plans.scan import order_statistics

LOG_SQRT_2PI = 0.9189385332046727


@dataclass(frozen=True)
class AftModel:
    """Frozen state of one fit; coefficients are in original feature units."""

    features: tuple[str, ...]
    intercept: float
    coef: tuple[float, ...]
    sigma: float
    n_events: int
    n_censored: int
    objective: float
    converged: bool = True

    def location(self) -> Column:
        out = F.lit(self.intercept)
        for f, c in zip(self.features, self.coef):
            out = out + F.lit(c) * F.col(f)
        return out


def _log_sf(z: np.ndarray) -> np.ndarray:
    """log(1 - Phi(z)) by the scaled complementary error function's continued fraction in the tail."""
    out = np.empty_like(z)
    near = z < 5.0
    out[near] = np.log(np.maximum(0.5 * np.array([math.erfc(v) for v in z[near] / math.sqrt(2.0)]), 1e-300)) if near.any() else out[near]
    t = z[~near]
    frac = t.copy()
    for i in range(60, 0, -1):
        frac = t + i / frac
    out[~near] = -0.5 * t * t - LOG_SQRT_2PI - np.log(frac)
    return out


def _fold_sums(df: DataFrame, features: Sequence[str], log_time: str, censored: str, fold: str) -> dict:
    """Per fold: count, sums and second moments of (1, x, y) over observed rows, feature moments over all."""
    z = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(log_time)]
    seen = (~F.col(censored)).cast("double")
    m = len(z)
    rows = df.groupBy(fold).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(1 - seen).alias("nc"), F.array(*[F.sum(seen * z[i] * z[j]) for i in range(m) for j in range(m)]).alias("M"),
        F.array(*[F.sum(c) for c in z[1:-1]]).alias("s"), F.array(*[F.sum(c * c) for c in z[1:-1]]).alias("q")).collect()
    return {r[fold]: (r["n"], r["nc"], np.reshape(r["M"], (m, m)), np.array(r["s"]), np.array(r["q"])) for r in rows}


def fit_aft(
    df: DataFrame, features: Sequence[str], duration: str, censored: str, *, models: dict[str, tuple[object, float]], fold: str | None = None,
    sigma_bounds: tuple[float, float] = (1e-3, 10.0), steps: int = 40,
) -> dict[str, AftModel]:
    """Fit several models at once: name -> (fold value left out or None, L2 penalty).

    A model reads all rows outside its fold; rows are never copied per model. The number of folds and
    models is the declared experiment grid.
    """
    features = list(features)
    work = df.withColumn("_y", F.ln(duration)).withColumn("_fold", F.col(fold) if fold else F.lit(0))
    sums = _fold_sums(work, features, "_y", censored, "_fold")
    d = len(features)
    state = {}
    for name, (left_out, l2) in models.items():
        parts = [v for f, v in sums.items() if left_out is None or f != left_out]
        n, nc = sum(p[0] for p in parts), sum(p[1] for p in parts)
        M = sum(p[2] for p in parts)
        mean = sum(p[3] for p in parts) / n
        scale = np.sqrt(np.maximum(sum(p[4] for p in parts) / n - mean**2, 0.0))
        scale = np.where(scale > 1e-12, scale, 1.0)
        T = np.eye(d + 2)
        for i in range(d):
            T[i + 1, i + 1], T[i + 1, 0] = 1 / scale[i], -mean[i] / scale[i]
        S = T @ M @ T.T  # moments of (1, standardised x, y)
        A, b, yy, ne = S[:-1, :-1], S[:-1, -1], S[-1, -1], S[0, 0]
        beta = np.linalg.pinv(A, hermitian=True) @ b
        rss = max(yy - 2 * beta @ b + beta @ A @ beta, 0.0)
        s0 = math.sqrt(rss / max(ne, 1.0))
        s0 = 0.25 if not math.isfinite(s0) or s0 < 0.05 else min(max(s0, sigma_bounds[0]), sigma_bounds[1])
        state[name] = dict(left_out=left_out, l2=l2, A=A, b=b, yy=yy, ne=ne, nc=nc, sumy=S[0, -1], mean=mean, scale=scale, theta=np.append(beta, math.log(s0)), damp=1e-6, done=False, converged=False, cost=None)
    cens = work.filter(F.col(censored)).select(*features, "_y", "_fold")
    any_censored = any(s["nc"] > 0 for s in state.values())
    if any_censored:
        cens = cens.persist()

    def censored_terms(trial: dict[str, np.ndarray]) -> dict:
        """Objective, gradient and curvature sums over censored rows for every model, one job."""
        zero = {n: (0.0, np.zeros(d + 2), np.zeros((d + 2, d + 2))) for n in trial}
        if not any_censored:
            return zero
        spec = [(n, state[n]["left_out"], state[n]["mean"], state[n]["scale"], th) for n, th in trial.items()]
        size = 1 + (d + 2) + (d + 2) ** 2

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = {s[0]: np.zeros(size) for s in spec}
            for pdf in batches:
                x, y, fd = pdf[features].to_numpy(float), pdf["_y"].to_numpy(float), pdf["_fold"].to_numpy()
                for name, left_out, mean, scale, th in spec:
                    keep = np.ones(len(y), bool) if left_out is None else fd != left_out
                    if not keep.any():
                        continue
                    X, sg = np.column_stack([np.ones(keep.sum()), (x[keep] - mean) / scale]), math.exp(th[-1])
                    z = (y[keep] - X @ th[:-1]) / sg
                    ls = _log_sf(z)
                    lam = np.exp(-0.5 * z * z - LOG_SQRT_2PI - ls)
                    dl = lam * (lam - z)
                    g = np.append(-(X.T @ lam) / sg, -(lam * z).sum())
                    H = np.zeros((d + 2, d + 2))
                    H[:-1, :-1] = (X * dl[:, None]).T @ X / sg**2
                    H[:-1, -1] = H[-1, :-1] = X.T @ (lam + z * dl) / sg
                    H[-1, -1] = (z * lam + z * z * dl).sum()
                    acc[name] += np.concatenate([[-ls.sum()], g, H.ravel()])
            for name, v in acc.items():
                yield pd.DataFrame({"model": name, "i": np.arange(size), "v": v})

        rows = cens.mapInPandas(partial, "model string, i int, v double").groupBy("model", "i").agg(F.sum("v").alias("v")).collect()
        out = {n: np.zeros(size) for n in trial}
        for r in rows:
            out[r["model"]][r["i"]] = r["v"]
        return {n: (v[0], v[1 : d + 3], v[d + 3 :].reshape(d + 2, d + 2)) for n, v in out.items()}

    def total(name: str, th: np.ndarray, extra) -> tuple[float, np.ndarray, np.ndarray]:
        s = state[name]
        beta, ls, sg2 = th[:-1], th[-1], math.exp(2 * th[-1])
        r1 = s["b"] - s["A"] @ beta
        rss = s["yy"] - 2 * beta @ s["b"] + beta @ s["A"] @ beta
        pen = np.append(np.full(d + 1, s["l2"]), 0.0)
        pen[0] = 0.0
        obj = s["sumy"] + s["ne"] * (ls + LOG_SQRT_2PI) + 0.5 * rss / sg2 + 0.5 * float(pen @ th**2)
        g = np.append(-r1 / sg2, s["ne"] - rss / sg2) + pen * th
        H = np.zeros((d + 2, d + 2))
        H[:-1, :-1], H[:-1, -1], H[-1, -1] = s["A"] / sg2, 2 * r1 / sg2, 2 * rss / sg2
        H[-1, :-1] = H[:-1, -1]
        return obj + extra[0], g + extra[1], H + np.diag(pen) + extra[2]

    cur = {n: total(n, s["theta"], e) for (n, s), e in zip(state.items(), censored_terms({n: s["theta"] for n, s in state.items()}).values())}
    lo, hi = math.log(sigma_bounds[0]), math.log(sigma_bounds[1])
    for _ in range(steps):
        trial = {}
        for n, s in state.items():
            if s["done"]:
                continue
            _, g, H = cur[n]
            step = np.linalg.solve(H + s["damp"] * np.diag(np.abs(np.diag(H)) + 1e-9), g)
            th = s["theta"] - step
            th[-1] = min(max(th[-1], lo), hi)
            trial[n] = th
        if not trial:
            break
        extras = censored_terms(trial)
        for n, th in trial.items():
            s, new = state[n], total(n, th, extras[n])
            if math.isfinite(new[0]) and new[0] <= cur[n][0] + 1e-12:
                s["done"] = s["converged"] = float(np.abs(th - s["theta"]).max()) < 1e-10
                s["theta"], cur[n], s["damp"] = th, new, max(s["damp"] * 0.1, 1e-12)
            else:
                s["damp"] = s["damp"] * 10 + 1e-8
                s["done"] = s["damp"] > 1e12
    if any_censored:
        cens.unpersist()
    out = {}
    for n, s in state.items():
        coef = s["theta"][1:-1] / s["scale"]
        out[n] = AftModel(tuple(features), float(s["theta"][0] - coef @ s["mean"]), tuple(float(c) for c in coef), float(math.exp(s["theta"][-1])), int(s["ne"]), int(s["nc"]), float(cur[n][0]), bool(s["converged"]))
    return out


def predict_aft(df: DataFrame, model: AftModel, *, quantiles: Sequence[float] = (0.1, 0.5, 0.9), survival_times: Sequence[float] = (), sigma: Column | None = None, offset: Column | None = None) -> DataFrame:
    """Log location, lifetime quantiles and survival probabilities as plain columns."""
    loc = model.location() if offset is None else model.location() + offset
    sg = F.lit(model.sigma) if sigma is None else sigma
    out = df.withColumn("log_location", loc)
    out = out.withColumns({f"p{round(100 * q):02d}": F.exp(F.col("log_location") + sg * F.lit(normal_quantile(q))) for q in quantiles})
    if survival_times:
        out = out.withColumns({f"survival_{round(t)}": normal_cdf(-(F.lit(math.log(t)) - F.col("log_location")) / sg) for t in survival_times})
    return out


def aft_nll(location: Column, sigma: Column, duration: Column, censored: Column) -> Column:
    z = (F.ln(duration) - location) / sigma
    return F.when(censored, -normal_log_sf(z)).otherwise(F.ln(duration) + F.ln(sigma) + F.lit(LOG_SQRT_2PI) + 0.5 * z * z)


def select_l2(df: DataFrame, features: Sequence[str], duration: str, censored: str, *, group: str, fold: str, folds: Sequence, penalties: Sequence[float]) -> DataFrame:
    """Group-isolated cross-validation: mean over groups of the validation negative log-likelihood per penalty,
    the lowest selected, ties to the stronger penalty. ``fold`` must keep whole groups together."""
    models = {f"{l2}|{f}": (f, float(l2)) for l2 in penalties for f in folds}
    fits = fit_aft(df, features, duration, censored, models=models, fold=fold)
    entries = F.array(*[F.struct(F.lit(float(l2)).alias("l2"), F.lit(f).alias("f"), F.lit(fits[f"{l2}|{f}"].sigma).alias("s"), fits[f"{l2}|{f}"].location().alias("m")) for l2 in penalties for f in folds])
    rows = df.withColumn("_e", F.explode(F.filter(entries, lambda e: e["f"] == F.col(fold))))
    nll = rows.select(group, F.col("_e.l2").alias("l2_penalty"), aft_nll(F.col("_e.m"), F.col("_e.s"), F.col(duration), F.col(censored)).alias("_n"))
    per = nll.groupBy("l2_penalty", group).agg(F.avg("_n").alias("_g")).groupBy("l2_penalty").agg(F.count(F.lit(1)).alias("n_groups"), F.avg("_g").alias("mean_group_nll"))
    best = per.agg(F.min(F.struct("mean_group_nll", (-F.col("l2_penalty")).alias("_o")))["_o"].alias("_b"))
    return attach_one_row(per, best).select("l2_penalty", "n_groups", "mean_group_nll", (F.col("l2_penalty") == -F.col("_b")).alias("selected"))


def offset_posteriors(refs: DataFrame, by: Sequence[str], residual: str, rank: str, ks: Sequence[int], *, residual_sigma: float | Column, prior_sd: float | Column, prior_mean: float = 0.0) -> DataFrame:
    """Gaussian offset from the first k references per group: shrunk (normal prior) and unshrunk (flat prior)."""
    sg = residual_sigma if isinstance(residual_sigma, Column) else F.lit(float(residual_sigma))
    sd = prior_sd if isinstance(prior_sd, Column) else F.lit(float(prior_sd))
    rows = refs.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).filter(F.col(rank) <= F.col("k"))
    agg = rows.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n_references"), F.sum(residual).alias("_s"), F.first(sg).alias("_sg"), F.first(sd).alias("_sd"))
    var = 1.0 / (1.0 / (F.col("_sd") * F.col("_sd")) + F.col("n_references") / (F.col("_sg") * F.col("_sg")))
    return agg.select(*by, "k", "n_references", (var * (prior_mean / (F.col("_sd") * F.col("_sd")) + F.col("_s") / (F.col("_sg") * F.col("_sg")))).alias("shrunk_mean"), F.sqrt(var).alias("shrunk_sd"),
                      (F.col("_s") / F.col("n_references")).alias("flat_mean"), (F.col("_sg") / F.sqrt("n_references")).alias("flat_sd"))


def reference_experiment(
    df: DataFrame, features: Sequence[str], duration: str, *, batch: str, batches: Sequence, entity: str, ks: Sequence[int], repeats: int, seed: int, l2: float = 1e-4, prior_multipliers: Sequence[float] = (1.0,),
) -> DataFrame:
    """Leave-one-batch-out base model, k reference cells per repeat, scored on the common query.

    Methods: zero_shot, shrunk_offset, unshrunk_offset and source_control (offset learned from the source batches'
    own references). One row per (batch, multiplier, k, method) with mean NLL and error over repeats and queries.
    """
    from trajlytics.operators.splits import nested_reference_partition

    data = df.withColumn("_cens", F.lit(False))
    fits = fit_aft(data, features, duration, "_cens", models={str(b): (b, l2) for b in batches}, fold=batch)
    # location and sigma of the model that did not see the row's own batch, and of every other target's model
    pick = lambda attr: F.coalesce(*[F.when(F.col(batch) == b, attr(fits[str(b)])) for b in batches])
    own = data.withColumns({"_loc": pick(lambda m: m.location()), "_sg": pick(lambda m: F.lit(m.sigma))}).withColumn("_res", F.ln(duration) - F.col("_loc"))
    parts = nested_reference_partition(df, domain=batch, entity=entity, max_k=max(ks), repeats=repeats, seed=seed)
    joined = parts.join(own.select(batch, entity, duration, "_loc", "_sg", "_res"), [batch, entity])
    mult = F.explode(F.array(*[F.lit(float(m)) for m in prior_multipliers]))
    refs = joined.filter("role = 'reference'").withColumn("multiplier", mult)
    post = offset_posteriors(refs, [batch, "repeat_index", "multiplier"], "_res", "reference_rank", ks, residual_sigma=F.col("_sg"), prior_sd=F.col("_sg") * F.col("multiplier"))
    # control: residuals of source cells under the same target model
    src_entries = F.array(*[F.struct(F.lit(b).alias("t"), (F.ln(duration) - fits[str(b)].location()).alias("r"), F.lit(fits[str(b)].sigma).alias("s")) for b in batches])
    source = data.withColumn("_t", F.explode(F.filter(src_entries, lambda e: e["t"] != F.col(batch)))).select(F.col("_t.t").alias("target"), entity, F.col("_t.r").alias("_res"), F.col("_t.s").alias("_sg"))
    sparts = nested_reference_partition(source, domain="target", entity=entity, max_k=max(ks), repeats=repeats, seed=seed + 1_000_003).filter("role = 'reference'")
    srefs = sparts.join(source, ["target", entity]).withColumn("multiplier", mult)
    spost = offset_posteriors(srefs, ["target", "repeat_index", "multiplier"], "_res", "reference_rank", ks, residual_sigma=F.col("_sg"), prior_sd=F.col("_sg") * F.col("multiplier")).select(
        F.col("target").alias(batch), "repeat_index", "multiplier", "k", F.col("shrunk_mean").alias("_cm"), F.col("shrunk_sd").alias("_cs"))
    q = joined.filter("role = 'query'").join(post, [batch, "repeat_index"]).join(spost, [batch, "repeat_index", "multiplier", "k"])
    zero, sg = F.lit(0.0), F.col("_sg")
    methods = [("zero_shot", zero, zero), ("shrunk_offset", F.col("shrunk_mean"), F.col("shrunk_sd")), ("unshrunk_offset", F.col("flat_mean"), F.col("flat_sd")), ("source_control", F.col("_cm"), F.col("_cs"))]
    entries = F.array(*[F.struct(F.lit(n).alias("method"), (F.col("_loc") + m).alias("loc"), F.sqrt(sg * sg + s * s).alias("sg")) for n, m, s in methods])
    rows = q.select(batch, "repeat_index", "multiplier", "k", duration, F.explode(entries).alias("e")).select("*", "e.*")
    err = F.abs(F.exp("loc") - F.col(duration))
    z = (F.ln(duration) - F.col("loc")) / F.col("sg")
    return rows.groupBy(batch, "multiplier", "k", "method").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(aft_nll(F.col("loc"), F.col("sg"), F.col(duration), F.lit(False))).alias("mean_nll"), F.avg(err).alias("mae"),
        F.avg(100 * err / F.col(duration)).alias("mape_pct"), F.avg((F.abs(z) <= normal_quantile(0.9)).cast("double")).alias("p10_p90_coverage"))


def external_predictions(source: DataFrame, target: DataFrame, feature: str, duration: str, entity: str, *, l2: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """One-feature source model and constant null model on a label-free target; shift diagnostics (one row)."""
    src = source.withColumns({"_cens": F.lit(False), "_zero": F.lit(0.0)})
    var = fit_aft(src, [feature], duration, "_cens", models={"m": (None, l2)})["m"]
    null = fit_aft(src, ["_zero"], duration, "_cens", models={"m": (None, l2)})["m"]
    out = None
    for name, model in [("source_feature", var), ("source_null", null)]:
        part = predict_aft(target.select(entity, feature).withColumn("_zero", F.lit(0.0)), model).select(entity, F.lit(name).alias("model"), "log_location", F.lit(model.sigma).alias("sigma"), "p10", "p50", "p90")
        out = part if out is None else out.unionByName(part)
    stats = source.agg(F.avg(feature).alias("_m"), F.stddev_pop(feature).alias("_s"), F.min(feature).alias("_lo"), F.max(feature).alias("_hi"), F.count(F.lit(1)).alias("n_source"))
    overlap = target.select(entity).join(source.select(entity), entity, "left_semi").agg(F.count(F.lit(1)).alias("n_identity_overlap"))
    shift = attach_one_row(attach_one_row(target, stats).agg(
        F.max("n_source").alias("n_source"), F.count(F.lit(1)).alias("n_target"), ((F.avg(feature) - F.max("_m")) / F.max("_s")).alias("mean_shift_in_source_sd"),
        F.count(F.when(F.col(feature) < F.col("_lo"), 1)).alias("n_below_source"), F.count(F.when(F.col(feature) > F.col("_hi"), 1)).alias("n_above_source")), overlap)
    return out, shift


def impute_and_scale(df: DataFrame, train: Column, features: Sequence[str]) -> DataFrame:
    """Median imputation and population scaling from training rows; zero variance scales by one."""
    tr = df.filter(train)
    long = tr.unpivot([], [F.col(f).cast("double").alias(f) for f in features], "f", "v").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    med = {r["f"]: r["m"] for r in order_statistics(long, ["f"], "v", {"m": ("linear", 0.5)}).select("f", "m").collect()}
    filled = df.withColumns({f: F.coalesce(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), F.lit(med[f])) for f in features})
    row = filled.filter(train).agg(*[c for f in features for c in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    return filled.withColumns({f: (F.col(f) - F.lit(row[f"m_{f}"])) / F.lit(row[f"s_{f}"] if row[f"s_{f}"] and row[f"s_{f}"] > 1e-12 else 1.0) for f in features})


def lifetime_baselines(df: DataFrame, features: Sequence[str], categorical: Sequence[str], label: str, *, alpha: float = 0.02, l1_ratio: float = 0.5, log10_target: bool = False) -> DataFrame:
    """Median, linear and elastic-net baselines on a frozen ``split`` column: metrics per split and model."""
    train = F.col("split") == "train"
    scaled = impute_and_scale(df, train, features)
    scaled = scaled.withColumn("_target", F.log10(label) if log10_target else F.col(label).cast("double"))
    stages_in = list(features)
    for c in categorical:
        idx = StringIndexer(inputCol=c, outputCol=f"_{c}_i", handleInvalid="keep").fit(scaled.filter(train))
        scaled = idx.transform(scaled)
        scaled = OneHotEncoder(inputCol=f"_{c}_i", outputCol=f"_{c}_v", dropLast=True).fit(scaled).transform(scaled)
        stages_in.append(f"_{c}_v")
    ready = VectorAssembler(inputCols=stages_in, outputCol="_x").transform(scaled)
    fit_rows = ready.filter(train)
    back = lambda c: F.pow(F.lit(10.0), c) if log10_target else c
    median = order_statistics(df.filter(train), [], label, {"m": ("linear", 0.5)}).select("m")
    out = attach_one_row(ready, median).withColumn("median", F.col("m"))
    for name, reg, l1 in [("linear_regression", 0.0, 0.0), ("elastic_net", alpha, l1_ratio)]:
        lr = LinearRegression(featuresCol="_x", labelCol="_target", predictionCol=f"_p_{name}", regParam=reg, elasticNetParam=l1, standardization=False, maxIter=500, tol=1e-10).fit(fit_rows)
        out = lr.transform(out).withColumn(name, back(F.col(f"_p_{name}")))
    long = out.filter(~train).unpivot([F.col("split"), F.col(label)], [F.col("median"), F.col("linear_regression"), F.col("elastic_net")], "model", "predicted")
    return regression_metrics(long, ["split", "model"], label, "predicted")


def logistic_danger(df: DataFrame, features: Sequence[str], label: str, *, c: float = 1.0) -> DataFrame:
    """L2 logistic danger score on population-standardised features (penalty 1 / (c n) per row mean)."""
    scaled = impute_and_scale(df, F.lit(True), features).withColumn("_y", F.col(label).cast("double"))
    ready = VectorAssembler(inputCols=list(features), outputCol="_x").transform(scaled)
    n = ready.count()
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-8, rawPredictionCol="_raw", probabilityCol="_prob").fit(ready)
    return model.transform(ready).withColumns({"danger_score": vector_to_array("_raw")[1], "danger_probability": vector_to_array("_prob")[1]}).drop("_x", "_raw", "_prob", "prediction")

