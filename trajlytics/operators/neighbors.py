"""Neighbour-based forecasts, expert gates and mixtures (survey rows E22-E29, U7).

Signatures are one row per cell, so everything after the neighbour join is joins and aggregates over
(target, neighbour, model) rows: at most k neighbours and the short model registry per target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlytics.functions.columns import attach_one_row, clip
from trajlytics.operators.closed_form import BASE_MODELS
from trajlytics.plans.knn import knn_join
from trajlytics.plans.scan import order_statistics


def robust_scales(refs: DataFrame, features: Sequence[str], floors: Sequence[float]) -> list[float]:
    """1.4826 MAD per feature with floors: one short vector of model state on the driver."""
    long = refs.unpivot([], [F.col(f).cast("double").alias(f) for f in features], "f", "v")
    med = order_statistics(long, ["f"], "v", {"m": ("linear", 0.5)}).select("f", "m")
    dev = order_statistics(long.join(F.broadcast(med), "f").withColumn("a", F.abs(F.col("v") - F.col("m"))), ["f"], "a", {"mad": ("linear", 0.5)}).select("f", "mad").collect()
    mad = {r["f"]: r["mad"] for r in dev}
    return [max(1.4826 * mad[f], fl) for f, fl in zip(features, floors)]


def scaled_vector(df: DataFrame, features: Sequence[str], scales: Sequence[float]) -> Column:
    return F.array(*[F.col(f).cast("double") / F.lit(float(s)) for f, s in zip(features, scales)])


def nearest_robust(targets: DataFrame, refs: DataFrame, entity: str, features: Sequence[str], floors: Sequence[float], k: int, scales: Sequence[float] | None = None) -> DataFrame:
    """k nearest references of each target under median/MAD scaling of the references."""
    s = scales or robust_scales(refs, features, floors)
    q = targets.select(F.col(entity).alias("query_id"), scaled_vector(targets, features, s).alias("vec"))
    r = refs.select(F.col(entity).alias("ref_id"), scaled_vector(refs, features, s).alias("vec"))
    return knn_join(q, r, k)


#: References in a block of whole vectors: boxes of many features rule out little, so queries visit few, large leaves.
WIDE_BLOCK = 32768


def nearest_std_loo(df: DataFrame, entity: str, vector: str, dims: int, k: int, *, floor: float = 1e-9, asked: Column | None = None) -> DataFrame:
    """Leave-one-out neighbours with population-SD scaling over the *other* entities.

    The scale without one entity follows from the total sums; it enters as a per-query weight. ``asked`` tells which rows are
    queries (all without it); scales and references are always those of all rows.
    """
    x = lambda i: F.element_at(vector, i + 1)
    tot = df.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.array(*[F.sum(x(i)) for i in range(dims)]).alias("_s"), F.array(*[F.sum(x(i) * x(i)) for i in range(dims)]).alias("_q"))
    row = tot.first()
    n, s, q = row["_n"], row["_s"], row["_q"]
    common = [max((q[i] / n - (s[i] / n) ** 2), floor**2) ** 0.5 for i in range(dims)]

    def weight(i: int) -> Column:
        m, v = (F.lit(s[i]) - x(i)) / (n - 1), (F.lit(q[i]) - x(i) * x(i)) / (n - 1)
        return F.lit(common[i]) / F.greatest(F.sqrt(F.greatest(v - m * m, F.lit(0.0))), F.lit(floor))

    vec = F.array(*[x(i) / F.lit(common[i]) for i in range(dims)])
    queries = (df if asked is None else df.filter(asked)).select(F.col(entity).alias("query_id"), vec.alias("vec"), F.array(*[weight(i) for i in range(dims)]).alias("w"))
    return knn_join(queries, df.select(F.col(entity).alias("ref_id"), vec.alias("vec")), k, block=WIDE_BLOCK)


def delta_transfer(near: DataFrame, last: DataFrame, history: DataFrame, *, epsilon: float = 1e-6) -> DataFrame:
    """Target's last value plus the inverse-distance weighted change of its neighbours after the prefix.

    last: query_id, last_value, last_cycle; history: ref_id, cycle_index, retention.
    """
    w = near.withColumn("_w", 1.0 / (F.col("distance") + epsilon)).join(last, "query_id")
    at_prefix = history.select("ref_id", F.col("cycle_index").alias("last_cycle"), F.col("retention").alias("_r0"))
    based = w.join(at_prefix, ["ref_id", "last_cycle"])
    moved = based.join(history, "ref_id").filter(F.col("cycle_index") > F.col("last_cycle"))
    agg = moved.groupBy("query_id", "cycle_index").agg((F.sum(F.col("_w") * (F.col("retention") - F.col("_r0"))) / F.sum("_w")).alias("_d"), F.max("last_value").alias("_l"), F.count(F.lit(1)).alias("n_neighbours"))
    return agg.select("query_id", F.col("cycle_index").alias("forecast_cycle"), "n_neighbours", clip(F.col("_l") + F.col("_d"), 0.0, 110.0).alias("predicted"))


def training_errors(forecasts: DataFrame, truth: DataFrame, entity: str) -> DataFrame:
    """MAE of every model on every cell's suffix."""
    j = forecasts.join(truth, [entity, "forecast_cycle"])
    return j.groupBy(entity, "model_id").agg(F.avg(F.abs(F.col("predicted") - F.col("retention"))).alias("mae"))


def model_rank(c: str = "model_id") -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in BASE_MODELS]), F.col(c))


def neighbour_errors(near: DataFrame, errors: DataFrame, entity: str) -> DataFrame:
    return near.join(errors.select(F.col(entity).alias("ref_id"), "model_id", "mae"), "ref_id")


def gate_selection(near: DataFrame, errors: DataFrame, entity: str) -> DataFrame:
    """Lowest mean training MAE over the neighbours, and consensus of their individual winners.

    Ties go to the registry order; disagreeing winners fall back to persistence.
    """
    ne = neighbour_errors(near, errors, entity)
    mean = ne.groupBy("query_id", "model_id").agg(F.avg("mae").alias("_m"))
    pick = mean.groupBy("query_id").agg(F.min(F.struct("_m", model_rank().alias("_o"), "model_id")).alias("_b")).select("query_id", F.col("_b.model_id").alias("mean_selected"), F.col("_b._m").alias("mean_mae"))
    own = ne.groupBy("query_id", "ref_id").agg(F.min(F.struct("mae", model_rank().alias("_o"), "model_id"))["model_id"].alias("_win"))
    cons = own.groupBy("query_id").agg(F.countDistinct("_win").alias("n_winners"), F.min("_win").alias("_w"))
    agreed = F.col("n_winners") == 1
    return pick.join(cons, "query_id").select("query_id", "mean_selected", "mean_mae", "n_winners", F.when(agreed, F.col("_w")).otherwise(BASE_MODELS[0]).alias("consensus_selected"),
                                              F.when(agreed, "consensus_selected").otherwise("neighbour_disagreement_fallback").alias("status"))


def expert_risks(near: DataFrame, errors: DataFrame, entity: str, *, epsilon: float = 1e-6, penalty: float = 0.5, extra: Sequence[str] = ()) -> DataFrame:
    """Risk per (target, model): distance-weighted mean error plus a dispersion penalty."""
    ne = neighbour_errors(near, errors, entity).withColumn("_w", 1.0 / (F.col("distance") + epsilon))
    keys = ["query_id", *extra, "model_id"]
    w = Window.partitionBy(*keys)  # k neighbours per group
    mean = F.sum(F.col("_w") * F.col("mae")).over(w) / F.sum("_w").over(w)
    staged = ne.withColumn("_m", mean)
    return staged.groupBy(*keys).agg((F.max("_m") + penalty * F.sum(F.col("_w") * F.abs(F.col("mae") - F.col("_m"))) / F.sum("_w")).alias("risk"))


def inverse_power_weights(risks: DataFrame, keys: Sequence[str], *, risk: str = "risk", epsilon: float = 0.05, power: float = 2.0, name: str = "weight") -> DataFrame:
    raw = F.pow(F.col(risk) + epsilon, F.lit(-power))
    return risks.withColumn(name, raw / F.sum(raw).over(Window.partitionBy(*keys)))


def jackknife_neighbours(targets: DataFrame, refs: DataFrame, entity: str, features: Sequence[str], floors: Sequence[float], k: int, scales: Sequence[float]) -> DataFrame:
    """Neighbours under all features and under every leave-one-feature-out set (variant 0 = all).

    A variant is a set of query weights: zero for the feature left out, and the others raised so that the mean stays one over
    the features kept. All variants ride in one neighbour join.
    """
    n = len(features)
    rest = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    weights = [[1.0] * n] + [[0.0 if i == v else rest for i in range(n)] for v in range(n)]
    variants = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(w).alias("w")) for v, w in enumerate(weights)])
    asked = targets.select(F.col(entity).alias("query_id"), scaled_vector(targets, features, scales).alias("vec"), F.explode(variants).alias("_v"))
    queries = asked.select("query_id", "vec", F.col("_v.variant").alias("variant"), F.col("_v.w").alias("w"))
    return knn_join(queries, refs.select(F.col(entity).alias("ref_id"), scaled_vector(refs, features, scales).alias("vec")), k, by=["variant"])


def evidence_mixture(
    variants: DataFrame, errors: DataFrame, thresholds: DataFrame, entity: str, *, epsilon: float = 1e-6, penalty: float = 0.5, risk_epsilon: float = 0.05, power: float = 2.0,
    margin: tuple[float, float] = (0.05, 0.5), stability: tuple[float, float] = (0.1, 0.6),
) -> DataFrame:
    """Weights per (target, model) shrunk towards uniform by margin x distance x stability support, with status.

    thresholds (one row): full_evidence_below, full_uniform_above, refusal_at_or_above.
    """
    n_models = float(len(BASE_MODELS))
    risks = expert_risks(variants, errors, entity, epsilon=epsilon, penalty=penalty, extra=["variant"])
    vw = inverse_power_weights(risks, ["query_id", "variant"], epsilon=risk_epsilon, power=power)
    mean_w = F.avg("weight").over(Window.partitionBy("query_id", "model_id"))
    inst = vw.withColumn("_d", F.abs(F.col("weight") - mean_w)).groupBy("query_id", "variant").agg(F.sum("_d").alias("_d")).groupBy("query_id").agg(F.avg("_d").alias("instability"))
    mean_risk = risks.groupBy("query_id", "model_id").agg(F.avg("risk").alias("risk"))
    ranked = inverse_power_weights(mean_risk, ["query_id"], epsilon=risk_epsilon, power=power, name="evidence_weight").withColumn(
        "_k", F.row_number().over(Window.partitionBy("query_id").orderBy("risk", model_rank())))
    top = ranked.groupBy("query_id").agg(F.max(F.when(F.col("_k") == 1, F.col("risk"))).alias("_r1"), F.max(F.when(F.col("_k") == 2, F.col("risk"))).alias("_r2"), F.max(F.when(F.col("_k") == 1, F.col("model_id"))).alias("hard_model"))
    dist = variants.filter("variant = 0").groupBy("query_id").agg(F.avg("distance").alias("mean_distance"))
    d = attach_one_row(top.join(inst, "query_id").join(dist, "query_id"), thresholds)
    ramp = lambda v, lo, hi: F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    d = d.withColumn("risk_margin", (F.col("_r2") - F.col("_r1")) / F.greatest("_r1", F.lit(risk_epsilon))).withColumns({
        "margin_support": ramp(F.col("risk_margin"), F.lit(margin[0]), F.lit(margin[1])),
        "distance_support": 1.0 - ramp(F.col("mean_distance"), F.col("full_evidence_below"), F.col("full_uniform_above")),
        "stability_support": 1.0 - ramp(F.col("instability"), F.lit(stability[0]), F.lit(stability[1]))})
    d = d.withColumn("strength", F.col("margin_support") * F.col("distance_support") * F.col("stability_support"))
    status = (
        F.when(F.col("mean_distance") >= F.col("refusal_at_or_above"), "out_of_domain").when(F.col("margin_support") == 0, "risk_ambiguous_equal_blend")
        .when(F.col("distance_support") == 0, "distance_unsupported_equal_blend").when(F.col("stability_support") == 0, "feature_unstable_equal_blend")
        .when(F.col("strength") < 1, "partial_evidence_blend").otherwise("supported_stable_risk_weighted_blend"))
    action = F.when(status == "out_of_domain", "refuse_recommended").when(status == "supported_stable_risk_weighted_blend", "predict").otherwise("predict_with_warning")
    d = d.withColumns({"evidence_status": status, "action": action}).select("query_id", "hard_model", "instability", "risk_margin", "mean_distance", "strength", "evidence_status", "action")
    return ranked.join(d, "query_id").withColumn("weight", 1.0 / n_models + F.col("strength") * (F.col("evidence_weight") - 1.0 / n_models)).drop("_k")


def _middle_ranks(n: int) -> list[int]:
    """One-based ranks that decide the median after one of n values is taken out."""
    return [n // 2, n // 2 + 1] if n % 2 == 0 else [(n - 1) // 2, (n + 1) // 2, (n + 3) // 2]


def _median_without(own: Column, mid: list[Column]) -> Column:
    """Median of n values without ``own``, from the order statistics around the middle."""
    if len(mid) == 2:
        return F.when(own <= mid[0], mid[1]).otherwise(mid[0])
    lo, m, hi = mid
    return F.when(own < m, (m + hi) / 2.0).when(own > m, (lo + m) / 2.0).otherwise((lo + hi) / 2.0)


def robust_scales_loo(refs: DataFrame, entity: str, features: Sequence[str], floors: Sequence[float]) -> DataFrame:
    """Median/MAD scale of every feature without the entity itself: (entity, scales).

    Taking one value out leaves at most three possible medians per feature, so the deviations are ranked
    once per feature and candidate centre, never per entity.
    """
    n = refs.count()
    if n < 4:
        raise ValueError("at least four references are required")
    ranks = _middle_ranks(n)
    at = lambda prefix: {f"{prefix}{i}": ("linear", (r - 1) / (n - 1)) for i, r in enumerate(ranks)}
    long = refs.unpivot([entity], [F.col(f).cast("double").alias(f) for f in features], "f", "v")
    mid = order_statistics(long, ["f"], "v", at("m")).drop("n")
    m = [F.col(f"m{i}") for i in range(len(ranks))]
    centred = long.join(F.broadcast(mid), "f").withColumn("c", _median_without(F.col("v"), m))
    candidates = [m[1], m[0]] if len(m) == 2 else [(m[1] + m[2]) / 2.0, (m[0] + m[1]) / 2.0, (m[0] + m[2]) / 2.0]
    dev = long.join(F.broadcast(mid), "f").select("f", "v", F.explode(F.array_distinct(F.array(*candidates))).alias("c")).withColumn("a", F.abs(F.col("v") - F.col("c")))
    spread = order_statistics(dev, ["f", "c"], "a", at("d")).drop("n")
    own = centred.select(entity, "f", "c", F.abs(F.col("v") - F.col("c")).alias("a")).join(F.broadcast(spread), ["f", "c"])
    floor = F.element_at(F.create_map(*[F.lit(x) for f, fl in zip(features, floors) for x in (f, float(fl))]), F.col("f"))
    scale = F.greatest(1.4826 * _median_without(F.col("a"), [F.col(f"d{i}") for i in range(len(ranks))]), floor)
    per = own.groupBy(entity).agg(*[F.max(F.when(F.col("f") == f, scale)).alias(f"_s{i}") for i, f in enumerate(features)])
    return per.select(entity, F.array(*[F.col(f"_s{i}") for i in range(len(features))]).alias("scales"))


def distance_thresholds(refs: DataFrame, entity: str, features: Sequence[str], floors: Sequence[float], k: int, scales: Sequence[float], *, quantiles: tuple[float, float, float] = (0.5, 0.9, 0.99), refusal_multiplier: float = 1.5) -> DataFrame:
    """Quantiles of the mean leave-one-out neighbour distance over the references (one row).

    Every left-out cell is compared under the scale of the others, as per-query weights of one join.
    """
    loo = refs.join(robust_scales_loo(refs, entity, features, floors), entity)
    weights = F.array(*[F.lit(float(s)) / F.element_at("scales", i + 1) for i, s in enumerate(scales)])
    queries = loo.select(F.col(entity).alias("query_id"), scaled_vector(loo, features, scales).alias("vec"), weights.alias("w"))
    near = knn_join(queries, refs.select(F.col(entity).alias("ref_id"), scaled_vector(refs, features, scales).alias("vec")), k)
    mean = near.groupBy("query_id").agg(F.avg("distance").alias("_d"))
    q = order_statistics(mean, [], "_d", {"a": ("linear", quantiles[0]), "b": ("linear", quantiles[1]), "c": ("linear", quantiles[2])})
    return q.select(F.col("a").alias("full_evidence_below"), F.col("b").alias("full_uniform_above"), (F.col("c") * refusal_multiplier).alias("refusal_at_or_above"))


def safe_prior(errors: DataFrame, *, max_relative: float = 1.0, max_absolute: float = 0.0, epsilon: float = 0.05, power: float = 2.0) -> DataFrame:
    """Global risk per model, eligibility against persistence (the anchor always stays) and prior weights."""
    g = errors.groupBy("model_id").agg(F.avg("mae").alias("global_risk"))
    w = Window.partitionBy()  # the registry has four rows
    anchor = F.max(F.when(F.col("model_id") == BASE_MODELS[0], F.col("global_risk"))).over(w)
    elig = (F.col("model_id") == BASE_MODELS[0]) | ((F.col("global_risk") <= anchor * max_relative) & (F.col("global_risk") <= anchor + max_absolute))
    out = g.withColumn("eligible", elig)
    raw = F.when(F.col("eligible"), F.pow(F.col("global_risk") + epsilon, F.lit(-power))).otherwise(F.lit(0.0))
    return out.withColumn("prior_weight", raw / F.sum(raw).over(w))


def restricted_mixture(mixture: DataFrame, prior: DataFrame, *, epsilon: float = 0.05, power: float = 2.0) -> DataFrame:
    """Local weights restricted to the safe pool, blended with the prior by the evidence strength."""
    j = mixture.join(F.broadcast(prior.select("model_id", "eligible", "prior_weight")), "model_id")
    raw = F.when(F.col("eligible"), F.pow(F.col("risk") + epsilon, F.lit(-power))).otherwise(F.lit(0.0))
    out = j.withColumn("local_weight", raw / F.sum(raw).over(Window.partitionBy("query_id")))
    return out.withColumn("final_weight", F.col("prior_weight") + F.col("strength") * (F.col("local_weight") - F.col("prior_weight")))


def mixture_forecasts(forecasts: DataFrame, weights: DataFrame, columns: dict[str, str], entity: str) -> DataFrame:
    """Mixed forecasts for several weight columns: name -> column."""
    w = weights.withColumnRenamed("query_id", entity).select(entity, "model_id", *columns.values())
    j = forecasts.join(w, [entity, "model_id"])
    agg = j.groupBy(entity, "forecast_cycle").agg(*[clip(F.sum(F.col(c) * F.col("predicted")), 0.0, 110.0).alias(n) for n, c in columns.items()])
    return agg.unpivot([entity, "forecast_cycle"], list(columns), "mixture_id", "predicted")


def evidence_bands(near: DataFrame, point_errors: DataFrame, selected: DataFrame, center: DataFrame, entity: str, *, prefix_cycle: int, minimum_half_width: float, reference_prefix: float, exponent: float, disagreement_multiplier: float) -> DataFrame:
    """Half-width per horizon: largest neighbour error of the selected model x scarcity x disagreement.

    point_errors: entity, model_id, forecast_cycle, abs_error; selected: query_id, model_id, disagreement; center: entity, model_id, forecast_cycle, predicted.
    """
    pe = point_errors.select(F.col(entity).alias("ref_id"), "model_id", "forecast_cycle", "abs_error")
    worst = near.select("query_id", "ref_id").join(selected, "query_id").join(pe, ["ref_id", "model_id"]).groupBy("query_id", "model_id", "disagreement", "forecast_cycle").agg(F.max("abs_error").alias("_e"))
    scarcity = max(1.0, (reference_prefix / prefix_cycle) ** exponent)
    half = F.greatest("_e", F.lit(minimum_half_width)) * scarcity * F.when(F.col("disagreement"), F.lit(disagreement_multiplier)).otherwise(F.lit(1.0))
    j = worst.withColumn("half_width", half).join(center.withColumnRenamed(entity, "query_id"), ["query_id", "model_id", "forecast_cycle"])
    return j.select("query_id", "model_id", "forecast_cycle", "predicted", "half_width", clip(F.col("predicted") - F.col("half_width"), 0.0, 110.0).alias("lower"), clip(F.col("predicted") + F.col("half_width"), 0.0, 110.0).alias("upper"))


def mixture_ablations(forecasts: DataFrame, truth: DataFrame, mixture: DataFrame, entity: str, *, epsilon: float = 0.05, power: float = 2.0) -> DataFrame:
    """MAE per target of hindsight best, evidence mixture, equal, pure inverse-risk and hard lowest-risk."""
    pure = inverse_power_weights(mixture, ["query_id"], epsilon=epsilon, power=power, name="_pure").withColumns({
        "_equal": F.lit(1.0 / len(BASE_MODELS)), "_hard": (F.col("model_id") == F.col("hard_model")).cast("double")})
    best = training_errors(forecasts, truth, entity).groupBy(entity).agg(F.min(F.struct("mae", model_rank().alias("_o")))["_o"].alias("_best"))
    w = pure.join(best.withColumnRenamed(entity, "query_id"), "query_id").withColumn("_hindsight", (model_rank() == F.col("_best")).cast("double"))
    mixed = mixture_forecasts(forecasts, w, {"hindsight_best": "_hindsight", "evidence_mixture": "weight", "equal_weight": "_equal", "pure_inverse_risk": "_pure", "hard_lowest_risk": "_hard"}, entity)
    j = mixed.join(truth, [entity, "forecast_cycle"])
    return j.groupBy(entity, "mixture_id").agg(F.avg(F.abs(F.col("predicted") - F.col("retention"))).alias("mae"))


