"""Structure-library aggregation (survey rows D14, E30-E33).

All groups here are the members of one trajectory at one horizon: at most the size of the declared
structure registry. They are gathered in one short array and judged there; coordinates never become rows that an aggregate holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlytics.functions.columns import clip, div, is_finite
from trajlytics.operators.features import array_median


def credible_members(fits: DataFrame, keys: Sequence[str], *, rmse_slack: float, residual_cap: float, bounds: tuple[float, float]) -> DataFrame:
    """Flag members close to the best prefix RMSE, within the residual cap and with bounded forecasts."""
    best = F.min("prefix_rmse_pp").over(Window.partitionBy(*keys))
    inside = F.forall("forecast", lambda v: is_finite(v) & (v >= bounds[0]) & (v <= bounds[1]))
    return fits.withColumn("credible_variant", (F.col("prefix_rmse_pp") <= best + rmse_slack) & (F.col("max_abs_residual_pp") <= residual_cap) & inside)


def credible_forecast(fits: DataFrame, keys: Sequence[str], days: Sequence[float], *, minimum_families: int = 2, fallback: str = "power") -> DataFrame:
    """Family median, overall median and min/max envelope of credible members per horizon day.

    Too few families: the fallback family's forecast, with the envelope of whatever is credible.
    """
    keys = list(keys)
    long = fits.select(*keys, "model_id", "credible_variant", F.posexplode("forecast").alias("_i", "_v"))
    fam = long.filter("credible_variant").groupBy(*keys, "_i", "model_id").agg(F.median("_v").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    agg = fam.groupBy(*keys, "_i").agg(F.count(F.lit(1)).alias("credible_families"), F.median("_m").alias("_point"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    back = long.filter(F.col("model_id") == fallback).select(*keys, "_i", F.col("_v").alias("_fb"))
    j = back.join(agg, [*keys, "_i"], "left")
    enough = F.coalesce(F.col("credible_families") >= minimum_families, F.lit(False))
    day = F.element_at(F.array(*[F.lit(float(d)) for d in days]), F.col("_i") + 1)
    return j.select(*keys, day.alias("forecast_day"), F.coalesce("credible_families", F.lit(0)).alias("credible_families"), F.when(enough, F.col("_point")).otherwise(F.col("_fb")).alias("point"),
                    F.coalesce("_lo", "_fb").alias("envelope_lower"), F.coalesce("_hi", "_fb").alias("envelope_upper"), (~enough).alias("fallback_used"))


def _at_each(vectors: Column, value: Callable[[Column], Column]) -> Column:
    """``value(i)`` of every coordinate i of a list of equally long vectors, as an array."""
    return F.transform(F.sequence(F.lit(0), F.size(F.get(vectors, F.lit(0))) - 1), value)


def _coordinate_medians(vectors: Column) -> Column:
    return _at_each(vectors, lambda i: array_median(F.array_compact(F.transform(vectors, lambda v: F.get(v, i)))))


def signature_representatives(members: DataFrame, keys: Sequence[str], vector: str = "forecast", *, step: float = 0.25) -> DataFrame:
    """Exact duplicates collapsed, then half-even signatures grouped; representative = coordinate median."""
    keys = list(keys)
    sig = members.select(*keys, vector).distinct().withColumn("signature", F.transform(vector, lambda v: F.bround(v / step).cast("bigint")))
    packed = sig.groupBy(*keys, "signature").agg(F.collect_list(vector).alias("_vs"))
    return packed.select(*keys, "signature", _coordinate_medians(F.col("_vs")).alias(vector))


def family_balanced_support(fits: DataFrame, keys: Sequence[str], vector: str = "forecast") -> DataFrame:
    """Support vectors with weight 1/families/signatures-in-family."""
    keys = list(keys)
    reps = signature_representatives(fits, [*keys, "model_id"], vector)
    per_family = F.count(F.lit(1)).over(Window.partitionBy(*keys, "model_id"))
    first = F.row_number().over(Window.partitionBy(*keys, "model_id").orderBy("signature"))
    staged = reps.withColumns({"_n": per_family, "_first": (first == 1).cast("int")})
    families = F.sum("_first").over(Window.partitionBy(*keys))
    return staged.withColumn("weight", 1.0 / (families * F.col("_n"))).drop("_n", "_first")


def weighted_quantiles(support: DataFrame, keys: Sequence[str], probabilities: dict[str, float], vector: str = "forecast", weight: str = "weight") -> DataFrame:
    """Inverted-CDF weighted quantile per coordinate: first value whose cumulative weight reaches p W."""
    keys, names = list(keys), list(probabilities)
    packed = support.groupBy(*keys).agg(F.collect_list(F.struct(F.col(vector).alias("v"), F.col(weight).cast("double").alias("w"))).alias("_s"))
    packed = packed.withColumn("_w", F.aggregate("_s", F.lit(0.0), lambda s, m: s + m["w"]))
    start = F.struct(F.lit(0.0).alias("c"), *[F.lit(None).cast("double").alias(n) for n in names])

    def step(found: Column, member: Column) -> Column:
        c = found["c"] + member["w"]
        # cumulative sums of equal shares meet p W exactly only up to rounding
        return F.struct(c.alias("c"), *[F.coalesce(found[n], F.when(c >= F.lit(p) * F.col("_w") - 1e-12, member["x"])).alias(n) for n, p in probabilities.items()])

    def quantiles(i: Column) -> Column:
        ordered = F.array_sort(F.transform("_s", lambda m: F.struct(F.get(m["v"], i).alias("x"), m["v"].alias("v"), m["w"].alias("w"))))
        return F.aggregate(ordered, start, step, lambda found: F.struct(*[F.coalesce(found[n], F.element_at(ordered, -1)["x"]).alias(n) for n in names]))

    each = _at_each(F.transform("_s", lambda m: m["v"]), quantiles)
    return packed.select(*keys, F.posexplode(each).alias("coordinate", "_q")).select(*keys, "coordinate", *[F.col("_q")[n].alias(n) for n in names])


def library_forecast(fits: DataFrame, keys: Sequence[str], baseline: DataFrame) -> DataFrame:
    """Family representatives (equal-weight inverted-CDF median of signatures), collapsed again by signature,
    median over the rest; below two families the square-root baseline. baseline: keys, sqrt_forecast."""
    keys = list(keys)
    fam_sigs = signature_representatives(fits, [*keys, "model_id"]).withColumn("weight", F.lit(1.0))
    fam = weighted_quantiles(fam_sigs, [*keys, "model_id"], {"_q": 0.5})
    vec = fam.groupBy(*keys, "model_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("coordinate", "_q"))), lambda s: s["_q"]).alias("forecast"))
    reps = signature_representatives(vec, keys)
    lib = reps.groupBy(*keys).agg(F.collect_list("forecast").alias("_vs")).select(*keys, _coordinate_medians(F.col("_vs")).alias("_lib"))
    n = vec.groupBy(*keys).agg(F.count(F.lit(1)).alias("families"))
    j = baseline.join(n, keys, "left").join(lib, keys, "left").withColumn("families", F.coalesce("families", F.lit(0)))
    enough = F.col("families") >= 2
    return j.select(*keys, "families", "sqrt_forecast", F.when(enough, F.col("_lib")).otherwise(F.col("sqrt_forecast")).alias("library_forecast"), enough.alias("hard_eligible"))


def blend_beta(library: DataFrame, truth: DataFrame, keys: Sequence[str], *, ridge: float = 0.01) -> DataFrame:
    """Single ridge blend coefficient in [0, 1] (one row). truth: keys, truth array."""
    j = library.join(truth, list(keys)).select(F.explode(F.arrays_zip("library_forecast", "sqrt_forecast", "truth")).alias("z")).select("z.*")
    x, y = F.col("library_forecast") - F.col("sqrt_forecast"), F.col("truth") - F.col("sqrt_forecast")
    agg = j.agg(F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"), F.count(F.lit(1)).alias("n_points"))
    beta = F.when(F.col("_xx") == 0, F.lit(0.0)).otherwise(clip(div("_xy", F.col("_xx") + ridge * F.col("n_points")), 0.0, 1.0))
    return agg.select("n_points", beta.alias("beta"))


def blended_center(library: DataFrame, beta: Column) -> DataFrame:
    return library.withColumn("center_forecast", F.zip_with("sqrt_forecast", "library_forecast", lambda s, lib: s + beta * (lib - s)))


def prefix_risk_features(fits: DataFrame, center: DataFrame, readings: DataFrame, leave_out: DataFrame, keys: Sequence[str], *, declared_families: int, year: float = 365.25) -> DataFrame:
    """Fourteen prefix-and-structure features per trajectory.

    center: sqrt_forecast, center_forecast; readings: arrays _t, _y (loss) of the prefix in time order (first, two middle
    and last readings are used for the slopes); leave_out: leave_last_out_error.
    """
    keys = list(keys)
    support = family_balanced_support(fits, keys)
    q = weighted_quantiles(support, keys, {"q10": 0.10, "q25": 0.25, "q75": 0.75, "q90": 0.90})
    width = F.col("q90") - F.col("q10")
    last = F.max("coordinate")
    spread = q.groupBy(*keys).agg(F.max_by(width, "coordinate").alias("width_end"), F.avg(F.col("q75") - F.col("q25")).alias("mean_iqr"), last.alias("_last"),
                                  F.max(F.when(F.col("coordinate") == 1, width)).alias("width_early"))
    counts = fits.groupBy(*keys).agg(F.countDistinct("model_id").alias("successful_families"), F.min("prefix_rmse_pp").alias("best_prefix_rmse"),
                                     F.avg(((F.col("c1") <= 0) & (F.col("c2") <= 0)).cast("double")).alias("boundary_hit_fraction"))
    shapes = signature_representatives(fits, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("effective_shapes"))
    n = F.size("_t")
    at = lambda a, i: F.element_at(a, i)
    mid, mid2 = F.ceil(n / 3).cast("int"), F.ceil(2 * n / 3).cast("int")
    slope = lambda i, j: div(at("_y", i) - at("_y", j), at("_t", j) - at("_t", i)) * year
    out = counts.join(spread, keys).join(shapes, keys).join(center, keys).join(readings, keys).join(leave_out, keys)
    return out.select(
        *keys, F.col("successful_families").cast("double").alias("successful_families"), (F.lit(declared_families) - F.col("successful_families")).cast("double").alias("failed_families"), "best_prefix_rmse",
        "width_end", "mean_iqr", F.col("effective_shapes").cast("double").alias("effective_shapes"), "boundary_hit_fraction", "leave_last_out_error",
        at("center_forecast", -1).alias("center_end"), (at("center_forecast", -1) - at("sqrt_forecast", -1)).alias("center_minus_sqrt_end"),
        (at("_y", -1) - at("_y", mid2)).alias("recent_loss"), (at("_y", mid) - at("_y", 1)).alias("early_loss"),
        (slope(mid, mid2) - slope(mid2, -1)).alias("slope_change"), F.greatest(F.col("width_end") - F.col("width_early"), F.lit(0.0)).alias("width_growth"))
