"""Per-trajectory feature extraction (survey rows D1-D15).

Prefix features first cut every trajectory at the observation cycle; cycle indices are unique, so a
group then holds at most that many rows and plain per-group windows are safe. Curve features work
on unbounded sample tables and use the two-level scans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlytics.functions.columns import div, finite_or_null, is_finite, ols
from trajlytics.plans.joins import checked_join
from trajlytics.plans.scan import integrated, null_safe_join, order_statistics, previous, running, value_bucket


def early_cycle_features(cycles: DataFrame, labels: DataFrame, *, observation_cycle: int = 100, minimum_cycles: int = 20) -> DataFrame:
    """One row per cell from its first ``observation_cycle`` cycles, joined one-to-one to labels."""
    key = ["dataset_id", "cell_id"]
    w = Window.partitionBy(*key).orderBy("cycle_index")
    seen = cycles.filter(F.col("cycle_index") <= observation_cycle).withColumns({
        "_d": F.col("discharge_capacity_ah") - F.lag("discharge_capacity_ah").over(w),
        "_pos": F.row_number().over(w),
    })
    x, cap, res = F.col("cycle_index"), F.col("discharge_capacity_ah"), F.col("internal_resistance_ohm")
    at = lambda c: F.max_by(cap, F.when(x <= c, x))
    feats = seen.groupBy(*key).agg(
        F.min_by("batch_id", x).alias("batch_id"), F.min_by("protocol_id", x).alias("protocol_id"),
        F.count(F.lit(1)).alias("observed_cycle_count"),
        F.median(F.when(F.col("_pos") <= 5, cap)).alias("capacity_initial_ah"),
        at(10).alias("capacity_cycle_10_ah"), at(50).alias("capacity_cycle_50_ah"),
        F.max_by(cap, x).alias("capacity_cycle_n_ah"),
        ols(x, cap)[0].alias("capacity_slope_ah_per_cycle"),
        F.log10(F.greatest(F.coalesce(F.var_samp("_d"), F.lit(0.0)), F.lit(1e-16))).alias("log10_capacity_diff_variance"),
        F.median(F.when((F.col("_pos") <= 5) & is_finite(res), res)).alias("resistance_initial_ohm"),
        ols(x, res)[0].alias("resistance_slope_ohm_per_cycle"),
        F.avg(finite_or_null("temperature_avg_c")).alias("temperature_avg_c"),
        F.max(finite_or_null("temperature_max_c")).alias("temperature_max_c"),
        F.avg(finite_or_null("charge_time_s")).alias("charge_time_avg_s"),
    ).filter(F.col("observed_cycle_count") >= minimum_cycles)
    feats = feats.withColumn("capacity_delta_10_to_n_ah", F.col("capacity_cycle_n_ah") - F.col("capacity_cycle_10_ah"))
    own = [c for c in labels.columns if c in key or c not in feats.columns]
    return checked_join(feats, labels.select(*own), key, validate="m:1", require_match=True)


def group_slope(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares slope over finite pairs; null below two distinct x."""
    ok = is_finite(x) & is_finite(y)
    return df.groupBy(*keys).agg(F.count(F.when(ok, 1)).alias("n_finite"), ols(F.col(x), F.col(y))[0].alias("slope"))


def resample_curves(
    curves: DataFrame, *, lo: float = 2.0, hi: float = 3.5, points: int = 1000, minimum_samples: int = 50,
    minimum_distinct: int = 2, keys: Sequence[str] = ("test_id", "cycle_number"),
) -> DataFrame:
    """Charge on a fixed voltage grid: median per equal voltage, coverage check, linear interpolation.

    Each segment between neighbouring voltages emits the grid points it covers, so the grid is
    never joined to the samples.
    """
    keys, step = list(keys), (hi - lo) / (points - 1)
    v, q = F.col("voltage_V"), F.col("coulomb_count_Ah")
    valid = curves.filter(is_finite(v) & is_finite(q) & v.between(lo - 0.02, hi + 0.10)).select(*keys, "voltage_V", "coulomb_count_Ah")
    medians = order_statistics(valid, [*keys, "voltage_V"], "coulomb_count_Ah", {"q": ("linear", 0.5)})
    usable = medians.groupBy(*keys).agg(
        F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_d"), F.min("voltage_V").alias("_v0"), F.max("voltage_V").alias("_v1")
    ).filter((F.col("_n") >= minimum_samples) & (F.col("_d") >= minimum_distinct) & (F.col("_v0") <= lo) & (F.col("_v1") >= hi)).select(*keys)
    segs = previous(medians.join(usable, keys, "left_semi"), keys, value_bucket("voltage_V", 4), ["voltage_V"], {"_pv": "voltage_V", "_pq": "q"})
    pos = lambda c: (c - lo) / step
    first_k = F.when(F.col("_pv").isNull(), F.ceil(pos(v) - 1e-9)).otherwise(F.floor(pos(F.col("_pv")) + 1e-9) + 1)
    last_k = F.floor(pos(v) + 1e-9)
    a, b = F.greatest(first_k, F.lit(0)), F.least(last_k, F.lit(points - 1))
    grid = segs.filter(a <= b).withColumn("k", F.explode(F.sequence(a, b)))
    at = F.lit(lo) + F.col("k") * F.lit(step)
    frac = F.coalesce(div(at - F.col("_pv"), v - F.col("_pv")), F.lit(1.0))
    value = F.coalesce(F.col("_pq") + frac * (F.col("q") - F.col("_pq")), F.col("q"))
    return grid.select(*keys, "k", at.alias("voltage_V"), value.alias("q"))


def delta_q_features(
    curves: DataFrame, *, early: int = 10, late: int = 100, lo: float = 2.0, hi: float = 3.5, points: int = 1000, **limits
) -> DataFrame:
    """Shape statistics of Q_late(V) - Q_early(V) per test; tests without both curves drop out."""
    wanted = curves.filter((F.col("step_type") == "discharge") & F.col("cycle_number").isin(early, late))
    grid = resample_curves(wanted, lo=lo, hi=hi, points=points, **limits)
    is_early = F.col("cycle_number") == early
    wide = grid.groupBy("test_id", "k").agg(
        F.max(F.when(is_early, F.col("q"))).alias("qe"), F.max(F.when(~is_early, F.col("q"))).alias("ql"),
    ).filter("qe is not null and ql is not null").withColumn("d", F.col("ql") - F.col("qe"))
    d, n = F.col("d"), F.count(F.lit(1)).cast("double")
    edge = F.sum(F.when(F.col("k").isin(0, points - 1), F.abs(d)).otherwise(0.0))
    step = (hi - lo) / (points - 1)
    var = F.var_pop(d)
    stats = wide.groupBy("test_id").agg(
        F.min(d).alias("delta_q_min_ah"), F.max(d).alias("delta_q_max_ah"), F.avg(d).alias("delta_q_mean_ah"),
        var.alias("delta_q_variance_ah2"), F.log10(F.greatest(var, F.lit(1e-16))).alias("log10_delta_q_variance"),
        (F.skewness(d) * F.sqrt(n * (n - 1)) / (n - 2)).alias("delta_q_skewness"),
        ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(d) + 6)).alias("delta_q_kurtosis"),
        (F.lit(step) * (F.sum(F.abs(d)) - 0.5 * edge)).alias("delta_q_abs_area_ah_v"),
        F.avg("qe").alias("q_early_mean_ah"), F.avg("ql").alias("q_late_mean_ah"),
    )
    temp = wanted.groupBy("test_id").agg(F.avg(finite_or_null("temperature_C")).alias("temperature_mean_c"))
    return stats.join(temp, "test_id")


def external_delta_q(curves: DataFrame, metadata: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Label-free variant: features plus every (test, issue) that breaks the strict test set."""
    early, late = kw.get("early", 10), kw.get("late", 100)
    wanted = curves.filter((F.col("step_type") == "discharge") & F.col("cycle_number").isin(early, late))
    have = wanted.groupBy("test_id").agg(F.countDistinct("cycle_number").alias("_c"))
    both = metadata.select("test_id").withColumn("_m", F.lit(1)).join(have, "test_id", "full_outer")
    issue = F.when(F.col("_m").isNull(), "unexpected_test").when(F.col("_c").isNull(), "missing_test").when(F.col("_c") < 2, "missing_cycle")
    feats = delta_q_features(curves, **kw)
    clean = both.filter(F.col("_m").isNotNull() & (F.col("_c") == 2)).select("test_id")
    failed = clean.join(feats.select("test_id"), "test_id", "left_anti").withColumn("issue", F.lit("insufficient_samples_or_coverage"))
    issues = both.select("test_id", issue.alias("issue")).filter("issue is not null").unionByName(failed)
    return feats.join(clean, "test_id", "left_semi"), issues


def integrate_curve(samples: DataFrame, keys: Sequence[str], bucket: str | Column) -> DataFrame:
    """Per sample: time step, charge and energy of the interval before it, and cumulative charge."""

    def steps(p: Column, r: Column) -> dict[str, Column]:
        hours = (r["timestamp_s"] - p["timestamp_s"]) / 3600.0
        i, pi = F.abs(r["current_A"]), F.abs(p["current_A"])
        return {
            "interval_ah": 0.5 * (i + pi) * hours,
            "interval_wh": 0.5 * (p["voltage_V"] * pi + r["voltage_V"] * i) * hours,
        }

    return integrated(
        samples, list(keys), bucket, ["timestamp_s"], ["timestamp_s", "current_A", "voltage_V"], steps, {"cumulative_ah": "interval_ah"}
    )


def curve_totals(integrated: DataFrame, keys: Sequence[str]) -> DataFrame:
    t = F.col("timestamp_s")
    return integrated.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), (F.max(t) - F.min(t)).alias("duration_s"),
        F.sum("interval_ah").alias("capacity_ah"), F.sum("interval_wh").alias("energy_wh"),
        (F.max("temperature_C") - F.min_by("temperature_C", t)).alias("temperature_rise_c"))


def first_downward_crossings(samples: DataFrame, keys: Sequence[str], bucket: str | Column, thresholds: Sequence[float]) -> DataFrame:
    """Elapsed time of the first sample at or below each threshold, linear between neighbours."""
    keys = list(keys)
    seg = previous(samples, keys, bucket, ["timestamp_s"], {"_pt": "timestamp_s", "_pv": "voltage_V"})
    start = samples.groupBy(*keys).agg(F.min("timestamp_s").alias("_t0"))
    hits = [
        F.min(F.when(F.col("voltage_V") <= thr, F.struct("timestamp_s", "_pt", "voltage_V", "_pv"))).alias(f"_h{i}")
        for i, thr in enumerate(thresholds)
    ]
    agg = seg.groupBy(*keys).agg(*hits)
    entries = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_h{i}").alias("h")) for i, t in enumerate(thresholds)])
    rows = agg.join(start, keys).select(*keys, "_t0", F.explode(entries).alias("e")).select(*keys, "_t0", "e.threshold", "e.h.*")
    drop = F.col("_pv") - F.col("voltage_V")
    frac = F.least(F.greatest(div(F.col("_pv") - F.col("threshold"), drop), F.lit(0.0)), F.lit(1.0))
    t = F.when(F.col("_pt").isNull() | (F.abs(drop) <= 1e-12), F.col("timestamp_s")).otherwise(
        F.col("_pt") + frac * (F.col("timestamp_s") - F.col("_pt")))
    return rows.select(*keys, "threshold", (t - F.col("_t0")).alias("crossing_s"),
                       F.when(F.col("timestamp_s").isNull(), "not_reached").otherwise("ok").alias("status"))


def voltage_at_charge(integrated: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Voltage at fixed cumulative charges and the mean dV/dQ between the first and last of them.

    The charge never falls along time, so the sample before the first one that reaches a point is the last one that does not."""
    keys, q = list(keys), F.col("cumulative_ah")
    rising = integrated.filter((F.col("interval_ah") > 1e-12) | (q == 0)).select(*keys, "timestamp_s", "voltage_V", "cumulative_ah")
    hits = []
    for i, p in enumerate(points):
        reached = q >= p - 1e-9
        hits += [F.min(F.when(reached, F.struct("cumulative_ah", "timestamp_s", "voltage_V"))).alias(f"_h{i}"),
                 F.max(F.when(~reached, F.struct("timestamp_s", "cumulative_ah", "voltage_V"))).alias(f"_p{i}")]
    agg = rising.groupBy(*keys).agg(*hits)

    def at(i: int, p: float) -> Column:
        h, prior = F.col(f"_h{i}"), F.col(f"_p{i}")
        frac = F.least(F.coalesce(div(F.lit(p) - prior["cumulative_ah"], h["cumulative_ah"] - prior["cumulative_ah"]), F.lit(1.0)), F.lit(1.0))
        return F.when(h.isNotNull(), F.coalesce(prior["voltage_V"] + frac * (h["voltage_V"] - prior["voltage_V"]), h["voltage_V"]))

    cols = [at(i, p).alias(f"voltage_at_{i}") for i, p in enumerate(points)]
    slope = (F.col(f"voltage_at_{len(points) - 1}") - F.col("voltage_at_0")) / (points[-1] - points[0])
    return agg.select(*keys, *cols).withColumn("mean_dv_dq", slope)


def _normalization(cycles: DataFrame, keys: list[str], initial: int) -> DataFrame:
    first = F.col("cycle_index").between(1, initial)
    return cycles.groupBy(*keys).agg(
        F.median(F.when(first, F.col("discharge_capacity_ah"))).alias("normalization_ah"), F.count(F.when(first, 1)).alias("n_initial"), F.count(F.lit(1)).alias("n_rows"))


def with_retention(cycles: DataFrame, keys: Sequence[str] = ("cell_id",), *, initial: int = 5) -> DataFrame:
    """Retention in percent of the median capacity of cycles 1..5. A null cell is a cell; cells without all five cycles or
    with a median that is not positive have no retention and are listed by `retention_issues`."""
    keys = list(keys)
    base = _normalization(cycles, keys, initial).filter((F.col("n_initial") == initial) & (F.col("normalization_ah") > 0)).select(*keys, "normalization_ah")
    return null_safe_join(cycles, base, keys).withColumn("retention", 100.0 * F.col("discharge_capacity_ah") / F.col("normalization_ah"))


def normalised_fits(prefix: DataFrame, keys: Sequence[str] = ("cell_id",), *, initial: int = 5) -> DataFrame:
    """Normalisation of `with_retention` with the last value and the non-positive linear fit of the retention of a prefix."""
    keys, x, q = list(keys), F.col("cycle_index").cast("double"), F.col("discharge_capacity_ah")
    first, m = F.col("cycle_index").between(1, initial), F.col("normalization_ah")
    agg = prefix.groupBy(*keys).agg(
        F.median(F.when(first, q)).alias("normalization_ah"), F.count(F.when(first, 1)).alias("_n"),
        F.max_by(q, x).alias("_last"), F.regr_slope(q, x).alias("_b"), F.avg(q).alias("_q"), F.avg(x).alias("_x"))
    scaled = agg.filter((F.col("_n") == initial) & (m > 0)).withColumn("slope", F.least(100.0 * F.col("_b") / m, F.lit(0.0)))
    return scaled.select(*keys, "normalization_ah", (100.0 * F.col("_last") / m).alias("last_value"), "slope",
                         (100.0 * F.col("_q") / m - F.col("slope") * F.col("_x")).alias("intercept"))


def retention_issues(cycles: DataFrame, keys: Sequence[str] = ("cell_id",), *, initial: int = 5) -> DataFrame:
    """Cells that `with_retention` leaves out: their rows, initial cycles and the reason."""
    issue = F.when(F.col("n_initial") != initial, "initial_cycles_incomplete").when(~(F.col("normalization_ah") > 0) | F.col("normalization_ah").isNull(), "normalization_not_positive")
    return _normalization(cycles, list(keys), initial).select(*keys, "n_rows", "n_initial", issue.alias("issue")).filter("issue is not null")


def eol_labels(cycles: DataFrame, *, nominal_ah: float, fraction: float, keys: Sequence[str] = ("dataset_id", "cell_id")) -> DataFrame:
    """First cycle at or below the end-of-life capacity, else censored at the last cycle."""
    hit = F.min(F.when(F.col("discharge_capacity_ah") <= nominal_ah * fraction, F.col("cycle_index")))
    agg = cycles.groupBy(*keys).agg(hit.alias("_hit"), F.max("cycle_index").alias("last_observed_cycle"))
    return agg.select(*keys, F.coalesce("_hit", "last_observed_cycle").alias("cycle_life"),
                      F.col("_hit").isNotNull().alias("event_observed"), F.col("_hit").isNull().alias("is_censored"), "last_observed_cycle")


def theil_sen(prefix: DataFrame, keys: Sequence[str], x: str, y: str, window: int) -> DataFrame:
    """Median pairwise slope (capped at zero) and median intercept of the last ``window`` points.

    The window is a fixed small number of points per trajectory; pairs are formed inside one array
    of at most that length, never as rows.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col(x).desc())
    recent = prefix.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= window)
    packed = recent.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).alias("y")))).alias("_p"))
    slopes = F.flatten(F.transform("_p", lambda a: F.transform(
        F.filter("_p", lambda b: b.x > a.x), lambda b: (b.y - a.y) / (b.x - a.x))))
    out = packed.withColumn("raw_slope", array_median(slopes)).withColumn("slope", F.least("raw_slope", F.lit(0.0)))
    return out.withColumn("intercept", array_median(F.transform("_p", lambda a: a.y - F.col("slope") * a.x))).drop("_p")


def array_median(arr: Column) -> Column:
    s = F.array_sort(arr)
    n = F.size(s)
    lo, hi = F.element_at(s, F.floor((n + 1) / 2).cast("int")), F.element_at(s, F.ceil((n + 1) / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2.0)


def capacity_signature(prefix: DataFrame, keys: Sequence[str], *, window: int = 20, floors: tuple[float, float] = (1e-6, 1e-3)) -> DataFrame:
    """Capacity-trend signature of a prefix with ``retention``: slopes, disagreement, residual spread,
    recovery share and the slopes of log resistance, temperature, log duration and efficiency."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("cycle_index")
    whole = Window.partitionBy(*keys)
    x, y = F.col("cycle_index").cast("double"), F.col("retention")
    staged = prefix.withColumns({
        "_dr": y - F.lag("retention").over(w),
        "_rank": F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("cycle_index").desc())),
        "_a": F.regr_intercept(y, x).over(whole), "_b": F.regr_slope(y, x).over(whole),
    })
    log_res = F.ln(F.greatest("internal_resistance_ohm", F.lit(floors[0])))
    log_dur = F.ln(F.greatest("charge_time_s", F.lit(floors[1])))
    recent = F.col("_rank") <= window
    resid = y - (F.col("_a") + F.col("_b") * x)
    return staged.groupBy(*keys).agg(
        F.max("_b").alias("capacity_full_slope"),
        F.regr_slope(F.when(recent, y), F.when(recent, x)).alias("capacity_recent_slope"),
        F.sqrt(F.avg(resid * resid)).alias("capacity_residual_std"),
        F.avg(F.when(F.col("_dr").isNotNull(), (F.col("_dr") > 0.1).cast("double"))).alias("capacity_recovery_fraction"),
        F.regr_slope(log_res, x).alias("log_resistance_slope"),
        F.regr_slope(F.col("temperature_max_c"), x).alias("temperature_max_slope"),
        F.regr_slope(log_dur, x).alias("log_duration_slope"),
        F.regr_slope(F.col("energy_efficiency"), x).alias("efficiency_slope"),
    ).withColumn("capacity_slope_disagreement", F.abs(F.col("capacity_full_slope") - F.col("capacity_recent_slope")))


def curve_signature(prefix: DataFrame, keys: Sequence[str], *, window: int = 12) -> DataFrame:
    """Curve-aware signature: robust recent slope, voltage-window, voltage-at-charge and temperature slopes."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("cycle_index")
    whole = Window.partitionBy(*keys)
    x, y = F.col("cycle_index").cast("double"), F.col("retention")
    staged = prefix.withColumns({
        "_dr": y - F.lag("retention").over(w), "_pos": F.row_number().over(w),
        "_a": F.regr_intercept(y, x).over(whole), "_b": F.regr_slope(y, x).over(whole),
    }).withColumn("_w0", F.median(F.when(F.col("_pos") <= 5, F.col("voltage_window_s"))).over(whole))
    resid = y - (F.col("_a") + F.col("_b") * x)
    agg = staged.groupBy(*keys).agg(
        F.max("_b").alias("capacity_full_slope"),
        F.sqrt(F.avg(resid * resid)).alias("capacity_residual_std"),
        F.coalesce(F.avg(F.when(F.col("_dr").isNotNull(), (F.col("_dr") > 0.1).cast("double"))), F.lit(0.0)).alias("capacity_recovery_fraction"),
        F.regr_slope(100.0 * F.col("voltage_window_s") / F.col("_w0"), x).alias("voltage_window_slope"),
        F.regr_slope(1000.0 * F.col("voltage_at_1ah"), x).alias("voltage_at_1ah_slope_mv"),
        F.regr_slope(F.col("temperature_rise_c"), x).alias("temperature_rise_slope"),
        F.min_by("cutoff_voltage_v", x).alias("cutoff_voltage_v"),
    )
    recent = theil_sen(prefix, keys, "cycle_index", "retention", window).select(*keys, F.col("slope").alias("capacity_recent_slope"))
    return agg.join(recent, keys).withColumn(
        "capacity_slope_disagreement", F.abs(F.col("capacity_full_slope") - F.col("capacity_recent_slope")))


def stress_features(temperature_c: str | Column, soc: str | Column) -> dict[str, Column]:
    """Inverse-temperature (1000/K against 25 degC), centred SOC, its square and the interaction."""
    t = (F.col(temperature_c) if isinstance(temperature_c, str) else temperature_c) + 273.15
    s = (F.col(soc) if isinstance(soc, str) else soc) - 0.5
    inv = 1000.0 * (1.0 / F.lit(298.15) - 1.0 / t)
    return {"x0": F.lit(1.0), "x1": inv, "x2": s, "x3": s * s, "x4": inv * s}


def leave_last_out_sqrt_error(df: DataFrame, keys: Sequence[str], *, fit_until: float, score_at: float, year: float = 365.25, cap: float = 5.0) -> DataFrame:
    """Fit a bounded square-root loss up to ``fit_until`` days, error at the ``score_at`` reading."""
    x, y = F.sqrt(F.col("elapsed_days") / year), 100.0 - F.col("capacity_retention_pct")
    fit = F.col("elapsed_days") <= fit_until
    agg = df.groupBy(*keys).agg(
        F.sum(F.when(fit, x * y)).alias("_xy"), F.sum(F.when(fit, x * x)).alias("_xx"),
        F.max(F.when(F.col("elapsed_days") == score_at, F.col("capacity_retention_pct"))).alias("_target"))
    k = F.least(F.greatest(F.coalesce(div("_xy", "_xx"), F.lit(0.0)), F.lit(0.0)), F.lit(cap))
    return agg.select(*keys, F.abs(100.0 - k * F.sqrt(F.lit(score_at / year)) - F.col("_target")).alias("leave_last_out_error"))

