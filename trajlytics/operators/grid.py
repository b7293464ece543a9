"""Separable least-squares fits on declared grids (survey rows E8, E10, E11, T12).

The nonlinear parameter runs over a short literal grid and the linear coefficients are closed form, so
one aggregate pass fits every trajectory at every grid point; partial sums combine before the shuffle.
The loss is squared error, or soft-L1 by reweighted rounds (`robust_power_law`). A refine round repeats the pass on a finer grid around each best point.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.functions.columns import clip, div
from trajlytics.operators.closed_form import nnls2
from trajlytics.plans.scan import null_safe_join
from trajlytics.session import cut_lineage

_T, _Y = "elapsed_days", "capacity_loss_pct"
EXPONENTS = [round(0.05 * i, 2) for i in range(1, 31)]


def _power_pass(rows: DataFrame, keys: Sequence[str], b: Column) -> DataFrame:
    t, y = F.col(_T), F.col(_Y)
    basis = F.pow(t, F.col("_b"))
    sums = rows.withColumn("_b", b).withColumn("_f", basis).groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("_f") * y).alias("_fy"), F.sum(F.col("_f") * F.col("_f")).alias("_ff"), F.sum(y * y).alias("_yy"))
    amp = F.greatest(div("_fy", "_ff"), F.exp(F.lit(-12.0)))
    sse = F.col("_yy") - 2 * amp * F.col("_fy") + amp * amp * F.col("_ff")
    return sums.withColumns({"_a": amp, "_sse": sse}).groupBy(*keys).agg(F.min(F.struct("_sse", "_b", "_a", "_n")).alias("m")).select(*keys, "m.*")


def power_law(df: DataFrame, keys: Sequence[str], *, exponents: Sequence[float] = tuple(EXPONENTS), refine: int = 10) -> DataFrame:
    """loss = exp(log_amplitude) t**exponent per key."""
    keys = list(keys)
    pos = df.filter(F.col(_T) > 0).select(*keys, _T, _Y)
    best = _power_pass(pos, keys, F.explode(F.array(*[F.lit(float(b)) for b in exponents])))
    if refine:
        step = (exponents[1] - exponents[0]) / refine
        offsets = F.array(*[F.lit(i * step) for i in range(-refine, refine + 1)])
        near = null_safe_join(pos, best.select(*keys, F.col("_b").alias("_c")), keys)
        best = _power_pass(near, keys, F.explode(F.filter(F.transform(offsets, lambda o: F.round(F.col("_c") + o, 6)), lambda v: (v >= exponents[0]) & (v <= exponents[-1]))))
    return best.select(*keys, F.ln("_a").alias("log_amplitude"), F.col("_b").alias("exponent"), F.col("_sse").alias("sse"), F.col("_n").alias("n_points"))


def box2(s11: Column, s12: Column, s22: Column, s1y: Column, s2y: Column, cap: float) -> Column:
    """Least squares in (x1 >= 0, 0 <= x2 <= cap): struct(gain, x1, x2) of the best candidate face."""
    def q(a: Column, b: Column) -> Column:
        return a * a * s11 + 2 * a * b * s12 + b * b * s22 - 2 * a * s1y - 2 * b * s2y

    det = s11 * s22 - s12 * s12
    a, b = div(s1y * s22 - s2y * s12, det), div(s2y * s11 - s1y * s12, det)
    inside = (det > F.lit(1e-12) * s11 * s22) & (a >= 0) & (b >= 0) & (b <= cap)
    at0, zero = F.greatest(F.coalesce(div(s1y, s11), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)
    atc = F.greatest(F.coalesce(div(s1y - s12 * cap, s11), F.lit(0.0)), F.lit(0.0))
    only2 = F.least(F.greatest(F.coalesce(div(s2y, s22), F.lit(0.0)), F.lit(0.0)), F.lit(float(cap)))
    cand = [F.struct(q(x, y).alias("q"), x.alias("x1"), y.alias("x2")) for x, y in [(at0, zero), (atc, F.lit(float(cap))), (zero, only2)]]
    joint = F.when(inside, F.struct(q(a, b).alias("q"), a.alias("x1"), b.alias("x2")))
    return F.coalesce(joint, F.array_min(F.array(*cand)))


def activation_power_law(df: DataFrame, keys: Sequence[str], *, timescales: Sequence[float] = (7.0,), exponents: Sequence[float] = tuple(EXPONENTS), cap: float = 10.0) -> DataFrame:
    """loss = A t**b - O (1 - exp(-t / tau)), A >= 0, 0 <= O <= cap; one row per key and timescale."""
    keys = list(keys)
    grid = F.array(*[F.struct(F.lit(float(tau)).alias("tau"), F.lit(float(b)).alias("b")) for tau in timescales for b in exponents])
    t, y = F.col(_T), F.col(_Y)
    rows = df.filter(t > 0).select(*keys, _T, _Y, F.explode(grid).alias("g")).withColumns({"_f": F.pow(t, F.col("g.b")), "_h": F.exp(-t / F.col("g.tau")) - 1.0})
    f, h = F.col("_f"), F.col("_h")
    sums = rows.groupBy(*keys, F.col("g.tau").alias("timescale"), F.col("g.b").alias("_b")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(f * f).alias("_11"), F.sum(f * h).alias("_12"), F.sum(h * h).alias("_22"), F.sum(f * y).alias("_1y"), F.sum(h * y).alias("_2y"), F.sum(y * y).alias("_yy"))
    fit = sums.withColumn("_s", box2(*[F.col(c) for c in ["_11", "_12", "_22", "_1y", "_2y"]], cap))
    best = fit.groupBy(*keys, "timescale").agg(F.min(F.struct((F.col("_yy") + F.col("_s.q")).alias("sse"), F.col("_b").alias("exponent"), F.col("_s.x1").alias("amplitude"), F.col("_s.x2").alias("offset_pp"), F.col("_n").alias("n_points"))).alias("m"))
    return best.select(*keys, "timescale", F.ln(F.greatest("m.amplitude", F.exp(F.lit(-12.0)))).alias("log_amplitude"), "m.exponent", "m.offset_pp", "m.sse", "m.n_points")


def activation_loss(days: Column, log_amplitude: Column, exponent: Column, offset: Column, timescale: Column) -> Column:
    return F.exp(log_amplitude) * F.pow(days, exponent) - offset * (1.0 - F.exp(-days / timescale))


# The structure registry. (model, variant, p1, p2, p3); knee variants form a prior grid
# and stay separate, the other nonlinear families keep their best grid point.
def structure_grid() -> list[tuple[str, str, float, float, float]]:
    out = [("power", f"b={b:g}", b, 0.0, 0.0) for b in (0.2, 0.35, 0.5, 0.65, 0.8, 1.0, 1.2)]
    out += [("saturating", f"tau={v:g}", v, 0.0, 0.0) for v in (1.0, 2.0, 4.0, 8.0, 16.0)]
    out += [("dual_power", f"p={p:g}|q={q:g}", p, q, 0.0) for p in (0.3, 0.5) for q in (0.9, 1.2, 1.5)]
    out += [("late_knee", f"k={k:g}|t={t:g}|w={w:g}", k, t, w) for k in (0.02, 0.05, 0.1) for t in (10.0, 15.0, 20.0) for w in (1.0, 3.0)]
    return out


def pack_prefix(prefix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prefix points as two aligned arrays; a prefix is at most the landmark's number of points."""
    packed = prefix.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(_T).alias("t"), F.col(_Y).alias("y")))).alias("_p"))
    return packed.select(*keys, F.transform("_p", lambda p: p["t"]).alias("_t"), F.transform("_p", lambda p: p["y"]).alias("_y"))


#: Trajectories of one partition while each is fitted under every structure, which turns one short row into dozens.
LIBRARY_KEYS = 512


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Written rows, those of about LIBRARY_KEYS keys to a partition: sizes in bytes do not tell how many rows they become."""
    n = df.select(*keys).distinct().count()
    return df.repartition(max(1, math.ceil(n / LIBRARY_KEYS)), *keys)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _bases(model: Column, p1: Column, p2: Column, p3: Column, t: Column) -> tuple[Column, Column, Column]:
    """(first basis, second basis, fixed offset) of a structure at time t."""
    z = (t - p2) / F.when(p3 > 0, p3).otherwise(F.lit(1.0))
    soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    f1 = F.when(model == "late_knee", F.sqrt(t)).when(model == "saturating", 1.0 - F.exp(-t / p1)).otherwise(F.pow(t, p1))
    f2 = F.when(model == "saturating", t).when(model == "dual_power", F.pow(t, p2)).otherwise(F.lit(0.0))
    return f1, f2, F.when(model == "late_knee", p1 * p3 * soft).otherwise(F.lit(0.0))


def structure_library(prefix: DataFrame, keys: Sequence[str], forecast_days: Sequence[float], *, grid: Sequence[tuple] | None = None) -> DataFrame:
    """Every structure fitted to every prefix: RMSE, largest residual and the forecast array.

    After the prefix points are packed and dealt out by their number each (trajectory, grid point) is a row-local
    computation; only the choice of the best grid point per family groups again.
    """
    keys = list(keys)
    entries = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(v).alias("v"), F.lit(float(a)).alias("p1"), F.lit(float(b)).alias("p2"), F.lit(float(c)).alias("p3")) for m, v, a, b, c in (grid or structure_grid())])
    packed = dealt(cut_lineage(pack_prefix(prefix, keys)), keys)
    rows = packed.select(*keys, "_t", "_y", F.explode(entries).alias("g")).select("*", F.col("g.m").alias("model_id"), F.col("g.v").alias("variant_id"), "g.p1", "g.p2", "g.p3").drop("g")
    at = lambda i: (lambda t: _bases(F.col("model_id"), F.col("p1"), F.col("p2"), F.col("p3"), t)[i])
    rows = rows.withColumns({"_f": F.transform("_t", at(0)), "_h": F.transform("_t", at(1)), "_o": F.transform("_t", at(2))})
    rows = rows.withColumn("_r", F.zip_with("_y", "_o", lambda y, o: y - o))
    rows = rows.withColumns({"_11": _dot("_f", "_f"), "_12": _dot("_f", "_h"), "_22": _dot("_h", "_h"), "_1y": _dot("_f", "_r"), "_2y": _dot("_h", "_r")})
    c1, c2 = nnls2(*[F.col(c) for c in ["_11", "_12", "_22", "_1y", "_2y"]])
    rows = rows.withColumns({"c1": c1, "c2": c2})
    resid = F.zip_with(F.zip_with("_f", "_h", lambda a, b: F.col("c1") * a + F.col("c2") * b), "_r", lambda p, y: p - y)
    rows = rows.withColumn("_e", resid)
    days = F.array(*[F.lit(float(d)) for d in forecast_days])
    loss = lambda d: F.col("c1") * at(0)(d) + F.col("c2") * at(1)(d) + at(2)(d)
    fit = rows.select(
        *keys, "model_id", "variant_id", "c1", "c2", F.sqrt(_dot("_e", "_e") / F.size("_e")).alias("prefix_rmse_pp"), F.array_max(F.transform("_e", lambda v: F.abs(v))).alias("max_abs_residual_pp"),
        F.transform(days, lambda d: 100.0 - loss(d)).alias("forecast"), F.when(F.col("model_id") == "late_knee", F.col("variant_id")).otherwise(F.lit("best")).alias("_slot"))
    rest = [c for c in fit.columns if c not in (*keys, "model_id", "_slot")]
    # errors equal to nine decimals are ties, decided by the variant name
    best = fit.groupBy(*keys, "model_id", "_slot").agg(F.min(F.struct(F.round("prefix_rmse_pp", 9), "variant_id", "prefix_rmse_pp", *[c for c in rest if c not in ("prefix_rmse_pp", "variant_id")])).alias("m"))
    simple = _simple_members(packed, keys, forecast_days)
    return best.select(*keys, "model_id", *[F.col(f"m.{c}").alias(c) for c in rest]).unionByName(simple)


def _simple_members(packed: DataFrame, keys: list[str], forecast_days: Sequence[float]) -> DataFrame:
    """Persistence and bounded square-root members in the same shape."""
    days = F.array(*[F.lit(float(d)) for d in forecast_days])
    packed = packed.withColumn("_sq", F.transform("_t", lambda t: F.sqrt(t)))
    packed = packed.withColumns({"_last": F.element_at("_y", -1), "_k": clip(F.coalesce(div(_dot("_sq", "_y"), _dot("_sq", "_sq")), F.lit(0.0)), 0.0, 5.0)})
    members = F.array(
        F.struct(F.lit("persistence").alias("m"), F.col("_last").alias("c"), F.transform("_t", lambda t: F.col("_last")).alias("p"), F.transform(days, lambda d: 100.0 - F.col("_last")).alias("f")),
        F.struct(F.lit("sqrt_time").alias("m"), F.col("_k").alias("c"), F.transform("_sq", lambda q: F.col("_k") * q).alias("p"), F.transform(days, lambda d: 100.0 - F.col("_k") * F.sqrt(d)).alias("f")))
    rows = packed.select(*keys, "_y", F.explode(members).alias("s")).withColumn("_e", F.zip_with("s.p", "_y", lambda p, y: p - y))
    return rows.select(*keys, F.col("s.m").alias("model_id"), F.lit("best").alias("variant_id"), F.col("s.c").alias("c1"), F.lit(0.0).alias("c2"),
                       F.sqrt(_dot("_e", "_e") / F.size("_e")).alias("prefix_rmse_pp"), F.array_max(F.transform("_e", lambda v: F.abs(v))).alias("max_abs_residual_pp"), F.col("s.f").alias("forecast"))


#: Soft-L1 loss: scale in percentage points, rounds at most, and the relative change at which a fit is settled.
ROBUST_SCALE, ROBUST_ROUNDS, SETTLED = 0.25, 40, 1e-7


def _reweighted(rows: DataFrame, keys: list[str], state: DataFrame, grid: list[str], scale: float | None) -> DataFrame:
    """Weighted sums of every (key, grid point) under the residuals of its state (c1, c2), and the cost of that state.

    A row weighs 1 / sqrt(1 + (residual / scale)^2), so far points pull as under an absolute loss; without a scale all weigh one."""
    f, h, y = F.col("_f"), F.col("_h"), F.col(_Y)
    r = F.col("c1") * f + F.col("c2") * h - y
    z = (r / F.lit(scale)) * (r / F.lit(scale)) if scale else F.lit(0.0)
    w = 1.0 / F.sqrt(1.0 + z)
    cost = F.lit(scale * scale) * (F.sqrt(1.0 + z) - 1.0) if scale else r * r / 2.0
    met = null_safe_join(rows, state, keys).withColumns({"_f": F.pow(F.col(_T), F.col("_b")), "_h": F.exp(-F.col(_T) / F.col("_tau")) - 1.0})
    sums = {"_11": w * f * f, "_12": w * f * h, "_22": w * h * h, "_1y": w * f * y, "_2y": w * h * y, "_cost": cost}
    return met.groupBy(*keys, *grid, "c1", "c2").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(n) for n, v in sums.items()])


def _robust_grid(rows: DataFrame, keys: list[str], points: DataFrame, cap: float, scale: float, rounds: int, settled: float | None) -> DataFrame:
    """Iteratively reweighted fit of every (key, grid point) of `points`; the best point of each key and timescale.

    A round is one aggregate over the rows, which meet the short state of their key; states are written, so the plan of a round
    does not hold the rounds before it. Rounds end when no coefficient of any point moves by more than `settled`."""
    grid = ["_tau", "_b"]
    state = points.withColumns({"c1": F.lit(0.0), "c2": F.lit(0.0)})
    moved = F.lit(True)
    for k in range(rounds + 1):
        sums = _reweighted(rows, keys, state, grid, scale if k else None)
        best = box2(*[F.col(c) for c in ("_11", "_12", "_22", "_1y", "_2y")], cap)
        x1 = F.greatest(F.least(F.col("_s.x1"), F.exp(F.lit(5.0))), F.exp(F.lit(-12.0)))
        step = F.greatest(F.abs(x1 - F.col("c1")) / (F.abs(x1) + 1e-3), F.abs(F.col("_s.x2") - F.col("c2")))
        state = cut_lineage(sums.withColumn("_s", best).select(*keys, *grid, x1.alias("_x1"), F.col("_s.x2").alias("_x2"), step.alias("_step"))
                            .withColumnsRenamed({"_x1": "c1", "_x2": "c2"}))
        if settled is not None and k and not state.where(F.col("_step") > settled).limit(1).count():
            break
        moved = F.col("_step") > (SETTLED if settled is None else settled)
    final = null_safe_join(_reweighted(rows, keys, state.drop("_step"), grid, scale), state.select(*keys, *grid, "_step"), [*keys, *grid])
    fit = F.struct(F.col("_cost").alias("cost"), F.col("_b").alias("exponent"), F.col("c1").alias("amplitude"), F.col("c2").alias("offset_pp"), F.col("_n").alias("n_points"), (~moved).alias("converged"))
    return final.groupBy(*keys, "_tau").agg(F.min(fit).alias("m")).select(*keys, "_tau", "m.*")


def robust_power_law(
    df: DataFrame, keys: Sequence[str], *, timescales: Sequence[float] | None = None, exponents: Sequence[float] = tuple(EXPONENTS), refine: int = 10, cap: float = 10.0,
    scale: float = ROBUST_SCALE, rounds: int = ROBUST_ROUNDS, settled: float | None = SETTLED,
) -> DataFrame:
    """loss = exp(log_amplitude) t**exponent under a soft-L1 loss; with timescales also less offset_pp (1 - exp(-t / timescale)),
    one row per key and timescale.

    Outliers of a few points move the fit little, unlike in `power_law`. `cost` is the sum of scale^2 (sqrt(1 + (r / scale)^2) - 1),
    `converged` tells whether the last round moved the best point by no more than `settled` (None: all rounds are run). Null keys
    are one key; keys without a positive time have no row, as nothing can be fitted to them.
    """
    keys = list(keys)
    rows = cut_lineage(df.filter((F.col(_T) > 0) & F.col(_Y).isNotNull()).select(*keys, _T, _Y))
    taus = [float(t) for t in timescales] if timescales else [1.0]
    bound = cap if timescales else 0.0
    coarse = rows.select(*keys).distinct().withColumn("_tau", F.explode(F.lit(taus))).withColumn("_b", F.explode(F.lit([float(b) for b in exponents])))
    best = _robust_grid(rows, keys, coarse, bound, scale, rounds, settled)
    if refine:
        step = (exponents[1] - exponents[0]) / refine
        near = F.transform(F.lit([float(i * step) for i in range(-refine, refine + 1)]), lambda o: F.round(F.col("exponent") + o, 6))
        fine = best.select(*keys, "_tau", F.explode(F.filter(near, lambda v: (v >= exponents[0]) & (v <= exponents[-1]))).alias("_b"))
        best = _robust_grid(rows, keys, fine, bound, scale, rounds, settled)
    named = best.withColumnRenamed("_tau", "timescale").withColumn("log_amplitude", F.ln("amplitude"))
    extra = ["timescale", "offset_pp"] if timescales else []
    return named.select(*keys, *extra, "log_amplitude", "exponent", "cost", "n_points", "converged")
