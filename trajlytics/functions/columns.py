"""Column expressions shared by all operators (JVM side, codegen friendly)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """True only for a non-null, non-NaN, non-infinite number."""
    d = col(c).cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def finite_or_null(c: str | Column) -> Column:
    return F.when(is_finite(c), col(c).cast("double"))


def div(a: str | Column, b: str | Column) -> Column:
    """Division that yields null for a zero denominator."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b != 0, a / b)


def clip(c: str | Column, lo: float | Column | None, hi: float | Column | None) -> Column:
    out = col(c)
    if lo is not None:
        out = F.when(out < lo, F.lit(lo) if not isinstance(lo, Column) else lo).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(hi) if not isinstance(hi, Column) else hi).otherwise(out)
    return out


def violations(condition: Column) -> Column:
    """Aggregate: number of rows on which ``condition`` holds."""
    return F.coalesce(F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def hash_text(*parts: str | int | Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def hash_draw(n: Column, *parts: str | int | Column) -> Column:
    """Uniform draw in [0, n) keyed by its parts only; the same on every run and cluster."""
    digits = F.conv(F.substring(hash_text(*parts), 1, 13), 16, 10).cast("bigint")
    return F.pmod(digits, n.cast("bigint"))


def ols(x: Column, y: Column) -> tuple[Column, Column]:
    """(slope, intercept) aggregates over pairs of finite values, null below two distinct x."""
    ok = is_finite(x) & is_finite(y)
    xs, ys = F.when(ok, x.cast("double")), F.when(ok, y.cast("double"))
    return F.regr_slope(ys, xs), F.regr_intercept(ys, xs)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


# Coefficients of the rational approximations of erf/erfc by W. J. Cody (1969).
_ERF_SMALL_P = [3.20937758913846947e03, 3.77485237685302021e02, 1.13864154151050156e02,
                3.16112374387056560e00, 1.85777706184603153e-1]
_ERF_SMALL_Q = [2.84423683343917062e03, 1.28261652607737228e03, 2.44024637934444173e02,
                2.36012909523441209e01, 1.0]
_ERFC_MID_P = [1.23033935479799725e03, 2.05107837782607147e03, 1.71204761263407058e03,
               8.81952221241769090e02, 2.98635138197400131e02, 6.61191906371416295e01,
               8.88314979438837594e00, 5.64188496988670089e-1, 2.15311535474403846e-8]
_ERFC_MID_Q = [1.23033935480374942e03, 3.43936767414372164e03, 4.36261909014324716e03,
               3.29079923573345963e03, 1.62138957456669019e03, 5.37181101862009858e02,
               1.17693950891312499e02, 1.57449261107098347e01, 1.0]
_ERFC_BIG_P = [-6.58749161529837803e-4, -1.60837851487422766e-2, -1.25781726111229246e-1,
               -3.60344899949804439e-1, -3.05326634961232344e-1, -1.63153871373020978e-2]
_ERFC_BIG_Q = [2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1,
               1.87295284992346047e00, 2.56852019228982242e00, 1.0]


def _poly(x: Column, coeffs: list[float]) -> Column:
    out = F.lit(coeffs[-1])
    for c in reversed(coeffs[:-1]):
        out = out * x + F.lit(c)
    return out


def erfc(x: Column) -> Column:
    """Complementary error function to double precision."""
    a = F.abs(x)
    small = 1.0 - x * _poly(x * x, _ERF_SMALL_P) / _poly(x * x, _ERF_SMALL_Q)
    mid = F.exp(-a * a) * _poly(a, _ERFC_MID_P) / _poly(a, _ERFC_MID_Q)
    inv = 1.0 / F.greatest(a * a, F.lit(1e-300))
    big = (F.exp(-a * a) / F.greatest(a, F.lit(1e-300))) * (
        F.lit(0.56418958354775628695) + inv * _poly(inv, _ERFC_BIG_P) / _poly(inv, _ERFC_BIG_Q)
    )
    tail = F.when(a <= 4.0, mid).otherwise(big)
    return F.when(a <= 0.46875, small).when(x < 0, 2.0 - tail).otherwise(tail)


def normal_cdf(z: Column) -> Column:
    return 0.5 * erfc(-z / F.sqrt(F.lit(2.0)))


def normal_log_sf(z: Column) -> Column:
    """log(1 - Phi(z)), stable in the far right tail through its asymptotic series."""
    direct = F.ln(F.greatest(0.5 * erfc(z / F.sqrt(F.lit(2.0))), F.lit(1e-300)))
    z2 = z * z
    safe = F.greatest(z, F.lit(1.0))
    i2 = 1.0 / F.greatest(z2, F.lit(1.0))
    series = -0.5 * z2 - F.ln(safe) - F.lit(0.9189385332046727) + F.ln(
        1.0 - i2 * (1.0 - 3.0 * i2 * (1.0 - 5.0 * i2))
    )
    return F.when(z > 30.0, series).otherwise(direct)


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate (bounded by construction) as a scalar subquery."""
    names = one_row.columns
    packed = one_row.agg(F.first(F.struct(*names)).alias("_s")).select("_s").scalar()
    return df.withColumn("_scalars", packed).select(
        *df.columns, *[F.col("_scalars")[n].alias(n) for n in names]
    )
