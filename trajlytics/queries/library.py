"""Grid fits and structure-library queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.operators import features as X
from trajlytics.operators import grid as Y
from trajlytics.operators import library as L
from trajlytics.operators import scoring as G
from trajlytics.queries import packs as P
from trajlytics.queries.closed_form import nnls_sql
from trajlytics.queries.registry import register
from trajlytics.session import cut_lineage
from trajlytics.sources import adapters as A
from trajlytics.sources.adapters import with_ctes

EXPS = str(Y.EXPONENTS)
_PW = """{n} AS (SELECT condition_id, MIN({{'s': yy - 2 * a * fy + a * a * ff, 'b': b, 'a': a, 'n': n}}) AS m FROM (SELECT *, GREATEST(fy / ff, EXP(-12e0)) AS a FROM (
      SELECT condition_id, b, COUNT(*) AS n, SUM(POWER(d, b) * y) AS fy, SUM(POWER(d, b) * POWER(d, b)) AS ff, SUM(y * y) AS yy FROM {src} GROUP BY 1, 2)) GROUP BY 1)"""
POWER_SQL = ["pos AS (SELECT condition_id, elapsed_days AS d, capacity_loss_pct AS y FROM calendar_obs WHERE elapsed_days > 0)",
          _PW.format(n="p1", src=f"(SELECT *, UNNEST({EXPS}::DOUBLE[]) AS b FROM pos)"),
          _PW.format(n="p2", src="(SELECT * FROM (SELECT pos.*, ROUND(m.b + UNNEST(range(-10, 11)) * ((0.1e0 - 0.05e0) / 10), 6) AS b FROM pos JOIN p1 USING (condition_id)) WHERE b >= 0.05e0 AND b <= 1.5e0)")]


@register("e8_power_law", "condition_id:i log_amplitude:d5 exponent:d sse:d4 n_points:i", with_ctes("cal", "SELECT condition_id, LN(m.a) AS log_amplitude, m.b AS exponent, m.s AS sse, m.n AS n_points FROM p2", *POWER_SQL))
def e8_power_law(spark, sf_dir):
    return Y.power_law(A.calendar_obs(spark, sf_dir), ["condition_id"])


def act_sql(src: str, taus: str, cap: int = 10) -> list[str]:
    return [
        f"""as0 AS (SELECT condition_id, tau, b, COUNT(*) AS n, SUM(f * f) AS s11, SUM(f * h) AS s12, SUM(h * h) AS s22, SUM(f * y) AS s1y, SUM(h * y) AS s2y, SUM(y * y) AS yy
            FROM (SELECT *, POWER(d, b) AS f, EXP(-d / tau) - 1 AS h FROM {src}, (SELECT UNNEST({EXPS}::DOUBLE[]) AS b), (SELECT UNNEST({taus}::DOUBLE[]) AS tau)) GROUP BY 1, 2, 3)""",
        """as1 AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / NULLIF(s11 * s22 - s12 * s12, 0) AS ja, (s2y * s11 - s1y * s12) / NULLIF(s11 * s22 - s12 * s12, 0) AS jb FROM as0)""",
        f"""as2 AS (SELECT *, UNNEST([{{'a': GREATEST(s1y / s11, 0), 'o': 0e0, 'j': 0}}, {{'a': GREATEST((s1y - s12 * {cap}) / s11, 0), 'o': {cap}e0, 'j': 0}},
            {{'a': 0e0, 'o': LEAST(GREATEST(s2y / s22, 0), {cap}), 'j': 0}}, {{'a': ja, 'o': jb, 'j': 1}}], recursive := true) FROM as1)""",
        f"""as3 AS (SELECT *, a * a * s11 + 2 * a * o * s12 + o * o * s22 - 2 * a * s1y - 2 * o * s2y AS q FROM as2 WHERE CASE WHEN det > 1e-12 * s11 * s22 AND ja >= 0 AND jb >= 0 AND jb <= {cap} THEN j = 1 ELSE j = 0 END)""",
        "af AS (SELECT condition_id, tau, MIN({'s': yy + q, 'b': b, 'a': a, 'o': o, 'n': n}) AS m FROM as3 GROUP BY 1, 2)"]


@register("e10_activation_power_law", "condition_id:i timescale:d log_amplitude:d5 exponent:d offset_pp:d5 sse:d4 n_points:i", with_ctes("cal", """
    SELECT condition_id, tau AS timescale, LN(GREATEST(m.a, EXP(-12e0))) AS log_amplitude, m.b AS exponent, m.o AS offset_pp, m.s AS sse, m.n AS n_points FROM af""", POWER_SQL[0], *act_sql("pos", "[3.0, 7.0]")))
def e10_activation_power_law(spark, sf_dir):
    return Y.activation_power_law(A.calendar_obs(spark, sf_dir), ["condition_id"], timescales=[3.0, 7.0])


ROBUST = 4


def robust_sql(points: str, cap: float, tag: str, rounds: int = ROBUST) -> list[str]:
    """Reweighted rounds over the grid ``points`` (condition_id, tau, b); {tag} has the best point of each condition and tau."""
    parts, state = [], f"(SELECT *, 0e0 AS a, 0e0 AS o FROM {points})"
    for k in range(rounds + 2):
        w = "1 / SQRT(1 + z)" if k else "1e0"
        parts.append(f"""{tag}s{k} AS MATERIALIZED (SELECT condition_id, tau, b, a AS a_, o AS o_, COUNT(*) AS n, SUM(w * f * f) AS s11, SUM(w * f * h) AS s12, SUM(w * h * h) AS s22, SUM(w * f * y) AS s1y, SUM(w * h * y) AS s2y, SUM(625e-4 * (SQRT(1 + z) - 1)) AS cost
            FROM (SELECT *, {w} AS w FROM (SELECT *, POWER((a * f + o * h - y) / 25e-2, 2) AS z FROM (SELECT s.*, y, POWER(d, b) AS f, EXP(-d / tau) - 1 AS h FROM pos JOIN {state} s USING (condition_id)))) GROUP BY 1, 2, 3, 4, 5)""")
        if k > rounds:
            break
        parts += [
            f"{tag}j{k} AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / NULLIF(s11 * s22 - s12 * s12, 0) AS ja, (s2y * s11 - s1y * s12) / NULLIF(s11 * s22 - s12 * s12, 0) AS jb FROM {tag}s{k})",
            f"""{tag}c{k} AS (SELECT *, UNNEST([{{'a': GREATEST(s1y / s11, 0), 'o': 0e0, 'j': 0}}, {{'a': GREATEST((s1y - s12 * {cap}) / s11, 0), 'o': {cap}, 'j': 0}},
                {{'a': 0e0, 'o': LEAST(GREATEST(s2y / s22, 0), {cap}), 'j': 0}}, {{'a': ja, 'o': jb, 'j': 1}}], recursive := true) FROM {tag}j{k})""",
            f"""{tag}q{k} AS MATERIALIZED (SELECT condition_id, tau, b, GREATEST(LEAST(m.a, EXP(5e0)), EXP(-12e0)) AS a, m.o AS o FROM (SELECT condition_id, tau, b, MIN({{'q': a * a * s11 + 2 * a * o * s12 + o * o * s22 - 2 * a * s1y - 2 * o * s2y, 'a': a, 'o': o}}) AS m
                FROM {tag}c{k} WHERE CASE WHEN det > 1e-12 * s11 * s22 AND ja >= 0 AND jb >= 0 AND jb <= {cap} THEN j = 1 ELSE j = 0 END GROUP BY 1, 2, 3))""",
        ]
        state = f"{tag}q{k}"
    parts.append(f"{tag} AS MATERIALIZED (SELECT condition_id, tau, MIN({{'c': cost, 'b': b, 'a': a_, 'o': o_, 'n': n}}) AS m FROM {tag}s{rounds + 1} GROUP BY 1, 2)")
    return parts


def robust_fit_sql(taus: str, cap: float) -> list[str]:
    fine = "(SELECT * FROM (SELECT condition_id, tau, ROUND(m.b + i * 5e-3, 6) AS b FROM rc, range(-10, 11) AS r(i)) WHERE b BETWEEN 0.05 AND 1.5)"
    return [POWER_SQL[0], f"gp AS (SELECT * FROM (SELECT DISTINCT condition_id FROM pos), (SELECT UNNEST({EXPS}::DOUBLE[]) AS b), (SELECT UNNEST({taus}::DOUBLE[]) AS tau))", *robust_sql("gp", cap, "rc"), f"gf AS {fine}", *robust_sql("gf", cap, "rf")]


@register("e8_robust", "condition_id:i log_amplitude:d4 exponent:d cost:d4 n_points:i", with_ctes("cal", "SELECT condition_id, LN(m.a) AS log_amplitude, m.b AS exponent, m.c AS cost, m.n AS n_points FROM rf", *robust_fit_sql("[1.0]", 0.0)))
def e8_robust(spark, sf_dir):
    return Y.robust_power_law(A.calendar_obs(spark, sf_dir), ["condition_id"], rounds=ROBUST, settled=None)


@register("e10_robust", "condition_id:i timescale:d log_amplitude:d4 exponent:d offset_pp:d4 cost:d4 n_points:i", with_ctes("cal", """
    SELECT condition_id, tau AS timescale, LN(m.a) AS log_amplitude, m.b AS exponent, m.o AS offset_pp, m.c AS cost, m.n AS n_points FROM rf""", *robust_fit_sql("[7.0]", 10.0)))
def e10_robust(spark, sf_dir):
    return Y.robust_power_law(A.calendar_obs(spark, sf_dir), ["condition_id"], timescales=[7.0], rounds=ROBUST, settled=None)


TAUS = [2.0, 7.0, 14.0]


@register("t12_timescale_sensitivity", "timescale:d n_units:i candidate_mean:d5 comparator_mean:d5 mean_delta:d5 n_better:i n_worse:i", with_ctes("cal", """
    SELECT tau AS timescale, COUNT(*) AS n_units, AVG(a.iae) AS candidate_mean, AVG(b.iae) AS comparator_mean, AVG(a.iae - b.iae) AS mean_delta, COUNT(*) FILTER (WHERE a.iae - b.iae < -1e-6) AS n_better, COUNT(*) FILTER (WHERE a.iae - b.iae > 1e-6) AS n_worse
    FROM tscore a JOIN score b USING (condition_id) WHERE b.method = 'prefix_sqrt' GROUP BY 1""",
    "pos AS (SELECT condition_id, elapsed_days AS d, capacity_loss_pct AS y FROM calendar_obs WHERE elapsed_days > 0 AND checkup_index < 10)", *act_sql("pos", str(TAUS)),
    """tp AS (SELECT o.condition_id, tau, elapsed_days, 1e2 - (GREATEST(m.a, EXP(-12e0)) * POWER(elapsed_days, m.b) - m.o * (1 - EXP(-elapsed_days / tau))) - capacity_retention_pct AS error FROM calendar_obs o JOIN af USING (condition_id) WHERE checkup_index >= 10)""",
    P.score_sql("tp", "tscore", "condition_id, tau"), P.pred_sql(), P.score_sql()))
def t12_timescale_sensitivity(spark, sf_dir):
    obs = P.observations(spark, sf_dir)
    fits = Y.activation_power_law(obs.filter("checkup_index < 10"), ["condition_id"], timescales=TAUS)
    coords = obs.filter("checkup_index >= 10").select("condition_id", "checkup_index", "elapsed_days").join(fits, "condition_id")
    loss = Y.activation_loss(F.col("elapsed_days"), F.col("log_amplitude"), F.col("exponent"), F.col("offset_pp"), F.col("timescale"))
    pack = coords.select("condition_id", "checkup_index", "elapsed_days", F.col("timescale").cast("string").alias("method"), (100.0 - loss).alias("predicted"))
    scores = P.score_pack(pack, obs)
    base = P.score_pack(P.predictions(obs).filter("method = 'prefix_sqrt'"), obs).select("condition_id", F.col("iae").alias("_b"))
    d = F.col("iae") - F.col("_b")
    return scores.join(base, "condition_id").groupBy(F.col("method").cast("double").alias("timescale")).agg(
        F.count(F.lit(1)).alias("n_units"), F.avg("iae").alias("candidate_mean"), F.avg("_b").alias("comparator_mean"), F.avg(d).alias("mean_delta"),
        F.count(F.when(d < -1e-6, 1)).alias("n_better"), F.count(F.when(d > 1e-6, 1)).alias("n_worse"))


DAYS = [16.0, 18.0, 20.0, 22.0, 24.0, 26.0, 28.0, 30.0]
LANDMARK = 20


def _grid_values() -> str:
    return ", ".join(f"('{m}', '{v}', {a}e0, {b}e0, {c}e0)" for m, v, a, b, c in Y.structure_grid())


def _basis(t: str) -> tuple[str, str, str]:
    z = f"(({t} - p2) / CASE WHEN p3 > 0 THEN p3 ELSE 1 END)"
    return (f"CASE WHEN m = 'late_knee' THEN SQRT({t}) WHEN m = 'saturating' THEN 1 - EXP(-{t} / p1) ELSE POWER({t}, p1) END",
            f"CASE WHEN m = 'saturating' THEN {t} WHEN m = 'dual_power' THEN POWER({t}, p2) ELSE 0e0 END",
            f"CASE WHEN m = 'late_knee' THEN p1 * p3 * (GREATEST({z}, 0) + LN(1 + EXP(-ABS({z})))) ELSE 0e0 END")


_B = _basis("d")
_LIB = [f"pfx AS (SELECT condition_id, elapsed_days AS d, capacity_loss_pct AS y0 FROM calendar_obs WHERE checkup_index < {LANDMARK})",
    f"gr(m, v, p1, p2, p3) AS (VALUES {_grid_values()})",
    f"fx AS (SELECT condition_id, m, v, p1, p2, p3, d, {_B[0]} AS r, {_B[1]} AS z, y0 - {_B[2]} AS y FROM pfx, gr)",
    "co AS (" + nnls_sql("fx", "condition_id, m, v") + ")",
    """st AS (SELECT condition_id, m, v, ANY_VALUE(p1) AS p1, ANY_VALUE(p2) AS p2, ANY_VALUE(p3) AS p3, ANY_VALUE(c1) AS c1, ANY_VALUE(c2) AS c2, SQRT(AVG(POWER(c1 * r + c2 * z - y, 2))) AS rmse, MAX(ABS(c1 * r + c2 * z - y)) AS mx
        FROM fx JOIN co USING (condition_id, m, v) GROUP BY 1, 2, 3)""",
    """bs AS (SELECT * FROM st QUALIFY ROW_NUMBER() OVER (PARTITION BY condition_id, m, CASE WHEN m = 'late_knee' THEN v ELSE 'best' END ORDER BY ROUND(rmse, 9), v) = 1)""",
    """sq AS (SELECT *, CASE WHEN m = 'persistence' THEN l ELSE k END AS c1 FROM (SELECT condition_id, ARG_MAX(y0, d) AS l, LEAST(GREATEST(COALESCE(SUM(SQRT(d) * y0) / NULLIF(SUM(d), 0), 0), 0), 5) AS k FROM pfx GROUP BY 1), (SELECT UNNEST(['persistence', 'sqrt_time']) AS m))""",
    f"""lib AS (SELECT condition_id, m AS model_id, v AS variant_id, c1, c2, rmse AS prefix_rmse_pp, mx AS max_abs_residual_pp, i, 1e2 - (c1 * ({_B[0]}) + c2 * ({_B[1]}) + ({_B[2]})) AS f FROM bs, (SELECT UNNEST({DAYS}::DOUBLE[]) AS d, UNNEST(range(8)) AS i)
        UNION ALL SELECT condition_id, m, 'best', ANY_VALUE(c1), 0, SQRT(AVG(POWER(CASE WHEN m = 'persistence' THEN c1 ELSE c1 * SQRT(d) END - y0, 2))), MAX(ABS(CASE WHEN m = 'persistence' THEN c1 ELSE c1 * SQRT(d) END - y0)), i,
          1e2 - CASE WHEN m = 'persistence' THEN ANY_VALUE(c1) ELSE ANY_VALUE(c1) * SQRT(fd) END FROM sq JOIN pfx USING (condition_id), (SELECT UNNEST({DAYS}::DOUBLE[]) AS fd, UNNEST(range(8)) AS i) GROUP BY condition_id, m, i, fd)""",
    """cr AS (SELECT *, prefix_rmse_pp <= MIN(prefix_rmse_pp) OVER (PARTITION BY condition_id) + 0.05 AND max_abs_residual_pp <= 0.5 AND bool_and(f BETWEEN 50 AND 110) OVER (PARTITION BY condition_id, model_id, variant_id) AS credible FROM lib)"""]


def library(spark, sf_dir):
    pre = A.calendar_obs(spark, sf_dir).filter(F.col("checkup_index") < LANDMARK)
    return pre, Y.structure_library(pre, ["condition_id"], DAYS)


def members_of(fits):
    return L.credible_members(fits, ["condition_id"], rmse_slack=0.05, residual_cap=0.5, bounds=(50.0, 110.0))


def written_members(fits):
    """Credibility of every member, written once and dealt by the number of trajectories, as every feature reads it."""
    return Y.dealt(cut_lineage(members_of(fits)), ["condition_id"])


def credible(spark, sf_dir):
    return members_of(library(spark, sf_dir)[1])


@register("e11_structure_library", "condition_id:i model_id variant_id c1:d5 c2:d5 prefix_rmse_pp:d5 max_abs_residual_pp:d5 day:d forecast_pct:d4", with_ctes("cal", f"""
    SELECT condition_id, model_id, variant_id, c1, c2, prefix_rmse_pp, max_abs_residual_pp, {DAYS}::DOUBLE[][i + 1] AS day, f AS forecast_pct FROM lib""".replace(f"{DAYS}::DOUBLE[][i + 1]", f"({DAYS}::DOUBLE[])[i + 1]"), *_LIB))
def e11_structure_library(spark, sf_dir):
    days = F.array(*[F.lit(d) for d in DAYS])
    return library(spark, sf_dir)[1].select("condition_id", "model_id", "variant_id", "c1", "c2", "prefix_rmse_pp", "max_abs_residual_pp", F.explode(F.arrays_zip(days.alias("d"), F.col("forecast"))).alias("z")).select(
        "*", F.col("z.d").alias("day"), F.col("z.forecast").alias("forecast_pct"))


@register("e30_credible_forecast", "condition_id:i forecast_day:d credible_families:i point:d4 envelope_lower:d4 envelope_upper:d4 fallback_used:b", with_ctes("cal", f"""
    SELECT b.condition_id, ({DAYS}::DOUBLE[])[b.i + 1] AS forecast_day, COALESCE(nf, 0) AS credible_families, CASE WHEN nf >= 2 THEN pt ELSE b.f END AS point, COALESCE(lo, b.f) AS envelope_lower, COALESCE(hi, b.f) AS envelope_upper, COALESCE(nf, 0) < 2 AS fallback_used
    FROM (SELECT * FROM lib WHERE model_id = 'power') b LEFT JOIN (SELECT condition_id, i, COUNT(*) AS nf, MEDIAN(md) AS pt, MIN(lo) AS lo, MAX(hi) AS hi FROM (
      SELECT condition_id, i, model_id, MEDIAN(f) AS md, MIN(f) AS lo, MAX(f) AS hi FROM cr WHERE credible GROUP BY 1, 2, 3) GROUP BY 1, 2) a USING (condition_id, i)""", *_LIB))
def e30_credible_forecast(spark, sf_dir):
    return L.credible_forecast(credible(spark, sf_dir), ["condition_id"], DAYS)


# Signatures are compared on forecasts rounded to 1e-6, so that both engines group alike.
_SIGS = """vc AS (SELECT condition_id, model_id, variant_id, LIST(ROUND(f, 6) ORDER BY i) AS vec FROM cr WHERE credible GROUP BY 1, 2, 3),
    vd AS (SELECT DISTINCT condition_id, model_id, vec, list_transform(vec, lambda x: CAST(ROUND_EVEN(x / 0.25, 0) AS BIGINT)) AS sig FROM vc),
    rp AS (SELECT condition_id, model_id, sig, i, MEDIAN(vec[i + 1]) AS v FROM vd, range(8) AS t(i) GROUP BY 1, 2, 3, 4),
    wt AS (SELECT *, 1.0e0 / (COUNT(DISTINCT model_id) OVER (PARTITION BY condition_id, i) * COUNT(*) OVER (PARTITION BY condition_id, i, model_id)) AS w FROM rp)"""


def rounded_credible(members):
    return members.filter("credible_variant").withColumn("forecast", F.transform("forecast", lambda v: F.round(v, 6)))


@register("e31_family_balanced_support", "condition_id:i model_id signature_text coordinate:i representative:d4 weight:d", with_ctes("cal", """
    SELECT condition_id, model_id, array_to_string(sig, ',') AS signature_text, i AS coordinate, v AS representative, w AS weight FROM wt""", *_LIB, _SIGS))
def e31_family_balanced_support(spark, sf_dir):
    s = L.family_balanced_support(rounded_credible(credible(spark, sf_dir)), ["condition_id"])
    return s.select("condition_id", "model_id", "weight", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature_text"), F.posexplode("forecast").alias("coordinate", "representative"))


_WQ = """wq AS (SELECT condition_id, i, MIN(v) FILTER (WHERE c >= 0.1 * t - 1e-12) AS q10, MIN(v) FILTER (WHERE c >= 0.25 * t - 1e-12) AS q25, MIN(v) FILTER (WHERE c >= 0.5 * t - 1e-12) AS q50, MIN(v) FILTER (WHERE c >= 0.75 * t - 1e-12) AS q75,
      MIN(v) FILTER (WHERE c >= 0.9 * t - 1e-12) AS q90 FROM (SELECT *, SUM(w) OVER (PARTITION BY condition_id, i ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, SUM(w) OVER (PARTITION BY condition_id, i) AS t FROM wt) GROUP BY 1, 2)"""


@register("e32_weighted_quantiles", "condition_id:i coordinate:i q10:d4 q50:d4 q90:d4", with_ctes("cal", "SELECT condition_id, i AS coordinate, q10, q50, q90 FROM wq", *_LIB, _SIGS, _WQ))
def e32_weighted_quantiles(spark, sf_dir):
    s = L.family_balanced_support(rounded_credible(credible(spark, sf_dir)), ["condition_id"])
    return L.weighted_quantiles(s, ["condition_id"], {"q10": 0.1, "q50": 0.5, "q90": 0.9})


_LF = """fq AS (SELECT condition_id, model_id, i, MIN(v) FILTER (WHERE c >= 0.5 * t - 1e-12) AS q FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY condition_id, model_id, i ORDER BY v) AS c, COUNT(*) OVER (PARTITION BY condition_id, model_id, i) AS t FROM rp) GROUP BY 1, 2, 3),
    fv AS (SELECT condition_id, model_id, LIST(q ORDER BY i) AS vec FROM fq GROUP BY 1, 2),
    fs AS (SELECT condition_id, list_transform(vec, lambda x: CAST(ROUND_EVEN(x / 0.25, 0) AS BIGINT)) AS sig, vec FROM (SELECT DISTINCT condition_id, vec FROM fv)),
    fr AS (SELECT condition_id, sig, i, MEDIAN(vec[i + 1]) AS v FROM fs, range(8) AS t(i) GROUP BY 1, 2, 3),
    ll AS (SELECT condition_id, i, MEDIAN(v) AS lv FROM fr GROUP BY 1, 2), nf AS (SELECT condition_id, COUNT(*) AS families FROM fv GROUP BY 1),
    lf AS (SELECT s.condition_id, s.i, COALESCE(families, 0) AS families, s.f AS sqrt_value, CASE WHEN families >= 2 THEN lv ELSE s.f END AS library_value FROM (SELECT * FROM lib WHERE model_id = 'sqrt_time') s
      LEFT JOIN nf USING (condition_id) LEFT JOIN ll ON ll.condition_id = s.condition_id AND ll.i = s.i)"""


def library_forecasts(members):
    fits = rounded_credible(members)
    base = members.filter("model_id = 'sqrt_time'").select("condition_id", F.col("forecast").alias("sqrt_forecast"))
    return L.library_forecast(fits, ["condition_id"], base)


@register("e33_library_forecast", "condition_id:i coordinate:i families:i sqrt_value:d4 library_value:d4", with_ctes("cal", "SELECT condition_id, i AS coordinate, families, sqrt_value, library_value FROM lf", *_LIB, _SIGS, _LF))
def e33_library_forecast(spark, sf_dir):
    return library_forecasts(written_members(library(spark, sf_dir)[1])).select("condition_id", "families", F.posexplode(F.arrays_zip("sqrt_forecast", "library_forecast")).alias("coordinate", "z")).select(
        "*", F.col("z.sqrt_forecast").alias("sqrt_value"), F.col("z.library_forecast").alias("library_value"))


_TRUTH = """tr AS (SELECT condition_id, i, 1e2 - k * SQRT(d) AS tv FROM (SELECT condition_id, SUM(SQRT(elapsed_days) * capacity_loss_pct) / SUM(elapsed_days) AS k FROM calendar_obs WHERE elapsed_days > 0 GROUP BY 1), (SELECT UNNEST({0}::DOUBLE[]) AS d, UNNEST(range(8)) AS i))""".format(DAYS)


@register("e33_blend_beta", "n_points:i beta:d", with_ctes("cal", """SELECT n AS n_points, LEAST(GREATEST(xy / (xx + 0.01 * n), 0), 1) AS beta FROM (SELECT COUNT(*) AS n, SUM((library_value - sqrt_value) * (tv - sqrt_value)) AS xy, SUM(POWER(library_value - sqrt_value, 2)) AS xx
    FROM lf JOIN tr USING (condition_id, i))""", *_LIB, _SIGS, _LF, _TRUTH))
def e33_blend_beta(spark, sf_dir):
    from trajlytics.operators.closed_form import sqrt_rate
    truth = sqrt_rate(A.calendar_obs(spark, sf_dir), ["condition_id"]).select("condition_id", F.transform(F.array(*[F.lit(d) for d in DAYS]), lambda d: 100.0 - F.col("k") * F.sqrt(d)).alias("truth"))
    return L.blend_beta(library_forecasts(written_members(library(spark, sf_dir)[1])), truth, ["condition_id"])


@register("d14_prefix_risk_features", """condition_id:i successful_families:d failed_families:d best_prefix_rmse:d4 width_end:d3 mean_iqr:d3 effective_shapes:d boundary_hit_fraction:d leave_last_out_error:d4 center_end:d3
    center_minus_sqrt_end:d3 recent_loss:d4 early_loss:d4 slope_change:d3 width_growth:d3""")
def d14_prefix_risk_features(spark, sf_dir):
    pre = cut_lineage(A.calendar_obs(spark, sf_dir).filter(F.col("checkup_index") < LANDMARK))
    members = written_members(Y.structure_library(pre, ["condition_id"], DAYS))
    center = L.blended_center(library_forecasts(members), F.lit(0.5)).select("condition_id", "sqrt_forecast", "center_forecast")
    last = pre.groupBy("condition_id").agg(F.max("elapsed_days").alias("_m"))
    scaled = pre.join(last, "condition_id").withColumn("elapsed_days", F.when(F.col("elapsed_days") == F.col("_m"), F.lit(1000.0)).otherwise(F.col("elapsed_days")))
    leave = X.leave_last_out_sqrt_error(scaled, ["condition_id"], fit_until=999.0, score_at=1000.0)
    return L.prefix_risk_features(rounded_credible(members), center, Y.pack_prefix(pre, ["condition_id"]), leave, ["condition_id"], declared_families=6)


__all__ = ["G"]
