"""Queries whose rows are planted with null keys, unknown values and units that an operator cannot use: none may vanish."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.operators import closed_form as K
from trajlytics.operators import features as X
from trajlytics.operators import grid as Y
from trajlytics.operators import resampling as R
from trajlytics.operators import splits as S
from trajlytics.queries.closed_form import EB_SQL, eb_base
from trajlytics.queries.library import POWER_SQL
from trajlytics.queries.registry import register
from trajlytics.queries.resampling import BASE, deltas
from trajlytics.queries.splits import STRESS_SQL, stress
from trajlytics.sources import adapters as A
from trajlytics.sources.adapters import table, with_ctes

_RANKED = """ev AS (SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN user_id END AS g FROM events),
    ranked AS (SELECT g, ROW_NUMBER() OVER (ORDER BY sha256(concat_ws('|', '42', g)), g) AS r, COUNT(*) OVER () AS n FROM (SELECT DISTINCT g FROM ev))"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("CASE WHEN user_id % 5 <> 0 THEN user_id END").alias("g"))


@register("c1_null_groups", "event_id:i g:i split", with_ctes("", """
    SELECT event_id, g, CASE WHEN r <= GREATEST(1, FLOOR(n * 0.2::DOUBLE)) THEN 'test' WHEN r <= GREATEST(1, FLOOR(n * 0.2::DOUBLE)) * 2 THEN 'validation' ELSE 'train' END AS split
    FROM ev JOIN ranked ON ev.g IS NOT DISTINCT FROM ranked.g""".replace("SELECT event_id, g,", "SELECT event_id, ev.g AS g,"), _RANKED))
def c1_null_groups(spark, sf_dir):
    return S.stable_group_split(_events(spark, sf_dir), ["g"])


@register("c5_null_groups", "g:i fold:i n_rows:i", with_ctes("", "SELECT ev.g AS g, (r - 1) % 5 AS fold, COUNT(*) AS n_rows FROM ev JOIN ranked ON ev.g IS NOT DISTINCT FROM ranked.g GROUP BY 1, 2", _RANKED))
def c5_null_groups(spark, sf_dir):
    return S.stable_group_folds(_events(spark, sf_dir), "g").groupBy("g", "fold").agg(F.count(F.lit(1)).alias("n_rows"))


@register("c16_unknown_stress", "condition_id:i temperature_in_range:b soc_in_range:b temperature_level_seen:b soc_level_seen:b support_class", with_ctes("", """
    SELECT condition_id, ti AS temperature_in_range, si AS soc_in_range, tl AS temperature_level_seen, sl AS soc_level_seen,
      CASE WHEN ti AND si THEN 'stress_covariate_interpolation' WHEN ti THEN 'soc_range_extrapolation'
           WHEN si THEN 'temperature_range_extrapolation' ELSE 'temperature_and_soc_range_extrapolation' END AS support_class
    FROM (SELECT a.condition_id, COALESCE(a.t BETWEEN MIN(b.t) AND MAX(b.t), FALSE) AS ti, COALESCE(a.s BETWEEN MIN(b.s) AND MAX(b.s), FALSE) AS si,
        COALESCE(bool_or(a.t = b.t), FALSE) AS tl, COALESCE(bool_or(a.s = b.s), FALSE) AS sl
      FROM known a JOIN known b ON a.condition_id <> b.condition_id GROUP BY a.condition_id, a.t, a.s)""", STRESS_SQL,
    "known AS (SELECT condition_id, CASE WHEN condition_id % 7 <> 0 THEN temperature_c END AS t, CASE WHEN condition_id % 5 <> 1 THEN storage_soc_fraction END AS s FROM stress)"))
def c16_unknown_stress(spark, sf_dir):
    return S.support_classes(stress(spark, sf_dir).selectExpr(
        "condition_id", "CASE WHEN condition_id % 7 <> 0 THEN temperature_c END AS temperature_c", "CASE WHEN condition_id % 5 <> 1 THEN storage_soc_fraction END AS storage_soc_fraction"))


_CELLS = "odd AS (SELECT CASE WHEN cell_id <> '3' THEN cell_id END AS cell_id, cycle_index, CASE WHEN cell_id = '4' THEN -1e0 ELSE discharge_capacity_ah END AS discharge_capacity_ah FROM cycles WHERE NOT (cycle_index = 3 AND cell_id LIKE '%5'))"


def _odd_cells(spark, sf_dir):
    rows = A.cycles(spark, sf_dir).where("NOT (cycle_index = 3 AND cell_id LIKE '%5')")
    return rows.selectExpr("CASE WHEN cell_id <> '3' THEN cell_id END AS cell_id", "cycle_index", "CASE WHEN cell_id = '4' THEN -1e0 ELSE discharge_capacity_ah END AS discharge_capacity_ah")


@register("d9_null_cells", "cell_id n_rows:i normalization_ah:d sum_retention:d4", with_ctes("cycles", """
    SELECT m.cell_id AS cell_id, COUNT(*) AS n_rows, MIN(m) AS normalization_ah, SUM(1e2 * discharge_capacity_ah / m) AS sum_retention
    FROM odd JOIN (SELECT cell_id, MEDIAN(discharge_capacity_ah) AS m FROM odd WHERE cycle_index BETWEEN 1 AND 5 GROUP BY 1 HAVING COUNT(*) = 5) m ON odd.cell_id IS NOT DISTINCT FROM m.cell_id
    WHERE m > 0 GROUP BY 1""", _CELLS))
def d9_null_cells(spark, sf_dir):
    return X.with_retention(_odd_cells(spark, sf_dir)).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("normalization_ah").alias("normalization_ah"), F.sum("retention").alias("sum_retention"))


@register("d9_retention_issues", "cell_id n_rows:i n_initial:i issue", with_ctes("cycles", """
    SELECT cell_id, n_rows, n_initial, CASE WHEN n_initial <> 5 THEN 'initial_cycles_incomplete' ELSE 'normalization_not_positive' END AS issue
    FROM (SELECT cell_id, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE cycle_index BETWEEN 1 AND 5) AS n_initial, MEDIAN(discharge_capacity_ah) FILTER (WHERE cycle_index BETWEEN 1 AND 5) AS m FROM odd GROUP BY 1)
    WHERE n_initial <> 5 OR NOT m > 0""", _CELLS))
def d9_retention_issues(spark, sf_dir):
    return X.retention_issues(_odd_cells(spark, sf_dir))


@register("e8_null_condition", "condition_id:i log_amplitude:d5 exponent:d sse:d4 n_points:i", with_ctes("cal", """
    SELECT CASE WHEN condition_id <> 3 THEN condition_id END AS condition_id, LN(m.a) AS log_amplitude, m.b AS exponent, m.s AS sse, m.n AS n_points FROM p2""", *POWER_SQL))
def e8_null_condition(spark, sf_dir):
    obs = A.calendar_obs(spark, sf_dir).withColumn("condition_id", F.expr("CASE WHEN condition_id <> 3 THEN condition_id END"))
    return Y.power_law(obs, ["condition_id"])


@register("e15_short_targets", "condition_id:i n_positive:i scale:d status", with_ctes("cal", """
    SELECT c.condition_id, COUNT(*) FILTER (WHERE elapsed_days > 0) AS n_positive,
      CASE WHEN COUNT(*) FILTER (WHERE elapsed_days > 0) >= 2 THEN LEAST(GREATEST((MIN(byy) + MIN(ridge)) / (MIN(bb) + MIN(ridge)), 0), 4) END AS scale,
      CASE WHEN COUNT(*) FILTER (WHERE elapsed_days > 0) >= 2 THEN 'ok' ELSE 'too_few_positive_times' END AS status
    FROM calendar_obs c LEFT JOIN per USING (condition_id), eb WHERE checkup_index < CASE WHEN c.condition_id % 3 = 0 THEN 2 ELSE 10 END GROUP BY 1""", EB_SQL))
def e15_short_targets(spark, sf_dir):
    obs = A.calendar_obs(spark, sf_dir)
    ridge = K.empirical_bayes_ridge(obs.filter("checkup_index < 10"), eb_base())
    return K.target_scale(obs.filter("checkup_index < CASE WHEN condition_id % 3 = 0 THEN 2 ELSE 10 END"), ridge, eb_base())


_ODD = """pn AS (SELECT condition_id, NULLIF(grp, '2') AS grp, CASE WHEN condition_id % 11 = 4 THEN 'NaN'::DOUBLE WHEN condition_id % 11 = 5 THEN NULL ELSE d_iae END AS d FROM pd),
    ok AS (SELECT *, isfinite(d) AND d IS NOT NULL AS fine FROM pn)"""


def _odd_deltas(spark, sf_dir):
    d = F.when(F.col("condition_id") % 11 == 4, F.lit(float("nan"))).when(F.col("condition_id") % 11 == 5, F.lit(None)).otherwise(F.col("d_iae"))
    return deltas(spark, sf_dir).select("condition_id", F.nullif("grp", F.lit("2")).alias("grp"), d.alias("d"))


_BOOT = """u AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY sha256('unit|' || condition_id), condition_id) - 1 AS i, COUNT(*) OVER (PARTITION BY grp) AS n FROM ok),
    dr AS (SELECT grp, replicate, CAST('0x' || SUBSTR(sha256(concat_ws('|', 'n1', replicate, i, grp)), 1, 13) AS BIGINT) % n AS pick FROM u, range(40) AS r(replicate)),
    rp AS (SELECT dr.grp, replicate, SUM(CASE WHEN fine THEN d ELSE 0 END) / NULLIF(COUNT(*) FILTER (WHERE fine), 0) AS m FROM dr JOIN u ON u.grp IS NOT DISTINCT FROM dr.grp AND u.i = dr.pick GROUP BY 1, 2),
    pt AS (SELECT grp, COUNT(*) AS n_units, AVG(d) FILTER (WHERE fine) AS mean_d, COUNT(*) FILTER (WHERE NOT COALESCE(fine, FALSE)) AS n_not_finite_d FROM ok GROUP BY 1)"""
_BOUNDS = """SELECT rp.grp AS grp, MIN(n_units) AS n_units, MIN(n_not_finite_d) AS n_not_finite_d, MIN(mean_d) AS mean_d, QUANTILE_CONT(m, 0.025) AS lower_d, QUANTILE_CONT(m, 0.975) AS upper_d
    FROM rp JOIN pt ON rp.grp IS NOT DISTINCT FROM pt.grp GROUP BY 1"""


@register("t1_null_groups", "grp n_units:i n_not_finite_d:i mean_d:d lower_d:d upper_d:d", with_ctes("cal", _BOUNDS, *BASE, _ODD, _BOOT))
def t1_null_groups(spark, sf_dir):
    return R.paired_bootstrap(_odd_deltas(spark, sf_dir), ["grp"], "condition_id", ["d"], replicates=40, seed="n1")


@register("t1_large_groups", "grp n_units:i n_not_finite_d:i mean_d:d lower_d:d upper_d:d", with_ctes("cal", _BOUNDS, *BASE, _ODD, _BOOT))
def t1_large_groups(spark, sf_dir):
    """The same draws by joins of unit and draw, as for groups beyond the packed size."""
    return R.paired_bootstrap(_odd_deltas(spark, sf_dir), ["grp"], "condition_id", ["d"], replicates=40, seed="n1", packed_units=3)


@register("t6_null_groups", "grp n_nonzero:i n_not_finite:i n_patterns:i two_sided_p:d status", with_ctes("cal", """
    SELECT s.grp AS grp, s.n AS n_nonzero, bad AS n_not_finite, COALESCE(np, CASE WHEN s.n = 0 THEN 1 END) AS n_patterns, CASE WHEN s.n = 0 THEN 1 ELSE p END AS two_sided_p, CASE WHEN s.n > 16 THEN 'above_exact_cap' ELSE 'exact' END AS status
    FROM (SELECT grp, COUNT(*) FILTER (WHERE fine AND ABS(d) > 0.005) AS n, COUNT(*) FILTER (WHERE NOT COALESCE(fine, FALSE)) AS bad FROM ok GROUP BY 1) s LEFT JOIN (
      SELECT grp, COUNT(*) AS np, AVG(CASE WHEN ABS(f) >= ABS(o) * (1 - 1e-12) THEN 1e0 ELSE 0e0 END) AS p FROM (
        SELECT grp, mask, SUM(d) AS o, SUM(CASE WHEN (mask >> CAST(i AS INT)) & 1 = 1 THEN -d ELSE d END) AS f
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY d) - 1 AS i, COUNT(*) OVER (PARTITION BY grp) AS n FROM ok WHERE fine AND ABS(d) > 0.005), range(65536) AS m(mask)
        WHERE n <= 16 AND mask < (1 << CAST(n AS INT)) GROUP BY 1, 2) GROUP BY 1) x ON s.grp IS NOT DISTINCT FROM x.grp""", *BASE, _ODD))
def t6_null_groups(spark, sf_dir):
    return R.exact_sign_flip(_odd_deltas(spark, sf_dir), ["grp"], "d", cap=16, tolerance=0.005)


@register("t7_null_groups", "grp condition_id:i full_mean:d loo_mean:d flipped:b", with_ctes("cal", """
    SELECT grp, condition_id, m AS full_mean, l AS loo_mean, SIGN(l) <> SIGN(m) AS flipped
    FROM (SELECT NULLIF(grp, '2') AS grp, condition_id, AVG(d_iae) OVER w AS m, (SUM(d_iae) OVER w - d_iae) / (COUNT(*) OVER w - 1) AS l FROM pd WINDOW w AS (PARTITION BY NULLIF(grp, '2')))""", *BASE))
def t7_null_groups(spark, sf_dir):
    return R.leave_one_out(deltas(spark, sf_dir).withColumn("grp", F.nullif("grp", F.lit("2"))), ["grp"], "condition_id", "d_iae")
