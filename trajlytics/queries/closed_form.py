"""Closed-form forecast queries and the flagship backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.operators import closed_form as K
from trajlytics.operators import features as X
from trajlytics.operators import scoring as G
from trajlytics.queries.features import RET, retention
from trajlytics.queries.registry import register
from trajlytics.sources import adapters as A
from trajlytics.sources.adapters import with_ctes

P, HORIZON = 100, 40
CLIP = "LEAST(GREATEST({}, 0), 110)"


def prefix(spark, sf_dir, p=P):
    return retention(spark, sf_dir).filter(F.col("cycle_index") <= p)


PRE = f"pre AS (SELECT * FROM ret WHERE cycle_index <= {P})"
LIN = """lin AS (SELECT cell_id, LEAST(REGR_SLOPE(retention, cycle_index), 0) AS b, AVG(retention) - LEAST(REGR_SLOPE(retention, cycle_index), 0) * AVG(cycle_index) AS a,
    ARG_MAX(retention, cycle_index) AS last_value, MAX(cycle_index) AS last_cycle FROM pre GROUP BY 1)"""
TS = f"""ts0 AS (SELECT x.cell_id, LEAST(MEDIAN((y.retention - x.retention) / (y.cycle_index - x.cycle_index)), 0) AS b FROM pre x JOIN pre y
      ON x.cell_id = y.cell_id AND y.cycle_index > x.cycle_index AND x.cycle_index > {P} - 12 AND y.cycle_index > {P} - 12 GROUP BY 1),
    ts AS (SELECT cell_id, b, MEDIAN(retention - b * cycle_index) AS a FROM pre JOIN ts0 USING (cell_id) WHERE cycle_index > {P} - 12 GROUP BY 1, 2)"""


def nnls_sql(src: str, keys: str, w: str = "1e0") -> str:
    """Coefficients (c1, c2) per key from columns r, z, y of ``src``."""
    return f"""SELECT {keys}, CASE WHEN ok THEN b1 WHEN g1 >= g2 THEN o1 ELSE 0 END AS c1, CASE WHEN ok THEN b2 WHEN g1 >= g2 THEN 0 ELSE o2 END AS c2
      FROM (SELECT *, det > 1e-12 * s11 * s22 AND b1 >= 0 AND b2 >= 0 AS ok, o1 * o1 * s11 AS g1, o2 * o2 * s22 AS g2
        FROM (SELECT *, (s1y * s22 - s2y * s12) / NULLIF(det, 0) AS b1, (s2y * s11 - s1y * s12) / NULLIF(det, 0) AS b2,
            GREATEST(COALESCE(s1y / NULLIF(s11, 0), 0), 0) AS o1, GREATEST(COALESCE(s2y / NULLIF(s22, 0), 0), 0) AS o2
          FROM (SELECT *, s11 * s22 - s12 * s12 AS det FROM (SELECT {keys}, SUM({w} * r * r) AS s11, SUM({w} * r * z) AS s12, SUM({w} * z * z) AS s22,
            SUM({w} * r * y) AS s1y, SUM({w} * z * y) AS s2y FROM {src} GROUP BY {keys}))))"""


def huber_sql(rounds: int = 3) -> list[str]:
    out = ["hx AS (SELECT cell_id, cycle_index, SQRT(cycle_index - 1) AS r, cycle_index - 1e0 AS z, 1e2 - retention AS y, 1e0 AS w FROM pre)",
           "h0 AS (" + nnls_sql("hx", "cell_id", "w") + ")"]
    for i in range(1, rounds):
        out += [
            f"e{i} AS (SELECT hx.*, y - c1 * r - c2 * z AS e FROM hx JOIN h{i - 1} USING (cell_id))",
            f"d{i} AS (SELECT *, ABS(e - MEDIAN(e) OVER (PARTITION BY cell_id)) AS d FROM e{i})",
            f"t{i} AS (SELECT *, 1.5e0 * GREATEST(1.4826e0 * MEDIAN(d) OVER (PARTITION BY cell_id), 1e-9) AS cut FROM d{i})",
            f"w{i} AS (SELECT cell_id, r, z, y, CASE WHEN d > cut THEN cut / d ELSE 1 END AS w FROM t{i})",
            f"h{i} AS (" + nnls_sql(f"w{i}", "cell_id", "w") + ")",
        ]
    return out


@register("backtest_minimum_slice", """candidate comparator n_units:i candidate_mean:d comparator_mean:d mean_delta:d relative_gain_pct:d n_better:i n_worse:i n_equal:i
    worst_delta:d worst_unit""", with_ctes("cycles", """
    SELECT 'target_prefix_full_linear' AS candidate, 'target_prefix_persistence' AS comparator, COUNT(*) AS n_units, AVG(a) AS candidate_mean, AVG(b) AS comparator_mean,
      AVG(a - b) AS mean_delta, 100 * (AVG(b) - AVG(a)) / AVG(b) AS relative_gain_pct, COUNT(*) FILTER (WHERE a - b < -1e-9) AS n_better, COUNT(*) FILTER (WHERE a - b > 1e-9) AS n_worse,
      COUNT(*) FILTER (WHERE ABS(a - b) <= 1e-9) AS n_equal, MAX(a - b) AS worst_delta, ARG_MAX(cell_id, {'d': a - b, 'u': cell_id}) AS worst_unit
    FROM (SELECT cell_id, SUM((ABS(e1) + ABS(p1)) / 2) / (MAX(cycle_index) - MIN(cycle_index)) AS a, SUM((ABS(e0) + ABS(p0)) / 2) / (MAX(cycle_index) - MIN(cycle_index)) AS b
      FROM (SELECT *, LAG(e1) OVER w AS p1, LAG(e0) OVER w AS p0 FROM (SELECT r.cell_id, r.cycle_index, LEAST(GREATEST(a + b * r.cycle_index, 0), 110) - retention AS e1, last_value - retention AS e0
          FROM ret r JOIN lin USING (cell_id) WHERE r.cycle_index > last_cycle) WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_index)) GROUP BY 1)""", RET, PRE, LIN))
def backtest_minimum_slice(spark, sf_dir):
    items = A.cycles(spark, sf_dir).select("cell_id", "cycle_index", "discharge_capacity_ah")
    x, q = F.col("cycle_index").cast("double"), F.col("discharge_capacity_ah")
    # Retention is a multiple of the capacity per cell, so its fit is that of the capacity, scaled: one pass for both.
    fits = X.normalised_fits(items.filter(F.col("cycle_index") <= P), ["cell_id"])
    suffix = items.filter(F.col("cycle_index") > P).join(fits, "cell_id")
    y = 100.0 * q / F.col("normalization_ah")
    values = {"target_prefix_persistence": F.col("last_value"), "target_prefix_full_linear": K.clip(F.col("intercept") + F.col("slope") * x, 0.0, 110.0)}
    errors = suffix.select("cell_id", "cycle_index", *[(v - y).alias(m) for m, v in values.items()])
    wide = G.score_error_columns(errors, ["cell_id"], "cycle_index", list(values), "FLOOR(cycle_index / 4096)", rows=A.table(spark, sf_dir, "lineitem").count())
    scores = wide.select("cell_id", F.explode(F.array(*[F.struct(F.lit(m).alias("model_id"), F.col(m)["iae"].alias("iae")) for m in values])).alias("m")).select("cell_id", "m.*")
    paired = G.pair_methods(scores, ["cell_id"], "model_id", "iae", [("target_prefix_full_linear", "target_prefix_persistence")])
    return G.comparison_summary(paired, ["candidate", "comparator"], "cell_id")


BASE_SQL = [RET, PRE, LIN, TS, *huber_sql(),
    f"""fits AS (SELECT cell_id, last_value, last_cycle, lin.a AS lin_a, lin.b AS lin_b, ts.a AS rob_a, ts.b AS rob_b, c1, c2
        FROM lin JOIN ts USING (cell_id) JOIN h2 USING (cell_id))""",
    f"""fc AS (SELECT cell_id, last_cycle, last_cycle + j AS forecast_cycle, UNNEST([
        {{'model_id': 'target_prefix_persistence', 'predicted': {CLIP.format('last_value')}}},
        {{'model_id': 'target_prefix_full_linear', 'predicted': {CLIP.format('lin_a + lin_b * (last_cycle + j)')}}},
        {{'model_id': 'target_prefix_robust_recent_linear', 'predicted': {CLIP.format('rob_a + rob_b * (last_cycle + j)')}}},
        {{'model_id': 'target_prefix_constrained_sqrt_linear', 'predicted': {CLIP.format('1e2 - c1 * SQRT(last_cycle + j - 1) - c2 * (last_cycle + j - 1)')}}}], recursive := true)
        FROM fits, range(1, {HORIZON} + 1) AS h(j))"""]


@register("e1_e4_base_forecasts", "cell_id last_cycle:i forecast_cycle:i model_id predicted:d5", with_ctes("cycles", "SELECT * FROM fc", *BASE_SQL))
def e1_e4_base_forecasts(spark, sf_dir):
    return K.base_forecasts(K.base_fits(prefix(spark, sf_dir), ["cell_id"]), ["cell_id"], HORIZON)


@register("e1_persistence", "cell_id last_value:d last_cycle:i", with_ctes("cycles", "SELECT cell_id, last_value, last_cycle FROM lin", RET, PRE, LIN))
def e1_persistence(spark, sf_dir):
    return prefix(spark, sf_dir).groupBy("cell_id").agg(F.max_by("retention", "cycle_index").alias("last_value"), F.max("cycle_index").alias("last_cycle"))


@register("e2_constrained_linear", "cell_id slope:d8 intercept:d", with_ctes("cycles", "SELECT cell_id, b AS slope, a AS intercept FROM lin", RET, PRE, LIN))
def e2_constrained_linear(spark, sf_dir):
    return K.linear_fit(prefix(spark, sf_dir), ["cell_id"], "cycle_index", "retention")


@register("e3_theil_sen", "cell_id slope:d8 intercept:d", with_ctes("cycles", "SELECT cell_id, b AS slope, a AS intercept FROM ts", RET, PRE, TS))
def e3_theil_sen(spark, sf_dir):
    return X.theil_sen(prefix(spark, sf_dir), ["cell_id"], "cycle_index", "retention", 12)


@register("e4_huber_sqrt_linear", "cell_id c_sqrt:d c_linear:d", with_ctes("cycles", "SELECT cell_id, c1 AS c_sqrt, c2 AS c_linear FROM h2", RET, PRE, *huber_sql()))
def e4_huber_sqrt_linear(spark, sf_dir):
    return K.huber_sqrt_linear(prefix(spark, sf_dir), ["cell_id"], "cycle_index", "retention")


@register("e5_sqrt_rate", "condition_id:i n_positive:i k:d8", with_ctes("cal", """SELECT condition_id, COUNT(*) AS n_positive,
    GREATEST(SUM(SQRT(elapsed_days) * capacity_loss_pct) / SUM(elapsed_days), 0) AS k FROM calendar_obs WHERE elapsed_days > 0 GROUP BY 1"""))
def e5_sqrt_rate(spark, sf_dir):
    return K.sqrt_rate(A.calendar_obs(spark, sf_dir), ["condition_id"])


@register("e6_bounded_variants", "condition_id:i model_id parameter:d prefix_rmse_pp:d max_abs_residual_pp:d", with_ctes("cal", """
    SELECT condition_id, 'target_prefix_persistence' AS model_id, MAX(l) AS parameter, SQRT(AVG(POWER(l - r, 2))) AS prefix_rmse_pp, MAX(ABS(l - r)) AS max_abs_residual_pp FROM j GROUP BY 1
    UNION ALL SELECT condition_id, 'target_prefix_sqrt_time', MAX(c), SQRT(AVG(POWER(1e2 - c * SQRT(d / 365.25e0) - r, 2))), MAX(ABS(1e2 - c * SQRT(d / 365.25e0) - r)) FROM j GROUP BY 1""",
    "p AS (SELECT condition_id, elapsed_days AS d, capacity_retention_pct AS r FROM calendar_obs WHERE checkup_index < 12)",
    """j AS (SELECT * FROM p JOIN (SELECT condition_id, ARG_MAX(r, d) AS l, LEAST(GREATEST(COALESCE(SUM(SQRT(d / 365.25e0) * (1e2 - r)) / NULLIF(SUM(d / 365.25e0), 0), 0), 0), 5) AS c FROM p GROUP BY 1) USING (condition_id))"""))
def e6_bounded_variants(spark, sf_dir):
    return K.bounded_variants(A.calendar_obs(spark, sf_dir).filter("checkup_index < 12"), ["condition_id"])


@register("e7_anchored_trends", "cell_id cycle_index:i model_id predicted:d", with_ctes("cycles", f"""
    SELECT cell_id, j AS cycle_index, UNNEST([{{'model_id': 'target_prefix_persistence', 'predicted': {CLIP.format('l')}}},
      {{'model_id': 'nonpositive_linear_trend', 'predicted': {CLIP.format('l + b * (j - n)')}}},
      {{'model_id': 'constrained_sqrt_loss_trend', 'predicted': {CLIP.format('l + s * (SQRT(j) - SQRT(n))')}}}], recursive := true)
    FROM (SELECT cell_id, ARG_MAX(retention, cycle_index) AS l, MAX(cycle_index) AS n, LEAST(REGR_SLOPE(retention, cycle_index), 0) AS b, LEAST(REGR_SLOPE(retention, SQRT(cycle_index)), 0) AS s
      FROM pre GROUP BY 1), range(1, 131) AS h(j) WHERE j > n""", RET, PRE))
def e7_anchored_trends(spark, sf_dir):
    return K.anchored_forecasts(K.anchored_trends(prefix(spark, sf_dir), ["cell_id"]), ["cell_id"], 130)


@register("e9_sqrt_linear", "condition_id:i c_sqrt:d c_linear:d", with_ctes("cal", "SELECT condition_id, LEAST(c1, 100) AS c_sqrt, LEAST(c2, 100) AS c_linear FROM (" + nnls_sql(
    "(SELECT condition_id, SQRT(elapsed_days / 365e0) AS r, elapsed_days / 365e0 AS z, capacity_loss_pct AS y FROM calendar_obs WHERE elapsed_days > 0)", "condition_id") + ")"))
def e9_sqrt_linear(spark, sf_dir):
    return K.sqrt_linear(A.calendar_obs(spark, sf_dir), ["condition_id"])


@register("e13_condition_agnostic_k", "n_conditions:i k:d8", with_ctes("cal", """SELECT COUNT(*) AS n_conditions, GREATEST(SUM(ty / n) / SUM(tt / n), 0) AS k FROM
    (SELECT condition_id, COUNT(*) AS n, SUM(SQRT(elapsed_days * 24) * capacity_loss_pct) AS ty, SUM(elapsed_days * 24) AS tt FROM calendar_obs WHERE elapsed_days > 0 GROUP BY 1)"""))
def e13_condition_agnostic_k(spark, sf_dir):
    return K.condition_agnostic_k(A.calendar_obs(spark, sf_dir).withColumn("elapsed_hours", F.col("elapsed_days") * 24))


EB_SQL = """per AS (SELECT condition_id, COUNT(*) AS n, SUM(base * y) AS byy, SUM(base * base) AS bb, SUM(y * y) AS yy FROM
      (SELECT condition_id, 4e-1 * SQRT(elapsed_days) AS base, capacity_loss_pct AS y FROM calendar_obs WHERE checkup_index < 10 AND elapsed_days > 0) GROUP BY 1),
    sc AS (SELECT *, GREATEST(byy / bb, 0) AS s FROM per WHERE bb > 0),
    ag AS (SELECT COUNT(*) AS n_conditions, GREATEST(SUM(yy - 2 * s * byy + s * s * bb) / SUM(n), 1e-8) AS rv, VAR_SAMP(s) AS vs, AVG(1 / bb) AS inv FROM sc),
    eb AS (SELECT n_conditions, rv AS residual_variance, GREATEST(vs - rv * inv, 1e-6) AS between_condition_variance, rv / GREATEST(vs - rv * inv, 1e-6) AS raw_ridge,
      LEAST(GREATEST(rv / GREATEST(vs - rv * inv, 1e-6), 0.01), 100) AS ridge FROM ag)"""


def eb_base():
    return 0.4 * F.sqrt("elapsed_days")


@register("e14_empirical_bayes_ridge", "n_conditions:i residual_variance:d between_condition_variance:d raw_ridge:d ridge:d", with_ctes("cal", "SELECT * FROM eb", EB_SQL))
def e14_empirical_bayes_ridge(spark, sf_dir):
    return K.empirical_bayes_ridge(A.calendar_obs(spark, sf_dir).filter("checkup_index < 10"), eb_base())


@register("e15_target_scale", "condition_id:i n_positive:i scale:d", with_ctes("cal", """SELECT condition_id, n AS n_positive, LEAST(GREATEST((byy + ridge) / (bb + ridge), 0), 4) AS scale
    FROM per, eb WHERE n >= 2""", EB_SQL))
def e15_target_scale(spark, sf_dir):
    pre = A.calendar_obs(spark, sf_dir).filter("checkup_index < 10")
    return K.target_scale(pre, K.empirical_bayes_ridge(pre, eb_base()), eb_base())


@register("e18_activation_gate", "condition_id:i n_positive:i minimum_loss_pct:d negative_evidence:b gate_ready:b", with_ctes("cal", """
    SELECT condition_id, COUNT(*) AS n_positive, MIN(capacity_loss_pct) AS minimum_loss_pct, MIN(capacity_loss_pct) < -0.05 AS negative_evidence,
      MIN(capacity_loss_pct) < -0.05 AND COUNT(*) >= 7 AS gate_ready FROM calendar_obs WHERE checkup_index < 10 AND elapsed_days > 0 GROUP BY 1"""))
def e18_activation_gate(spark, sf_dir):
    return K.activation_gate(A.calendar_obs(spark, sf_dir).filter("checkup_index < 10"), ["condition_id"], margin_pp=0.05)
