"""Bootstrap, exact-test and sensitivity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.operators import resampling as R
from trajlytics.queries import packs as P
from trajlytics.queries.registry import register
from trajlytics.queries.scoring import POOL_SQL, pool_flags
from trajlytics.sources import adapters as A
from trajlytics.sources.adapters import table, with_ctes

_PD = """pd AS (SELECT a.condition_id, CAST(a.condition_id % 6 AS VARCHAR) AS grp, CAST(a.condition_id // 12 AS VARCHAR) AS cohort, a.iae - b.iae AS d_iae, a.final_abs_error - b.final_abs_error AS d_final
    FROM score a JOIN score b USING (condition_id) WHERE a.method = 'prefix_sqrt' AND b.method = 'prefix_linear')"""
BASE = [P.pred_sql(), P.score_sql(), _PD]


def deltas(spark, sf_dir):
    at = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    wide = P.scored(spark, sf_dir).groupBy("condition_id").agg(
        (at("prefix_sqrt", "iae") - at("prefix_linear", "iae")).alias("d_iae"), (at("prefix_sqrt", "final_abs_error") - at("prefix_linear", "final_abs_error")).alias("d_final"))
    return wide.withColumns({"grp": (F.col("condition_id") % 6).cast("string"), "cohort": F.floor(F.col("condition_id") / 12).cast("string")})


def boot_sql(units: str, group: str, unit: str, sums: list[str], reps: int, seed: str) -> str:
    """Per (group, replicate) sums over drawn units; ``units`` has the group, unit and sum columns."""
    s = ", ".join(f"SUM({c}) AS {c}" for c in sums)
    return f"""SELECT d.{group} AS {group}, replicate, COUNT(*) AS n_drawn, {s} FROM (
        SELECT a.{group}, replicate, CAST('0x' || SUBSTR(sha256(concat_ws('|', '{seed}', replicate, a.i, a.{group})), 1, 13) AS BIGINT) % a.n AS pick
        FROM (SELECT {group}, ROW_NUMBER() OVER (PARTITION BY {group} ORDER BY sha256('unit|' || {unit}), {unit}) - 1 AS i, COUNT(*) OVER (PARTITION BY {group}) AS n FROM {units}) a, range({reps}) AS r(replicate)) d
      JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY {group} ORDER BY sha256('unit|' || {unit}), {unit}) - 1 AS i FROM {units}) u ON u.{group} = d.{group} AND u.i = d.pick GROUP BY 1, 2"""


REPS = 100


@register("t1_paired_bootstrap", "grp n_units:i mean_d_iae:d lower_d_iae:d upper_d_iae:d", with_ctes("cal", f"""
    SELECT grp, n_units, mean_d_iae, QUANTILE_CONT(d_iae / n_drawn, 0.025) AS lower_d_iae, QUANTILE_CONT(d_iae / n_drawn, 0.975) AS upper_d_iae
    FROM ({boot_sql('pd', 'grp', 'condition_id', ['d_iae'], REPS, 'b1')}) b JOIN (SELECT grp, COUNT(*) AS n_units, AVG(d_iae) AS mean_d_iae FROM pd GROUP BY 1) USING (grp) GROUP BY 1, 2, 3""", *BASE))
def t1_paired_bootstrap(spark, sf_dir):
    return R.paired_bootstrap(deltas(spark, sf_dir), ["grp"], "condition_id", ["d_iae"], replicates=REPS, seed="b1")


@register("t2_group_bootstrap", "n_groups:i mae:d4 mae_lower:d4 mae_upper:d4 rmse:d4 rmse_lower:d4 rmse_upper:d4 mape_pct:d4 mape_pct_lower:d4 mape_pct_upper:d4", with_ctes("quant", f"""
    SELECT (SELECT COUNT(*) FROM per) AS n_groups, (SELECT SUM(ae) / SUM(rows_) FROM per) AS mae, (SELECT SQRT(SUM(se) / SUM(rows_)) FROM per) AS rmse, (SELECT 100 * SUM(pe) / SUM(rows_) FROM per) AS mape_pct,
      QUANTILE_CONT(ae / rows_, 0.025) AS mae_lower, QUANTILE_CONT(ae / rows_, 0.975) AS mae_upper, QUANTILE_CONT(SQRT(se / rows_), 0.025) AS rmse_lower, QUANTILE_CONT(SQRT(se / rows_), 0.975) AS rmse_upper,
      QUANTILE_CONT(100 * pe / rows_, 0.025) AS mape_pct_lower, QUANTILE_CONT(100 * pe / rows_, 0.975) AS mape_pct_upper FROM ({boot_sql('per', 'al', 'cell_id', ['rows_', 'ae', 'se', 'pe'], REPS, 'b2')})""",
    "per AS (SELECT 0 AS al, cell_id, COUNT(*) AS rows_, SUM(ABS(p50 - truth)) AS ae, SUM(POWER(p50 - truth, 2)) AS se, SUM(ABS(p50 - truth) / truth) AS pe FROM quantile_rows GROUP BY 2)"))
def t2_group_bootstrap(spark, sf_dir):
    return R.group_bootstrap_metrics(A.quantile_rows(spark, sf_dir), "cell_id", "truth", "p50", replicates=REPS, seed="b2")


@register("t3_two_delta_bootstrap", "al:i n_units:i mean_d_iae:d lower_d_iae:d upper_d_iae:d mean_d_final:d lower_d_final:d upper_d_final:d", with_ctes("cal", f"""
    SELECT 0 AS al, (SELECT COUNT(*) FROM pd) AS n_units, (SELECT AVG(d_iae) FROM pd) AS mean_d_iae, QUANTILE_CONT(d_iae / n_drawn, 0.025) AS lower_d_iae, QUANTILE_CONT(d_iae / n_drawn, 0.975) AS upper_d_iae,
      (SELECT AVG(d_final) FROM pd) AS mean_d_final, QUANTILE_CONT(d_final / n_drawn, 0.025) AS lower_d_final, QUANTILE_CONT(d_final / n_drawn, 0.975) AS upper_d_final
    FROM ({boot_sql('pd0', 'al', 'condition_id', ['d_iae', 'd_final'], REPS, 'b3')})""", *BASE, "pd0 AS (SELECT *, 0 AS al FROM pd)"))
def t3_two_delta_bootstrap(spark, sf_dir):
    return R.paired_bootstrap(deltas(spark, sf_dir).withColumn("al", F.lit(0)), ["al"], "condition_id", ["d_iae", "d_final"], replicates=REPS, seed="b3")


_T4 = """u AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY family ORDER BY sha256('unit|' || cluster_id), cluster_id) - 1 AS i, COUNT(*) OVER (PARTITION BY family) AS n FROM pf),
    dr AS (SELECT family, replicate, pick, COUNT(*) AS times FROM (SELECT family, replicate, CAST('0x' || SUBSTR(sha256(concat_ws('|', 'b4', replicate, i, family)), 1, 13) AS BIGINT) % n AS pick FROM u, range(8) AS r(replicate)) GROUP BY ALL),
    dj AS (SELECT replicate, times, CASE WHEN catastrophic THEN 1e0 ELSE 0e0 END AS c, danger, disagreement, content_hash FROM dr JOIN u ON u.family = dr.family AND u.i = dr.pick WHERE eligible),
    bs AS (SELECT replicate, SUM(times) AS n_eligible, SUM(times * c) / SUM(times) AS random_rate, FLOOR(SUM(times) * 0.5) AS k FROM dj GROUP BY 1),
    cu AS (SELECT dj.*, k, SUM(times) OVER (PARTITION BY replicate ORDER BY danger, content_hash) AS c0, SUM(times) OVER (PARTITION BY replicate ORDER BY disagreement, content_hash) AS c1 FROM dj JOIN bs USING (replicate)),
    bt AS (SELECT replicate, n_eligible, random_rate, TRUE AS defined, 1 - r0 / random_rate AS reduction_prefix, 1 - r1 / random_rate AS reduction_visible, (r0 - r1) / random_rate AS increment
      FROM bs JOIN (SELECT replicate, SUM(LEAST(GREATEST(k - (c0 - times), 0), times) * c) / MAX(k) AS r0, SUM(LEAST(GREATEST(k - (c1 - times), 0), times) * c) / MAX(k) AS r1 FROM cu GROUP BY 1) USING (replicate))"""


def _stratified(spark, sf_dir):
    pool = pool_flags(spark, sf_dir)
    return R.stratified_rerank_bootstrap(pool, family="family", unit="cluster_id", tie="content_hash", arms={"prefix": "danger", "visible": "disagreement"}, catastrophic="catastrophic",
                                         eligible="eligible", issue_fraction=0.5, replicates=8, seed="b4")


@register("t4_stratified_rerank_bootstrap", "replicate:i n_eligible:i random_rate:d defined:b reduction_prefix:d reduction_visible:d increment:d", with_ctes("pool", "SELECT * FROM bt", POOL_SQL, _T4))
def t4_stratified_rerank_bootstrap(spark, sf_dir):
    return _stratified(spark, sf_dir)


def tail_sql(n: str, k: str) -> str:
    return f"list_sum(list_transform(range(0, CAST({k} AS BIGINT) + 1), lambda i: EXP(lgamma({n} + 1e0) - lgamma(i + 1e0) - lgamma({n} - i + 1e0) - {n} * LN(2e0))))"


_SG = "sg AS (SELECT grp, COUNT(*) FILTER (WHERE d_iae < -0.01) AS n_negative, COUNT(*) FILTER (WHERE d_iae > 0.01) AS n_positive, COUNT(*) FILTER (WHERE ABS(d_iae) <= 0.01) AS n_zero FROM pd GROUP BY 1)"


@register("t5_exact_sign_test", "grp n_negative:i n_positive:i n_zero:i two_sided_p:d", with_ctes("cal", f"""
    SELECT *, CASE WHEN n_negative + n_positive = 0 THEN 1 ELSE LEAST(1, 2 * {tail_sql('(n_negative + n_positive)', 'LEAST(n_negative, n_positive)')}) END AS two_sided_p FROM sg""", *BASE, _SG))
def t5_exact_sign_test(spark, sf_dir):
    return R.exact_sign_test(deltas(spark, sf_dir), ["grp"], "d_iae", tolerance=0.01)


@register("t6_exact_sign_flip", "cohort n_nonzero:i n_patterns:i two_sided_p:d status", with_ctes("cal", """
    SELECT cohort, n AS n_nonzero, COALESCE(np, CASE WHEN n = 0 THEN 1 END) AS n_patterns, CASE WHEN n = 0 THEN 1 ELSE p END AS two_sided_p, CASE WHEN n > 20 THEN 'above_exact_cap' ELSE 'exact' END AS status
    FROM (SELECT cohort, COUNT(*) FILTER (WHERE ABS(d_iae) > 0.005) AS n FROM pd GROUP BY 1) LEFT JOIN (
      SELECT cohort, COUNT(*) AS np, AVG(CASE WHEN ABS(f) >= ABS(o) * (1 - 1e-12) THEN 1e0 ELSE 0e0 END) AS p FROM (
        SELECT cohort, mask, SUM(d_iae) AS o, SUM(CASE WHEN (mask >> CAST(i AS INT)) & 1 = 1 THEN -d_iae ELSE d_iae END) AS f
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY cohort ORDER BY d_iae) - 1 AS i, COUNT(*) OVER (PARTITION BY cohort) AS n FROM pd WHERE ABS(d_iae) > 0.005), range(1048576) AS m(mask)
        WHERE n <= 20 AND mask < (1 << CAST(n AS INT)) GROUP BY 1, 2) GROUP BY 1) USING (cohort)""", *BASE))
def t6_exact_sign_flip(spark, sf_dir):
    return R.exact_sign_flip(deltas(spark, sf_dir), ["cohort"], "d_iae", cap=20, tolerance=0.005)


@register("t7_leave_one_out", "grp condition_id:i full_mean:d loo_mean:d change:d direction:i flipped:b", with_ctes("cal", """
    SELECT grp, condition_id, m AS full_mean, l AS loo_mean, l - m AS change, CASE WHEN l < -1e-12 THEN -1 WHEN l > 1e-12 THEN 1 ELSE 0 END AS direction, SIGN(l) <> SIGN(m) AS flipped
    FROM (SELECT grp, condition_id, AVG(d_iae) OVER (PARTITION BY grp) AS m, (SUM(d_iae) OVER (PARTITION BY grp) - d_iae) / (COUNT(*) OVER (PARTITION BY grp) - 1) AS l FROM pd)""", *BASE))
def t7_leave_one_out(spark, sf_dir):
    return R.leave_one_out(deltas(spark, sf_dir), ["grp"], "condition_id", "d_iae")


@register("t8_margin_sensitivity", "grp margin:d n_better:i n_worse:i n_equivalent:i", with_ctes("cal", """
    SELECT grp, margin, COUNT(*) FILTER (WHERE d_iae < -GREATEST(margin, 1e-12)) AS n_better, COUNT(*) FILTER (WHERE d_iae > GREATEST(margin, 1e-12)) AS n_worse, COUNT(*) FILTER (WHERE ABS(d_iae) <= GREATEST(margin, 1e-12)) AS n_equivalent
    FROM pd, (VALUES (0.01e0), (0.05e0), (0.1e0), (0.25e0)) AS t(margin) GROUP BY 1, 2""", *BASE))
def t8_margin_sensitivity(spark, sf_dir):
    return R.margin_sensitivity(deltas(spark, sf_dir), ["grp"], "d_iae", [0.01, 0.05, 0.1, 0.25])


_T9 = """un AS (SELECT concat(CAST(temperature_c AS BIGINT), CASE WHEN storage_soc_fraction < 0.5 THEN 'L' ELSE 'H' END) AS u, CASE WHEN storage_soc_fraction < 0.5 THEN 'low' ELSE 'high' END AS r, AVG(ABS(error)) AS s
      FROM pred WHERE method = 'prefix_sqrt' GROUP BY 1, 2),
    ui AS (SELECT *, ROW_NUMBER() OVER (ORDER BY u) - 1 AS i, COUNT(*) OVER () AS n FROM un),
    pm AS (SELECT mask FROM range(4096) AS m(mask) WHERE bit_count(mask) = 6),
    pt AS (SELECT mask, route, COALESCE(n_calibration, 0) AS n_calibration, CEIL((COALESCE(n_calibration, 0) + 1) * 0.6e0) AS rank, multiplier FROM (SELECT * FROM pm, (SELECT DISTINCT r AS route FROM ui)) LEFT JOIN (
      SELECT mask, r AS route, COUNT(*) AS n_calibration, MAX(CASE WHEN k = CEIL((c + 1) * 0.6e0) THEN s END) AS multiplier FROM (SELECT mask, r, s, ROW_NUMBER() OVER (PARTITION BY mask, r ORDER BY s) AS k, COUNT(*) OVER (PARTITION BY mask, r) AS c
        FROM pm, ui WHERE (mask >> CAST(i AS INT)) & 1 = 1) GROUP BY 1, 2) USING (mask, route))"""


def _partitions(spark, sf_dir):
    units = P.with_error(spark, sf_dir).filter("method = 'prefix_sqrt'").withColumns({
        "u": F.concat(F.col("temperature_c").cast("bigint").cast("string"), F.expr("CASE WHEN storage_soc_fraction < 0.5 THEN 'L' ELSE 'H' END")),
        "r": F.expr("CASE WHEN storage_soc_fraction < 0.5 THEN 'low' ELSE 'high' END")}).groupBy("u", "r").agg(F.avg(F.abs("error")).alias("s"))
    return R.partition_sensitivity(units, unit="u", route="r", score="s", choose=6, coverage=0.6)


@register("t9_partition_sensitivity", "mask:i route n_calibration:i rank:i multiplier:d", with_ctes("cal", "SELECT * FROM pt", P.pred_sql(), _T9))
def t9_partition_sensitivity(spark, sf_dir):
    return _partitions(spark, sf_dir)


_T9_PAIRS = """mn AS (SELECT l_suppkey % 18 AS u, CASE WHEN l_suppkey % 3 = 0 THEN 'a' ELSE 'b' END AS r, AVG(l_discount + l_suppkey / 1e4) AS s FROM lineitem GROUP BY 1, 2),
    sc AS (SELECT u, MIN(r) AS r, AVG(s) AS s FROM mn GROUP BY 1)"""


def _many_units(spark, sf_dir):
    """Eighteen units: more than a mask per subset can hold in bounded time, few enough pairs of them."""
    u = F.col("l_suppkey") % 18
    r = F.when(F.col("l_suppkey") % 3 == 0, "a").otherwise("b")
    per = table(spark, sf_dir, "lineitem").groupBy(u.alias("u"), r.alias("r")).agg(F.avg(F.col("l_discount") + F.col("l_suppkey") / 1e4).alias("s"))
    return per.groupBy("u").agg(F.min("r").alias("r"), F.avg("s").alias("s"))


@register("t9_many_units", "a:i b:i route n_calibration:i multiplier:d", f"""WITH {_T9_PAIRS},
    p AS (SELECT a.u AS a, b.u AS b FROM sc a JOIN sc b ON a.u < b.u),
    c AS (SELECT a, b, r, s FROM p JOIN sc ON u <> a AND u <> b),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY a, b, r ORDER BY s) AS k, COUNT(*) OVER (PARTITION BY a, b, r) AS n FROM c)
    SELECT a, b, r AS route, MAX(n) AS n_calibration, MAX(CASE WHEN k = CEIL((n + 1) * 0.6e0) THEN s END) AS multiplier FROM k GROUP BY a, b, r""")
def t9_many_units(spark, sf_dir):
    """Calibration on 16 of 18 units; a and b are the two left out."""
    parts = R.partition_sensitivity(_many_units(spark, sf_dir), unit="u", route="r", score="s", choose=16, coverage=0.6)
    out = F.filter(F.sequence(F.lit(0), F.lit(17)), lambda k: F.floor(F.col("mask") / F.pow(F.lit(2.0), k)) % 2 == 0)
    return parts.withColumn("_o", out).select(F.get("_o", F.lit(0)).alias("a"), F.get("_o", F.lit(1)).alias("b"), "route", "n_calibration", "multiplier")


@register("t9_leave_one_calibration_out", "removed:i route n_calibration:i rank:i multiplier:d change:d covers_removed:b", f"""WITH {_T9_PAIRS},
    f AS (SELECT r, MAX(CASE WHEN k = CEIL((n + 1) * 0.6e0) THEN s END) AS w FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY r ORDER BY s) AS k, COUNT(*) OVER (PARTITION BY r) AS n FROM sc) GROUP BY 1),
    c AS (SELECT x.u AS removed, x.r AS r0, x.s AS s0, y.r, y.s FROM sc x JOIN sc y ON x.u <> y.u),
    k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY removed, r ORDER BY s) AS k, COUNT(*) OVER (PARTITION BY removed, r) AS n FROM c),
    m AS (SELECT removed, r0, s0, r, MAX(n) AS n, MAX(CASE WHEN k = CEIL((n + 1) * 0.6e0) THEN s END) AS m FROM k GROUP BY 1, 2, 3, 4)
    SELECT removed, r AS route, n AS n_calibration, CEIL((n + 1) * 0.6e0) AS rank, m AS multiplier, m - w AS change, CASE WHEN r = r0 THEN s0 <= m END AS covers_removed FROM m JOIN f USING (r)""")
def t9_leave_one_calibration_out(spark, sf_dir):
    return R.leave_one_calibration_out(_many_units(spark, sf_dir), unit="u", route="r", score="s", coverage=0.6)


@register("t9_partition_summary", "route n_partitions:i n_finite:i min_calibration:i max_calibration:i multiplier_min:d multiplier_q25:d multiplier_median:d multiplier_q75:d multiplier_max:d", with_ctes("cal", """
    SELECT route, COUNT(*) AS n_partitions, COUNT(multiplier) AS n_finite, MIN(n_calibration) AS min_calibration, MAX(n_calibration) AS max_calibration, MIN(multiplier) AS multiplier_min, QUANTILE_CONT(multiplier, 0.25) AS multiplier_q25,
      MEDIAN(multiplier) AS multiplier_median, QUANTILE_CONT(multiplier, 0.75) AS multiplier_q75, MAX(multiplier) AS multiplier_max FROM pt GROUP BY 1""", P.pred_sql(), _T9))
def t9_partition_summary(spark, sf_dir):
    return R.partition_summary(_partitions(spark, sf_dir))


_T10 = """cells AS (SELECT FLOOR(c_custkey * 10 / 51e0) AS protocol, c_custkey AS cell, 500 + c_acctbal / 20 AS y, 800e0 AS z, 500 + c_nationkey * 20e0 AS p FROM customer),
    perms AS (SELECT [a, b, c, d, e] AS pm, ROW_NUMBER() OVER (ORDER BY a, b, c, d, e) - 1 AS assignment FROM range(5) t1(a), range(5) t2(b), range(5) t3(c), range(5) t4(d), range(5) t5(e)
      WHERE a NOT IN (b, c, d, e) AND b NOT IN (c, d, e) AND c NOT IN (d, e) AND d <> e),
    ci AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY protocol ORDER BY cell) - 1 AS i FROM cells
      WHERE protocol IN (SELECT protocol FROM cells GROUP BY 1 HAVING COUNT(*) = 5)),
    sup AS (SELECT protocol, assignment, source_mape, null_mape, source_mape < null_mape AS improved FROM (SELECT a.protocol, assignment, SUM(ABS(a.p - b.y) / b.y) / 5 AS source_mape, SUM(ABS(a.z - b.y) / b.y) / 5 AS null_mape
      FROM ci a, perms, ci b WHERE b.protocol = a.protocol AND b.i = pm[a.i + 1] GROUP BY 1, 2))"""


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") * 10 / 51.0).alias("protocol"), F.col("c_custkey").alias("cell"),
        (500 + F.col("c_acctbal") / 20).alias("y"), F.lit(800.0).alias("z"), (500 + F.col("c_nationkey") * 20.0).alias("p"),
    )


def _support(spark, sf_dir):
    return R.assignment_support(_cells(spark, sf_dir), "protocol", slots=5, prediction="p", outcome="y", null_prediction="z")


@register("t10_assignment_bounds", "protocol:i observed_delta:d best_delta:d worst_delta:d can_improve:b always_improves:b", with_ctes("", """
    SELECT protocol, MAX(CASE WHEN assignment = 0 THEN source_mape - null_mape END) AS observed_delta, MIN(source_mape - null_mape) AS best_delta, MAX(source_mape - null_mape) AS worst_delta,
      bool_or(improved) AS can_improve, bool_and(improved) AS always_improves FROM sup GROUP BY 1""", _T10))
def t10_assignment_bounds(spark, sf_dir):
    return R.assignment_bounds(_support(spark, sf_dir), "protocol")


@register("t10_excluded_protocols", "protocol:i n_cells:i", with_ctes("", """
    SELECT protocol, COUNT(*) AS n_cells FROM cells GROUP BY 1 HAVING COUNT(*) <> 5""", _T10))
def t10_excluded_protocols(spark, sf_dir):
    return R.excluded_protocols(_cells(spark, sf_dir), "protocol", slots=5)


@register("t10_joint_assignments", "draw:i delta_mape:d improvement:d n_improved:i gate_passed:b", with_ctes("", """
    SELECT draw, AVG(source_mape - null_mape) AS delta_mape, 1 - AVG(source_mape) / AVG(null_mape) AS improvement, COUNT(*) FILTER (WHERE improved) AS n_improved,
      1 - AVG(source_mape) / AVG(null_mape) >= 0.05 AND COUNT(*) FILTER (WHERE improved) >= 100 AS gate_passed
    FROM (SELECT protocol, draw, CAST('0x' || SUBSTR(sha256(concat_ws('|', 'joint', draw, CAST(protocol AS BIGINT))), 1, 13) AS BIGINT) % 120 AS assignment FROM (SELECT DISTINCT protocol FROM sup), range(50) AS r(draw))
    JOIN sup USING (protocol, assignment) GROUP BY 1""", _T10))
def t10_joint_assignments(spark, sf_dir):
    return R.joint_assignments(_cells(spark, sf_dir), "protocol", slots=5, prediction="p", outcome="y", null_prediction="z", draws_=50, seed="joint", minimum_gain=0.05, minimum_protocols=100)


@register("t11_permutation_control", "permutation:i n_issued:i issued_rate:d pool_rate:d risk_reduction:d", with_ctes("pool", """
    SELECT permutation, COUNT(*) AS n_issued, AVG(c) AS issued_rate, MAX(pr) AS pool_rate, 1 - AVG(c) / MAX(pr) AS risk_reduction FROM (
      SELECT permutation, c, pr, k, ROW_NUMBER() OVER (PARTITION BY permutation ORDER BY score, content_hash) AS r FROM (
        SELECT d.permutation, q.content_hash, q.c, q.danger + 0.25e0 * d.disagreement + -0.5e0 * d.iae AS score FROM (SELECT family, permutation, disagreement, iae, ROW_NUMBER() OVER (PARTITION BY family, permutation
            ORDER BY sha256(concat_ws('|', 'perm', permutation, family, content_hash)), content_hash) AS pos FROM ep, range(4) AS t(permutation)) d
          JOIN (SELECT *, CASE WHEN catastrophic THEN 1e0 ELSE 0e0 END AS c, ROW_NUMBER() OVER (PARTITION BY family ORDER BY content_hash) AS pos FROM ep) q ON q.family = d.family AND q.pos = d.pos),
        (SELECT FLOOR(COUNT(*) * 0.5) AS k, AVG(CASE WHEN catastrophic THEN 1e0 ELSE 0e0 END) AS pr FROM ep)) WHERE r <= k GROUP BY 1""", POOL_SQL, "ep AS (SELECT * FROM pf WHERE eligible)"))
def t11_permutation_control(spark, sf_dir):
    pool = pool_flags(spark, sf_dir).filter("eligible")
    return R.permutation_control(pool, family="family", tie="content_hash", base_score="danger", block=["disagreement", "iae"], weights=[0.25, -0.5], catastrophic="catastrophic",
                                 issue_fraction=0.5, permutations_=4, seed="perm")


@register("t13_sign_diagnostics", "grp n_negative:i n_positive:i n_zero:i superiority_p:d two_sided_p:d", with_ctes("cal", f"""
    SELECT *, CASE WHEN n = 0 THEN 1 ELSE pu END AS superiority_p, CASE WHEN n = 0 THEN 1 ELSE LEAST(1, 2 * LEAST(pu, pl)) END AS two_sided_p
    FROM (SELECT *, n_negative + n_positive AS n, {tail_sql('(n_negative + n_positive)', 'n_positive')} AS pu, {tail_sql('(n_negative + n_positive)', 'n_negative')} AS pl FROM sg)""", *BASE, _SG))
def t13_sign_diagnostics(spark, sf_dir):
    return R.sign_diagnostics(deltas(spark, sf_dir), ["grp"], "d_iae", tolerance=0.01)


@register("t14_replicate_summary", "n_replicates:i n_undefined:i visible_p05:d increment_p05:d increment_p975:d status", with_ctes("pool", """
    SELECT COUNT(*) AS n_replicates, 0 AS n_undefined, QUANTILE_CONT(reduction_visible, 0.05) AS visible_p05, QUANTILE_CONT(increment, 0.05) AS increment_p05, QUANTILE_CONT(increment, 0.975) AS increment_p975, 'ok' AS status FROM bt""", POOL_SQL, _T4))
def t14_replicate_summary(spark, sf_dir):
    return R.replicate_summary(_stratified(spark, sf_dir), {"visible_p05": ("reduction_visible", 0.05), "increment_p05": ("increment", 0.05), "increment_p975": ("increment", 0.975)})
