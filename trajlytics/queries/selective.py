"""Ranking and selective-prediction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.operators import intervals as H
from trajlytics.operators import selective as Q
from trajlytics.queries.contracts import FIT_EXPRS
from trajlytics.queries.intervals import exact_bound_sql
from trajlytics.queries.registry import register
from trajlytics.queries.scoring import POOL_SQL, pool_flags
from trajlytics.sources import adapters as A
from trajlytics.sources.adapters import table, with_ctes

# Envelope points: one per line item of a cluster.
POINT_EXPRS = {
    "cluster_id": "l_orderkey", "point": "CASE WHEN l_discount = 1e-1 AND l_tax = 8e-2 THEN CAST('NaN' AS DOUBLE) ELSE 1e2 - l_quantity END",
    "lower": "9.5e1 - l_quantity - 1e2 * l_tax", "upper": "CASE WHEN l_discount = 9e-2 AND l_tax = 8e-2 THEN NULL ELSE 1e2 - l_quantity + 5e1 * l_discount END",
}
QUOTA = 500
_DEC = [f"fits AS (SELECT o_orderpriority AS partition_id, f.* FROM (SELECT {A._sql(FIT_EXPRS)} FROM lineitem) f JOIN orders ON o_orderkey = cluster_id)",
    f"points AS (SELECT o_orderpriority AS partition_id, p.* FROM (SELECT {A._sql(POINT_EXPRS)} FROM lineitem) p JOIN orders ON o_orderkey = cluster_id)",
    """mem AS (SELECT cluster_id, COUNT(DISTINCT CASE WHEN credible_variant THEN model_id END) AS credible_families, COUNT(*) FILTER (WHERE fit_status <> 'ok') AS fit_failures,
        MIN(CASE WHEN fit_status = 'ok' THEN prefix_rmse_pp END) AS best_rmse_pp FROM fits GROUP BY 1)""",
    """env AS (SELECT partition_id, cluster_id, MAX(upper - lower) AS w, bool_and(lower IS NOT NULL AND upper IS NOT NULL) AS e, bool_and(NOT isnan(point)) AS p FROM points GROUP BY 1, 2)""",
    """jd AS (SELECT partition_id, cluster_id, credible_families, fit_failures, best_rmse_pp, CASE WHEN credible_families >= 2 AND e THEN w END AS disagreement, p,
        credible_families >= 2 AND e AND p AS eligible, sha256('proto|' || sha256(CAST(cluster_id AS VARCHAR))) AS th FROM env JOIN mem USING (cluster_id))""",
    """rk AS (SELECT partition_id, cluster_id, ROW_NUMBER() OVER (PARTITION BY partition_id ORDER BY disagreement, th, cluster_id) AS issuance_rank FROM jd WHERE eligible)""",
    f"""decisions AS (SELECT jd.*, issuance_rank, COALESCE(issuance_rank <= {QUOTA}, FALSE) AS issued, concat_ws(';', CASE WHEN credible_families < 2 THEN 'fewer_than_two_credible_families' END,
        CASE WHEN disagreement IS NULL THEN 'nonfinite_disagreement' END, CASE WHEN NOT p THEN 'nonfinite_point_forecast' END, CASE WHEN issuance_rank > {QUOTA} THEN 'ranked_above_quota' END) AS reason_text
        FROM jd LEFT JOIN rk USING (partition_id, cluster_id))"""]


def decisions(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cluster_id"), F.col("o_orderpriority").alias("partition_id"))
    fits = items.select(*A._select(FIT_EXPRS)).join(orders, "cluster_id")
    points = items.select(*A._select(POINT_EXPRS)).join(orders, "cluster_id").withColumn("content_hash", F.sha2(F.col("cluster_id").cast("string"), 256))
    return Q.envelope_decisions(fits, points, partition="partition_id", entity="cluster_id", quota=QUOTA, protocol="proto")


@register("q1_envelope_decisions", "partition_id cluster_id:i credible_families:i fit_failures:i best_rmse_pp:d disagreement:d eligible:b issuance_rank:i issued:b reason_text",
          with_ctes("", "SELECT * FROM decisions", *_DEC))
def q1_envelope_decisions(spark, sf_dir):
    return decisions(spark, sf_dir).withColumn("reason_text", F.array_join("reasons", ";"))


RANKED_SQL = """ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY partition_id ORDER BY danger, content_hash, cluster_id) AS rank, COUNT(*) OVER (PARTITION BY partition_id) AS pn FROM pf WHERE eligible)"""


def _eligible(spark, sf_dir):
    return pool_flags(spark, sf_dir).filter("eligible").drop("issued")


def _ranked(spark, sf_dir):
    return Q.rank_for_issuance(_eligible(spark, sf_dir), ["partition_id"], score="danger", tie="content_hash", ordinal="cluster_id", fraction=0.5)


@register("q2_rank_for_issuance", "partition_id cluster_id:i danger:d rank:i issued:b", with_ctes("pool", "SELECT *, rank <= FLOOR(pn * 0.5) AS issued FROM ranked",
          POOL_SQL.replace(", disagreement < 9e0 AND danger < 8e-1 AS issued", ""), RANKED_SQL))
def q2_rank_for_issuance(spark, sf_dir):
    return _ranked(spark, sf_dir)


@register("q2_least_dangerous", "cluster_id:i danger:d content_hash", with_ctes("pool", "SELECT cluster_id, danger, content_hash FROM pool ORDER BY danger, content_hash LIMIT 100"))
def q2_least_dangerous(spark, sf_dir):
    return Q.least_dangerous(A.pool(spark, sf_dir), "danger", "content_hash", 100)


_PAIRS = "prs AS (SELECT a.o_orderkey // 2 AS pair_id, a.o_orderkey AS left_id, b.o_orderkey AS right_id FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 AND a.o_orderkey % 2 = 0)"


def pairs(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return ids.groupBy(F.floor(F.col("id") / 2).alias("pair_id")).agg(F.min("id").alias("left_id"), F.max("id").alias("right_id")).filter("left_id < right_id")


@register("q3_calibration_threshold", "threshold:d n_eligible:i", with_ctes("", "SELECT MAX(CASE WHEN issuance_rank = 250 THEN disagreement END) AS threshold, COUNT(*) AS n_eligible FROM decisions WHERE partition_id = '1-URGENT' AND eligible", *_DEC))
def q3_calibration_threshold(spark, sf_dir):
    return Q.calibration_threshold(decisions(spark, sf_dir), "partition_id", "1-URGENT", 250)


@register("q3_matched_pair_rejection", "pair_id:i left_score:d right_score:d left_rejected:b right_rejected:b both_rejected:b", with_ctes("", """
    SELECT pair_id, l.disagreement AS left_score, r.disagreement AS right_score, COALESCE(l.disagreement > t, FALSE) AS left_rejected, COALESCE(r.disagreement > t, FALSE) AS right_rejected,
      COALESCE(l.disagreement > t, FALSE) AND COALESCE(r.disagreement > t, FALSE) AS both_rejected
    FROM prs JOIN decisions l ON left_id = l.cluster_id JOIN decisions r ON right_id = r.cluster_id,
      (SELECT MAX(CASE WHEN issuance_rank = 250 THEN disagreement END) AS t FROM decisions WHERE partition_id = '1-URGENT' AND eligible)""", *_DEC, _PAIRS))
def q3_matched_pair_rejection(spark, sf_dir):
    dec = decisions(spark, sf_dir)
    return Q.matched_pair_rejection(pairs(spark, sf_dir), dec, Q.calibration_threshold(dec, "partition_id", "1-URGENT", 250), "cluster_id")


@register("q4_risk_reduction", "partition_id n_eligible:i n_issued:i random_rate:d issued_rate:d risk_reduction:d status", with_ctes("pool", """
    SELECT *, 1 - issued_rate / random_rate AS risk_reduction, 'ok' AS status FROM (SELECT partition_id, COUNT(*) FILTER (WHERE eligible) AS n_eligible, COUNT(*) FILTER (WHERE issued) AS n_issued,
      AVG(CAST(catastrophic AS INT)) FILTER (WHERE eligible) AS random_rate, AVG(CAST(catastrophic AS INT)) FILTER (WHERE issued) AS issued_rate FROM pf GROUP BY 1)""", POOL_SQL))
def q4_risk_reduction(spark, sf_dir):
    return Q.risk_reduction(pool_flags(spark, sf_dir), ["partition_id"], eligible="eligible", issued="issued", catastrophic="catastrophic")


ISSUE, RANKINGS = 1000, 20
_RND = f"""rnd AS (SELECT ranking_index, COUNT(*) AS n_issued, AVG(CAST(catastrophic AS INT)) AS issued_rate FROM (SELECT i AS ranking_index, catastrophic,
      ROW_NUMBER() OVER (PARTITION BY i ORDER BY sha256(concat_ws('|', 'root', i, content_hash)), content_hash) AS r FROM pf, range({RANKINGS}) AS t(i) WHERE eligible) WHERE r <= {ISSUE} GROUP BY 1),
    ex AS (SELECT AVG(CAST(catastrophic AS INT)) AS expected_rate FROM pf WHERE eligible)"""


def _random(spark, sf_dir):
    return Q.random_rankings(_eligible(spark, sf_dir), tie="content_hash", catastrophic="catastrophic", issue_count=ISSUE, rankings=RANKINGS, seed="root")


@register("q5_random_rankings", "ranking_index:i n_issued:i issued_rate:d expected_rate:d risk_reduction:d", with_ctes("pool", "SELECT *, 1 - issued_rate / expected_rate AS risk_reduction FROM rnd, ex", POOL_SQL, _RND))
def q5_random_rankings(spark, sf_dir):
    return _random(spark, sf_dir)


@register("q6_risk_coverage_curve", "partition_id n_issued:i coverage:d n_catastrophic:i catastrophic_rate:d mean_iae:d max_issued_score:d marker:d", with_ctes("pool", """
    SELECT partition_id, rank AS n_issued, rank / pn AS coverage, SUM(CAST(catastrophic AS INT)) OVER w AS n_catastrophic, SUM(CAST(catastrophic AS INT)) OVER w / rank AS catastrophic_rate, SUM(iae) OVER w / rank AS mean_iae,
      MAX(danger) OVER w AS max_issued_score, CASE WHEN rank = ROUND_EVEN(pn * 0.25e0, 0) THEN 0.25 WHEN rank = ROUND_EVEN(pn * 0.5e0, 0) THEN 0.5 WHEN rank = ROUND_EVEN(pn * 0.75e0, 0) THEN 0.75 END AS marker
    FROM ranked WINDOW w AS (PARTITION BY partition_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", POOL_SQL, RANKED_SQL))
def q6_risk_coverage_curve(spark, sf_dir):
    return Q.risk_coverage_curve(_ranked(spark, sf_dir), ["partition_id"], rank="rank", catastrophic="catastrophic", iae="iae", score="danger")


@register("q7_fraction_policies", "partition_id fraction:d quota:i n_issued:i issued_rate:d pool_rate:d risk_reduction:d", with_ctes("pool", """
    SELECT partition_id, fraction, MAX(q) AS quota, COUNT(*) FILTER (WHERE rank <= q) AS n_issued, AVG(c) FILTER (WHERE rank <= q) AS issued_rate, AVG(c) AS pool_rate, 1 - AVG(c) FILTER (WHERE rank <= q) / AVG(c) AS risk_reduction
    FROM (SELECT *, ROUND_EVEN(pn * fraction, 0) AS q, CASE WHEN catastrophic THEN 1e0 ELSE 0e0 END AS c FROM ranked, (VALUES (0.25e0), (0.5e0), (0.75e0)) AS f(fraction)) GROUP BY 1, 2""", POOL_SQL, RANKED_SQL))
def q7_fraction_policies(spark, sf_dir):
    return Q.fraction_policies(_ranked(spark, sf_dir), ["partition_id"], rank="rank", catastrophic="catastrophic", fractions=[0.25, 0.5, 0.75])


@register("q8_auroc", "partition_id n_rows:i n_positive:i auroc:d", with_ctes("pool", """
    SELECT partition_id, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE catastrophic) AS n_positive, (SUM(r) FILTER (WHERE catastrophic) - COUNT(*) FILTER (WHERE catastrophic) * (COUNT(*) FILTER (WHERE catastrophic) + 1) / 2.0e0)
      / (COUNT(*) FILTER (WHERE catastrophic) * COUNT(*) FILTER (WHERE NOT catastrophic)) AS auroc
    FROM (SELECT *, RANK() OVER (PARTITION BY partition_id ORDER BY disagreement) + (COUNT(*) OVER (PARTITION BY partition_id, disagreement) - 1) / 2.0e0 AS r FROM pf WHERE eligible) GROUP BY 1""", POOL_SQL))
def q8_auroc(spark, sf_dir):
    return Q.auroc(_eligible(spark, sf_dir), ["partition_id"], score="disagreement", label="catastrophic", bucket="FLOOR(disagreement * 10)")


ARMS = {"prefix": "danger", "visible": "disagreement"}


def subset_sql(subset: str) -> str:
    return f"""arm AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {subset} ORDER BY danger, sha256('p|prefix|' || content_hash)) AS r0, ROW_NUMBER() OVER (PARTITION BY {subset} ORDER BY disagreement, sha256('p|visible|' || content_hash)) AS r1,
        COUNT(*) OVER (PARTITION BY {subset}) // 2 AS k, CASE WHEN catastrophic THEN 1e0 ELSE 0e0 END AS c FROM pf WHERE eligible),
      sub AS (SELECT {subset}, COUNT(*) AS n_eligible, COUNT(*) FILTER (WHERE catastrophic) AS n_catastrophic, MAX(k) AS n_issued, 1 - AVG(c) FILTER (WHERE r0 <= k) / AVG(c) AS reduction_prefix,
        1 - AVG(c) FILTER (WHERE r1 <= k) / AVG(c) AS reduction_visible, AVG(c) FILTER (WHERE r0 <= k) / AVG(c) - AVG(c) FILTER (WHERE r1 <= k) / AVG(c) AS increment FROM arm GROUP BY 1)"""


def _subset(spark, sf_dir, subset):
    return Q.subset_rerank(_eligible(spark, sf_dir), subset, ARMS, tie="content_hash", catastrophic="catastrophic", protocol="p")


@register("q9_subset_rerank", "subset_id n_eligible:i n_catastrophic:i n_issued:i reduction_prefix:d reduction_visible:d increment:d", with_ctes("pool", "SELECT * FROM sub", POOL_SQL, subset_sql("subset_id")))
def q9_subset_rerank(spark, sf_dir):
    return _subset(spark, sf_dir, "subset_id")


_SRC = "src AS (SELECT family, COUNT(*) AS n_source FROM pool GROUP BY 1)"


def _with_source(spark, sf_dir):
    src = A.pool(spark, sf_dir).groupBy("family").agg(F.count(F.lit(1)).alias("n_source"))
    return _subset(spark, sf_dir, "family").join(src, "family")


@register("q10_family_gates", "family estimate:d reasons status", with_ctes("pool", """
    SELECT family, CASE WHEN rs = '' THEN reduction_visible END AS estimate, rs AS reasons, CASE WHEN rs <> '' THEN 'inconclusive' WHEN reduction_visible >= 0 THEN 'passed' ELSE 'failed' END AS status
    FROM (SELECT *, concat_ws(';', CASE WHEN n_source <> 5029 THEN 'source_count' END, CASE WHEN n_eligible < CEIL(0.9 * 5029) THEN 'eligible_count' END, CASE WHEN n_catastrophic < 30 THEN 'catastrophic_count' END) AS rs
      FROM sub JOIN src USING (family))""", POOL_SQL, subset_sql("family"), _SRC))
def q10_family_gates(spark, sf_dir):
    return Q.family_gates(_with_source(spark, sf_dir), "family", expected=5029, min_eligible_share=0.9, min_catastrophic=30, reduction="reduction_visible")


@register("q10_directional_gates", "family gate estimate:d status", with_ctes("pool", """
    SELECT family, gate, CASE WHEN ok THEN e END AS estimate, CASE WHEN NOT ok THEN 'inconclusive' WHEN e > 0 THEN 'passed' ELSE 'failed' END AS status
    FROM (SELECT family, n_source >= 1000 AND n_catastrophic >= 20 AS ok, UNNEST([{'gate': 'positive_risk_reduction', 'e': reduction_visible}, {'gate': 'positive_increment', 'e': increment}], recursive := true)
      FROM sub JOIN src USING (family))""", POOL_SQL, subset_sql("family"), _SRC))
def q10_directional_gates(spark, sf_dir):
    return Q.directional_gates(_with_source(spark, sf_dir), "family", minimum_source=1000, minimum_catastrophic=20, reduction="reduction_visible", increment="increment")


_MEMB = "memb AS (SELECT *, iae < 2 AS covered, FLOOR(iae * 2) AS width, FLOOR(danger * 10) AS coarse FROM pf)"


def _members(spark, sf_dir):
    return pool_flags(spark, sf_dir).withColumns({"covered": F.col("iae") < 2, "width": F.floor(F.col("iae") * 2).cast("double"), "coarse": F.floor(F.col("danger") * 10).cast("double")})


@register("q11_pair_coverage", "pair_id:i both_covered:b width_equal:b max_width:d", with_ctes("pool", """
    SELECT pair_id, l.covered AND r.covered AS both_covered, l.width IS NOT DISTINCT FROM r.width AS width_equal, GREATEST(l.width, r.width) AS max_width
    FROM prs JOIN memb l ON left_id = l.cluster_id JOIN memb r ON right_id = r.cluster_id""", POOL_SQL, _MEMB, _PAIRS))
def q11_pair_coverage(spark, sf_dir):
    return Q.pair_coverage(pairs(spark, sf_dir), _members(spark, sf_dir), "cluster_id", covered="covered", width="width")


@register("q12_pair_discrimination", "pair_id:i score_delta:d error_delta:d correct_order:b", with_ctes("pool", """
    SELECT pair_id, l.coarse - r.coarse AS score_delta, l.endpoint_error - r.endpoint_error AS error_delta, (l.coarse - r.coarse) * (l.endpoint_error - r.endpoint_error) > 0 AS correct_order
    FROM prs JOIN memb l ON left_id = l.cluster_id JOIN memb r ON right_id = r.cluster_id""", POOL_SQL, _MEMB, _PAIRS))
def q12_pair_discrimination(spark, sf_dir):
    return Q.pair_discrimination(pairs(spark, sf_dir), _members(spark, sf_dir), "cluster_id", score="coarse", error="endpoint_error")


@register("q12_pair_summary", "n_pairs:i n_correct:i fraction:d cp_lower:d cp_upper:d", with_ctes("pool", f"""
    SELECT n AS n_pairs, k AS n_correct, k / n AS fraction, {exact_bound_sql('k', 'n', 0.025)} AS cp_lower, {exact_bound_sql('k', 'n', 0.025, upper=True)} AS cp_upper
    FROM (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE (l.coarse - r.coarse) * (l.endpoint_error - r.endpoint_error) > 0) AS k
      FROM prs JOIN memb l ON left_id = l.cluster_id JOIN memb r ON right_id = r.cluster_id)""", POOL_SQL, _MEMB, _PAIRS))
def q12_pair_summary(spark, sf_dir):
    scores = Q.pair_discrimination(pairs(spark, sf_dir), _members(spark, sf_dir), "cluster_id", score="coarse", error="endpoint_error")
    agg = scores.agg(F.count(F.lit(1)).alias("n_pairs"), F.count(F.when(F.col("correct_order"), 1)).alias("n_correct")).withColumn("fraction", F.col("n_correct") / F.col("n_pairs"))
    return H.with_clopper_pearson(agg, "n_correct", "n_pairs", two_sided=True)


@register("q13_pair_invariance", "output n_pairs:i n_mismatch:i", with_ctes("pool", """
    SELECT UNNEST([{'output': 'covered', 'n_mismatch': COUNT(*) FILTER (WHERE l.covered IS DISTINCT FROM r.covered)}, {'output': 'coarse', 'n_mismatch': COUNT(*) FILTER (WHERE l.coarse IS DISTINCT FROM r.coarse)},
      {'output': 'eligible', 'n_mismatch': COUNT(*) FILTER (WHERE l.eligible IS DISTINCT FROM r.eligible)}], recursive := true), COUNT(*) AS n_pairs
    FROM prs JOIN memb l ON left_id = l.cluster_id JOIN memb r ON right_id = r.cluster_id""", POOL_SQL, _MEMB, _PAIRS))
def q13_pair_invariance(spark, sf_dir):
    return Q.pair_invariance(pairs(spark, sf_dir), _members(spark, sf_dir), "cluster_id", ["covered", "coarse", "eligible"])


@register("q14_probability_diagnostics", "family n_rows:i n_positive:i n_invalid:i mean_probability:d prevalence:d brier:d", with_ctes("pool", """
    SELECT family, COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE catastrophic) AS n_positive, COUNT(*) FILTER (WHERE danger > 1) AS n_invalid, CASE WHEN MAX(danger) <= 1 THEN AVG(danger) END AS mean_probability,
      CASE WHEN MAX(danger) <= 1 THEN AVG(CAST(catastrophic AS INT)) END AS prevalence, CASE WHEN MAX(danger) <= 1 THEN AVG(POWER(danger - CAST(catastrophic AS INT), 2)) END AS brier FROM pf GROUP BY 1""", POOL_SQL))
def q14_probability_diagnostics(spark, sf_dir):
    return Q.probability_diagnostics(pool_flags(spark, sf_dir), ["family"], "danger", "catastrophic")


@register("q15_policy_comparison", "arm n_eligible:i n_issued:i issued_rate:d random_mean_rate:d coverage:d risk_reduction:d", with_ctes("pool", f"""
    SELECT arm, n_eligible, n_issued, issued_rate, m AS random_mean_rate, n_issued / n_eligible AS coverage, 1 - issued_rate / m AS risk_reduction FROM (
      SELECT arm, COUNT(*) AS n_eligible, COUNT(*) FILTER (WHERE r <= {ISSUE}) AS n_issued, AVG(CAST(catastrophic AS INT)) FILTER (WHERE r <= {ISSUE}) AS issued_rate FROM (
        SELECT 'prefix' AS arm, catastrophic, ROW_NUMBER() OVER (ORDER BY danger, sha256('p|prefix|' || content_hash)) AS r FROM pf WHERE eligible UNION ALL
        SELECT 'visible', catastrophic, ROW_NUMBER() OVER (ORDER BY disagreement, sha256('p|visible|' || content_hash)) FROM pf WHERE eligible) GROUP BY 1), (SELECT AVG(issued_rate) AS m FROM rnd)""", POOL_SQL, _RND))
def q15_policy_comparison(spark, sf_dir):
    mean = _random(spark, sf_dir).agg(F.avg("issued_rate").alias("random_mean_rate"))
    return Q.policy_comparison(_eligible(spark, sf_dir), ARMS, tie="content_hash", catastrophic="catastrophic", protocol="p", issue_count=ISSUE, random_mean=mean)
