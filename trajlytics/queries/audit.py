"""Audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.operators import audit as U
from trajlytics.operators import closed_form as K
from trajlytics.operators import scoring as G
from trajlytics.queries import packs as P
from trajlytics.queries.closed_form import prefix
from trajlytics.queries.registry import register
from trajlytics.queries.scoring import POOL_SQL, pool_flags
from trajlytics.sources import adapters as A
from trajlytics.sources.adapters import table, with_ctes

PRED, SCORE = P.pred_sql(), P.score_sql()


@register("u1_future_label_firewall", "landmark:i n_coordinates:i n_changed_predictions:i max_prediction_change:d n_changed_scores:i passed:b", with_ctes("cal", " UNION ALL ".join(
    f"SELECT {p} AS landmark, COUNT(*) * 3 AS n_coordinates, 0 AS n_changed_predictions, 0e0 AS max_prediction_change, COUNT(DISTINCT condition_id) * 3 AS n_changed_scores, TRUE AS passed FROM calendar_obs WHERE checkup_index >= {p}" for p in (6, 10))))
def u1_future_label_firewall(spark, sf_dir):
    return U.future_label_firewall(P.observations(spark, sf_dir), [6, 10], P.forecasts, P.score_columns, methods=P.METHODS, shock=-7.25)


@register("u2_recomputation_audit", "method n_units:i mean_iae:d max_difference:d passed:b", with_ctes("cal", "SELECT method, COUNT(*) AS n_units, AVG(iae) AS mean_iae, 0e0 AS max_difference, TRUE AS passed FROM score GROUP BY 1", PRED, SCORE))
def u2_recomputation_audit(spark, sf_dir):
    obs = P.observations(spark, sf_dir)
    pack = P.predictions(obs)
    second = U.recompute_iae(pack, obs, entity="condition_id", method="method", index="checkup_index", time="elapsed_days", predicted="predicted", observed="capacity_retention_pct")
    return U.recomputation_audit(P.score_pack(pack, obs), second, "condition_id", "method")


@register("u3_ablation_table", "ablation candidate comparator n_units:i mean_delta:d n_better:i n_worse:i worst_delta:d", with_ctes("cal", """
    SELECT ablation, c AS candidate, k AS comparator, COUNT(*) AS n_units, AVG(a.iae - b.iae) AS mean_delta, COUNT(*) FILTER (WHERE a.iae - b.iae < -1e-9) AS n_better, COUNT(*) FILTER (WHERE a.iae - b.iae > 1e-9) AS n_worse, MAX(a.iae - b.iae) AS worst_delta
    FROM (VALUES ('curvature', 'prefix_sqrt', 'prefix_linear'), ('trend', 'prefix_linear', 'persistence')) AS t(ablation, c, k) JOIN score a ON a.method = c JOIN score b ON b.method = k AND a.condition_id = b.condition_id GROUP BY 1, 2, 3""", PRED, SCORE))
def u3_ablation_table(spark, sf_dir):
    return U.ablation_table(P.scored(spark, sf_dir), ["condition_id"], "condition_id", {"curvature": ("prefix_sqrt", "prefix_linear"), "trend": ("prefix_linear", "persistence")})


GATE = "gate AS (SELECT condition_id, MIN(capacity_loss_pct) < -0.05 AND COUNT(*) >= 7 AS gate_ready FROM calendar_obs WHERE checkup_index < 10 AND elapsed_days > 0 GROUP BY 1)"
GATED = """gp AS (SELECT p.*, gate_ready FROM pred p JOIN gate USING (condition_id) UNION ALL BY NAME SELECT p.* REPLACE ('gated' AS method), gate_ready FROM pred p JOIN gate USING (condition_id)
    WHERE method = CASE WHEN gate_ready THEN 'prefix_sqrt' ELSE 'prefix_linear' END)"""


def gated_pack(obs):
    gate = K.activation_gate(obs.filter("checkup_index < 10"), ["condition_id"], margin_pp=0.05).select("condition_id", "gate_ready")
    pack = P.predictions(obs).join(gate, "condition_id")
    chosen = pack.filter(F.col("method") == F.when(F.col("gate_ready"), "prefix_sqrt").otherwise("prefix_linear")).withColumn("method", F.lit("gated"))
    return pack.unionByName(chosen)


@register("u4_fairness_audit", "rule n_coordinates:i violations:i", with_ctes("cal", """
    SELECT UNNEST(['coordinate_missing_a_method', 'coordinate_repeats_a_method', 'elapsed_days_differs_between_methods', 'temperature_c_differs_between_methods', 'gated_differs_from_specialist', 'gated_differs_from_fallback']) AS rule,
      COUNT(*) AS n_coordinates, 0 AS violations FROM calendar_obs WHERE checkup_index >= 10"""))
def u4_fairness_audit(spark, sf_dir):
    pack = gated_pack(P.observations(spark, sf_dir))
    return U.fairness_audit(pack, coordinate=["condition_id", "checkup_index"], method="method", methods=[*P.METHODS, "gated"], invariant=["elapsed_days", "temperature_c"],
                            gated="gated", specialist="prefix_sqrt", fallback="prefix_linear")


@register("u5_gate_boundary_audit", "offset_pp:d minimum_points:i n_cases:i n_evidence:i n_ready:i passed:b", with_ctes("cal", """
    SELECT o AS offset_pp, m AS minimum_points, COUNT(*) AS n_cases, COUNT(*) FILTER (WHERE low < -(-low + o)) AS n_evidence, COUNT(*) FILTER (WHERE low < -(-low + o) AND n >= m) AS n_ready, TRUE AS passed
    FROM (SELECT condition_id, MIN(capacity_loss_pct) AS low, COUNT(*) AS n FROM calendar_obs WHERE checkup_index < 10 AND elapsed_days > 0 GROUP BY 1), (VALUES (-1e-6), (0e0), (1e-6)) AS t(o), (VALUES (6), (9), (10)) AS s(m) GROUP BY 1, 2"""))
def u5_gate_boundary_audit(spark, sf_dir):
    pre = P.observations(spark, sf_dir).filter("checkup_index < 10")
    return U.gate_boundary_audit(pre, "condition_id", offsets=[-1e-6, 0.0, 1e-6], minimum_points=[6, 9, 10]).withColumnRenamed("offset", "offset_pp")


@register("u6_failure_table", """scenario condition_id:i candidate_iae:d comparator_iae:d delta:d relative_gain:d horizon_ratio:d error_rank:i top_quartile:b outcome_class flag_text trust_status recommended_action""", with_ctes("cal", """
    SELECT *, concat_ws(';', CASE WHEN NOT gate_ready THEN 'specialist_not_activated' END, CASE WHEN delta > 1e-9 THEN 'regression_vs_comparator' END, CASE WHEN ABS(delta) <= 1e-9 THEN 'fallback_same_as_comparator' END,
        CASE WHEN delta < -1e-9 THEN 'improvement_signal' END, CASE WHEN gate_ready AND delta >= -1e-9 THEN 'gate_triggered_without_gain' END, CASE WHEN cf > kf + 1e-9 THEN 'worse_at_final_checkup' END,
        CASE WHEN horizon_ratio > 5 THEN 'long_horizon_from_short_prefix' END, CASE WHEN top_quartile THEN 'top_quartile_error' END, CASE WHEN t IN (t0, t1) THEN 'temperature_at_edge' END,
        CASE WHEN ungated - comparator_iae > 1e-9 THEN 'ungated_would_regress' END, CASE WHEN alt - comparator_iae > 1e-9 THEN 'alternative_gate_regresses' END) AS flag_text,
      CASE WHEN delta > 1e-9 THEN 'relative_regression' WHEN ABS(delta) <= 1e-9 THEN 'exact_fallback' ELSE 'improvement' END AS outcome_class,
      CASE WHEN delta > 1e-9 OR (gate_ready AND delta >= -1e-9) THEN 'observed_relative_failure' WHEN NOT gate_ready THEN 'fallback_only' ELSE 'needs_external_validation' END AS trust_status,
      CASE WHEN delta > 1e-9 OR (gate_ready AND delta >= -1e-9) THEN 'retain_comparator' WHEN NOT gate_ready THEN 'collect_denser_early_data' ELSE 'freeze_rule_and_test_new_cohort' END AS recommended_action
    FROM (SELECT *, error_rank <= CEIL(n * 0.25) AS top_quartile FROM (SELECT *, candidate_iae - comparator_iae AS delta, (comparator_iae - candidate_iae) / comparator_iae AS relative_gain, horizon_days / prefix_end AS horizon_ratio,
        ROW_NUMBER() OVER (PARTITION BY scenario ORDER BY -candidate_iae, condition_id) AS error_rank, COUNT(*) OVER (PARTITION BY scenario) AS n, MIN(t) OVER (PARTITION BY scenario) AS t0, MAX(t) OVER (PARTITION BY scenario) AS t1
      FROM (SELECT s.condition_id, 'S' || CAST(x.storage_soc_fraction * 8 AS BIGINT) % 3 AS scenario, MAX(CASE WHEN method = 'gated' THEN iae END) AS candidate_iae, MAX(CASE WHEN method = 'prefix_linear' THEN iae END) AS comparator_iae,
          MAX(CASE WHEN method = 'prefix_sqrt' THEN iae END) AS ungated, MAX(CASE WHEN method = 'persistence' THEN iae END) AS alt, MAX(CASE WHEN method = 'gated' THEN final_abs_error END) AS cf,
          MAX(CASE WHEN method = 'prefix_linear' THEN final_abs_error END) AS kf, ANY_VALUE(x.t) AS t, ANY_VALUE(gate_ready) AS gate_ready, ANY_VALUE(prefix_end) AS prefix_end, ANY_VALUE(horizon_days) AS horizon_days
        FROM gscore s JOIN (SELECT condition_id, storage_soc_fraction, temperature_c AS t, MAX(elapsed_days) FILTER (WHERE checkup_index < 10) AS prefix_end, MAX(elapsed_days) AS horizon_days FROM calendar_obs GROUP BY 1, 2, 3) x USING (condition_id)
        JOIN gate USING (condition_id) GROUP BY 1, 2)))""", PRED, GATE, GATED, P.score_sql("gp", "gscore")))
def u6_failure_table(spark, sf_dir):
    obs = P.observations(spark, sf_dir)
    scores = P.score_pack(gated_pack(obs), obs)
    scenario = F.concat(F.lit("S"), ((F.col("storage_soc_fraction") * 8).cast("bigint") % 3).cast("string"))
    support = obs.groupBy("condition_id", "temperature_c", "storage_soc_fraction").agg(
        F.max(F.when(F.col("checkup_index") < 10, F.col("elapsed_days"))).alias("prefix_end_days"), F.max("elapsed_days").alias("horizon_days")).withColumn("scenario", scenario)
    gate = K.activation_gate(obs.filter("checkup_index < 10"), ["condition_id"], margin_pp=0.05).select("condition_id", "gate_ready")
    support = support.join(gate, "condition_id").drop("storage_soc_fraction")
    table_ = U.failure_table(scores.join(support.select("condition_id", "scenario"), "condition_id"), support, scenario="scenario", unit="condition_id",
                             roles={"candidate": "gated", "comparator": "prefix_linear", "ungated": "prefix_sqrt", "alternative": "persistence"})
    return table_.withColumn("flag_text", F.array_join("risk_flags", ";"))


@register("u8_distribution_shift", "field reference_mean:d reference_sd:d other_mean:d other_sd:d smd:d", with_ctes("pool", """
    SELECT *, (other_mean - reference_mean) / NULLIF(SQRT((POWER(reference_sd, 2) + POWER(other_sd, 2)) / 2), 0) AS smd FROM (SELECT field, AVG(v) FILTER (WHERE partition_id = '1-URGENT') AS reference_mean, STDDEV_POP(v) FILTER (WHERE partition_id = '1-URGENT') AS reference_sd,
      AVG(v) FILTER (WHERE partition_id = '5-LOW') AS other_mean, STDDEV_POP(v) FILTER (WHERE partition_id = '5-LOW') AS other_sd
    FROM (SELECT partition_id, UNNEST([{'field': 'danger', 'v': danger}, {'field': 'disagreement', 'v': disagreement}, {'field': 'iae', 'v': iae}], recursive := true) FROM pool) GROUP BY 1)"""))
def u8_distribution_shift(spark, sf_dir):
    return U.distribution_shift(A.pool(spark, sf_dir), partition="partition_id", reference="1-URGENT", other="5-LOW", fields=["danger", "disagreement", "iae"])


@register("u8_proportion_shift", "family n_reference:i n_other:i proportion_difference:d", with_ctes("pool", """
    SELECT family, a AS n_reference, b AS n_other, b / SUM(b) OVER () - a / SUM(a) OVER () AS proportion_difference FROM (SELECT family, COUNT(*) FILTER (WHERE partition_id = '1-URGENT') AS a, COUNT(*) FILTER (WHERE partition_id = '5-LOW') AS b FROM pool GROUP BY 1)"""))
def u8_proportion_shift(spark, sf_dir):
    return U.proportion_shift(A.pool(spark, sf_dir), partition="partition_id", reference="1-URGENT", other="5-LOW", family="family")


@register("u9_collision_report", "fingerprint n_entities:i n_partitions:i first_entity:i", """
    SELECT fp AS fingerprint, COUNT(*) AS n_entities, COUNT(DISTINCT source) AS n_partitions, MIN(doc_id) AS first_entity FROM (
      SELECT doc_id, source, sha256(concat_ws('|', 1, CAST('0x' || SUBSTR(h, 1, 15) AS BIGINT), CAST('0x' || SUBSTR(h, 16, 15) AS BIGINT), CAST('0x' || SUBSTR(h, 31, 15) AS BIGINT), CAST('0x' || SUBSTR(h, 46, 15) AS BIGINT))) AS fp
      FROM (SELECT doc_id, source, sha256(text) AS h FROM documents)) GROUP BY 1 HAVING COUNT(*) > 1""")
def u9_collision_report(spark, sf_dir):
    return U.collision_report(table(spark, sf_dir, "documents"), F.col("text"), entity="doc_id", partition="source")


def _drift(size):
    def change(df):
        progress = (F.col("cycle_index") - 1) / 99.0
        return df.withColumn("retention", F.col("retention") * (1.0 - size * progress))
    return change


@register("u10_perturbation_attack", "scenario cell_id mean_change:d max_change:d action baseline_action action_changed:b passed:b")
def u10_perturbation_attack(spark, sf_dir):
    pre = prefix(spark, sf_dir)

    def forecast(df, keys):
        return K.base_forecasts(K.base_fits(df, keys), keys, 40).filter("model_id = 'target_prefix_full_linear'")

    def action(df):
        slope = df.groupBy("scenario", "cell_id").agg(F.regr_slope("retention", "cycle_index").alias("_b"))
        return slope.select("scenario", "cell_id", F.when(F.col("_b") < -0.06, "refuse_recommended").otherwise("predict").alias("action"))

    return U.perturbation_attack(pre, {"mild_drift": _drift(0.002), "severe_drift": _drift(0.05)}, forecast, on=["cell_id", "forecast_cycle"], value="predicted",
                                 action=action, entity="cell_id", limit=2.0)


@register("u11_split_isolation_attack", "attacked:b n_coordinates:i n_changed:i passed:b", with_ctes("cal", """
    SELECT condition_id % 5 = 0 AS attacked, COUNT(*) * 3 AS n_coordinates, CASE WHEN condition_id % 5 = 0 THEN COUNT(*) * 3 ELSE 0 END AS n_changed, TRUE AS passed FROM calendar_obs WHERE checkup_index >= 10 GROUP BY 1"""))
def u11_split_isolation_attack(spark, sf_dir):
    return U.split_isolation_attack(P.observations(spark, sf_dir), target=F.col("condition_id") % 5 == 0, shock=0.5, landmark=10, predict=lambda o: P.predictions(o, 10),
                                    on=["condition_id", "checkup_index", "method"])


__all__ = ["POOL_SQL", "pool_flags", "G"]
