"""Negative controls: audits run on planted faults must flag exactly those, and isolation is attacked on fitted priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.operators import audit as U
from trajlytics.operators import hierarchical as B
from trajlytics.queries import packs as P
from trajlytics.queries.audit import GATE, PRED, SCORE, gated_pack
from trajlytics.queries.registry import register
from trajlytics.sources.adapters import with_ctes

LANDMARKS = (6, 10)
SHOCK = -7.25


def leaky_forecasts(obs, landmark: int, outcomes: dict, keep: tuple = ()):
    """Persistence that peeks: a thousandth of the mean of the target's own future is added to it."""
    future = obs.filter(F.col("checkup_index") >= landmark).groupBy("condition_id").agg(*[F.avg(y).alias(f"_peek_{name}") for name, y in outcomes.items()])
    wide = P.forecasts(obs, landmark, outcomes, keep).join(future, "condition_id")
    peeks = {name: F.col(name).withField("persistence", F.col(name)["persistence"] + F.col(f"_peek_{name}") / 1000.0) for name in outcomes}
    return wide.withColumns(peeks).drop(*[f"_peek_{name}" for name in outcomes])


@register("u1_leaky_control", "landmark:i n_coordinates:i n_changed_predictions:i max_prediction_change:d passed:b", with_ctes("cal", " UNION ALL ".join(
    f"""SELECT {p} AS landmark, COUNT(*) * 3 AS n_coordinates, COUNT(*) AS n_changed_predictions, {-SHOCK / 1000} AS max_prediction_change, FALSE AS passed
    FROM calendar_obs WHERE checkup_index >= {p}""" for p in LANDMARKS)))  # fmt: skip
def u1_leaky_control(spark, sf_dir):
    return U.future_label_firewall(P.observations(spark, sf_dir), list(LANDMARKS), leaky_forecasts, P.score_columns, methods=P.METHODS, shock=SHOCK)


@register("u2_disturbed_control", "method n_units:i passed:b", with_ctes("cal", """
    SELECT method, COUNT(*) AS n_units, method <> 'prefix_sqrt' AS passed FROM score GROUP BY 1""", PRED, SCORE))
def u2_disturbed_control(spark, sf_dir):
    obs = P.observations(spark, sf_dir)
    pack = P.predictions(obs)
    shifted = pack.withColumn("predicted", F.col("predicted") + F.when(F.col("method") == "prefix_sqrt", 50.0).otherwise(0.0))
    second = U.recompute_iae(
        shifted, obs, entity="condition_id", method="method", index="checkup_index", time="elapsed_days",
        predicted="predicted", observed="capacity_retention_pct",
    )
    return U.recomputation_audit(P.score_pack(pack, obs), second, "condition_id", "method")


@register("u4_planted_faults", "rule n_coordinates:i violations:i", with_ctes("cal", """
    SELECT UNNEST([
      {'rule': 'coordinate_missing_a_method', 'violations': COUNT(*) FILTER (WHERE checkup_index = 11)},
      {'rule': 'coordinate_repeats_a_method', 'violations': COUNT(*) FILTER (WHERE checkup_index = 12)},
      {'rule': 'elapsed_days_differs_between_methods', 'violations': COUNT(*) FILTER (WHERE checkup_index = 15)},
      {'rule': 'temperature_c_differs_between_methods', 'violations': 0},
      {'rule': 'gated_differs_from_specialist', 'violations': COUNT(*) FILTER (WHERE checkup_index = 20 AND gate_ready)},
      {'rule': 'gated_differs_from_fallback', 'violations': COUNT(*) FILTER (WHERE checkup_index = 20 AND NOT gate_ready)}], recursive := true),
      COUNT(*) AS n_coordinates
    FROM calendar_obs JOIN gate USING (condition_id) WHERE checkup_index >= 10""", GATE))
def u4_planted_faults(spark, sf_dir):
    pack = gated_pack(P.observations(spark, sf_dir))
    at = lambda index, method: (F.col("checkup_index") == index) & (F.col("method") == method)
    faulty = pack.filter(~at(11, "persistence")).unionByName(pack.filter(at(12, "persistence"))).withColumns(
        {
            "elapsed_days": F.col("elapsed_days") + F.when(at(15, "persistence"), 1e-3).otherwise(0.0),
            "predicted": F.col("predicted") + F.when(at(20, "gated"), 0.5).otherwise(0.0),
        }
    )
    return U.fairness_audit(
        faulty, coordinate=["condition_id", "checkup_index"], method="method", methods=[*P.METHODS, "gated"],
        invariant=["elapsed_days", "temperature_c"], gated="gated", specialist="prefix_sqrt", fallback="prefix_linear",
    )


@register("u11_prior_isolation", "own:b n_coordinates:i moved:b", with_ctes("cal", """
    SELECT condition_id = (SELECT MIN(condition_id) FROM calendar_obs) AS own, COUNT(*) AS n_coordinates,
      condition_id <> (SELECT MIN(condition_id) FROM calendar_obs) AS moved
    FROM calendar_obs WHERE checkup_index >= 10 AND condition_id IN
      (SELECT condition_id FROM calendar_obs WHERE checkup_index < 10 AND elapsed_days > 0) GROUP BY ALL"""))
def u11_prior_isolation(spark, sf_dir):
    """One target's future is lowered: forecasts from fitted priors must stay for itself and move for the others, whose
    priors it belongs to. A prior that includes its own target would fail the first, one that is not fitted the second."""
    obs = P.observations(spark, sf_dir)
    target = obs.agg(F.min("condition_id").alias("t")).select("t").scalar()
    future = (F.col("condition_id") == target) & (F.col("checkup_index") >= 10)
    lowered = obs.withColumn("capacity_retention_pct", F.col("capacity_retention_pct") - F.when(future, 5.0).otherwise(0.0)).withColumn(
        "capacity_loss_pct", 100.0 - F.col("capacity_retention_pct")
    )
    key = ["condition_id", "checkup_index"]
    before = B.cross_fitted_residuals(obs, landmark=10).select(*key, F.col("predicted").alias("a"))
    after = B.cross_fitted_residuals(lowered, landmark=10).select(*key, F.col("predicted").alias("b"))
    both = before.join(after, key, "full_outer").withColumn("own", F.col("condition_id") == target)
    moved = F.coalesce(F.abs(F.col("a") - F.col("b")) > 1e-9, F.lit(True))
    return both.groupBy("own").agg(F.count(F.lit(1)).alias("n_coordinates"), F.bool_or(moved).alias("moved"))
