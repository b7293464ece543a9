"""Leakage, recomputation, fairness, boundary and distribution audits (survey rows U1-U6, U8-U11)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.functions.columns import div
from trajlytics.operators.closed_form import activation_gate
from trajlytics.operators.contracts import fingerprint
from trajlytics.operators.scoring import comparison_summary, pair_methods
from trajlytics.plans.scan import dealt_rows, grouped_rank
from trajlytics.session import shared_path


def compare_runs(before: DataFrame, after: DataFrame, on: Sequence[str], value: str, *, tolerance: float = 1e-9) -> DataFrame:
    """One row: coordinates only in one run, changed values and the largest change."""
    a = before.select(*on, F.col(value).alias("_a"), F.lit(1).alias("_x"))
    b = after.select(*on, F.col(value).alias("_b"), F.lit(1).alias("_y"))
    j = a.join(b, list(on), "full_outer")
    d = F.abs(F.col("_a") - F.col("_b"))
    return j.agg(
        F.count(F.lit(1)).alias("n_coordinates"), F.count(F.when(F.col("_x").isNull() | F.col("_y").isNull(), 1)).alias("n_unmatched"),
        F.count(F.when(d > tolerance, 1)).alias("n_changed"), F.coalesce(F.max(d), F.lit(0.0)).alias("max_change"))


def _changes(pairs: Sequence[tuple[Column, Column]], tolerance: float = 1e-9) -> list[Column]:
    """Aggregates over rows that hold both runs: compared values, changed values and the largest change."""
    d = [F.abs(a - b) for a, b in pairs]
    return [(F.count(F.lit(1)) * len(d)).alias("n_coordinates"), sum((F.count(F.when(x > tolerance, 1)) for x in d), F.lit(0)).alias("n_changed"),
            F.coalesce(F.max(F.greatest(*d, F.lit(None))), F.lit(0.0)).alias("max_change")]


def future_label_firewall(
    obs: DataFrame, landmarks: Sequence[int], predict: Callable[[DataFrame, int, dict, tuple], DataFrame], score: Callable[[DataFrame, list], DataFrame],
    *, methods: Sequence[str], shock: float,
) -> DataFrame:
    """Shift every outcome at or after each landmark: predictions must not move, scores must.

    Both runs are columns of one row. ``predict(obs, landmark, {name: outcome column}, keep)`` gives, per later check-up, a struct of
    the methods' forecasts under each name; it is handed the outcomes of the two runs under neutral names and nothing else of them.
    ``score(errors, columns)`` gives a struct with ``iae`` per unit and error column. The observations are written once and read by all parts."""
    spark, path = obs.sparkSession, shared_path(obs.sparkSession, "observations.parquet")
    obs.drop("capacity_loss_pct").write.parquet(path)
    stored = spark.read.parquet(path)
    runs = {"before": "_y0", "after": "_y1"}
    out = None
    for p in landmarks:
        y = F.col("capacity_retention_pct")
        both = stored.withColumns({"_y0": y, "_y1": F.when(F.col("checkup_index") >= p, y + shock).otherwise(y)}).drop("capacity_retention_pct")
        wide = predict(both, p, runs, ("_y0", "_y1"))
        pred = wide.agg(*_changes([(F.col("before")[m], F.col("after")[m]) for m in methods]))
        errors = {f"_{run}_{i}": F.col(run)[m] - F.col(outcome) for run, outcome in runs.items() for i, m in enumerate(methods)}
        scores = score(wide.withColumns(errors), list(errors))
        sc = scores.agg(*_changes([(F.col(f"_before_{i}")["iae"], F.col(f"_after_{i}")["iae"]) for i in range(len(methods))]))
        row = pred.select(F.lit(p).alias("landmark"), "n_coordinates", F.col("n_changed").alias("n_changed_predictions"), F.col("max_change").alias("max_prediction_change"))
        joined = row.withColumn("_s", sc.select(F.struct("n_changed", "max_change")).scalar()).select(
            "*", F.col("_s.n_changed").alias("n_changed_scores"), F.col("_s.max_change").alias("max_score_change")).drop("_s")
        verdict = joined.withColumn("passed", (F.col("n_changed_predictions") == 0) & (F.col("n_changed_scores") > 0))
        out = verdict if out is None else out.unionByName(verdict)
    return out


def recompute_iae(pack: DataFrame, truth: DataFrame, *, entity: str, method: str, index: str, time: str, predicted: str, observed: str) -> DataFrame:
    """Second formulation of the integrated error: the preceding point by an equality join on its index."""
    err = pack.join(truth.select(entity, index, F.col(observed).alias("_o")), [entity, index]).select(
        entity, method, index, time, F.abs(F.col(predicted) - F.col("_o")).alias("_e"))
    nxt = err.select(entity, method, (F.col(index) + 1).alias(index), F.col(time).alias("_t0"), F.col("_e").alias("_e0"))
    seg = err.join(nxt, [entity, method, index])
    return seg.groupBy(entity, method).agg(
        (F.sum(0.5 * (F.col("_e") + F.col("_e0")) * (F.col(time) - F.col("_t0"))) / F.sum(F.col(time) - F.col("_t0"))).alias("iae"))


def recomputation_audit(primary: DataFrame, second: DataFrame, entity: str, method: str) -> DataFrame:
    j = primary.select(entity, method, F.col("iae").alias("_a")).join(second.select(entity, method, F.col("iae").alias("_b")), [entity, method], "full_outer")
    d = F.abs(F.col("_a") - F.col("_b"))
    return j.groupBy(method).agg(F.count(F.lit(1)).alias("n_units"), F.avg("_b").alias("mean_iae"), F.max(d).alias("max_difference"),
                                 (F.bool_and(d.isNotNull()) & (F.max(d) <= 1e-9)).alias("passed"))


def ablation_table(scores: DataFrame, units: Sequence[str], unit: str, comparisons: dict[str, tuple[str, str]]) -> DataFrame:
    """Named method pairs summarised side by side."""
    paired = pair_methods(scores, units, "method", "iae", list(comparisons.values()))
    names = F.array(*[F.struct(F.lit(n).alias("ablation"), F.lit(a).alias("candidate"), F.lit(b).alias("comparator")) for n, (a, b) in comparisons.items()])
    labelled = paired.withColumn("_n", F.explode(F.filter(names, lambda s: (s["candidate"] == F.col("candidate")) & (s["comparator"] == F.col("comparator"))))).withColumn("ablation", F.col("_n.ablation"))
    return comparison_summary(labelled, ["ablation", "candidate", "comparator"], unit)


def fairness_audit(pack: DataFrame, *, coordinate: Sequence[str], method: str, methods: Sequence[str], invariant: Sequence[str], gated: str, specialist: str, fallback: str) -> DataFrame:
    """Every coordinate has all methods, shared columns agree, and the gated method equals its route."""
    at = lambda m: F.max(F.when(F.col(method) == m, F.col("predicted")))
    per = dealt_rows(pack.select(*coordinate, method, *invariant, "gate_ready", "predicted"), coordinate).groupBy(*coordinate).agg(
        F.countDistinct(method).alias("_m"), F.count(F.lit(1)).alias("_n"), *[(~F.min(c).eqNullSafe(F.max(c))).alias(f"_v_{c}") for c in invariant],
        F.max("gate_ready").alias("_g"), at(gated).alias("_x"), at(specialist).alias("_s"), at(fallback).alias("_f"))
    d = F.abs(F.col("_x") - F.when(F.col("_g"), F.col("_s")).otherwise(F.col("_f")))
    checks = {
        "coordinate_missing_a_method": F.count(F.when(F.col("_m") != len(methods), 1)), "coordinate_repeats_a_method": F.count(F.when(F.col("_n") != F.col("_m"), 1)),
        **{f"{c}_differs_between_methods": F.count(F.when(F.col(f"_v_{c}"), 1)) for c in invariant},
        "gated_differs_from_specialist": F.count(F.when(F.col("_g") & (d > 1e-9), 1)), "gated_differs_from_fallback": F.count(F.when(~F.col("_g") & (d > 1e-9), 1)),
    }
    one = per.agg(F.count(F.lit(1)).alias("_c"), *[v.alias(k) for k, v in checks.items()])
    return one.select("_c", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in checks])).alias("r")).select("r.rule", F.col("_c").alias("n_coordinates"), "r.violations")


def gate_boundary_audit(prefix: DataFrame, key: str, *, offsets: Sequence[float], minimum_points: Sequence[int]) -> DataFrame:
    """The gate at margins placed relative to each trajectory's own minimum loss.

    Offset zero puts the loss exactly on the margin, which must not fire (strict inequality).
    """
    low = prefix.filter("elapsed_days > 0").groupBy(key).agg(F.min("capacity_loss_pct").alias("_low"), F.count(F.lit(1)).alias("_n"))
    grid = low.withColumn("offset", F.explode(F.array(*[F.lit(float(o)) for o in offsets]))).withColumn(
        "minimum_points", F.explode(F.array(*[F.lit(int(m)) for m in minimum_points]))).withColumn("margin", -F.col("_low") + F.col("offset"))
    cases = prefix.join(grid, key)
    gate = activation_gate(cases, [key, "offset", "minimum_points", "margin", "_n"], minimum_points=0, margin_pp=0.0).select(
        key, "offset", "minimum_points", "n_positive", (F.col("minimum_loss_pct") < -F.col("margin")).alias("negative_evidence"))
    observed = gate.withColumn("ready", F.col("negative_evidence") & (F.col("n_positive") >= F.col("minimum_points")))
    return observed.groupBy("offset", "minimum_points").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count(F.when(F.col("negative_evidence"), 1)).alias("n_evidence"), F.count(F.when(F.col("ready"), 1)).alias("n_ready")).withColumn(
        "passed", F.when(F.col("offset") >= 0, F.col("n_evidence") == 0).otherwise(F.col("n_evidence") == F.col("n_cases")))


# Labels of the failure table.
RISK_FLAGS = [
    "specialist_not_activated", "regression_vs_comparator", "fallback_same_as_comparator", "improvement_signal", "gate_triggered_without_gain", "worse_at_final_checkup",
    "long_horizon_from_short_prefix", "top_quartile_error", "temperature_at_edge", "scenario_duplicate", "ungated_would_regress", "alternative_gate_regresses",
]


def failure_table(scores: DataFrame, support: DataFrame, *, scenario: str, unit: str, roles: dict[str, str], tolerance: float = 1e-9) -> DataFrame:
    """Candidate, comparator, ungated and alternative methods joined per target with flags, outcome and trust.

    support: scenario, unit, temperature_c, gate_ready, prefix_end_days, horizon_days.
    """
    keys = [scenario, unit]
    at = lambda role, c: F.max(F.when(F.col("method") == roles[role], F.col(c)))
    wide = scores.groupBy(*keys).agg(
        at("candidate", "iae").alias("candidate_iae"), at("comparator", "iae").alias("comparator_iae"), at("ungated", "iae").alias("ungated_iae"), at("alternative", "iae").alias("alternative_iae"),
        at("candidate", "final_abs_error").alias("candidate_final"), at("comparator", "final_abs_error").alias("comparator_final"))
    t = wide.join(support, keys)
    sizes = t.groupBy(scenario).agg(F.count(F.lit(1)).alias("_n"), F.min("temperature_c").alias("_t0"), F.max("temperature_c").alias("_t1"))
    repeats = t.groupBy(unit).agg(F.countDistinct(scenario).alias("n_scenarios"))
    ranked = grouped_rank(t.withColumn("_neg", -F.col("candidate_iae")), [scenario], F.floor(F.col("_neg") * 64), ["_neg", unit], "error_rank").drop("_neg").join(sizes, scenario).join(repeats, unit)
    delta = F.col("candidate_iae") - F.col("comparator_iae")
    ready = F.col("gate_ready")
    worse, same = delta > tolerance, F.abs(delta) <= tolerance
    out = ranked.withColumns({
        "delta": delta, "relative_gain": div(-delta, "comparator_iae"), "horizon_ratio": div("horizon_days", "prefix_end_days"),
        "top_quartile": F.col("error_rank") <= F.ceil(F.col("_n") * 0.25),
        "outcome_class": F.when(worse, "relative_regression").when(same, "exact_fallback").otherwise("improvement"),
        "gate_gap": F.when(ready, "none").otherwise("gate_evidence_missing"),
    })
    conditions = [
        ~ready, worse, same, ~worse & ~same, ready & (delta >= -tolerance), F.col("candidate_final") > F.col("comparator_final") + tolerance, F.col("horizon_ratio") > 5.0, F.col("top_quartile"),
        F.col("temperature_c").isin() | (F.col("temperature_c") == F.col("_t0")) | (F.col("temperature_c") == F.col("_t1")), F.col("n_scenarios") > 1,
        F.col("ungated_iae") - F.col("comparator_iae") > tolerance, F.col("alternative_iae") - F.col("comparator_iae") > tolerance,
    ]
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in zip(conditions, RISK_FLAGS)]))
    failed = worse | (ready & (delta >= -tolerance))
    return out.withColumn("risk_flags", flags).withColumns({
        "trust_status": F.when(failed, "observed_relative_failure").when(~ready, "fallback_only").otherwise("needs_external_validation"),
        "recommended_action": F.when(failed, "retain_comparator").when(~ready, "collect_denser_early_data").otherwise("freeze_rule_and_test_new_cohort"),
    }).drop("_n", "_t0", "_t1")


def distribution_shift(df: DataFrame, *, partition: str, reference: str, other: str, fields: Sequence[str]) -> DataFrame:
    """Standardised mean difference (population SD, pooled) of every covariate between two partitions."""
    long = df.filter(F.col(partition).isin(reference, other)).unpivot([partition], [F.col(f).cast("double").alias(f) for f in fields], "field", "_v")
    a, b = F.col(partition) == reference, F.col(partition) == other
    agg = long.groupBy("field").agg(
        F.avg(F.when(a, F.col("_v"))).alias("reference_mean"), F.stddev_pop(F.when(a, F.col("_v"))).alias("reference_sd"),
        F.avg(F.when(b, F.col("_v"))).alias("other_mean"), F.stddev_pop(F.when(b, F.col("_v"))).alias("other_sd"))
    pooled = F.sqrt((F.pow("reference_sd", F.lit(2.0)) + F.pow("other_sd", F.lit(2.0))) / 2.0)
    return agg.withColumn("smd", F.when(pooled > 0, (F.col("other_mean") - F.col("reference_mean")) / pooled))


def proportion_shift(df: DataFrame, *, partition: str, reference: str, other: str, family: str) -> DataFrame:
    both = df.filter(F.col(partition).isin(reference, other))
    n = both.agg(F.count(F.when(F.col(partition) == reference, 1)).alias("_a"), F.count(F.when(F.col(partition) == other, 1)).alias("_b"))
    from trajlytics.functions.columns import attach_one_row
    per = both.groupBy(family).agg(F.count(F.when(F.col(partition) == reference, 1)).alias("n_reference"), F.count(F.when(F.col(partition) == other, 1)).alias("n_other"))
    return attach_one_row(per, n).select(family, "n_reference", "n_other", (F.col("n_other") / F.col("_b") - F.col("n_reference") / F.col("_a")).alias("proportion_difference"))


def collision_report(df: DataFrame, text: Column, *, entity: str, partition: str) -> DataFrame:
    """Contents shared by several entities: how many entities and partitions each spans."""
    prints = fingerprint(df, text, [entity, partition])
    return prints.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n_entities"), F.countDistinct(partition).alias("n_partitions"), F.min(entity).alias("first_entity")).filter("n_entities > 1")


def perturbation_attack(
    prefix: DataFrame, scenarios: dict[str, Callable[[DataFrame], DataFrame]], forecast: Callable[[DataFrame, list[str]], DataFrame], *, on: Sequence[str],
    value: str, action: Callable[[DataFrame], DataFrame], entity: str, limit: float,
) -> DataFrame:
    """Perturbed prefixes as a scenario column, one forecast job for all, joined to the unperturbed run."""
    out = prefix.withColumn("scenario", F.lit("baseline"))
    for name, change in scenarios.items():
        out = out.unionByName(change(prefix).withColumn("scenario", F.lit(name)))
    fc = forecast(out, ["scenario", entity])
    acts = action(out)
    base = fc.filter("scenario = 'baseline'").select(*on, F.col(value).alias("_base"))
    moved = fc.filter("scenario <> 'baseline'").join(base, list(on)).groupBy("scenario", entity).agg(
        F.avg(F.abs(F.col(value) - F.col("_base"))).alias("mean_change"), F.max(F.abs(F.col(value) - F.col("_base"))).alias("max_change"))
    base_act = acts.filter("scenario = 'baseline'").select(entity, F.col("action").alias("baseline_action"))
    return moved.join(acts, ["scenario", entity]).join(base_act, entity).withColumns({
        "action_changed": F.col("action") != F.col("baseline_action"), "passed": F.col("max_change") <= limit})


def split_isolation_attack(obs: DataFrame, *, target: Column, shock: float, landmark: int, predict: Callable[[DataFrame], DataFrame], on: Sequence[str]) -> DataFrame:
    """Lower the prefix of the attacked targets: their forecasts must respond, all others must stay."""
    hit = target & (F.col("checkup_index") < landmark) & (F.col("checkup_index") > 0)
    mutated = obs.withColumn("capacity_retention_pct", F.when(hit, F.col("capacity_retention_pct") - shock).otherwise(F.col("capacity_retention_pct"))).withColumn(
        "capacity_loss_pct", 100.0 - F.col("capacity_retention_pct"))
    a = predict(obs).select(*on, F.col("predicted").alias("_a"))
    b = predict(mutated).select(*on, F.col("predicted").alias("_b"))
    j = a.join(b, list(on), "full_outer").withColumn("attacked", target)
    d = F.abs(F.col("_a") - F.col("_b"))
    return j.groupBy("attacked").agg(F.count(F.lit(1)).alias("n_coordinates"), F.count(F.when(d > 1e-9, 1)).alias("n_changed"), F.coalesce(F.max(d), F.lit(0.0)).alias("max_change")).withColumn(
        "passed", F.when(F.col("attacked"), F.col("n_changed") > 0).otherwise(F.col("n_changed") == 0))
