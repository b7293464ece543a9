"""Table contracts, prefix cuts and fingerprints (survey rows B1-B14).

A contract never fails on its own: it returns one row per rule with the number of violating rows,
computed in one pass of conditional aggregates plus one key count for duplicates. ``enforce``
turns a report into an exception for callers that want one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.functions.columns import is_finite, violations
from trajlytics.plans.scan import index_bucket, null_safe_join, previous, running


class ContractError(ValueError):
    """Raised by ``enforce`` when an error rule is violated."""


def rule_rows(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Evaluate aggregate rules in one pass: rows (rule, severity, violations)."""
    one = df.agg(*[agg.alias(name) for name, (_, agg) in rules.items()])
    entries = [
        F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.col(n).cast("bigint").alias("violations"))
        for n, (s, _) in rules.items()
    ]
    return one.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def duplicate_rows(df: DataFrame, keys: Sequence[str], rule: str, severity: str = "error") -> DataFrame:
    """Rule row counting all rows that share their key with another row."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("violations")).select(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "violations"
    )


def enforce(report: DataFrame) -> None:
    broken = report.filter("severity = 'error' and violations > 0").collect()
    if broken:
        raise ContractError("; ".join(f"{r['rule']}: {r['violations']}" for r in broken))


def cycle_contract(df: DataFrame) -> DataFrame:
    idx, cap = F.col("cycle_index"), F.col("discharge_capacity_ah")
    whole = is_finite(idx) & (F.abs(idx - F.round(idx)) <= 1e-8)
    rules = {
        "null_key": ("error", violations(
            F.col("dataset_id").isNull() | F.col("cell_id").isNull() | idx.isNull())),
        "cycle_index_not_integer": ("error", violations(~whole)),
        "cycle_index_below_one": ("error", violations(is_finite(idx) & (idx < 1))),
        "capacity_not_finite": ("error", violations(~is_finite(cap))),
        "capacity_not_positive": ("error", violations(is_finite(cap) & (cap <= 0))),
        "null_batch_or_protocol": ("warning", violations(
            F.col("batch_id").isNull() | F.col("protocol_id").isNull())),
    }
    if "temperature_avg_c" in df.columns:
        t = F.col("temperature_avg_c")
        rules["temperature_out_of_range"] = ("warning", violations(is_finite(t) & ((t < -60) | (t > 150))))
    return rule_rows(df, rules).unionByName(
        duplicate_rows(df, ["dataset_id", "cell_id", "cycle_index"], "duplicate_key")
    )


def label_contract(df: DataFrame) -> DataFrame:
    life = F.col("cycle_life")
    rules = {
        "null_key": ("error", violations(F.col("dataset_id").isNull() | F.col("cell_id").isNull())),
        "life_not_finite": ("error", violations(~is_finite(life))),
        "life_not_positive": ("error", violations(is_finite(life) & (life <= 0))),
    }
    if "is_censored" in df.columns:
        strict = dict(df.dtypes)["is_censored"] == "boolean"
        cens = F.col("is_censored")
        rules["censor_null"] = ("error", violations(cens.isNull()))
        rules["censor_not_boolean"] = ("error", violations(F.lit(not strict) & cens.isNotNull()))
        if strict:
            rules["all_censored"] = ("warning", F.min(cens.cast("int")))
    if "eol_threshold" in df.columns:
        thr = F.col("eol_threshold")
        rules["threshold_not_finite"] = ("error", violations(~is_finite(thr)))
        rules["threshold_out_of_range"] = ("error", violations(is_finite(thr) & ((thr <= 0) | (thr >= 1))))
    return rule_rows(df, rules).unionByName(
        duplicate_rows(df, ["dataset_id", "cell_id"], "duplicate_cell")
    )


def _differs(a: Column, b: Column, tol: float) -> Column:
    return F.coalesce(F.abs(a - b) > tol, F.lit(True))


def calendar_contract(
    df: DataFrame, *, expected_conditions: int | None = None, expected_rows: int | None = None
) -> DataFrame:
    """Check-up table contract: units, derived columns, ranges, time axis and identities."""
    numeric = [
        "temperature_c", "storage_soc_fraction", "elapsed_time_s", "elapsed_hours", "elapsed_days",
        "checkup_index", "capacity_ah", "capacity_retention_pct", "capacity_loss_pct",
        "resistance_dc_ohm", "resistance_growth_pct", "nominal_capacity_ah",
    ]
    first = df.groupBy("condition_id").agg(
        F.max(F.when(F.col("checkup_index") == 0, F.col("capacity_ah"))).alias("_cap0"),
        F.max(F.when(F.col("checkup_index") == 0, F.col("resistance_dc_ohm"))).alias("_res0"),
    )
    seq = previous(
        df, ["condition_id"], F.floor("elapsed_days"), ["elapsed_time_s", "checkup_index"],
        {"_pt": "elapsed_time_s", "_pi": "checkup_index"},
    )
    seq = null_safe_join(seq, first, ["condition_id"])
    c = F.col
    not_finite = ~is_finite(numeric[0])
    for n in numeric[1:]:
        not_finite = not_finite | ~is_finite(n)
    starts = c("_pt").isNull()
    rules = {
        "not_finite": ("error", violations(not_finite)),
        "negative_time": ("error", violations((c("elapsed_time_s") < 0) | (c("elapsed_days") < 0))),
        "hours_inconsistent": ("error", violations(_differs(c("elapsed_hours"), c("elapsed_time_s") / 3600.0, 1e-9))),
        "days_inconsistent": ("error", violations(_differs(c("elapsed_days"), c("elapsed_time_s") / 86400.0, 1e-9))),
        "loss_inconsistent": ("error", violations(
            _differs(c("capacity_loss_pct"), 100.0 - c("capacity_retention_pct"), 1e-9))),
        "soc_out_of_range": ("error", violations(~c("storage_soc_fraction").between(0.0, 1.0))),
        "temperature_out_of_range": ("error", violations(~c("temperature_c").between(-40.0, 100.0))),
        "capacity_not_positive": ("error", violations((c("capacity_ah") <= 0) | (c("resistance_dc_ohm") <= 0))),
        "resistance_not_in_ohms": ("error", violations(~c("resistance_dc_ohm").between(0.001, 1.0))),
        "capacity_not_in_ah": ("error", violations(
            ~(c("capacity_ah") / F.nullif(c("nominal_capacity_ah"), F.lit(0.0))).between(0.1, 1.25))),
        "retention_inconsistent": ("error", violations(_differs(
            c("capacity_retention_pct"), 100.0 * c("capacity_ah") / F.nullif(c("_cap0"), F.lit(0.0)), 1e-9))),
        "resistance_growth_inconsistent": ("error", violations(_differs(
            c("resistance_growth_pct"),
            100.0 * (c("resistance_dc_ohm") / F.nullif(c("_res0"), F.lit(0.0)) - 1.0), 1e-9))),
        "time_not_from_zero": ("error", violations(starts & (c("elapsed_time_s") != 0))),
        "time_not_increasing": ("error", violations(~starts & (c("elapsed_time_s") <= c("_pt")))),
        "checkup_not_contiguous": ("error", violations(
            c("checkup_index") != F.when(starts, F.lit(0)).otherwise(c("_pi") + 1))),
        "initial_retention_not_100": ("error", violations(starts & (F.abs(c("capacity_retention_pct") - 100.0) > 1e-8))),
    }
    per = df.groupBy("condition_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("temperature_c").alias("t0"), F.max("temperature_c").alias("t1"),
        F.min("storage_soc_fraction").alias("s0"), F.max("storage_soc_fraction").alias("s1"),
    )
    per_rules = {
        "temperature_not_constant": ("error", violations(c("t0") != c("t1"))),
        "soc_not_constant": ("error", violations(c("s0") != c("s1"))),
    }
    if expected_rows is not None:
        per_rules["unexpected_checkup_count"] = ("error", violations(c("n") != expected_rows))
    if expected_conditions is not None:
        per_rules["unexpected_condition_count"] = (
            "error", F.abs(F.count(F.lit(1)) - F.lit(expected_conditions)))
    return (
        rule_rows(seq, rules)
        .unionByName(rule_rows(per, per_rules))
        .unionByName(duplicate_rows(df, ["condition_id", "elapsed_time_s"], "duplicate_time"))
        .unionByName(duplicate_rows(df, ["condition_id", "checkup_index"], "duplicate_checkup"))
        .unionByName(duplicate_rows(per, ["t0", "s0"], "condition_profile_not_unique"))
    )


def cohort_contract(
    df: DataFrame, cohort: DataFrame, *, expected_days: Sequence[int], constant: Sequence[str]
) -> DataFrame:
    """Per cell: is it in the declared cohort, does it follow the day grid, are constants constant.

    ``cohort``: (cell_id, condition_id). Cells of the cohort without rows are reported as absent.
    """
    days = [int(d) for d in expected_days]
    per = df.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        violations(~F.col("elapsed_days").isin(days)).alias("unexpected_days"),
        F.countDistinct(F.when(F.col("elapsed_days").isin(days), F.col("elapsed_days"))).alias("_hit"),
        F.min("condition_id").alias("_c0"), F.max("condition_id").alias("_c1"),
        *[(F.min(k) != F.max(k)).alias(f"_v_{k}") for k in constant],
    )
    varying = F.array_compact(F.array(*[F.when(F.col(f"_v_{k}"), F.lit(k)) for k in constant]))
    joined = cohort.select("cell_id", F.col("condition_id").alias("declared")).join(per, "cell_id", "full_outer")
    status = (
        F.when(F.col("declared").isNull(), "not_in_cohort")
        .when(F.col("n_rows").isNull(), "absent")
        .when((F.col("_c0") != F.col("_c1")) | (F.col("_c0") != F.col("declared")), "condition_changed")
        .when((F.col("unexpected_days") > 0) | (F.col("_hit") != len(days)) | (F.col("n_rows") != len(days)),
              "day_grid_changed")
        .otherwise("ok")
    )
    return joined.select(
        "cell_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("unexpected_days", F.lit(0)).alias("unexpected_days"),
        (F.lit(len(days)) - F.coalesce("_hit", F.lit(0))).alias("missing_days"),
        F.array_join(F.coalesce(varying, F.array().cast("array<string>")), ";").alias("varying"),
        status.alias("status"),
    )


def cycle_feature_contract(df: DataFrame, *, initial_cycles: int = 5) -> DataFrame:
    """Per-cycle curve-feature contract: crossing order, ratios, slopes, contiguity, constants."""
    c = F.col
    seq = previous(
        df, ["cell_id"], index_bucket("cycle_index"), ["cycle_index"],
        {"_pi": "cycle_index", "_pd": "elapsed_days"},
    )
    t1, t2, t3 = c("time_to_3p8_v_s"), c("time_to_3p6_v_s"), c("time_to_3p4_v_s")
    inside = lambda t: (t >= -1e-12) & (t <= c("discharge_duration_s") + 1e-12)
    v5, v10 = c("voltage_at_0p5_ah_v"), c("voltage_at_1p0_ah_v")
    vin = lambda v: v.between(c("voltage_min_v") - 1e-12, c("voltage_max_v") + 1e-12)
    rules = {
        "too_few_samples": ("error", violations(c("sample_count") < 2)),
        "negative_elapsed": ("error", violations(c("elapsed_days") < 0)),
        "capacity_not_positive": ("error", violations(c("integrated_discharge_capacity_ah") <= 0)),
        "ratio_out_of_range": ("error", violations(~c("capacity_integration_ratio").between(0.5, 1.5))),
        "ratio_inconsistent": ("error", violations(_differs(
            c("capacity_integration_ratio"),
            c("integrated_discharge_capacity_ah") / F.nullif(c("discharge_capacity_ah"), F.lit(0.0)), 1e-12))),
        "crossings_not_ordered": ("error", violations(~((t1 <= t2 + 1e-12) & (t2 <= t3 + 1e-12)))),
        "crossing_outside_discharge": ("error", violations(~(inside(t1) & inside(t2) & inside(t3)))),
        "window_inconsistent": ("error", violations(
            _differs(c("common_window_3p8_to_3p4_duration_s"), t3 - t1, 1e-9))),
        "dvdq_inconsistent": ("error", violations(
            _differs(c("mean_dv_dq_0p5_to_1p0_v_per_ah"), (v10 - v5) / 0.5, 1e-12))),
        "dvdq_positive": ("error", violations(c("mean_dv_dq_0p5_to_1p0_v_per_ah") > 1e-12)),
        "voltage_outside_range": ("error", violations(~(vin(v5) & vin(v10)))),
        "cycles_not_contiguous": ("error", violations(
            c("cycle_index") != F.coalesce(c("_pi") + 1, F.lit(1)))),
        "elapsed_not_monotone": ("error", violations(c("elapsed_days") < c("_pd"))),
    }
    per = df.groupBy("cell_id").agg(
        F.min("protocol_id").alias("p0"), F.max("protocol_id").alias("p1"),
        F.min("discharge_cutoff_voltage_v").alias("u0"), F.max("discharge_cutoff_voltage_v").alias("u1"),
    )
    per_rules = {
        "protocol_not_constant": ("error", violations(c("p0") != c("p1"))),
        "cutoff_not_constant": ("error", violations(c("u0") != c("u1"))),
    }
    return rule_rows(seq, rules).unionByName(rule_rows(per, per_rules))


# Column names, name tokens and name fragments that carry outcomes.
PROTECTED_NAMES = (
    "capacity_fade",
    "capacity_loss",
    "capacity_retention",
    "censor",
    "cycle_life",
    "eol",
    "event",
    "failure",
    "is_censored",
    "life",
    "lifetime",
    "num_cycles",
    "observed_time",
    "remaining_useful_life",
    "resistance",
    "rul",
    "soh",
    "source_num_cycles",
    "target",
)
PROTECTED_TOKENS = ("censor", "eol", "event", "failure")
PROTECTED_FRAGMENTS = ("cycle_life", "num_cycles", "resistance")
PROTECTED_PATTERN = r"r(_?\d+|_.+)?"


def protected_columns(df: DataFrame) -> list[str]:
    """Outcome columns by name; decided on the schema, before any job runs."""
    found = []
    for name in df.columns:
        snake = "_".join(re.findall(r"[a-z0-9]+", name.lower()))
        by_name = snake in PROTECTED_NAMES or re.fullmatch(PROTECTED_PATTERN, snake)
        by_part = set(PROTECTED_TOKENS) & set(snake.split("_")) or any(f in snake for f in PROTECTED_FRAGMENTS)
        if by_name or by_part:
            found.append(name)
    return sorted(found)


def reject_protected(df: DataFrame, frame: str = "predictors") -> DataFrame:
    bad = protected_columns(df)
    if bad:
        raise ContractError(f"{frame} contains outcome columns: {bad}")
    return df


def forward_fill(df: DataFrame, key: str, index: str, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Past-only fill of ``allowed`` columns within ``key``; returns (filled, ledger).

    Ledger: one row per filled coordinate; ``leading_null`` marks a null with no earlier value, which
    stays null and is an error for the caller.
    """
    scanned = running(
        df, [key], index_bucket(index), [index],
        {f"_f_{c}": ("last", finite) for c in allowed for finite in [F.when(is_finite(c), F.col(c))]},
    )
    missing = [
        F.when(~is_finite(c), F.struct(F.lit(c).alias("column"), F.col(f"_f_{c}").cast("double").alias("value")))
        for c in allowed
    ]
    ledger = (
        scanned.select(key, index, F.explode(F.array_compact(F.array(*missing))).alias("m"))
        .select(key, index, "m.column", F.col("m.value").alias("filled_value"), F.col("m.value").isNull().alias("leading_null"))
    )
    filled = scanned.select(*[
        (F.when(is_finite(c), F.col(c)).otherwise(F.col(f"_f_{c}")).alias(c) if c in allowed else F.col(c))
        for c in df.columns
    ])
    return filled, ledger


def contiguous_support(df: DataFrame, key: str, index: str, last: int) -> DataFrame:
    """Keys whose rows up to ``last`` are exactly 1..last, each once."""
    return (
        df.filter(F.col(index) <= last).groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("n"), F.min(index).alias("lo"), F.max(index).alias("hi"),
            F.countDistinct(index).alias("d"),
        )
        .filter((F.col("n") == last) & (F.col("d") == last) & (F.col("lo") == 1) & (F.col("hi") == last))
        .select(key)
    )


def select_prefix(df: DataFrame, key: str, index: str, size: int) -> tuple[DataFrame, DataFrame]:
    """First ``size`` rows by zero-based index, and the keys whose prefix is incomplete."""
    prefix = df.filter((F.col(index) >= 0) & (F.col(index) < size))
    have = df.groupBy(key).agg(
        F.countDistinct(F.when((F.col(index) >= 0) & (F.col(index) < size), F.col(index))).alias("n_prefix")
    )
    return prefix, have.filter(F.col("n_prefix") < size)


def prefix_and_future(df: DataFrame, index: str, landmarks: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Rows at or before, and rows after, each landmark: one scan, landmarks as a column."""
    marks = F.explode(F.array(*[F.lit(int(p)) for p in landmarks]))
    cut = df.withColumn("prefix_cycle", marks)
    return (
        cut.filter(F.col(index) <= F.col("prefix_cycle")),
        cut.filter(F.col(index) > F.col("prefix_cycle")),
    )


def training_and_targets(
    df: DataFrame, split: str, training: str, evaluation: Sequence[str], index: str, landmarks: Sequence[int]
) -> tuple[DataFrame, DataFrame]:
    """Complete history of the training split; prefixes only of the evaluation splits."""
    train = df.filter(F.col(split) == training)
    target, _ = prefix_and_future(df.filter(F.col(split).isin(list(evaluation))), index, landmarks)
    return train, target


def row_text(columns: Sequence[str | Column]) -> Column:
    """Canonical row text; null is distinct from the empty string."""
    return F.concat_ws(
        "|", *[F.coalesce((c if isinstance(c, Column) else F.col(c)).cast("string"), F.lit("~")) for c in columns]
    )


def fingerprint(df: DataFrame, text: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Order-invariant fingerprint per key (or of the table): a multiset hash.

    The digest of every row is cut into four 60-bit numbers that are summed, so partial sums
    combine before the shuffle and no list of rows is ever built.
    """
    digest = F.sha2(text, 256)
    parts = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint").cast("decimal(28,0)")).alias(f"_s{i}")
        for i in range(4)
    ]
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *parts)
    return agg.select(
        *keys, "n_rows",
        F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(4)]), 256)
        .alias("fingerprint"),
    )


def member_fit_contract(
    fits: DataFrame, forecasts: DataFrame, variants: DataFrame, *, entity: Sequence[str], status_values: Sequence[str]
) -> DataFrame:
    """Exact variant registry per entity, status against null mask, matching forecast rows."""
    entity = list(entity)
    n_variants = variants.count()  # the registry is a fixed list
    ok = F.col("fit_status") == "ok"
    values_null = F.col("prefix_rmse_pp").isNull() | F.col("max_abs_residual_pp").isNull()
    rules = {
        "unknown_status": ("error", violations(~F.col("fit_status").isin(list(status_values)))),
        "ok_without_values": ("error", violations(ok & values_null)),
        "failed_with_values": ("error", violations(~ok & ~values_null)),
        "values_not_finite": ("error", violations(ok & ~values_null & ~(
            is_finite("prefix_rmse_pp") & is_finite("max_abs_residual_pp")))),
        "negative_error": ("error", violations(ok & ((F.col("prefix_rmse_pp") < 0) | (F.col("max_abs_residual_pp") < 0)))),
        "rmse_above_max_residual": ("error", violations(ok & (F.col("prefix_rmse_pp") > F.col("max_abs_residual_pp") + 1e-9))),
        "credible_null": ("error", violations(F.col("credible_variant").isNull())),
        "credible_but_failed": ("error", violations(~ok & F.col("credible_variant"))),
    }
    on = ["model_id", "variant_id"]
    unknown = fits.join(variants.select(*on), on, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
    short = fits.groupBy(*entity).agg(F.countDistinct(*on).alias("n")).agg(
        violations(F.col("n") != n_variants).alias("violations"))
    keys = [*entity, *on]
    fitted = fits.filter(ok).select(*keys).distinct()
    forecast_keys = forecasts.select(*keys).distinct()
    missing = fitted.join(forecast_keys, keys, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
    orphan = forecast_keys.join(fitted, keys, "left_anti").agg(F.count(F.lit(1)).alias("violations"))

    def as_rule(df: DataFrame, rule: str) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.lit("error").alias("severity"), F.col("violations").cast("bigint").alias("violations"))

    return (
        rule_rows(fits, rules)
        .unionByName(duplicate_rows(fits, keys, "duplicate_fit"))
        .unionByName(as_rule(unknown, "variant_not_registered"))
        .unionByName(as_rule(short, "registry_incomplete"))
        .unionByName(as_rule(missing, "fit_without_forecast"))
        .unionByName(as_rule(orphan, "forecast_without_fit"))
    )


def inventory(files: DataFrame, path: str = "path", size: str = "size_bytes", depth: int = 1) -> DataFrame:
    """File counts and bytes by extension and by leading path part."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    prefix = F.substring_index(F.col(path), "/", depth)
    return (
        files.select(ext.alias("extension"), prefix.alias("prefix"), F.col(size).alias("_b"))
        .groupBy("extension", "prefix")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("_b").cast("bigint").alias("n_bytes"))
    )


def inventory_differences(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Groups whose counts or bytes differ from the declared snapshot, absent sides as zero."""
    on = ["extension", "prefix"]
    e = expected.select(*on, F.col("n_files").alias("expected_files"), F.col("n_bytes").alias("expected_bytes"))
    both = observed.join(e, on, "full_outer").na.fill(0, ["n_files", "n_bytes", "expected_files", "expected_bytes"])
    return both.filter((F.col("n_files") != F.col("expected_files")) | (F.col("n_bytes") != F.col("expected_bytes")))
