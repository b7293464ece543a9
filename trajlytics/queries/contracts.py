"""Contract, prefix and fingerprint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.operators import contracts as C
from trajlytics.queries.registry import register
from trajlytics.sources import adapters as A
from trajlytics.sources.adapters import table, with_ctes

RULE_SPEC = "rule severity violations:i"

# Raw readings with the faults a contract must count; every line item is one reading.
READING_EXPRS = {
    "dataset_id": "'TPC'",
    "cell_id": "CASE WHEN l_linestatus = 'O' AND l_quantity = 1e0 THEN NULL ELSE CAST(l_suppkey AS STRING) END",
    "batch_id": "CASE WHEN l_returnflag = 'N' AND l_quantity = 2e0 THEN NULL ELSE l_returnflag END",
    "protocol_id": "l_linestatus",
    "cycle_index": "l_partkey - 3e0 - CASE WHEN l_tax = 8e-2 THEN 5e-1 ELSE 0e0 END",
    "discharge_capacity_ah": "CASE WHEN l_discount = 1e-1 THEN NULL WHEN l_discount = 9e-2 THEN CAST('NaN' AS DOUBLE)"
    " WHEN l_discount = 8e-2 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity - 3e0 END",
    "temperature_avg_c": "CASE WHEN l_discount = 5e-2 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice / 5e2 - 6.5e1 END",
}
READINGS = f"readings AS (SELECT {A._sql(READING_EXPRS)} FROM lineitem)"
FINITE = "({c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c}))"


def fin(c: str) -> str:
    return FINITE.replace("{c}", f"CAST({c} AS DOUBLE)")


def rules_sql(source: str, rules: list[tuple[str, str, str]]) -> str:
    """One row per rule: ``(name, severity, predicate)`` counted over ``source``."""
    return "\nUNION ALL\n".join(
        f"SELECT '{n}' AS rule, '{s}' AS severity, COUNT(*) FILTER (WHERE {p}) AS violations FROM {source}"
        for n, s, p in rules
    )


def dup_sql(source: str, keys: str, rule: str, severity: str = "error") -> str:
    return (
        f"SELECT '{rule}' AS rule, '{severity}' AS severity, COALESCE(SUM(n), 0) AS violations "
        f"FROM (SELECT COUNT(*) AS n FROM {source} GROUP BY {keys} HAVING COUNT(*) > 1)"
    )


def readings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*A._select(READING_EXPRS))


@register("b1_cycle_contract", RULE_SPEC, with_ctes("", "", READINGS) + "\nUNION ALL\n".join([
    rules_sql("readings", [
        ("null_key", "error", "dataset_id IS NULL OR cell_id IS NULL OR cycle_index IS NULL"),
        ("cycle_index_not_integer", "error", f"NOT ({fin('cycle_index')} AND ABS(cycle_index - ROUND(cycle_index)) <= 1e-8)"),
        ("cycle_index_below_one", "error", f"{fin('cycle_index')} AND cycle_index < 1"),
        ("capacity_not_finite", "error", f"NOT {fin('discharge_capacity_ah')}"),
        ("capacity_not_positive", "error", f"{fin('discharge_capacity_ah')} AND discharge_capacity_ah <= 0"),
        ("null_batch_or_protocol", "warning", "batch_id IS NULL OR protocol_id IS NULL"),
        ("temperature_out_of_range", "warning", f"{fin('temperature_avg_c')} AND (temperature_avg_c < -60 OR temperature_avg_c > 150)"),
    ]),
    dup_sql("readings", "dataset_id, cell_id, cycle_index", "duplicate_key"),
]))
def b1_cycle_contract(spark, sf_dir):
    return C.cycle_contract(readings(spark, sf_dir))


LABEL_DIRTY_EXPRS = {
    "dataset_id": "o_orderstatus",
    "cell_id": "CASE WHEN o_custkey = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END",
    "cycle_life": "CASE WHEN o_totalprice < 2e4 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice - 5e4 END",
    "is_censored": "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END",
    "eol_threshold": "CASE WHEN o_totalprice > 4.9e5 THEN NULL ELSE o_totalprice / 4.5e5 END",
}
LABEL_DIRTY = f"dirty_labels AS (SELECT {A._sql(LABEL_DIRTY_EXPRS)} FROM orders)"


@register("b2_label_contract", RULE_SPEC, with_ctes("", "", LABEL_DIRTY) + "\nUNION ALL\n".join([
    rules_sql("dirty_labels", [
        ("null_key", "error", "dataset_id IS NULL OR cell_id IS NULL"),
        ("life_not_finite", "error", f"NOT {fin('cycle_life')}"),
        ("life_not_positive", "error", f"{fin('cycle_life')} AND cycle_life <= 0"),
        ("censor_null", "error", "is_censored IS NULL"),
        ("censor_not_boolean", "error", "FALSE"),
        ("threshold_not_finite", "error", f"NOT {fin('eol_threshold')}"),
        ("threshold_out_of_range", "error", f"{fin('eol_threshold')} AND (eol_threshold <= 0 OR eol_threshold >= 1)"),
    ]),
    "SELECT 'all_censored', 'warning', CAST(bool_and(is_censored) AS BIGINT) FROM dirty_labels",
    dup_sql("dirty_labels", "dataset_id, cell_id", "duplicate_cell"),
]))
def b2_label_contract(spark, sf_dir):
    return C.label_contract(table(spark, sf_dir, "orders").select(*A._select(LABEL_DIRTY_EXPRS)))


CAL_CHECK_EXPRS = {
    "condition_id": "condition_id",
    "checkup_index": "checkup_index",
    "temperature_c": "temperature_c",
    "storage_soc_fraction": "storage_soc_fraction",
    "elapsed_time_s": "elapsed_days * 864e2",
    "elapsed_hours": "elapsed_days * 24e0 + CASE WHEN condition_id % 7 = 0 THEN 1e-3 ELSE 0e0 END",
    "elapsed_days": "elapsed_days",
    "capacity_ah": "3e0 * capacity_retention_pct / 1e2",
    "capacity_retention_pct": "capacity_retention_pct",
    "capacity_loss_pct": "capacity_loss_pct + CASE WHEN checkup_index = 3 THEN 1e-3 ELSE 0e0 END",
    "resistance_dc_ohm": "2e-2 + 1e-3 * checkup_index",
    "resistance_growth_pct": "1e2 * ((2e-2 + 1e-3 * checkup_index) / 2e-2 - 1e0)"
    " + CASE WHEN checkup_index = 5 THEN 1e0 ELSE 0e0 END",
    "nominal_capacity_ah": "3e0",
}
CAL_CHECK = f"checkups AS (SELECT {A._sql(CAL_CHECK_EXPRS)} FROM calendar_obs)"
CAL_SEQ = """seq AS (SELECT c.*, LAG(elapsed_time_s) OVER w AS pt, LAG(checkup_index) OVER w AS pi,
    MAX(CASE WHEN checkup_index = 0 THEN capacity_ah END) OVER (PARTITION BY condition_id) AS cap0,
    MAX(CASE WHEN checkup_index = 0 THEN resistance_dc_ohm END) OVER (PARTITION BY condition_id) AS res0
    FROM checkups c WINDOW w AS (PARTITION BY condition_id ORDER BY elapsed_time_s, checkup_index))"""
CAL_PER = """per AS (SELECT condition_id, COUNT(*) AS n, MIN(temperature_c) AS t0, MAX(temperature_c) AS t1,
    MIN(storage_soc_fraction) AS s0, MAX(storage_soc_fraction) AS s1 FROM checkups GROUP BY 1)"""


@register("b3_calendar_contract", RULE_SPEC, with_ctes("cal", "", CAL_CHECK, CAL_SEQ, CAL_PER) + "\nUNION ALL\n".join([
    rules_sql("seq", [
        ("not_finite", "error", "FALSE"),
        ("negative_time", "error", "elapsed_time_s < 0"),
        ("hours_inconsistent", "error", "ABS(elapsed_hours - elapsed_time_s / 3600) > 1e-9"),
        ("days_inconsistent", "error", "ABS(elapsed_days - elapsed_time_s / 86400) > 1e-9"),
        ("loss_inconsistent", "error", "ABS(capacity_loss_pct - (100 - capacity_retention_pct)) > 1e-9"),
        ("soc_out_of_range", "error", "NOT storage_soc_fraction BETWEEN 0 AND 1"),
        ("temperature_out_of_range", "error", "NOT temperature_c BETWEEN -40 AND 100"),
        ("capacity_not_positive", "error", "capacity_ah <= 0 OR resistance_dc_ohm <= 0"),
        ("resistance_not_in_ohms", "error", "NOT resistance_dc_ohm BETWEEN 0.001 AND 1"),
        ("capacity_not_in_ah", "error", "NOT capacity_ah / nominal_capacity_ah BETWEEN 0.1 AND 1.25"),
        ("retention_inconsistent", "error", "ABS(capacity_retention_pct - 100 * capacity_ah / cap0) > 1e-9"),
        ("resistance_growth_inconsistent", "error", "ABS(resistance_growth_pct - 100 * (resistance_dc_ohm / res0 - 1)) > 1e-9"),
        ("time_not_from_zero", "error", "pt IS NULL AND elapsed_time_s <> 0"),
        ("time_not_increasing", "error", "elapsed_time_s <= pt"),
        ("checkup_not_contiguous", "error", "checkup_index <> COALESCE(pi + 1, 0)"),
        ("initial_retention_not_100", "error", "pt IS NULL AND ABS(capacity_retention_pct - 100) > 1e-8"),
    ]),
    rules_sql("per", [
        ("temperature_not_constant", "error", "t0 <> t1"),
        ("soc_not_constant", "error", "s0 <> s1"),
        ("unexpected_checkup_count", "error", "n <> 60"),
    ]),
    "SELECT 'unexpected_condition_count', 'error', ABS(COUNT(*) - 17) FROM per",
    dup_sql("checkups", "condition_id, elapsed_time_s", "duplicate_time"),
    dup_sql("checkups", "condition_id, checkup_index", "duplicate_checkup"),
    dup_sql("per", "t0, s0", "condition_profile_not_unique"),
]))
def b3_calendar_contract(spark, sf_dir):
    checkups = A.calendar_obs(spark, sf_dir).select(*A._select(CAL_CHECK_EXPRS))
    return C.calendar_contract(checkups, expected_conditions=17, expected_rows=60)


COHORT_EXPRS = {
    "cell_id": "o_custkey", "condition_id": "o_orderpriority",
    "elapsed_days": "CAST(l_linenumber AS DOUBLE)", "temperature_c": "l_tax",
}


@register(
    "b4_cohort_contract",
    "cell_id:i n_rows:i unexpected_days:i missing_days:i varying status",
    """WITH obs AS (SELECT o_custkey AS cell_id, o_orderpriority AS condition_id,
        CAST(l_linenumber AS DOUBLE) AS elapsed_days, l_tax AS temperature_c
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    cohort AS (SELECT c_custkey AS cell_id, CASE WHEN c_nationkey < 12 THEN '1-URGENT' ELSE '5-LOW' END AS declared
        FROM customer WHERE c_mktsegment <> 'BUILDING'),
    per AS (SELECT cell_id, COUNT(*) AS n_rows,
        COUNT(*) FILTER (WHERE elapsed_days NOT IN (1, 2, 3, 4, 5)) AS unexpected_days,
        COUNT(DISTINCT CASE WHEN elapsed_days IN (1, 2, 3, 4, 5) THEN elapsed_days END) AS hit,
        MIN(condition_id) AS c0, MAX(condition_id) AS c1,
        MIN(temperature_c) <> MAX(temperature_c) AS v FROM obs GROUP BY 1)
    SELECT cell_id, COALESCE(n_rows, 0) AS n_rows, COALESCE(unexpected_days, 0) AS unexpected_days,
        5 - COALESCE(hit, 0) AS missing_days, CASE WHEN v THEN 'temperature_c' ELSE '' END AS varying,
        CASE WHEN declared IS NULL THEN 'not_in_cohort' WHEN n_rows IS NULL THEN 'absent'
             WHEN c0 <> c1 OR c0 <> declared THEN 'condition_changed'
             WHEN unexpected_days > 0 OR hit <> 5 OR n_rows <> 5 THEN 'day_grid_changed' ELSE 'ok' END AS status
    FROM cohort FULL JOIN per USING (cell_id)""",
)
def b4_cohort_contract(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    obs = items.join(orders, items.l_orderkey == orders.o_orderkey).select(*A._select(COHORT_EXPRS))
    cohort = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("cell_id"),
        F.expr("CASE WHEN c_nationkey < 12 THEN '1-URGENT' ELSE '5-LOW' END").alias("condition_id"),
    )
    return C.cohort_contract(obs, cohort, expected_days=[1, 2, 3, 4, 5], constant=["temperature_c"])


FEATURE_EXPRS = {
    "cell_id": "cell_id", "cycle_index": "cycle_index", "protocol_id": "protocol_id",
    "elapsed_days": "cycle_index + (temperature_avg_c - 25e0)",
    "sample_count": "charge_time_s / 6e2",
    "discharge_capacity_ah": "discharge_capacity_ah",
    "integrated_discharge_capacity_ah": "discharge_capacity_ah + (temperature_avg_c - 27e0) / 4e0",
    "capacity_integration_ratio": "(discharge_capacity_ah + (temperature_avg_c - 27e0) / 4e0) / discharge_capacity_ah",
    "discharge_duration_s": "charge_time_s",
    "time_to_3p8_v_s": "2e2 + 1e1 * (temperature_avg_c - 25e0)",
    "time_to_3p6_v_s": "2.2e2", "time_to_3p4_v_s": "charge_time_s - 4e2",
    "common_window_3p8_to_3p4_duration_s": "charge_time_s - 6e2 - 1e1 * (temperature_avg_c - 25e0)",
    "voltage_at_0p5_ah_v": "3.6e0", "voltage_at_1p0_ah_v": "3.5e0 + (temperature_avg_c - 25e0) / 3e1",
    "mean_dv_dq_0p5_to_1p0_v_per_ah": "((3.5e0 + (temperature_avg_c - 25e0) / 3e1) - 3.6e0) / 5e-1",
    "voltage_min_v": "2.7e0", "voltage_max_v": "3.6e0",
    "discharge_cutoff_voltage_v": "CASE WHEN cycle_index = 500 AND batch_id = '1' THEN 2.5e0 ELSE 2.7e0 END",
}


@register("b5_cycle_feature_contract", RULE_SPEC, with_ctes(
    "cycles", "", f"feats AS (SELECT {A._sql(FEATURE_EXPRS)} FROM cycles)",
    """seq AS (SELECT *, LAG(cycle_index) OVER w AS pi, LAG(elapsed_days) OVER w AS pd FROM feats
        WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_index))""",
    """per AS (SELECT cell_id, MIN(protocol_id) AS p0, MAX(protocol_id) AS p1,
        MIN(discharge_cutoff_voltage_v) AS u0, MAX(discharge_cutoff_voltage_v) AS u1 FROM feats GROUP BY 1)""",
) + rules_sql("seq", [
    ("too_few_samples", "error", "sample_count < 2"),
    ("negative_elapsed", "error", "elapsed_days < 0"),
    ("capacity_not_positive", "error", "integrated_discharge_capacity_ah <= 0"),
    ("ratio_out_of_range", "error", "NOT capacity_integration_ratio BETWEEN 0.5 AND 1.5"),
    ("ratio_inconsistent", "error",
     "ABS(capacity_integration_ratio - integrated_discharge_capacity_ah / discharge_capacity_ah) > 1e-12"),
    ("crossings_not_ordered", "error",
     "NOT (time_to_3p8_v_s <= time_to_3p6_v_s + 1e-12 AND time_to_3p6_v_s <= time_to_3p4_v_s + 1e-12)"),
    ("crossing_outside_discharge", "error",
     "LEAST(time_to_3p8_v_s, time_to_3p6_v_s, time_to_3p4_v_s) < -1e-12 OR "
     "GREATEST(time_to_3p8_v_s, time_to_3p6_v_s, time_to_3p4_v_s) > discharge_duration_s + 1e-12"),
    ("window_inconsistent", "error",
     "ABS(common_window_3p8_to_3p4_duration_s - (time_to_3p4_v_s - time_to_3p8_v_s)) > 1e-9"),
    ("dvdq_inconsistent", "error",
     "ABS(mean_dv_dq_0p5_to_1p0_v_per_ah - (voltage_at_1p0_ah_v - voltage_at_0p5_ah_v) / 0.5) > 1e-12"),
    ("dvdq_positive", "error", "mean_dv_dq_0p5_to_1p0_v_per_ah > 1e-12"),
    ("voltage_outside_range", "error",
     "NOT (voltage_at_0p5_ah_v BETWEEN voltage_min_v - 1e-12 AND voltage_max_v + 1e-12 AND "
     "voltage_at_1p0_ah_v BETWEEN voltage_min_v - 1e-12 AND voltage_max_v + 1e-12)"),
    ("cycles_not_contiguous", "error", "cycle_index <> COALESCE(pi + 1, 1)"),
    ("elapsed_not_monotone", "error", "elapsed_days < pd"),
]) + "\nUNION ALL\n" + rules_sql("per", [
    ("protocol_not_constant", "error", "p0 <> p1"), ("cutoff_not_constant", "error", "u0 <> u1"),
]))
def b5_cycle_feature_contract(spark, sf_dir):
    return C.cycle_feature_contract(A.cycles(spark, sf_dir).select(*A._select(FEATURE_EXPRS)))


# No check query: the decision is made on column names.
@register("b6_protected_columns", "table_name column_name rows_scanned:i", with_ctes("cycles", """
    SELECT 'cycles' AS table_name, 'internal_resistance_ohm' AS column_name, COUNT(*) AS rows_scanned FROM cycles
    UNION ALL SELECT 'cell_labels', UNNEST(['cycle_life', 'eol_threshold', 'is_censored']), COUNT(*) FROM supplier"""))
def b6_protected_columns(spark, sf_dir):
    cyc, lab = A.cycles(spark, sf_dir), A.cell_labels(spark, sf_dir)
    out = None
    for name, df in [("cycles", cyc), ("cell_labels", lab)]:
        cols = F.array(*[F.lit(c) for c in C.protected_columns(df)]).cast("array<string>")
        part = df.agg(F.count(F.lit(1)).alias("rows_scanned")).select(
            F.lit(name).alias("table_name"), F.explode(cols).alias("column_name"), "rows_scanned")
        out = part if out is None else out.unionByName(part)
    return out


GAPPY = """gappy AS (SELECT cell_id, cycle_index,
    CASE WHEN temperature_avg_c > 31.5e0 THEN NULL ELSE internal_resistance_ohm END AS internal_resistance_ohm,
    CASE WHEN temperature_avg_c < 25.6e0 THEN CAST('NaN' AS DOUBLE) ELSE charge_time_s END AS charge_time_s FROM cycles)"""


def _gappy(spark, sf_dir):
    return A.cycles(spark, sf_dir).select(
        "cell_id", "cycle_index",
        F.expr("CASE WHEN temperature_avg_c > 31.5e0 THEN NULL ELSE internal_resistance_ohm END").alias("internal_resistance_ohm"),
        F.expr("CASE WHEN temperature_avg_c < 25.6e0 THEN CAST('NaN' AS DOUBLE) ELSE charge_time_s END").alias("charge_time_s"),
    )


_FF = """scan AS (SELECT cell_id, cycle_index, internal_resistance_ohm AS r, charge_time_s AS q,
    LAST_VALUE(CASE WHEN NOT isnan(internal_resistance_ohm) THEN internal_resistance_ohm END IGNORE NULLS) OVER w AS fr,
    LAST_VALUE(CASE WHEN NOT isnan(charge_time_s) THEN charge_time_s END IGNORE NULLS) OVER w AS fq
    FROM gappy WINDOW w AS (PARTITION BY cell_id ORDER BY cycle_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@register("b7_forward_fill", "cell_id cycle_index:i internal_resistance_ohm:d8 charge_time_s:d", with_ctes(
    "cycles", "SELECT cell_id, cycle_index, fr AS internal_resistance_ohm, fq AS charge_time_s FROM scan", GAPPY, _FF))
def b7_forward_fill(spark, sf_dir):
    return C.forward_fill(_gappy(spark, sf_dir), "cell_id", "cycle_index", ["internal_resistance_ohm", "charge_time_s"])[0]


@register("b7_fill_ledger", "cell_id cycle_index:i column filled_value:d leading_null:b".replace("column", "filled_column"), with_ctes(
    "cycles", """SELECT cell_id, cycle_index, 'internal_resistance_ohm' AS filled_column, fr AS filled_value, fr IS NULL AS leading_null
    FROM scan WHERE r IS NULL UNION ALL
    SELECT cell_id, cycle_index, 'charge_time_s', fq, fq IS NULL FROM scan WHERE isnan(q)""", GAPPY, _FF))
def b7_fill_ledger(spark, sf_dir):
    ledger = C.forward_fill(_gappy(spark, sf_dir), "cell_id", "cycle_index", ["internal_resistance_ohm", "charge_time_s"])[1]
    return ledger.withColumnRenamed("column", "filled_column")


@register("b8_contiguous_support", "cell_id", with_ctes("cycles", """SELECT cell_id FROM cycles WHERE cycle_index <= 600
    GROUP BY cell_id HAVING COUNT(*) = 600 AND MIN(cycle_index) = 1 AND MAX(cycle_index) = 600 AND COUNT(DISTINCT cycle_index) = 600"""))
def b8_contiguous_support(spark, sf_dir):
    return C.contiguous_support(A.cycles(spark, sf_dir), "cell_id", "cycle_index", 600)


@register("b9_select_prefix", "condition_id:i checkup_index:i elapsed_days:d capacity_loss_pct:d", with_ctes(
    "cal", "SELECT * FROM calendar_obs WHERE checkup_index < 10"))
def b9_select_prefix(spark, sf_dir):
    return C.select_prefix(A.calendar_obs(spark, sf_dir), "condition_id", "checkup_index", 10)[0]


@register("b9_incomplete_prefix", "condition_id:i n_prefix:i", with_ctes("cal", """SELECT condition_id,
    COUNT(DISTINCT CASE WHEN checkup_index < 70 THEN checkup_index END) AS n_prefix FROM calendar_obs GROUP BY 1 HAVING n_prefix < 70"""))
def b9_incomplete_prefix(spark, sf_dir):
    return C.select_prefix(A.calendar_obs(spark, sf_dir), "condition_id", "checkup_index", 70)[1]


_MARKS = "(VALUES (20), (100), (300)) AS m(prefix_cycle)"


@register("b10_prefix_future", "role prefix_cycle:i n_rows:i n_cells:i first_cycle:i last_cycle:i capacity:d4", with_ctes(
    "cycles", f"""SELECT CASE WHEN cycle_index <= prefix_cycle THEN 'prefix' ELSE 'future' END AS role, prefix_cycle,
    COUNT(*) AS n_rows, COUNT(DISTINCT cell_id) AS n_cells, MIN(cycle_index) AS first_cycle, MAX(cycle_index) AS last_cycle,
    SUM(discharge_capacity_ah) AS capacity FROM cycles, {_MARKS} GROUP BY 1, 2"""))
def b10_prefix_future(spark, sf_dir):
    prefix, future = C.prefix_and_future(A.cycles(spark, sf_dir), "cycle_index", [20, 100, 300])
    both = prefix.withColumn("role", F.lit("prefix")).unionByName(future.withColumn("role", F.lit("future")))
    return both.groupBy("role", "prefix_cycle").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cell_id").alias("n_cells"),
        F.min("cycle_index").alias("first_cycle"), F.max("cycle_index").alias("last_cycle"),
        F.sum("discharge_capacity_ah").alias("capacity"),
    )


@register("b11_training_and_targets", "role batch_id cell_id prefix_cycle:i n_rows:i capacity:d4", with_ctes(
    "cycles", f"""SELECT 'training' AS role, batch_id, cell_id, 0 AS prefix_cycle, COUNT(*) AS n_rows, SUM(discharge_capacity_ah) AS capacity
    FROM cycles WHERE batch_id = '0' GROUP BY 2, 3 UNION ALL
    SELECT 'target', batch_id, cell_id, prefix_cycle, COUNT(*), SUM(discharge_capacity_ah)
    FROM cycles, {_MARKS} WHERE batch_id IN ('1', '2') AND cycle_index <= prefix_cycle GROUP BY 2, 3, 4"""))
def b11_training_and_targets(spark, sf_dir):
    train, target = C.training_and_targets(
        A.cycles(spark, sf_dir), "batch_id", "0", ["1", "2"], "cycle_index", [20, 100, 300])
    both = train.withColumn("role", F.lit("training")).withColumn("prefix_cycle", F.lit(0)).unionByName(
        target.withColumn("role", F.lit("target")))
    return both.groupBy("role", "batch_id", "cell_id", "prefix_cycle").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("discharge_capacity_ah").alias("capacity"))


def fingerprint_sql(source: str, text: str, keys: str = "") -> str:
    sums = ", ".join(f"SUM(CAST('0x' || SUBSTR(h, {1 + 15 * i}, 15) AS BIGINT))" for i in range(4))
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return (
        f"SELECT {lead}COUNT(*) AS n_rows, sha256(concat_ws('|', COUNT(*), {sums})) AS fingerprint "
        f"FROM (SELECT {lead}sha256({text}) AS h FROM {source}) {group}"
    )


@register("b12_fingerprint_table", "n_rows:i fingerprint", fingerprint_sql(
    "lineitem", "concat_ws('|', l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT), CAST(FLOOR(l_extendedprice * 100 + 0.5) AS BIGINT), l_returnflag)"))
def b12_fingerprint_table(spark, sf_dir):
    text = C.row_text(["l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint"),
                       F.floor(F.col("l_extendedprice") * 100 + 0.5), "l_returnflag"])
    return C.fingerprint(table(spark, sf_dir, "lineitem"), text)


@register("b12_fingerprint_entities", "cell_id:i n_rows:i fingerprint", fingerprint_sql(
    "(SELECT *, l_suppkey AS cell_id FROM lineitem)", "concat_ws('|', l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT))", "cell_id"))
def b12_fingerprint_entities(spark, sf_dir):
    text = C.row_text(["l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint")])
    return C.fingerprint(table(spark, sf_dir, "lineitem").withColumn("cell_id", F.col("l_suppkey")), text, ["cell_id"])


FIT_EXPRS = {
    "cluster_id": "l_orderkey", "model_id": "l_returnflag", "variant_id": "l_linenumber",
    "fit_status": "CASE WHEN l_discount = 1e-1 THEN 'failed' WHEN l_discount = 9e-2 THEN 'other' ELSE 'ok' END",
    "prefix_rmse_pp": "CASE WHEN l_discount = 1e-1 AND l_tax < 7e-2 THEN NULL WHEN l_tax = 1e-2 AND l_discount = 0e0 THEN NULL"
    " ELSE l_quantity - 2e0 END",
    "max_abs_residual_pp": "CASE WHEN l_discount = 1e-1 AND l_tax < 7e-2 THEN NULL ELSE l_quantity + l_tax * 1e2 - 4e0 END",
    "credible_variant": "CASE WHEN l_discount = 5e-2 AND l_tax = 5e-2 THEN NULL ELSE l_quantity < 25e0 END",
}
_FITS = f"fits AS (SELECT {A._sql(FIT_EXPRS)} FROM lineitem)"


@register("b13_member_fit_contract", RULE_SPEC, with_ctes(
    "", "", _FITS, "forecasts AS (SELECT DISTINCT cluster_id, model_id, variant_id FROM fits WHERE fit_status <> 'other' AND credible_variant IS NOT NULL)",
    "variants AS (SELECT DISTINCT model_id, variant_id FROM fits WHERE variant_id <= 6)",
    "ok_keys AS (SELECT DISTINCT cluster_id, model_id, variant_id FROM fits WHERE fit_status = 'ok')",
) + rules_sql("fits", [
    ("unknown_status", "error", "fit_status NOT IN ('ok', 'failed')"),
    ("ok_without_values", "error", "fit_status = 'ok' AND (prefix_rmse_pp IS NULL OR max_abs_residual_pp IS NULL)"),
    ("failed_with_values", "error", "fit_status <> 'ok' AND NOT (prefix_rmse_pp IS NULL OR max_abs_residual_pp IS NULL)"),
    ("values_not_finite", "error", "FALSE"),
    ("negative_error", "error", "fit_status = 'ok' AND (prefix_rmse_pp < 0 OR max_abs_residual_pp < 0)"),
    ("rmse_above_max_residual", "error", "fit_status = 'ok' AND prefix_rmse_pp > max_abs_residual_pp + 1e-9"),
    ("credible_null", "error", "credible_variant IS NULL"),
    ("credible_but_failed", "error", "fit_status <> 'ok' AND credible_variant"),
]) + "\nUNION ALL\n" + dup_sql("fits", "cluster_id, model_id, variant_id", "duplicate_fit") + """
UNION ALL SELECT 'variant_not_registered', 'error', COUNT(*) FROM fits f ANTI JOIN variants v USING (model_id, variant_id)
UNION ALL SELECT 'registry_incomplete', 'error', COUNT(*) FROM (SELECT cluster_id FROM fits GROUP BY 1
    HAVING COUNT(DISTINCT model_id || '|' || variant_id) <> (SELECT COUNT(*) FROM variants))
UNION ALL SELECT 'fit_without_forecast', 'error', COUNT(*) FROM ok_keys ANTI JOIN forecasts USING (cluster_id, model_id, variant_id)
UNION ALL SELECT 'forecast_without_fit', 'error', COUNT(*) FROM forecasts ANTI JOIN ok_keys USING (cluster_id, model_id, variant_id)""")
def b13_member_fit_contract(spark, sf_dir):
    fits = table(spark, sf_dir, "lineitem").select(*A._select(FIT_EXPRS))
    forecasts = fits.filter("fit_status <> 'other' and credible_variant is not null").select(
        "cluster_id", "model_id", "variant_id").distinct()
    variants = fits.filter("variant_id <= 6").select("model_id", "variant_id").distinct()
    return C.member_fit_contract(fits, forecasts, variants, entity=["cluster_id"], status_values=["ok", "failed"])


FILE_EXPRS = {
    "path": "concat(domain_, '/', p_name, '_', CAST(p_partkey AS STRING), CASE WHEN p_size % 3 = 0 THEN '.csv' WHEN p_size % 3 = 1 THEN '.JSON' ELSE '' END)",
    "size_bytes": "p_size * 1000",
}
_FILES = """files AS (SELECT p_brand || '/' || p_name || '_' || p_partkey ||
    CASE WHEN p_size % 3 = 0 THEN '.csv' WHEN p_size % 3 = 1 THEN '.JSON' ELSE '' END AS path, p_size * 1000 AS size_bytes FROM part)"""
_INV = """inv AS (SELECT LOWER(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS extension, split_part(path, '/', 1) AS prefix,
    COUNT(*) AS n_files, SUM(size_bytes) AS n_bytes FROM files GROUP BY 1, 2)"""


def _files(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.concat("p_brand", F.lit("/"), "p_name", F.lit("_"), F.col("p_partkey").cast("string"),
                 F.expr("CASE WHEN p_size % 3 = 0 THEN '.csv' WHEN p_size % 3 = 1 THEN '.JSON' ELSE '' END")).alias("path"),
        (F.col("p_size") * 1000).alias("size_bytes"),
    )


@register("b14_inventory", "extension prefix n_files:i n_bytes:i", with_ctes("", "SELECT * FROM inv", _FILES, _INV))
def b14_inventory(spark, sf_dir):
    return C.inventory(_files(spark, sf_dir))


@register("b14_inventory_differences", "extension prefix n_files:i n_bytes:i expected_files:i expected_bytes:i", with_ctes(
    "", """SELECT extension, prefix, COALESCE(n_files, 0) AS n_files, COALESCE(n_bytes, 0) AS n_bytes,
    COALESCE(expected_files, 0) AS expected_files, COALESCE(expected_bytes, 0) AS expected_bytes
    FROM inv FULL JOIN declared USING (extension, prefix)
    WHERE COALESCE(n_files, 0) <> COALESCE(expected_files, 0) OR COALESCE(n_bytes, 0) <> COALESCE(expected_bytes, 0)""",
    _FILES, _INV, """declared AS (SELECT CASE WHEN extension = '' THEN 'mat' ELSE extension END AS extension, prefix,
    n_files AS expected_files, n_bytes + CASE WHEN n_files % 2 = 0 THEN 0 ELSE 1 END AS expected_bytes FROM inv)"""))
def b14_inventory_differences(spark, sf_dir):
    observed = C.inventory(_files(spark, sf_dir))
    declared = observed.select(
        F.when(F.col("extension") == "", "mat").otherwise(F.col("extension")).alias("extension"), "prefix", "n_files",
        (F.col("n_bytes") + F.when(F.col("n_files") % 2 == 0, 0).otherwise(1)).alias("n_bytes"))
    return C.inventory_differences(observed, declared)
