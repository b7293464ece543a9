"""Test adapters: the star-schema tables re-read as trajectories (no battery meaning).

Scalar expressions are plain SQL text that Spark and DuckDB evaluate alike (double literals are
written with an exponent), so each adapter exists once as expressions, once as a Spark plan with
skew-safe ordering, and once as a common table expression for the check queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlytics.plans.scan import grouped_rank, previous, running

DAY_US = 86_400_000_000

CYCLE_EXPRS = {
    "dataset_id": "'TPC'",
    "cell_id": "CAST(l_suppkey AS STRING)",
    "batch_id": "CAST(s_nationkey % 3 AS STRING)",
    "protocol_id": "CAST(s_nationkey AS STRING)",
    "cycle_index": "cycle_index",
    "discharge_capacity_ah": "1.1e0 - 5e-4 * cycle_index + 5e-4 * (l_quantity - 25e0)",
    "internal_resistance_ohm": "1.8e-2 + 1e-5 * cycle_index + 1e-3 * l_discount",
    "temperature_avg_c": "25e0 + 50e0 * l_tax",
    "temperature_max_c": "28e0 + 50e0 * l_tax",
    "charge_time_s": "600e0 + l_extendedprice / 1e3",
}

LABEL_EXPRS = {
    "dataset_id": "'TPC'",
    "cell_id": "CAST(s_suppkey AS STRING)",
    "batch_id": "CAST(s_nationkey % 3 AS STRING)",
    "protocol_id": "CAST(s_nationkey AS STRING)",
    "cycle_life": "5e2 + ABS(s_acctbal) / 1e1",
    "eol_threshold": "8e-1",
    "is_censored": "s_suppkey % 4 = 0",
}

CURVE_EXPRS = {
    "test_id": "CAST(l_suppkey AS STRING)",
    "cycle_number": "CASE WHEN l_orderkey % 2 = 0 THEN 10 ELSE 100 END",
    "step_type": "CASE WHEN l_returnflag = 'R' THEN 'charge' ELSE 'discharge' END",
    "timestamp_s": "CAST(l_orderkey * 10 + l_linenumber AS DOUBLE)",
    "current_A": "CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE -1e0 END - l_tax",
    "voltage_V": "2e0 + 1.5e0 * (l_quantity - 1e0) / 49e0",
    "coulomb_count_Ah": "1.1e0 * (1e0 - (l_quantity - 1e0) / 49e0) + 1e-1 * l_discount"
    " - CASE WHEN l_orderkey % 2 = 0 THEN 0e0 ELSE 2e-2 END",
    "temperature_C": "25e0 + 50e0 * l_tax",
}

CAL_EXPRS = {
    "condition_id": "user_id",
    "checkup_index": "checkup_index",
    "temperature_c": "1e1 * (user_id % 6)",
    "storage_soc_fraction": "(user_id % 9) / 8e0",
    "elapsed_days": "elapsed_days",
    "capacity_loss_pct": "CASE WHEN checkup_index = 0 THEN 0e0"
    " ELSE 3e-1 * SQRT(elapsed_days) + 5e-3 * (LEAST(value, 5e1) - 12e0)"
    " - CASE WHEN user_id % 3 = 0 THEN 1e0 - EXP(-elapsed_days / 2e0) ELSE 0e0 END END",
}

# One row per order: a pool of forecasts to rank, issue or refuse.
POOL_EXPRS = {
    "partition_id": "o_orderpriority",
    "cluster_id": "o_orderkey",
    "family": "o_orderstatus",
    "subset_id": "CAST(o_custkey % 4 AS STRING)",
    "danger": "FLOOR(o_totalprice / 5e2) / 1e3",
    "disagreement": "FLOOR((o_totalprice * 7e0) / 3e2 - 2e2 * FLOOR(o_totalprice * 7e0 / 6e4)) / 1e1",
    "iae": "ABS(o_totalprice / 1e5 - 2e0) + 5e-1",
    "endpoint_error": "o_totalprice / 5e4 - 4.5e0",
}

# One row per line item: a truth with three predicted quantiles.
QUANTILE_EXPRS = {
    "cell_id": "l_suppkey",
    "group_id": "l_linestatus",
    "route": "l_returnflag",
    "protocol_id": "l_linenumber",
    "row_id": "l_orderkey",
    "truth": "l_extendedprice",
    "p10": "l_quantity * 9e2 + 1e2",
    "p50": "l_quantity * 1.5e3 + 1e2",
    "p90": "l_quantity * 2.1e3 + 1e2",
    "is_censored": "l_shipdate >= TIMESTAMP '2001-06-01 00:00:00'",
}

# One row per customer: a right-censored lifetime and a forecast survival curve.
SURVIVAL_EXPRS = {
    "unit_id": "c_custkey",
    "stratum": "c_mktsegment",
    "time": "CAST(FLOOR(ABS(c_acctbal) / 2e1) + 1e0 AS DOUBLE)",
    "event": "c_nationkey % 3 <> 0",
    "scale": "1e2 + 1e1 * c_nationkey",
}


def _select(exprs: dict[str, str]) -> list:
    return [F.expr(e).alias(n) for n, e in exprs.items()]


def _sql(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {n}" for n, e in exprs.items())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        "l_quantity", "l_discount", "l_tax", "l_extendedprice",
    )
    ranked = grouped_rank(
        items, ["l_suppkey"], F.unix_date(F.col("l_shipdate").cast("date")),
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], "cycle_index",
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return ranked.join(supplier, ranked.l_suppkey == supplier.s_suppkey).select(*_select(CYCLE_EXPRS))


def cell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(*_select(LABEL_EXPRS))


def curve_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_select(CURVE_EXPRS))


def calendar_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    day = F.unix_date(F.col("ts").cast("date"))
    ranked = running(
        events, ["user_id"], day, ["ts", "event_id"], {"_rank": ("count", F.lit(1)), "_t0": ("total_min", "ts")}
    )
    dated = ranked.select(
        "user_id", "value", (F.col("_rank") - 1).alias("checkup_index"),
        (F.expr("timestampdiff(MICROSECOND, _t0, ts)") / F.lit(float(DAY_US))).alias("elapsed_days"),
    )
    return dated.select(*_select(CAL_EXPRS)).withColumn(
        "capacity_retention_pct", F.lit(100.0) - F.col("capacity_loss_pct")
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .select(*_select(POOL_EXPRS))
        .withColumn("content_hash", F.sha2(F.col("cluster_id").cast("string"), 256))
    )


def quantile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_select(QUANTILE_EXPRS))


def survival_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(*_select(SURVIVAL_EXPRS))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("entity_id"), F.col("label").alias("domain"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


CTE = {
    "cycles": f"""cycles AS (SELECT {_sql(CYCLE_EXPRS)} FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey
            ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS cycle_index
        FROM lineitem) l JOIN supplier ON s_suppkey = l_suppkey)""",
    "labels_": f"cell_labels AS (SELECT {_sql(LABEL_EXPRS)} FROM supplier)",
    "curves": f"curve_samples AS (SELECT {_sql(CURVE_EXPRS)} FROM lineitem)",
    "cal": f"""calendar_obs AS (SELECT *, 1e2 - capacity_loss_pct AS capacity_retention_pct FROM (
        SELECT {_sql(CAL_EXPRS)} FROM (
        SELECT user_id, value,
            ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS checkup_index,
            (epoch_us(ts) - MIN(epoch_us(ts)) OVER (PARTITION BY user_id)) / 864e8 AS elapsed_days
        FROM events)))""",
    "pool": f"pool AS (SELECT {_sql(POOL_EXPRS)}, sha256(CAST(o_orderkey AS VARCHAR)) AS content_hash FROM orders)",
    "quant": f"quantile_rows AS (SELECT {_sql(QUANTILE_EXPRS)} FROM lineitem)",
    "surv": f"survival_units AS (SELECT {_sql(SURVIVAL_EXPRS)} FROM customer)",
    "sig": """signatures AS (SELECT vec_id AS entity_id, label AS domain,
        CAST(embedding AS DOUBLE[]) AS features FROM embeddings)""",
}


def with_ctes(names: str, body: str, *more: str) -> str:
    """Prepend the named adapter expressions (and further ``name AS (...)`` texts) to a query."""
    parts = [CTE[n] for n in names.split()] + list(more)
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


__all__ = [
    "cycles", "cell_labels", "curve_samples", "calendar_obs", "pool", "quantile_rows",
    "survival_units", "signatures", "table", "with_ctes", "CTE", "previous", "running",
]
