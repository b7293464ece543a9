"""Source, extraction and normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.queries.registry import register
from trajlytics.session import shared_path
from trajlytics.sources import adapters as A
from trajlytics.sources import tables as T
from trajlytics.sources.adapters import table, with_ctes


@register("a1_scan_by_suffix", "l_returnflag n_rows:i quantity:d", """SELECT l_returnflag, COUNT(*) AS n_rows, SUM(l_quantity) AS quantity
    FROM lineitem WHERE l_discount > 0.05 GROUP BY 1""")
def a1_scan_by_suffix(spark, sf_dir):
    df = T.read_table(spark, f"{sf_dir}/lineitem.parquet")
    return df.filter(F.col("l_discount") > 0.05).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("quantity"))




def _round_trip(spark, sf_dir, name: str, partition_by=()):
    """Orders with nulls, empty texts, commas and quotes, written to the shared folder and read again with their schema."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", _odd_text().alias("note"))
    path = shared_path(spark, name)
    T.write_table(orders, path, partition_by=partition_by)
    return T.read_table(spark, path, orders.schema)


def _odd_text():
    k = F.col("o_orderkey") % 5
    return F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, 'a, "b"').otherwise(F.col("o_orderpriority"))


_ROUND_TRIP = """SELECT o_orderkey, o_totalprice, o_orderstatus,
    CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'a, "b"' ELSE o_orderpriority END AS note FROM orders"""


@register("a1_csv_round_trip", "o_orderkey:i o_totalprice:d o_orderstatus note", _ROUND_TRIP)
def a1_csv_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "orders.csv")


@register("a2_parquet_round_trip", "o_orderkey:i o_totalprice:d o_orderstatus note", _ROUND_TRIP)
def a2_parquet_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "orders.parquet", ["o_orderstatus"])


def _selected_tests(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("test_id"))


_TESTS = "tests AS (SELECT CAST(s_suppkey AS VARCHAR) AS test_id FROM supplier WHERE s_acctbal > 0)"


@register("a3_curve_subset", "test_id cycle_number:i timestamp_s:d voltage_V:d coulomb_count_Ah:d", with_ctes("curves", """
    SELECT c.* FROM curve_samples c SEMI JOIN tests USING (test_id) WHERE cycle_number IN (100) AND step_type = 'discharge'""", _TESTS))
def a3_curve_subset(spark, sf_dir):
    return T.curve_subset(A.curve_samples(spark, sf_dir), _selected_tests(spark, sf_dir), [100])


@register("a4_curve_completeness", "test_id cycle_number:i sample_count:i status", with_ctes("curves", """
    SELECT test_id, cycle_number, COALESCE(n, 0) AS sample_count,
      CASE WHEN n IS NULL THEN 'missing' WHEN e IS NULL THEN 'unexpected' ELSE 'observed' END AS status
    FROM (SELECT test_id, cycle_number, 1 AS e FROM tests, (SELECT UNNEST([10, 55, 100]) AS cycle_number))
    FULL JOIN (SELECT test_id, cycle_number, COUNT(*) AS n FROM curve_samples WHERE step_type = 'discharge' GROUP BY 1, 2) USING (test_id, cycle_number)""", _TESTS))
def a4_curve_completeness(spark, sf_dir):
    observed = A.curve_samples(spark, sf_dir).filter("step_type = 'discharge'")
    return T.curve_completeness(observed, _selected_tests(spark, sf_dir), [10, 55, 100])


def _segments(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("barcode"), F.col("vec_id").alias("source_file"),
        F.expr("date_add(DATE '2020-01-01', CAST((vec_id * 37) % 1009 AS INT))").alias("first_time"),
        F.expr("transform(sequence(0, size(embedding) - 1), i -> CAST(i + CASE WHEN vec_id % 7 = 3 THEN 1 ELSE 0 END AS BIGINT))").alias("raw_cycle_index"),
        F.col("embedding").cast("array<double>").alias("capacity"))


_SEG = """seg AS (SELECT label AS barcode, vec_id AS source_file, CAST(DATE '2020-01-01' + CAST((vec_id * 37) % 1009 AS INT) AS DATE) AS first_time,
        len(embedding) AS summary_rows, CASE WHEN vec_id % 7 = 3 THEN 1 ELSE 0 END AS shift, CAST(embedding AS DOUBLE[]) AS capacity FROM embeddings),
    ord AS (SELECT *, ROW_NUMBER() OVER w AS segment_index,
        COALESCE(SUM(summary_rows) OVER (PARTITION BY barcode ORDER BY first_time, source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
        FROM seg WINDOW w AS (PARTITION BY barcode ORDER BY first_time, source_file))"""
_SEG_BUCKET = "TRUNC(first_time, 'month')"


@register("a5_merge_segments", "barcode:i source_file:i segment_index:i raw_cycle_index:i cycle_index:i valid_index:b capacity:d", with_ctes("", """
    SELECT barcode, source_file, segment_index, i + shift AS raw_cycle_index, i + shift + off + 1 AS cycle_index, shift = 0 AS valid_index, capacity[i + 1] AS capacity
    FROM (SELECT *, UNNEST(range(summary_rows)) AS i FROM ord)""", _SEG))
def a5_merge_segments(spark, sf_dir):
    return T.merge_segments(_segments(spark, sf_dir), ["capacity"], _SEG_BUCKET)


@register("a6_segment_inventory", "barcode:i source_file:i summary_rows:i first_raw_cycle_index:i last_raw_cycle_index:i segment_index:i segment_count:i cell_summary_rows:i usable_at_observation_cycle:b",
          with_ctes("", """SELECT barcode, source_file, summary_rows, shift AS first_raw_cycle_index, shift + summary_rows - 1 AS last_raw_cycle_index,
    segment_index, COUNT(*) OVER (PARTITION BY barcode) AS segment_count, SUM(summary_rows) OVER (PARTITION BY barcode) AS cell_summary_rows,
    SUM(summary_rows) OVER (PARTITION BY barcode) >= 3200 AS usable_at_observation_cycle FROM ord""", _SEG))
def a6_segment_inventory(spark, sf_dir):
    return T.segment_inventory(_segments(spark, sf_dir), _SEG_BUCKET, 3200)


@register("a7_unpivot_replicates", "l_orderkey:i l_linenumber:i l_partkey:i replicate_id cycle_life:d", """
    SELECT l_orderkey, l_linenumber, l_partkey, 'R1' AS replicate_id, l_quantity AS cycle_life FROM lineitem UNION ALL
    SELECT l_orderkey, l_linenumber, l_partkey, 'R2', l_extendedprice FROM lineitem UNION ALL
    SELECT l_orderkey, l_linenumber, l_partkey, 'R3', l_tax FROM lineitem""")
def a7_unpivot_replicates(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("R1"), F.col("l_extendedprice").alias("R2"), F.col("l_tax").alias("R3"))
    return T.unpivot_replicates(wide, ["l_orderkey", "l_linenumber", "l_partkey"], ["R1", "R2", "R3"])


@register("a8_normalise_calendar", "cell:i day:i checkup_index:i elapsed_hours:d elapsed_time_s:d capacity_retention_pct:d capacity_loss_pct:d", with_ctes("", """
    SELECT cell, day, ROW_NUMBER() OVER w - 1 AS checkup_index, day * 24 AS elapsed_hours, day * 86400 AS elapsed_time_s,
      1e2 * cap / FIRST_VALUE(cap) OVER w AS capacity_retention_pct, 1e2 - 1e2 * cap / FIRST_VALUE(cap) OVER w AS capacity_loss_pct
    FROM raw WINDOW w AS (PARTITION BY cell ORDER BY day)""",
    "raw AS (SELECT l_suppkey AS cell, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS day, SUM(l_quantity) AS cap FROM lineitem GROUP BY 1, 2)"))
def a8_normalise_calendar(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("cell"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("day")
    ).agg(F.sum("l_quantity").alias("cap"))
    return T.normalise_calendar(raw, entity="cell", day="day", capacity="cap", bucket=F.floor(F.col("day") / 64))


def _calendar_inputs(spark, sf_dir):
    summary = A.calendar_obs(spark, sf_dir).select(
        F.concat(F.lit("T"), F.col("condition_id").cast("string")).alias("test_id"), (F.col("elapsed_days") * 864e2).alias("elapsed_time_s"),
        "capacity_retention_pct", F.expr("2e-2 + 1e-3 * checkup_index").alias("resistance_dc_ohm"))
    tests = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("test_id"), F.col("c_custkey").alias("condition_id"),
        F.expr("1e1 * (c_custkey % 6)").alias("temperature_c"), F.expr("(c_custkey % 9) / 8e0").alias("storage_soc_fraction"),
        (F.col("c_nationkey") + 55).alias("expected_checkups"))
    return T.calendar_table(summary, tests, bucket=F.floor(F.col("elapsed_time_s") / 864e2))


_CALT = """summary AS (SELECT 'T' || condition_id AS test_id, elapsed_days * 864e2 AS elapsed_time_s, capacity_retention_pct, 2e-2 + 1e-3 * checkup_index AS resistance_dc_ohm FROM calendar_obs),
    tests AS (SELECT 'T' || c_custkey AS test_id, c_custkey AS condition_id, c_nationkey + 55 AS expected_checkups FROM customer WHERE c_mktsegment <> 'BUILDING'),
    cnt AS (SELECT test_id, COUNT(*) AS n FROM summary GROUP BY 1)"""


@register("a9_calendar_table", "condition_id:i checkup_index:i elapsed_hours:d elapsed_days:d capacity_loss_pct:d resistance_growth_pct:d", with_ctes("cal", """
    SELECT condition_id, ROW_NUMBER() OVER w - 1 AS checkup_index, elapsed_time_s / 36e2 AS elapsed_hours, elapsed_time_s / 864e2 AS elapsed_days,
      1e2 - capacity_retention_pct AS capacity_loss_pct, 1e2 * (resistance_dc_ohm / FIRST_VALUE(resistance_dc_ohm) OVER w - 1e0) AS resistance_growth_pct
    FROM summary JOIN tests USING (test_id) WINDOW w AS (PARTITION BY condition_id ORDER BY elapsed_time_s, test_id)""", _CALT))
def a9_calendar_table(spark, sf_dir):
    return _calendar_inputs(spark, sf_dir)[0]


@register("a9_calendar_coverage", "test_id issue", with_ctes("cal", """
    SELECT test_id, CASE WHEN cnt.n IS NULL THEN 'missing_left' WHEN tests.condition_id IS NULL THEN 'missing_right' ELSE 'checkup_count' END AS issue
    FROM cnt FULL JOIN tests USING (test_id) WHERE cnt.n IS NULL OR tests.condition_id IS NULL OR cnt.n <> expected_checkups""", _CALT))
def a9_calendar_coverage(spark, sf_dir):
    return _calendar_inputs(spark, sf_dir)[1]
