"""Table sources and sinks: files, curve subsets, nested payloads, calendar normalisation (A1-A9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlytics.functions.columns import div
from trajlytics.plans.joins import join_report
from trajlytics.plans.scan import running


#: What the CSV parser puts in the place of an empty field; no text of one control character is read as data.
NO_VALUE = "\x01"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV or Parquet by suffix. CSV needs a schema so that no inference pass reads the data; an empty field is null, a quoted
    empty one is an empty text."""
    lowered = path.rstrip("/").lower()
    if lowered.endswith(".parquet"):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(path)
    if lowered.endswith((".csv", ".csv.gz")):
        if schema is None:
            raise ValueError("a CSV table needs an explicit schema")
        return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("nullValue", NO_VALUE).csv(path)
    raise ValueError(f"unsupported table suffix: {path}")


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), overwrite: bool = False) -> None:
    """CSV or Parquet by suffix; an existing target is refused unless ``overwrite`` is set."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    lowered = path.rstrip("/").lower()
    if lowered.endswith(".parquet"):
        writer.option("compression", "zstd").parquet(path)
    elif lowered.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported table suffix: {path}")


CURVE_COLUMNS = (
    "timestamp_s", "current_A", "voltage_V", "test_id", "cycle_number", "temperature_C", "coulomb_count_Ah", "step_type",
)


def curve_subset(curves: DataFrame, tests: DataFrame, cycles: Sequence[int], step_type: str = "discharge") -> DataFrame:
    """Projected, filtered samples of the selected tests; both filters reach the Parquet scan."""
    wanted = sorted({int(c) for c in cycles})
    if not wanted or wanted[0] < 1:
        raise ValueError("at least one positive cycle number is required")
    return (
        curves.filter(F.col("cycle_number").isin(wanted) & (F.col("step_type") == step_type))
        .select(*CURVE_COLUMNS)
        .join(tests.select("test_id").distinct(), "test_id", "left_semi")
    )


def write_curve_subset(subset: DataFrame, path: str) -> None:
    """Zstd Parquet, one folder per cycle number, sorted inside files for row-group pruning."""
    ordered = subset.repartition("cycle_number", "test_id").sortWithinPartitions("test_id", "cycle_number", "timestamp_s")
    write_table(ordered, path, partition_by=["cycle_number"])


def curve_completeness(subset: DataFrame, tests: DataFrame, cycles: Sequence[int]) -> DataFrame:
    """Expected against observed (test, cycle) pairs with sample counts.

    The expected side multiplies the test list by the short literal list of cycles only.
    """
    wanted = F.array(*[F.lit(int(c)) for c in sorted(set(cycles))])
    expected = tests.select("test_id").distinct().select("test_id", F.explode(wanted).alias("cycle_number"))
    observed = subset.groupBy("test_id", "cycle_number").agg(F.count(F.lit(1)).alias("sample_count"))
    both = expected.withColumn("_e", F.lit(1)).join(observed, ["test_id", "cycle_number"], "full_outer")
    status = F.when(F.col("sample_count").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("observed")
    return both.select("test_id", "cycle_number", F.coalesce("sample_count", F.lit(0)).alias("sample_count"), status.alias("status"))


def order_segments(segments: DataFrame, bucket: str | Column) -> DataFrame:
    """Segments of a cell in time order: ``segment_index`` and the cycles of all earlier segments.

    Input: barcode, source_file, first_time and the array ``raw_cycle_index``.
    """
    sized = segments.withColumn("summary_rows", F.size("raw_cycle_index"))
    return running(
        sized, ["barcode"], bucket, ["first_time", "source_file"],
        {"segment_index": ("count", F.lit(1)), "_through": ("sum", F.col("summary_rows").cast("double"))},
    ).withColumn("cycle_offset", (F.col("_through") - F.col("summary_rows")).cast("bigint")).drop("_through")


def merge_segments(segments: DataFrame, arrays: Sequence[str], bucket: str | Column) -> DataFrame:
    """One row per cycle across all segments of a cell, restarting indices offset.

    ``valid_index`` is false on every row of a segment whose raw index is not 0..n-1.
    """
    ordered = order_segments(segments, bucket)
    valid = F.col("raw_cycle_index") == F.sequence(F.lit(0), F.greatest(F.size("raw_cycle_index") - 1, F.lit(0))).cast("array<bigint>")
    zipped = F.arrays_zip("raw_cycle_index", *arrays)
    exploded = ordered.withColumn("valid_index", valid).select(
        "barcode", "source_file", "segment_index", "cycle_offset", "valid_index", F.posexplode(zipped).alias("_pos", "_z"))
    return exploded.select(
        "barcode", "source_file", "segment_index", F.col("_z.raw_cycle_index").alias("raw_cycle_index"),
        (F.col("_z.raw_cycle_index") + F.col("cycle_offset") + 1).alias("cycle_index"), "valid_index",
        *[F.col(f"_z.{a}").alias(a) for a in arrays])


def segment_inventory(segments: DataFrame, bucket: str | Column, observation_cycle: int) -> DataFrame:
    ordered = order_segments(segments, bucket)
    cell = ordered.groupBy("barcode").agg(
        F.count(F.lit(1)).alias("segment_count"), F.sum("summary_rows").alias("cell_summary_rows"))
    return ordered.join(cell, "barcode").select(
        "barcode", "source_file", "summary_rows",
        F.element_at("raw_cycle_index", 1).alias("first_raw_cycle_index"),
        F.element_at("raw_cycle_index", -1).alias("last_raw_cycle_index"),
        "segment_index", "segment_count", "cell_summary_rows",
        (F.col("cell_summary_rows") >= observation_cycle).alias("usable_at_observation_cycle"))


def unpivot_replicates(wide: DataFrame, ids: Sequence[str], replicates: Sequence[str], value: str = "cycle_life") -> DataFrame:
    return wide.unpivot([F.col(i) for i in ids], [F.col(r) for r in replicates], "replicate_id", value)


def normalise_calendar(raw: DataFrame, *, entity: str, day: str, capacity: str, bucket: str | Column) -> DataFrame:
    """Check-up index by day, retention against the first capacity, loss and unit conversions."""
    ranked = running(raw, [entity], bucket, [day], {"_r": ("count", F.lit(1)), "_c0": ("total_first", capacity)})
    retention = 100.0 * div(capacity, "_c0")
    return ranked.select(
        *raw.columns, (F.col("_r") - 1).alias("checkup_index"),
        (F.col(day) * 86400.0).alias("elapsed_time_s"), (F.col(day) * 24.0).alias("elapsed_hours"),
        F.col(day).cast("double").alias("elapsed_days"),
        retention.alias("capacity_retention_pct"), (100.0 - retention).alias("capacity_loss_pct"))


def calendar_table(
    summary: DataFrame, tests: DataFrame, *, bucket: str | Column
) -> tuple[DataFrame, DataFrame]:
    """Calendar observations from a cycle summary and test metadata, with the coverage report.

    summary: test_id, elapsed_time_s, capacity_retention_pct, resistance_dc_ohm;
    tests: test_id (unique), condition_id, temperature_c, storage_soc_fraction, expected_checkups.
    """
    counts = summary.groupBy("test_id").agg(F.count(F.lit(1)).alias("n_checkups"))
    declared = tests.select("test_id", "expected_checkups")
    coverage = join_report(summary.select("test_id"), tests.select("test_id"), ["test_id"]).filter(
        F.col("issue").isin("missing_left", "missing_right", "duplicate_right", "duplicate_both")
    ).select("test_id", "issue").unionByName(
        counts.join(declared, "test_id").filter(F.col("n_checkups") != F.col("expected_checkups"))
        .select("test_id", F.lit("checkup_count").alias("issue")))
    known = summary.join(tests, "test_id")
    ranked = running(
        known, ["condition_id"], bucket, ["elapsed_time_s", "test_id"],
        {"_r": ("count", F.lit(1)), "_r0": ("total_first", "resistance_dc_ohm")},
    )
    table = ranked.select(
        "condition_id", "test_id", "temperature_c", "storage_soc_fraction",
        (F.col("_r") - 1).alias("checkup_index"), "elapsed_time_s",
        (F.col("elapsed_time_s") / 3600.0).alias("elapsed_hours"), (F.col("elapsed_time_s") / 86400.0).alias("elapsed_days"),
        "capacity_retention_pct", (100.0 - F.col("capacity_retention_pct")).alias("capacity_loss_pct"),
        "resistance_dc_ohm", (100.0 * (div("resistance_dc_ohm", "_r0") - 1.0)).alias("resistance_growth_pct"))
    return table, coverage
