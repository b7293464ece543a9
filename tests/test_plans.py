"""Plan shape: native plans, pushed filters, no cross products, nothing large in one partition."""

import pytest
from pyspark.sql import functions as F

from trajlytics.queries import catalog
from trajlytics.session import cut_lineage
from trajlytics.sources import tables as T


def plan(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


NATIVE = ["a3_curve_subset", "b5_cycle_feature_contract", "c1_stable_group_split", "d3_resample_curves", "d11_capacity_signature", "e10_activation_power_law", "g1_trajectory_scores", "h14_issuance_decisions", "k1_censoring_curve", "q2_rank_for_issuance"]


@pytest.mark.parametrize("name", NATIVE)
def test_native_and_without_cross_products(spark, sf_dir, name):
    text = plan(catalog.callables()[name](spark, sf_dir))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, f"{bad} in {name}"


def test_curve_subset_pushes_filters_and_prunes(spark, tmp_path):
    path = str(tmp_path / "curves.parquet")
    curves = spark.range(100).selectExpr("CAST(id AS DOUBLE) AS timestamp_s", "1e0 AS current_A", "3e0 AS voltage_V", "CAST(id % 5 AS STRING) AS test_id", "CAST(id % 3 AS INT) * 45 + 10 AS cycle_number",
                                         "25e0 AS temperature_C", "1e0 AS coulomb_count_Ah", "'discharge' AS step_type", "repeat('x', 100) AS unused")
    curves.write.parquet(path)
    tests = spark.createDataFrame([("1",), ("2",)], "test_id string")
    subset = T.curve_subset(T.read_table(spark, path), tests, [10, 100])
    text = plan(subset)
    assert "PushedFilters: [In(cycle_number, [10,100])" in text.replace("IsNotNull(step_type), ", "") or "In(cycle_number" in text
    assert "unused" not in text.split("ReadSchema")[1].split("\n")[0]
    out = str(tmp_path / "subset.parquet")
    T.write_curve_subset(subset, out)
    assert T.read_table(spark, out).count() == subset.count() > 0
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        T.write_curve_subset(subset, out)


def test_csv_round_trip_needs_a_schema(spark, tmp_path):
    df = spark.range(5).select("id", (F.col("id") / 2).alias("v"))
    path = str(tmp_path / "t.csv")
    T.write_table(df, path)
    with pytest.raises(ValueError):
        T.read_table(spark, path)
    assert T.read_table(spark, path, df.schema).agg(F.sum("v")).first()[0] == 5.0


def test_lineage_cut_uses_the_reliable_checkpoint(spark):
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert "Scan ExistingRDD" in plan(df, "simple") and spark.sparkContext.getCheckpointDir()
