"""What one task holds and what is shuffled must not depend on how many keys happen to fit one partition."""

import pytest
from pyspark.sql import functions as F

from trajlytics.operators import grid as Y


def test_structure_fits_are_dealt_by_the_number_of_trajectories(spark):
    n = 3 * Y.LIBRARY_KEYS
    points = spark.range(n).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("d")).select(
        "k", F.col("d").cast("double").alias("elapsed_days"), F.sqrt("d").alias("capacity_loss_pct"))
    fits = Y.structure_library(points, ["k"], [10.0])
    held = fits.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("k").alias("n"))
    assert held.agg(F.max("n")).first()[0] < 1.5 * Y.LIBRARY_KEYS
    assert fits.select("k").distinct().count() == n


def test_neighbour_queries_read_the_cycles_once(spark, sf_dir):
    from trajlytics.queries import catalog
    plan = catalog.callables()["e29_evidence_bands"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "lineitem" not in plan and "l_suppkey" not in plan


def test_quota_is_cut_by_bucket_counts(spark):
    from trajlytics.operators.resampling import within_quota
    rows = [(run, i // 5, float(1 + i % 3), None if i == 7 else float(i % 2), i, 13.0 + 20 * run) for run in (0, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "run int, b int, _t double, _c double, i int, _k double").withColumn("_at", F.struct("b"))
    got = {r["run"]: (r["n"], r["c"], r["v"]) for r in within_quota(df, "run", ["i"]).collect()}
    for run in (0, 1):
        left, n, c, v = 13.0 + 20 * run, 0.0, 0.0, 0.0
        for _, _, t, outcome, _, _ in (r for r in rows if r[0] == run):
            take = min(t, left)
            left, n, c, v = left - take, n + take, c + take * (outcome or 0.0), v + (take if outcome is not None else 0.0)
        assert got[run] == (n, c, v)


def _plan(spark, sf_dir, name):
    from trajlytics.queries import catalog
    return catalog.callables()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_joint_assignments_join_no_support(spark, sf_dir):
    plan = _plan(spark, sf_dir, "t10_joint_assignments")
    assert plan.count("Join ") == 1 and "Join LeftSemi" in plan


def test_permutations_are_not_ranked_as_rows(spark, sf_dir):
    assert "o_orderkey" not in _plan(spark, sf_dir, "t11_permutation_control")


def test_fairness_audit_deals_rows_by_their_number(spark, sf_dir):
    assert "RepartitionByExpression [condition_id" in _plan(spark, sf_dir, "u4_fairness_audit")


def test_failure_summary_deals_rows_by_their_number(spark, sf_dir):
    assert "RepartitionByExpression [cluster_id" in _plan(spark, sf_dir, "g20_failure_summary")


@pytest.mark.parametrize("name", ["u1_leaky_control", "u1_future_label_firewall"])
def test_firewall_keeps_both_runs_in_one_row(spark, sf_dir, name):
    plan = _plan(spark, sf_dir, name)
    assert "user_id" not in plan and "Generate" not in plan and "FullOuter" not in plan


def test_error_columns_are_scored_like_single_errors(spark):
    from trajlytics.operators import scoring as G
    rows = [(k, float(t), (t * 7 + k) % 5 - 2.0, None if t == 3 else t * 0.5) for k in (1, 2) for t in range(1, 3 + 4 * k)] + [(3, 1.0, -4.0, 0.25)]
    df = spark.createDataFrame(rows, "k int, t double, a double, b double")
    wide = {r["k"]: r for r in G.score_error_columns(df, ["k"], "t", ["a", "b"], "FLOOR(t / 2)").collect()}
    for k in (1, 2, 3):
        pts = sorted((t, a) for i, t, a, _ in rows if i == k)
        area = sum(0.5 * (abs(e0) + abs(e1)) * (t1 - t0) for (t0, e0), (t1, e1) in zip(pts, pts[1:]))
        want = area / (pts[-1][0] - pts[0][0]) if len(pts) > 1 else abs(pts[0][1])
        assert abs(wide[k]["a"]["iae"] - want) < 1e-12 and wide[k]["n_points"] == len(pts)
    for name in ("a", "b"):
        for r in G.score_errors(df, ["k"], "t", name, "FLOOR(t / 2)").collect():
            assert r.asDict() == {"k": r["k"], "n_points": wide[r["k"]]["n_points"], **wide[r["k"]][name].asDict()}


def test_backtest_deals_points_by_their_number(spark, sf_dir):
    plan = _plan(spark, sf_dir, "backtest_minimum_slice")
    assert "RepartitionByExpression [_at" in plan and plan.count("Relation [l_") <= 8


def test_dealt_points_keep_their_previous_row(spark, monkeypatch):
    from trajlytics.plans import scan
    monkeypatch.setattr(scan, "DEALT_ROWS", 100)
    df = spark.range(2000).selectExpr("id % 7 AS k", "id AS t")
    found = scan.previous(df, ["k"], "FLOOR(t / 50)", ["t"], {"p": "t"}, rows=2000)
    assert found.filter("t >= 7").count() == found.filter("p = t - 7").count() == 1993 and found.filter("p IS NULL").count() == 7
    assert scan.dealt_by(df, ["k", "t"], 2000).rdd.getNumPartitions() == 21


def test_fits_of_the_capacity_are_fits_of_the_retention(spark):
    from trajlytics.operators import features as X
    df = spark.createDataFrame([(c, i, 1.1 - 0.002 * i * (c + 1) + 0.01 * (i * 7 % 3)) for c in range(3) for i in range(1 + (c == 2), 30)], "cell_id int, cycle_index int, discharge_capacity_ah double")
    want = {r["cell_id"]: r for r in X.with_retention(df).groupBy("cell_id").agg(
        F.max_by("retention", "cycle_index").alias("l"), F.regr_slope("retention", "cycle_index").alias("b"), F.regr_intercept("retention", "cycle_index").alias("a")).collect()}
    got = {r["cell_id"]: r for r in X.normalised_fits(df).collect()}
    assert set(got) == set(want) == {0, 1}
    for c in want:
        assert max(abs(got[c][n] - want[c][m]) for n, m in (("last_value", "l"), ("slope", "b"), ("intercept", "a"))) < 1e-9


def test_voltage_at_charge_scans_once_with_few_buckets(spark, sf_dir):
    plan = _plan(spark, sf_dir, "d8_voltage_at_charge")
    assert "lag(" in plan and "_pq" not in plan and "1000.0" not in plan


def test_voltage_at_charge_finds_the_sample_before(spark):
    from trajlytics.operators import features as X
    rows = [("a", 1.0, 4.0, 0.0, 0.0), ("a", 2.0, 3.8, 2.0, 2.0), ("a", 3.0, 9.9, 2.0, 0.0), ("a", 4.0, 3.4, 4.0, 2.0), ("b", 1.0, 4.1, 0.0, 0.0), ("b", 2.0, 4.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, timestamp_s double, voltage_V double, cumulative_ah double, interval_ah double")
    got = {r["k"]: r for r in X.voltage_at_charge(df, ["k"], [0.0, 1.0, 3.0, 3.5]).collect()}
    assert [round(got["a"][f"voltage_at_{i}"], 9) for i in range(4)] == [4.0, 3.9, 3.6, 3.5]
    assert [got["b"][f"voltage_at_{i}"] and round(got["b"][f"voltage_at_{i}"], 9) for i in range(4)] == [4.1, 4.066666667, 4.0, None]
