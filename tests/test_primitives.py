"""Scans, ranks, order statistics, joins and neighbours against brute force, with a hot key."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajlytics.functions.columns import erfc, hash_draw, is_finite, normal_log_sf
from trajlytics.operators.contracts import calendar_contract, fingerprint, row_text
from trajlytics.operators.intervals import beta_cdf, clopper_pearson, conformal_radius
from trajlytics.operators.resampling import assignment_support, exact_sign_flip, excluded_protocols
from trajlytics.operators.scoring import validate_predictions
from trajlytics.operators.splits import in_convex_hull, nested_reference_partition
from trajlytics.plans.joins import asof_join, checked_join, join_report
from trajlytics.plans.scan import cut_bucket, cut_points, grouped_rank, hash_bucket, index_bucket, integrated, order_statistics, previous, running


@pytest.fixture(scope="module")
def hot():
    rng = random.Random(3)
    rows = [("hot", i, rng.gauss(0, 10), None if i % 7 == 0 else float(i % 11)) for i in range(900)]
    for k in range(40):
        rows += [(f"k{k}", i * 3, rng.gauss(0, 10), None if i % 3 == 0 else float(i)) for i in range(rng.randint(1, 30))]
    rng.shuffle(rows)
    return pd.DataFrame(rows, columns=["k", "i", "v", "w"])


def test_running_matches_pandas(spark, hot):
    df = spark.createDataFrame(hot).withColumn("w", F.when(~F.isnan("w"), F.col("w")))
    got = running(df, ["k"], index_bucket("i", 64), ["i"], {
        "s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "m": ("max", F.col("v")), "f": ("last", F.col("w"))}).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
    want = hot.sort_values(["k", "i"]).reset_index(drop=True)
    g = want.groupby("k")
    np.testing.assert_allclose(got.s, g.v.cumsum(), atol=1e-9)
    assert (got.n == g.cumcount() + 1).all()
    np.testing.assert_allclose(got.m, g.v.cummax())
    np.testing.assert_allclose(got.f.astype(float), g.w.ffill(), equal_nan=True)


def test_previous_crosses_buckets_and_keeps_nulls(spark, hot):
    df = spark.createDataFrame(hot)
    got = previous(df, ["k"], index_bucket("i", 16), ["i"], {"pv": "v", "pw": "w"}).toPandas().sort_values(["k", "i"]).reset_index(drop=True)
    want = hot.sort_values(["k", "i"]).reset_index(drop=True).groupby("k")
    np.testing.assert_allclose(got.pv, want.v.shift(), equal_nan=True)
    np.testing.assert_allclose(got.pw.astype(float), want.w.shift(), equal_nan=True)


@pytest.mark.parametrize("values", [[1.0] * 500 + [2.0] * 5, list(range(505)), [float(i % 3) for i in range(505)]])
def test_rank_with_heavy_ties(spark, values):
    pdf = pd.DataFrame({"k": ["a"] * 400 + ["b"] * 105, "v": [float(v) for v in values]})
    pdf["h"] = [f"{(i * 2654435761) % 2**32:08x}" for i in range(len(pdf))]
    df = spark.createDataFrame(pdf)
    got = grouped_rank(df, ["k"], cut_bucket("v", cut_points(df, "v", 8), "h"), ["v", "h"], "r").toPandas()
    want = pdf.sort_values(["v", "h"]).groupby("k").cumcount() + 1
    merged = got.merge(pdf.assign(want=want), on=["k", "v", "h"])
    assert (merged.r == merged.want).all()


def test_rank_by_hash_bucket(spark):
    df = spark.range(3000).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    got = grouped_rank(df, [], hash_bucket("h"), ["h"], "r").toPandas().sort_values("h")
    assert list(got.r) == list(range(1, 3001))


def test_order_statistics(spark, hot):
    df = spark.createDataFrame(hot.assign(v=hot.v.round(1)))
    got = order_statistics(df, ["k"], "v", {"med": ("linear", 0.5), "p9": ("linear", 0.9), "hi": ("higher", 0.8), "rk": ("rank", 0.9)}).toPandas().set_index("k")
    for k, g in hot.assign(v=hot.v.round(1)).groupby("k"):
        v = np.sort(g.v.to_numpy())
        assert got.loc[k, "med"] == pytest.approx(np.quantile(v, 0.5))
        assert got.loc[k, "p9"] == pytest.approx(np.quantile(v, 0.9))
        assert got.loc[k, "hi"] == pytest.approx(np.quantile(v, 0.8, method="higher"))
        rank = math.ceil((len(v) + 1) * 0.9)
        if rank > len(v):
            assert np.isnan(got.loc[k, "rk"])
        else:
            assert got.loc[k, "rk"] == pytest.approx(v[rank - 1])


@pytest.mark.parametrize("strict", [True, False])
def test_asof_join(spark, strict):
    left = pd.DataFrame({"k": ["a"] * 5 + ["b"] * 2, "t": [0.0, 1.0, 2.5, 3.0, 9.0, 1.0, 4.0]})
    right = pd.DataFrame({"k": ["a", "a", "a", "b"], "u": [1.0, 3.0, 3.5, 2.0], "x": [10.0, 30.0, 35.0, 20.0]})
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), keys=["k"], left_on="t", right_on="u", values=["x"], bucket="FLOOR(_t / 2)", strict=strict).toPandas()
    for r in got.itertuples():
        ok = right[(right.k == r.k) & ((right.u < r.t) if strict else (right.u <= r.t))]
        want = ok.sort_values("u").x.iloc[-1] if len(ok) else float("nan")
        assert (np.isnan(r.x) and np.isnan(want)) or r.x == want


def test_checked_join_rejects_repeated_and_missing_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, l string")
    right = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, r double")
    assert checked_join(left, right, ["k"]).count() == 3
    with pytest.raises(Exception, match="repeats a key"):
        checked_join(left, right.union(right), ["k"]).collect()
    with pytest.raises(Exception, match="requires a match"):
        checked_join(left, right.filter("k = 1"), ["k"], require_match=True).collect()
    assert {r["issue"] for r in join_report(left, right.filter("k = 1"), ["k"]).collect()} == {"duplicate_left", "missing_right"}


def test_hull_membership(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (2.0, 2.0), (2.0, 0.0)], "x double, y double")
    q = spark.createDataFrame([(1, 2.0, 0.0), (2, 4.0, 4.0), (3, 4.1, 1.0), (4, -0.1, 0.0), (5, 1.0, 3.0)], "id int, x double, y double")
    got = {r["id"]: r["in_hull"] for r in in_convex_hull(q, pts, "x", "y").collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True}


def test_error_function_and_tails(spark):
    xs = [-6.0, -2.0, -0.3, 0.0, 0.2, 0.46875, 1.0, 3.9, 4.1, 10.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("e"), normal_log_sf(F.col("x") * 4).alias("l")).collect()
    for r in got:
        assert r["e"] == pytest.approx(math.erfc(r["x"]), rel=1e-13, abs=1e-300)
        if r["x"] * 4 < 30:
            assert r["l"] == pytest.approx(math.log(0.5 * math.erfc(r["x"] * 4 / math.sqrt(2))), rel=1e-10, abs=1e-14)


def test_exact_binomial_bounds():
    lo, hi = clopper_pearson(7, 20, 0.95, two_sided=True)
    assert (lo, hi) == (pytest.approx(0.15390, abs=1e-4), pytest.approx(0.59219, abs=1e-4))
    assert clopper_pearson(0, 9, 0.95)[0] == 0.0 and clopper_pearson(9, 9, 0.95)[1] == 1.0
    assert beta_cdf(6.0, 5.0, 0.5) == pytest.approx(sum(math.comb(10, i) for i in range(5)) / 1024, rel=1e-12)


def test_fingerprint_ignores_order_and_sees_multiplicity(spark):
    df = spark.range(200).selectExpr("id % 13 AS a", "CAST(id AS STRING) AS b")
    one = fingerprint(df, row_text(["a", "b"])).collect()
    assert one == fingerprint(df.repartition(7).orderBy(F.rand(1)), row_text(["a", "b"])).collect()
    assert one != fingerprint(df.union(df.limit(1)), row_text(["a", "b"])).collect()


def test_finite_and_draws(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (float("-inf"),)], "v double")
    assert [r[0] for r in df.select(is_finite("v")).collect()] == [True, False, False, False, False]
    d = [r[0] for r in spark.range(2000).select(hash_draw(F.lit(7), "s", F.col("id").cast("string"))).collect()]
    assert set(d) == set(range(7)) and max(d.count(i) for i in range(7)) < 380


NAN, INF = float("nan"), float("inf")
DIRTY = [("a", 1, 1.0), ("a", None, 2.0), (None, 1, 3.0), (None, 2, NAN), (None, None, 4.0), ("a", 9, None), ("a", 40, INF)]


def test_scans_keep_null_keys_and_buckets(spark):
    df = spark.createDataFrame(DIRTY, "k string, i long, v double")
    ranked = grouped_rank(df, ["k"], index_bucket("i", 8), ["i"], "r").collect()
    assert sorted((str(r["k"]), r["r"]) for r in ranked) == [("None", 1), ("None", 2), ("None", 3), ("a", 1), ("a", 2), ("a", 3), ("a", 4)]
    before = {(r["k"], r["i"]): r["p"] for r in previous(df, ["k"], index_bucket("i", 8), ["i"], {"p": "i"}).collect()}
    assert before == {("a", None): None, ("a", 1): None, ("a", 9): 1, ("a", 40): 9, (None, None): None, (None, 1): None, (None, 2): 1}
    totals = running(df, ["k"], index_bucket("i", 8), ["i"], {"n": ("total_sum", F.lit(1)), "top": ("total_max", "i")}).collect()
    assert {(r["k"], r["n"], r["top"]) for r in totals} == {("a", 4, 40), (None, 3, 2)}


def test_order_statistics_leave_out_what_is_not_finite(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", NAN), ("b", INF), (None, 5.0), ("a", None)], "k string, v double")
    got = {r["k"]: r for r in order_statistics(df, ["k"], "v", {"m": ("linear", 0.5)}, count_not_finite=True).collect()}
    assert (got["a"]["m"], got["a"]["n"], got["a"]["n_not_finite"]) == (2.0, 3, 1)
    assert (got["b"]["m"], got["b"]["n"], got["b"]["n_not_finite"]) == (None, 0, 1) and got[None]["m"] == 5.0
    assert {r["k"] for r in order_statistics(df, ["k"], "v", {"m": ("linear", 0.5)}).collect()} == {"a", None}


def test_a_radius_needs_finite_scores(spark):
    scores = spark.createDataFrame([("a", float(i)) for i in range(9)] + [("b", float(i)) for i in range(9)] + [("b", NAN)] * 3, "k string, score double")
    got = {r["k"]: r for r in conformal_radius(scores, ["k"], 0.8).collect()}
    assert (got["a"]["radius"], got["a"]["status"], got["a"]["n_calibration"]) == (7.0, "finite_order_statistic", 9)
    assert (got["b"]["radius"], got["b"]["status"], got["b"]["n_not_finite"]) == (None, "invalid_scores", 3)


def test_contract_counts_rows_with_nulls(spark):
    names = ["temperature_c", "storage_soc_fraction", "elapsed_time_s", "elapsed_hours", "elapsed_days", "checkup_index", "capacity_ah",
             "capacity_retention_pct", "capacity_loss_pct", "resistance_dc_ohm", "resistance_growth_pct", "nominal_capacity_ah"]
    rows = [("c", 25.0, 0.5, 0.0, 0.0, 0.0, 0, 3.0, 100.0, 0.0, 0.01, 0.0, 3.0), ("c", 25.0, 0.5, 86400.0, 24.0, None, 1, 3.0, 100.0, 0.0, 0.01, 0.0, 3.0),
            (None, 30.0, 0.5, 0.0, 0.0, 0.0, 0, 3.0, 100.0, 0.0, 0.01, 0.0, 3.0)]
    df = spark.createDataFrame(rows, "condition_id string, " + ", ".join(f"{n} {'long' if n == 'checkup_index' else 'double'}" for n in names))
    report = {r["rule"]: r["violations"] for r in calendar_contract(df).collect()}
    assert report["not_finite"] == 1 and report["days_inconsistent"] == 1 and report["retention_inconsistent"] == 0


def test_nothing_is_left_out_silently(spark):
    cells = spark.createDataFrame([("p", i, 1.0, 2.0, 3.0) for i in range(5)] + [("q", i, 1.0, 2.0, 3.0) for i in range(4)], "protocol string, cell int, y double, z double, p double")
    assert {r["protocol"] for r in assignment_support(cells, "protocol", slots=5, prediction="p", outcome="y", null_prediction="z").collect()} == {"p"}
    assert [tuple(r) for r in excluded_protocols(cells, "protocol", slots=5).collect()] == [("q", 4)]
    roles = nested_reference_partition(cells.selectExpr("protocol AS d", "cell"), domain="d", entity="cell", max_k=4, repeats=1, seed=1)
    assert {(r["d"], r["role"]): r["count"] for r in roles.groupBy("d", "role").count().collect()} == {("p", "reference"): 4, ("p", "query"): 1, ("q", "too_small"): 4}
    deltas = spark.createDataFrame([("g", float(i + 1)) for i in range(17)], "g string, d double")
    flip = exact_sign_flip(deltas, ["g"], "d").first()
    assert (flip["n_patterns"], flip["status"], flip["two_sided_p"]) == (2**17, "exact", 2 / 2**17)


def test_absent_targets_are_reported(spark):
    truth = spark.createDataFrame([(e, i, float(i)) for e in ("a", "b") for i in range(3)], "e string, i int, t double")
    pack = spark.createDataFrame([("a", m, i, float(i), 1.0, i == 2) for m in ("x", "y") for i in range(3)], "e string, m string, i int, t double, v double, is_final boolean")
    report = {r["rule"]: r["violations"] for r in validate_predictions(pack, truth, entity=["e"], method="m", index="i", time="t", predicted="v").collect()}
    assert report["target_missing"] == 2 and report["future_coordinate_missing"] == 6 and report["final_flag_wrong"] == 0


def test_integrated_steps_cross_buckets(spark, hot):
    df = spark.createDataFrame(hot[["k", "i", "v"]])

    def steps(p, r):
        return {"area": 0.5 * (p["v"] + r["v"]) * (r["i"] - p["i"]), "rise": r["v"] - p["v"]}

    got = integrated(df, ["k"], index_bucket("i", 16), ["i"], ["i", "v"], steps, {"total": "area"}).toPandas()
    got = got.sort_values(["k", "i"]).reset_index(drop=True)
    want = hot.sort_values(["k", "i"]).reset_index(drop=True)
    g = want.groupby("k")
    area = (0.5 * (g.v.shift() + want.v) * (want.i - g.i.shift())).fillna(0.0)
    np.testing.assert_allclose(got.area, area, atol=1e-9)
    np.testing.assert_allclose(got.rise, (want.v - g.v.shift()).fillna(0.0), atol=1e-9)
    np.testing.assert_allclose(got.total, area.groupby(want.k).cumsum(), atol=1e-6)
