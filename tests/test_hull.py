"""Hull membership against the half-plane test of every edge, degenerate hulls, and the plan."""

import random

import numpy as np

from trajlytics.operators.splits import _hull, hull_vertices, in_convex_hull


def test_membership_matches_all_edges(spark):
    rng = random.Random(5)
    pts = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(500)] + [(3.0, float(k)) for k in range(-2, 3)] + [(float("nan"), 0.0)]
    asked = [(k, rng.uniform(-4, 4), rng.uniform(-4, 4)) for k in range(400)] + [(900 + k, *pts[k]) for k in range(500)] + [(2000, None, 1.0), (2001, 3.0, 0.5), (2002, 3.0, 2.0001)]
    ring = _hull(np.array(pts[:-1]))
    edges = list(zip(ring, np.roll(ring, -1, axis=0), strict=True))
    want = {i: x is not None and all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-10 for a, b in edges) for i, x, y in asked}
    points = spark.createDataFrame(pts, "x double, y double").repartition(13)
    got = {r["id"]: r["in_hull"] for r in in_convex_hull(spark.createDataFrame(asked, "id int, x double, y double"), points, "x", "y").collect()}
    assert got == want
    assert {(r["x"], r["y"]) for r in hull_vertices(points, "x", "y").collect()} == {tuple(v) for v in ring}


def test_degenerate_hulls(spark):
    asked = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 3.0, 3.0), (4, 1.0, 2.0)], "id int, x double, y double")
    for pts, inside in ([(1.0, 1.0), (2.0, 2.0)], {1, 2}), ([(1.0, 1.0)], {1}), ([(1.0, 1.0), (1.0, 2.0)], {1, 4}), ([(None, 1.0)], set()):
        points = spark.createDataFrame(pts, "x double, y double")
        assert {r["id"] for r in in_convex_hull(asked, points, "x", "y").collect() if r["in_hull"]} == inside


def test_hull_has_no_single_partition_exchange(spark):
    points = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    plan = hull_vertices(points, "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "RoundRobinPartitioning(1)" not in plan
