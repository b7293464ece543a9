"""Neighbour join: exact against all pairs, in rounds over leaves, with rows that do not grow with the square of the input."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlytics.operators.neighbors import jackknife_neighbours
from trajlytics.plans import knn
from test_resampling import shuffled_rows


def frame(spark, n, seed=1, dims=3, ties=True):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 1) if k % 4 or not ties else round(rng.gauss(3, 0.2), 1) for _ in range(dims)], [rng.uniform(0, 2) for _ in range(dims)]) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, vec array<double>, w array<double>").repartition(3)


def plain(rows, k):
    x, w = (np.array([r[i] for r in rows]) for i in (1, 2))
    out = {}
    for at, (q, *_) in enumerate(rows):
        d = np.sqrt(np.mean((w[at] * (x - x[at])) ** 2, axis=1))
        d[at] = np.inf
        out[q] = np.argsort(d, kind="stable")[:k].tolist()
    return out


@pytest.mark.parametrize("block,visits", [(512, (1, 4)), (32, (1, 4)), (16, (1,)), (8, (2, 3, 5))])
def test_exact_under_weights_ties_and_any_visits(spark, block, visits):
    rows, df = frame(spark, 400)
    got = knn.knn_join(df.selectExpr("id AS query_id", "vec", "w"), df.selectExpr("id AS ref_id", "vec"), 5, block=block, visits=visits).collect()
    best = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        best.setdefault(r["query_id"], []).append(r["ref_id"])
    assert best == plain(rows, 5)


def test_variants_ride_in_one_join(spark):
    rows, df = frame(spark, 200, ties=False)
    df = df.select("id", *[F.get("vec", F.lit(i)).alias(f"f{i}") for i in range(3)])
    got = jackknife_neighbours(df, df, "id", ["f0", "f1", "f2"], [0.1] * 3, 4, [1.0, 2.0, 0.5])
    scaled = [(i, [x / s for x, s in zip(v, (1.0, 2.0, 0.5), strict=True)]) for i, v, _ in rows]
    for variant in range(4):
        keep = [i for i in range(3) if i != variant - 1]
        want = plain([(i, [v[j] for j in keep], [1.0] * len(keep)) for i, v in scaled], 4)
        have = {}
        for r in got.where(F.col("variant") == variant).orderBy("rank").collect():
            have.setdefault(r["query_id"], []).append(r["ref_id"])
        assert have == want


def test_more_neighbours_than_a_leaf_holds_and_few_references(spark):
    rows, df = frame(spark, 60)
    q, r = df.selectExpr("id AS query_id", "vec"), df.selectExpr("id AS ref_id", "vec")
    assert knn.knn_join(q, r, 20, block=4).count() == 60 * 20
    assert knn.knn_join(q, r.limit(3), 20, block=1).groupBy("query_id").count().agg(F.max("count")).first()[0] == 3


def test_box_distance_is_a_bound_under_weights():
    rng = np.random.default_rng(4)
    x, w, refs = rng.normal(size=(50, 3)), rng.uniform(0, 2, (50, 3)), rng.normal(size=(300, 3))
    leaf = knn.MedianTree(refs, 16).leaf(refs)
    low = np.stack([refs[leaf == k].min(0) if (leaf == k).any() else np.full(3, np.inf) for k in range(16)])
    high = np.stack([refs[leaf == k].max(0) if (leaf == k).any() else np.full(3, -np.inf) for k in range(16)])
    bound = knn.box_distances(x, w, low, high)
    real = np.sqrt((((x[:, None] - refs[None]) * w[:, None]) ** 2).mean(2))
    assert all((real[:, leaf == k].min(1) >= bound[:, k] - 1e-12).all() for k in range(16) if (leaf == k).any())


def test_visited_rows_grow_with_the_rows_not_their_square(spark):
    moved = []
    for n in (1500, 6000):
        _, df = frame(spark, n, dims=2)
        moved.append(shuffled_rows(knn.knn_join(df.selectExpr("id AS query_id", "vec"), df.selectExpr("id AS ref_id", "vec"), 3, block=64)))
    assert moved[1] <= 4 * 1.6 * moved[0]


def test_asked_rows_get_the_neighbours_of_the_whole_run(spark):
    """Restricting the queries changes neither the scales nor the references."""
    from trajlytics.operators.neighbors import nearest_std_loo

    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "entity_id bigint, features array<double>")
    whole = nearest_std_loo(df, "entity_id", "features", 4, 3)
    asked = nearest_std_loo(df, "entity_id", "features", 4, 3, asked=F.col("entity_id") % 20 == 0)
    want = sorted(tuple(r) for r in whole.filter("query_id % 20 = 0").select("query_id", "rank", "ref_id", "distance").collect())
    assert len(want) == 18
    assert sorted(tuple(r) for r in asked.select("query_id", "rank", "ref_id", "distance").collect()) == want


def test_every_signature_asks(spark, sf_dir):
    """The registered query and its check leave no signature out."""
    from oracle import connect
    from trajlytics.queries import catalog

    con = connect(sf_dir)
    n = con.execute("SELECT COUNT(*) FROM embeddings").fetchone()[0]
    got = catalog.callables()["e22_nearest_std_loo"](spark, sf_dir).agg(F.count(F.lit(1)), F.countDistinct("query_id")).first()
    assert tuple(got) == (5 * n, n)
    assert con.execute(f"SELECT COUNT(*), COUNT(DISTINCT query_id) FROM ({catalog.checks()['e22_nearest_std_loo']})").fetchone() == (5 * n, n)


@pytest.mark.parametrize("shift,digits,copies", [(0.0, 9, 1), (0.0, 1, 1), (1e6, 9, 1), (0.0, 9, 40)])
def test_closest_is_the_plain_search(monkeypatch, shift, digits, copies):
    """Far from zero, with equal distances, among copies, and with values that are too large or no numbers."""
    monkeypatch.setattr(knn, "SLICE", 5000)
    rng = np.random.default_rng(6)
    x = np.repeat(np.round(rng.normal(size=(600 // copies, 3)), digits), copies, axis=0) + shift
    x[5, 2], x[7, 1], x[9, 0] = np.nan, np.inf, 1e200
    w, ids = np.where(rng.random(x.shape) < 0.1, 0.0, rng.uniform(0.5, 2, x.shape)), np.arange(len(x))
    with np.errstate(all="ignore"):
        at, near, dist = knn.closest(x[:200], w[:200], ids[:200], x, ids, 4)
        for q in range(200):
            d = np.sqrt(np.mean((w[q] * (x - x[q])) ** 2, axis=1))
            d[q] = np.inf
            want = [i for i in np.argsort(d, kind="stable")[:4] if np.isfinite(d[i])]
            assert near[at == q].tolist() == want
            assert dist[at == q].tolist() == d[want].tolist()
