"""Resampling plans: packed and joined draws agree, subsets are unranked, sign flips meet in the middle."""

import itertools
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajlytics.operators import resampling as R


def test_subsets_are_unranked_in_mask_order(spark):
    for n, k in [(6, 3), (5, 0), (5, 5), (9, 2)]:
        got = [tuple(r[0]) for r in spark.range(math.comb(n, k)).orderBy("id").select(R.unranked(F.col("id"), n, k)).collect()]
        assert got == sorted(itertools.combinations(range(n), k), key=lambda c: sum(1 << p for p in c))


def test_pools_beyond_a_mask_are_refused_by_their_count_only(spark):
    wide = spark.range(70).select("id", F.lit("r").alias("r"), F.rand(1).alias("s"))
    parts = R.partition_sensitivity(wide, unit="id", route="r", score="s", choose=1, coverage=0.5)
    assert parts.count() == 70 and parts.where("mask is not null").count() == 0
    with pytest.raises(ValueError, match="too many partitions"):
        R.partition_sensitivity(wide, unit="id", route="r", score="s", choose=35, coverage=0.5)


def test_sign_flips_meet_in_the_middle():
    rng = random.Random(2)
    cases = [[rng.uniform(-1, 2) for _ in range(n)] for n in (1, 2, 3, 7, 12)] + [[1.0] * 9, [1.0, -1.0, 2.0, -2.0]]
    want = [sum(abs(sum(s * v for s, v in zip(signs, c))) >= abs(sum(c)) * (1 - 1e-12) for signs in itertools.product((1, -1), repeat=len(c))) for c in cases]
    assert R._extreme_patterns(pd.Series(cases)).tolist() == want


def test_forty_units_need_no_pattern_rows(spark):
    df = spark.createDataFrame([("a", 1.0)] * 40 + [(None, float(k)) for k in range(1, 19)] + [("b", float("nan"))], "g string, d double")
    got = {r["g"]: r for r in R.exact_sign_flip(df, ["g"], "d", cap=40).collect()}
    assert got["a"]["two_sided_p"] == 2 / 2**40 and got[None]["n_patterns"] == 2**18 and got["b"]["n_not_finite"] == 1
    plan = R.exact_sign_flip(df, ["g"], "d", cap=40)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_packed_and_joined_bootstraps_are_equal(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(g, k, rng.gauss(0, 1)) for g in ("a", "b", None) for k in range(rng.randrange(5, 40))], "g string, u int, d double")
    rows = [sorted(((r["g"] or "", r["replicate"], r["n_drawn"], round(r["d"], 9)) for r in R.bootstrap_sums(df, ["g"], "u", ["d"], replicates=20, seed="s", packed_units=p).collect())) for p in (1000, 1)]
    assert rows[0] == rows[1] and len(rows[0]) == 60


def shuffled_rows(df):
    """Rows written to shuffles by the executed plan."""
    df.collect()
    total, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            stack.append(node.plan())
            continue
        if name == "Exchange":
            total += int(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    return total


def test_draws_of_packed_groups_are_not_shuffled(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), "id", F.rand(5).alias("d"))
    packed = shuffled_rows(R.bootstrap_sums(df, ["g"], "id", ["d"], replicates=50, seed="s"))
    joined = shuffled_rows(R.bootstrap_sums(df, ["g"], "id", ["d"], replicates=50, seed="s", packed_units=10))
    assert packed <= 3000 + 3 * R.REPLICATE_BLOCKS < joined


def test_random_rankings_shuffle_only_the_range_of_the_quota(spark):
    import hashlib

    from trajlytics.operators import selective as Q

    pool = spark.range(20000).select(F.sha2(F.col("id").cast("string"), 256).alias("tie"), (F.col("id") % 7 == 0).alias("bad"))
    df = Q.random_rankings(pool, tie="tie", catastrophic="bad", issue_count=300, rankings=3, seed="s")
    assert shuffled_rows(df) < 2000  # 60,000 when every ranking was shuffled
    rows = [(r["tie"], r["bad"]) for r in pool.collect()]
    for r in df.collect():
        order = sorted((hashlib.sha256(f"s|{r['ranking_index']}|{t}".encode()).hexdigest(), t, b) for t, b in rows)[:300]
        assert r["n_issued"] == 300 and abs(r["issued_rate"] - sum(b for _, _, b in order) / 300) < 1e-12
