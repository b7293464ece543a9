"""Ranking, quota issuance and selective-prediction analysis (survey rows Q1-Q15).

A rank inside a partition orders by (score, content hash[, ordinal]). Cut points of the score, taken
once over the pool (at most 256 numbers), split every partition into order buckets; a score that
repeats often is split further by its hash. No partition is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlytics.functions.columns import attach_one_row, div, hash_text, is_finite
from trajlytics.operators.scoring import average_ranks
from trajlytics.plans.scan import cut_bucket, cut_points, hash_bucket, running
from trajlytics.session import cut_lineage

#: Hexadecimal digits of the hash ranges of a random ranking.
HASH_DIGITS = 3


def rank_by_score(
    df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], name: str = "rank", size: str | None = None
) -> DataFrame:
    """One-based rank per key by ascending score, then the tie columns (the first one a hash); ``size`` names a column for
    the number of rows of the key."""
    specs = {name: ("count", F.lit(1)), **({size: ("total_sum", F.lit(1))} if size else {})}
    return running(df, keys, cut_bucket(score, cut_points(df, score), tie[0]), [score, *tie], specs)


def envelope_decisions(fits: DataFrame, points: DataFrame, *, partition: str, entity: str, quota: int, protocol: str) -> DataFrame:
    """Eligibility, disagreement score, rank within the partition, quota issue and reasons.

    fits: model_id, fit_status, prefix_rmse_pp, credible_variant; points: point, lower, upper. The score is
    the widest envelope over the horizon; eligible needs two credible families and finite forecasts.
    """
    keys = [partition, entity]
    members = fits.groupBy(*keys).agg(
        F.countDistinct(F.when(F.col("credible_variant"), F.col("model_id"))).alias("credible_families"),
        F.count(F.when(F.col("fit_status") != "ok", 1)).alias("fit_failures"), F.min(F.when(F.col("fit_status") == "ok", F.col("prefix_rmse_pp"))).alias("best_rmse_pp"))
    env = points.groupBy(*keys).agg(
        F.max(F.col("upper") - F.col("lower")).alias("_width"), F.bool_and(is_finite("lower") & is_finite("upper")).alias("_env"), F.bool_and(is_finite("point")).alias("_point"),
        F.min("content_hash").alias("content_hash"))
    joined = env.join(members, keys, "left").withColumn("credible_families", F.coalesce("credible_families", F.lit(0)))
    enough = F.col("credible_families") >= 2
    judged = joined.withColumn("disagreement", F.when(enough & F.col("_env"), F.col("_width"))).withColumn(
        "eligible", enough & F.col("disagreement").isNotNull() & F.col("_point")).withColumn("tie_hash", hash_text(protocol, F.col("content_hash")))
    ranked = rank_by_score(judged.filter("eligible"), [partition], "disagreement", ["tie_hash", entity], "issuance_rank").select(*keys, "issuance_rank")
    out = judged.join(ranked, keys, "left").withColumn("issued", F.coalesce(F.col("issuance_rank") <= quota, F.lit(False)))
    reasons = F.array_compact(F.array(
        F.when(~enough, F.lit("fewer_than_two_credible_families")), F.when(F.col("disagreement").isNull(), F.lit("nonfinite_disagreement")),
        F.when(~F.col("_point"), F.lit("nonfinite_point_forecast")), F.when(F.col("issuance_rank") > quota, F.lit("ranked_above_quota"))))
    return out.select(*keys, "credible_families", "fit_failures", "best_rmse_pp", "disagreement", "eligible", "issuance_rank", "issued", reasons.alias("reasons"))


def rank_for_issuance(pool: DataFrame, keys: Sequence[str], *, score: str, tie: str, ordinal: str, fraction: float) -> DataFrame:
    """Rank of the eligible pool and issue of its ``floor(n * fraction)`` least dangerous members."""
    ranked = rank_by_score(pool, keys, score, [tie, ordinal], size="_n")
    return ranked.withColumn("issued", F.col("rank") <= F.floor(F.col("_n") * F.lit(fraction))).drop("_n")


def least_dangerous(pool: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    """Top-k report: Spark keeps k rows per task and merges them; no full sort."""
    return pool.orderBy(F.col(score), F.col(tie)).limit(k)


def calibration_threshold(decisions: DataFrame, partition: str, calibration: str, rank: int, score: str = "disagreement") -> DataFrame:
    """One row: the score at the declared calibration rank, null when too few are eligible."""
    return decisions.filter((F.col(partition) == calibration) & F.col("eligible")).agg(
        F.max(F.when(F.col("issuance_rank") == rank, F.col(score))).alias("threshold"), F.count(F.lit(1)).alias("n_eligible"))


def join_pairs(pairs: DataFrame, members: DataFrame, entity: str, columns: Sequence[str]) -> DataFrame:
    """Pair table (pair_id, left_id, right_id) with the columns of both members as left_* and right_*."""
    out = pairs
    for side in ("left", "right"):
        cols = members.select(F.col(entity).alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        out = out.join(cols, f"{side}_id")
    return out


def matched_pair_rejection(pairs: DataFrame, decisions: DataFrame, threshold: DataFrame, entity: str, score: str = "disagreement") -> DataFrame:
    joined = attach_one_row(join_pairs(pairs, decisions, entity, [score]), threshold.select("threshold"))
    above = lambda side: F.coalesce(F.col(f"{side}_{score}") > F.col("threshold"), F.lit(False))
    return joined.select("pair_id", F.col(f"left_{score}").alias("left_score"), F.col(f"right_{score}").alias("right_score"),
                         above("left").alias("left_rejected"), above("right").alias("right_rejected"), (above("left") & above("right")).alias("both_rejected"))


def risk_reduction(pool: DataFrame, by: Sequence[str], *, eligible: str, issued: str, catastrophic: str) -> DataFrame:
    """Issued catastrophic rate against the rate expected from random issue of the eligible pool."""
    c = F.col(catastrophic).cast("double")
    agg = pool.groupBy(*by).agg(
        F.count(F.when(F.col(eligible), 1)).alias("n_eligible"), F.count(F.when(F.col(issued), 1)).alias("n_issued"),
        F.avg(F.when(F.col(eligible), c)).alias("random_rate"), F.avg(F.when(F.col(issued), c)).alias("issued_rate"))
    ok = (F.col("n_issued") > 0) & (F.col("random_rate") > 0)
    return agg.withColumns({"risk_reduction": F.when(ok, 1.0 - div("issued_rate", "random_rate")), "status": F.when(ok, "ok").otherwise("inconclusive")})


def random_rankings(pool: DataFrame, *, tie: str, catastrophic: str, issue_count: int, rankings: int, seed: str) -> DataFrame:
    """Issue by ``hash(seed | i | content)`` for i < rankings: catastrophic rate and risk reduction.

    Rows are counted per ranking and hash range; ranges wholly inside the quota are summed from the counts, and only the rows
    of the range that the quota ends in are ranked, so no ranking is ever shuffled.
    """
    drawn = pool.select(tie, catastrophic).withColumn("ranking_index", F.explode(F.sequence(F.lit(0), F.lit(rankings - 1)))).withColumn(
        "_h", hash_text(seed, F.col("ranking_index").cast("string"), F.col(tie))).withColumn("_range", hash_bucket("_h", HASH_DIGITS))
    c = F.col(catastrophic).cast("double")
    ranges = drawn.groupBy("ranking_index", "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum(c).alias("_c"), F.count(c).alias("_k"))
    before = Window.partitionBy("ranking_index").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 ranges at most
    ranges = cut_lineage(ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < issue_count))
    full = F.col("_before") + F.col("_n") <= issue_count
    inside = ranges.filter(full).select("ranking_index", "_n", "_c", "_k")
    edge = ranges.filter(~full).select("ranking_index", "_range", (F.lit(issue_count) - F.col("_before")).alias("_left"))  # a row a ranking
    order = Window.partitionBy("ranking_index").orderBy("_h", tie)
    last = drawn.join(F.broadcast(edge), ["ranking_index", "_range"]).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= F.col("_left"))
    rest = last.select("ranking_index", F.lit(1).cast("bigint").alias("_n"), c.alias("_c"), c.isNotNull().cast("bigint").alias("_k"))
    rate = inside.unionByName(rest).groupBy("ranking_index").agg(F.sum("_n").alias("n_issued"), div(F.sum("_c"), F.sum("_k")).alias("issued_rate"))
    expected = pool.agg(F.avg(F.col(catastrophic).cast("double")).alias("expected_rate"))
    return attach_one_row(rate, expected).withColumn("risk_reduction", 1.0 - div("issued_rate", "expected_rate"))


def risk_coverage_curve(ranked: DataFrame, keys: Sequence[str], *, rank: str, catastrophic: str, iae: str, score: str, fractions: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Cumulative catastrophic rate and mean IAE along the issuance rank, declared fractions marked."""
    keys = list(keys)
    cum = running(ranked, keys, F.floor(F.col(rank) / 4096), [rank], {
        "_c": ("sum", F.col(catastrophic).cast("double")), "_i": ("sum", F.col(iae)), "max_issued_score": ("max", F.col(score)),
        "_n": ("total_sum", F.lit(1))})
    marker = F.coalesce(*[F.when(F.col(rank) == F.bround(F.col("_n") * F.lit(f)), F.lit(f)) for f in fractions])
    k = F.col(rank)
    return cum.select(*keys, k.alias("n_issued"), (k / F.col("_n")).alias("coverage"), F.col("_c").cast("bigint").alias("n_catastrophic"),
                      (F.col("_c") / k).alias("catastrophic_rate"), (F.col("_i") / k).alias("mean_iae"), "max_issued_score", marker.alias("marker"))


def fraction_policies(ranked: DataFrame, keys: Sequence[str], *, rank: str, catastrophic: str, fractions: Sequence[float]) -> DataFrame:
    """Issue at fixed fractions: rank <= round(n f)."""
    keys = list(keys)
    n = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col(catastrophic).cast("double")).alias("pool_rate"))
    rows = ranked.join(n, keys).withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    quota = F.bround(F.col("_n") * F.col("fraction"))
    c = F.col(catastrophic).cast("double")
    return rows.groupBy(*keys, "fraction").agg(
        F.max(quota).alias("quota"), F.count(F.when(F.col(rank) <= quota, 1)).alias("n_issued"), F.avg(F.when(F.col(rank) <= quota, c)).alias("issued_rate"),
        F.max("pool_rate").alias("pool_rate")).withColumn("risk_reduction", F.when(F.col("pool_rate") > 0, 1.0 - div("issued_rate", "pool_rate")))


def auroc(pool: DataFrame, keys: Sequence[str], *, score: str, label: str, bucket: str | Column) -> DataFrame:
    """Area under the ROC curve from average ranks; null when one class is absent."""
    ranked = average_ranks(pool.filter(is_finite(score)), keys, score, "_r", bucket=bucket)
    agg = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col(label), F.col("_r"))).alias("_s"), F.count(F.when(F.col(label), 1)).cast("double").alias("_p"))
    p, n = F.col("_p"), F.col("n_rows") - F.col("_p")
    return agg.select(*keys, "n_rows", F.col("_p").cast("bigint").alias("n_positive"), div(F.col("_s") - p * (p + 1) / 2.0, p * n).alias("auroc"))


def arm_scores(pool: DataFrame, arms: dict[str, str], tie: str, protocol: str, keep: Sequence[str]) -> DataFrame:
    """Pool unpivoted to one row per arm, each arm with its own tie hash."""
    entries = F.array(*[F.struct(F.lit(a).alias("arm"), F.col(c).cast("double").alias("arm_score"), hash_text(protocol, a, F.col(tie)).alias("arm_tie")) for a, c in arms.items()])
    return pool.select(*keep, F.explode(entries).alias("a")).select(*keep, "a.*")


def subset_rerank(pool: DataFrame, subset: str, arms: dict[str, str], *, tie: str, catastrophic: str, protocol: str, quota: int | None = None) -> DataFrame:
    """Both arms re-ranked inside every subset; quota = eligible // 2 unless given."""
    long = arm_scores(pool, arms, tie, protocol, [subset, catastrophic])
    ranked = rank_by_score(long, [subset, "arm"], "arm_score", ["arm_tie"])
    size = pool.groupBy(subset).agg(F.count(F.lit(1)).alias("n_eligible"), F.count(F.when(F.col(catastrophic), 1)).alias("n_catastrophic"))
    q = F.lit(quota) if quota is not None else F.floor(F.col("n_eligible") / 2)
    rates = ranked.join(size.withColumn("n_issued", q), subset).groupBy(subset, "n_eligible", "n_catastrophic", "n_issued").agg(*[
        F.avg(F.when((F.col("arm") == a) & (F.col("rank") <= F.col("n_issued")), F.col(catastrophic).cast("double"))).alias(f"_r{i}") for i, a in enumerate(arms)])
    pool_rate = F.col("n_catastrophic") / F.col("n_eligible")
    out = rates.select("*", *[F.when(pool_rate > 0, 1.0 - div(f"_r{i}", pool_rate)).alias(f"reduction_{a}") for i, a in enumerate(arms)])
    first, second = list(arms)[:2]
    return out.withColumn("increment", F.col(f"reduction_{second}") - F.col(f"reduction_{first}")).drop(*[f"_r{i}" for i in range(len(arms))])


def family_gates(summary: DataFrame, family: str, *, expected: int, min_eligible_share: float, min_catastrophic: int, reduction: str) -> DataFrame:
    """Inconclusive with reasons when counts do not suffice, else passed on a non-negative reduction."""
    reasons = F.array_compact(F.array(
        F.when(F.col("n_source") != expected, F.lit("source_count")), F.when(F.col("n_eligible") < F.ceil(F.lit(min_eligible_share * expected)), F.lit("eligible_count")),
        F.when(F.col("n_catastrophic") < min_catastrophic, F.lit("catastrophic_count"))))
    verdict = F.when(F.size(reasons) > 0, "inconclusive").when(F.col(reduction) >= 0, "passed").otherwise("failed")
    return summary.select(family, F.when(F.size(reasons) == 0, F.col(reduction)).alias("estimate"), F.array_join(reasons, ";").alias("reasons"), verdict.alias("status"))


def directional_gates(summary: DataFrame, subset: str, *, minimum_source: int, minimum_catastrophic: int, reduction: str, increment: str) -> DataFrame:
    """Positive reduction and positive increment per subset, as separate verdict rows."""
    ok = (F.col("n_source") >= minimum_source) & (F.col("n_catastrophic") >= minimum_catastrophic)
    gates = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(c).alias("estimate")) for g, c in [("positive_risk_reduction", reduction), ("positive_increment", increment)]])
    rows = summary.select(subset, ok.alias("_ok"), F.explode(gates).alias("g")).select(subset, "_ok", "g.*")
    return rows.select(subset, "gate", F.when(F.col("_ok"), F.col("estimate")).alias("estimate"),
                       F.when(~F.col("_ok"), "inconclusive").when(F.col("estimate") > 0, "passed").otherwise("failed").alias("status"))


def pair_coverage(pairs: DataFrame, members: DataFrame, entity: str, *, covered: str, width: str) -> DataFrame:
    joined = join_pairs(pairs, members, entity, [covered, width])
    return joined.select("pair_id", (F.col(f"left_{covered}") & F.col(f"right_{covered}")).alias("both_covered"),
                         F.col(f"left_{width}").eqNullSafe(F.col(f"right_{width}")).alias("width_equal"), F.greatest(f"left_{width}", f"right_{width}").alias("max_width"))


def pair_discrimination(pairs: DataFrame, members: DataFrame, entity: str, *, score: str, error: str) -> DataFrame:
    """Does the score order the pair as the error does; any tie counts as wrong."""
    joined = join_pairs(pairs, members, entity, [score, error])
    ds, de = F.col(f"left_{score}") - F.col(f"right_{score}"), F.col(f"left_{error}") - F.col(f"right_{error}")
    return joined.select("pair_id", ds.alias("score_delta"), de.alias("error_delta"), (ds * de > 0).alias("correct_order"))


def pair_invariance(pairs: DataFrame, members: DataFrame, entity: str, outputs: Sequence[str]) -> DataFrame:
    """Pairs with identical input whose outputs differ: mismatching pairs per output column."""
    joined = join_pairs(pairs, members, entity, outputs)
    counts = joined.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.when(~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")), 1)).alias(c) for c in outputs])
    return counts.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("output"), F.col(c).alias("n_mismatch")) for c in outputs])).alias("o")).select(
        "o.output", F.col("_n").alias("n_pairs"), "o.n_mismatch")


def probability_diagnostics(df: DataFrame, by: Sequence[str], probability: str, label: str) -> DataFrame:
    p, y = F.col(probability), F.col(label).cast("double")
    bad = ~is_finite(p) | (p < 0) | (p > 1)
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col(label), 1)).alias("n_positive"), F.count(F.when(bad, 1)).alias("n_invalid"),
        F.avg(p).alias("_mp"), F.avg(y).alias("_prev"), F.avg((p - y) * (p - y)).alias("_b"))
    ok = F.col("n_invalid") == 0
    return agg.select(*by, "n_rows", "n_positive", "n_invalid", F.when(ok, F.col("_mp")).alias("mean_probability"), F.when(ok, F.col("_prev")).alias("prevalence"), F.when(ok, F.col("_b")).alias("brier"))


def policy_comparison(pool: DataFrame, arms: dict[str, str], *, tie: str, catastrophic: str, protocol: str, issue_count: int, random_mean: DataFrame) -> DataFrame:
    """Every score as an issuance policy against the mean rate of random rankings (one row)."""
    ranked = rank_by_score(arm_scores(pool, arms, tie, protocol, [catastrophic]), ["arm"], "arm_score", ["arm_tie"])
    rate = ranked.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n_eligible"), F.count(F.when(F.col("rank") <= issue_count, 1)).alias("n_issued"),
        F.avg(F.when(F.col("rank") <= issue_count, F.col(catastrophic).cast("double"))).alias("issued_rate"))
    return attach_one_row(rate, random_mean).withColumns({
        "coverage": F.col("n_issued") / F.col("n_eligible"), "risk_reduction": 1.0 - div("issued_rate", "random_mean_rate")})
