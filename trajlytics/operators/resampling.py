"""Bootstraps, exact tests and sensitivity sweeps (survey rows T1-T14).

Replicates are a column. Draws are hash based, ``hash(seed | replicate | slot | group) mod n``, so they
are the same on every run; units carry a dense zero-based index within their group and draws meet
them in an equality join on (group, index), which spreads a large group over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlytics.functions.columns import attach_one_row, div, hash_draw, hash_text, is_finite
from trajlytics.operators.intervals import beta_cdf
from trajlytics.operators.selective import cut_bucket, cut_points
from trajlytics.plans.scan import grouped_rank, hash_bucket, null_safe_join, running
from trajlytics.session import cut_lineage


def indexed_units(units: DataFrame, group: Sequence[str], unit: str, seed: str = "unit") -> DataFrame:
    """Units with a dense zero-based index per group in hash order, and the group size."""
    group = list(group)
    hashed = units.withColumn("_h", hash_text(seed, F.col(unit).cast("string")))
    ranked = running(
        hashed, group, hash_bucket("_h", 3), ["_h", unit], {"_i": ("count", F.lit(1)), "_n": ("total_sum", F.lit(1))}
    )
    return ranked.withColumn("_i", F.col("_i") - 1).drop("_h")


def drawn_slots(units: DataFrame, group: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """(group, replicate, index) of every draw. Every unit index is also one slot of its group, so the slots need no separate table."""
    group = list(group)
    slots = units.select(*group, F.col("_i").alias("_slot"), "_n").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    tag = [F.col(g).cast("string") for g in group]
    picked = slots.withColumn("_i", hash_draw(F.col("_n"), seed, F.col("replicate").cast("string"), F.col("_slot").cast("string"), *tag))
    return picked.select(*group, "replicate", "_i")


def draws(units: DataFrame, group: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """(group, replicate, index, times): how often each unit of the group is drawn per replicate."""
    return drawn_slots(units, group, replicates, seed).groupBy(*group, "replicate", "_i").agg(F.count(F.lit(1)).alias("times"))


#: Groups of up to so many units travel as one array per block of replicates; larger ones by joins of unit and draw.
PACKED_UNITS = 32_768
#: Blocks of replicates that a packed group is copied to.
REPLICATE_BLOCKS = 8


def _packed_sums(idx: DataFrame, group: list[str], sums: Sequence[str], replicates: int, seed: str) -> DataFrame:
    """Sums of every replicate from the units of a group in one array: units move once, then one row a block of replicates."""
    unit = F.struct("_i", *sums)
    packed = idx.groupBy(*group, "_n").agg(F.sort_array(F.collect_list(unit)).alias("_units"))
    n_blocks = min(REPLICATE_BLOCKS, replicates)
    tag = [F.col(g).cast("string") for g in group]
    dealt = packed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).repartition(*group, "_block")
    spread = dealt.withColumn("replicate", F.explode(F.filter(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: r % n_blocks == F.col("_block"))))
    slots = F.sequence(F.lit(0).cast("bigint"), F.col("_n").cast("bigint") - 1)
    at = lambda slot: F.get("_units", hash_draw(F.col("_n"), seed, F.col("replicate").cast("string"), slot.cast("string"), *tag).cast("int"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in sums])

    def add(total: Column, slot: Column) -> Column:
        return F.get(F.transform(F.array(at(slot)), lambda u: F.struct(*[(total[c] + u[c].cast("double")).alias(c) for c in sums])), F.lit(0))

    summed = spread.withColumn("_sum", F.aggregate(slots, zero, add))
    return summed.select(*group, "replicate", F.col("_n").cast("bigint").alias("n_drawn"), *[F.col("_sum")[c].alias(c) for c in sums])


def _joined_sums(idx: DataFrame, group: list[str], sums: Sequence[str], replicates: int, seed: str) -> DataFrame:
    joined = null_safe_join(draws(idx, group, replicates, seed), idx.select(*group, "_i", *sums), [*group, "_i"])
    return joined.groupBy(*group, "replicate").agg(
        F.sum("times").alias("n_drawn"), *[F.sum(F.col("times") * F.col(s).cast("double")).alias(s) for s in sums])


def bootstrap_sums(
    units: DataFrame, group: Sequence[str], unit: str, sums: Sequence[str], *, replicates: int, seed: str, packed_units: int = PACKED_UNITS
) -> DataFrame:
    """Per (group, replicate): weighted sums of the unit columns and the number of drawn units. Null groups are one group.

    Both ways draw the same units, so ``packed_units`` changes the plan of a group and never its values.
    """
    group = list(group)
    idx = cut_lineage(indexed_units(units, group, unit).select(*group, "_i", "_n", *sums))
    small = _packed_sums(idx.where(F.col("_n") <= packed_units), group, sums, replicates, seed)
    return small.unionByName(_joined_sums(idx.where(F.col("_n") > packed_units), group, sums, replicates, seed))


def paired_bootstrap(
    paired: DataFrame, group: Sequence[str], unit: str, deltas: Sequence[str], *, replicates: int, seed: str, level: float = 0.95, packed_units: int = PACKED_UNITS
) -> DataFrame:
    """Percentile interval of the mean of each delta per group, null groups included.

    A delta that is null, NaN or infinite is left out of its means and counted in ``n_not_finite_<delta>``; a replicate that
    draws no usable unit has no mean and is left out of the percentiles.
    """
    group = list(group)
    values = [c for d in deltas for c in (F.when(is_finite(d), F.col(d).cast("double")).otherwise(0.0).alias(d), is_finite(d).cast("double").alias(f"_ok_{d}"))]
    paired = cut_lineage(paired.select(*group, unit, *values))  # read several times below
    reps = cut_lineage(bootstrap_sums(paired, group, unit, [c for d in deltas for c in (d, f"_ok_{d}")], replicates=replicates, seed=seed, packed_units=packed_units))
    ok = {d: F.col(f"_ok_{d}") for d in deltas}
    out = paired.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_units"), *[div(F.sum(d), F.sum(ok[d])).alias(f"mean_{d}") for d in deltas],
        *[F.sum(1 - ok[d]).cast("bigint").alias(f"n_not_finite_{d}") for d in deltas])
    a = (1 - level) / 2
    # percentiles over the declared number of replicates: a bounded group
    q = reps.groupBy(*group).agg(*[F.percentile(div(d, ok[d]), [a, 1 - a]).alias(f"_q_{d}") for d in deltas])
    bounds = q.select(*group, *[c for d in deltas for c in (F.get(f"_q_{d}", F.lit(0)).alias(f"lower_{d}"), F.get(f"_q_{d}", F.lit(1)).alias(f"upper_{d}"))])
    return null_safe_join(out, bounds, group, "left")


def group_bootstrap_metrics(df: DataFrame, group: str, truth: str, predicted: str, *, replicates: int, seed: str, level: float = 0.95) -> DataFrame:
    """Bootstrap of MAE, RMSE and MAPE over whole groups, from per-group sums."""
    e = F.col(predicted) - F.col(truth)
    per = df.groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.sum(F.abs(e)).alias("ae"), F.sum(e * e).alias("se"), F.sum(F.abs(e) / F.abs(F.col(truth))).alias("pe"))
    per = cut_lineage(per)
    reps = bootstrap_sums(per.withColumn("_all", F.lit(0)), ["_all"], group, ["rows", "ae", "se", "pe"], replicates=replicates, seed=seed)
    point = per.agg(F.count(F.lit(1)).alias("n_groups"), (F.sum("ae") / F.sum("rows")).alias("mae"), F.sqrt(F.sum("se") / F.sum("rows")).alias("rmse"), (100 * F.sum("pe") / F.sum("rows")).alias("mape_pct"))
    a = (1 - level) / 2
    q = reps.select((F.col("ae") / F.col("rows")).alias("mae"), F.sqrt(F.col("se") / F.col("rows")).alias("rmse"), (100 * F.col("pe") / F.col("rows")).alias("mape_pct"))
    bounds = q.agg(*[F.percentile(m, [a, 1 - a]).alias(f"_{m}") for m in ("mae", "rmse", "mape_pct")])
    joined = attach_one_row(point, bounds)
    return joined.select("n_groups", *[c for m in ("mae", "rmse", "mape_pct") for c in (F.col(m), F.col(f"_{m}")[0].alias(f"{m}_lower"), F.col(f"_{m}")[1].alias(f"{m}_upper"))])


def within_quota(rows: DataFrame, run: str, order: Sequence[str]) -> DataFrame:
    """Per run: copies (n), catastrophic copies (c) and copies with a known outcome (v) inside its quota along ``order``.

    rows: run, ``_at`` (bucket of the order), ``_t`` (copies), ``_c`` (outcome), ``_k`` (quota of the run). Copies are counted per
    bucket; buckets wholly inside the quota are summed from the counts, and only rows of the bucket it ends in are ordered, so
    no run is ever shuffled.
    """
    t, c = F.col("_t"), F.col("_c")
    sums = lambda copies: [F.sum(copies).alias("n"), F.coalesce(F.sum(copies * c), F.lit(0.0)).alias("c"), F.sum(copies * c.isNotNull().cast("double")).alias("v")]
    before = Window.partitionBy(run).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(run, "_at").agg(*sums(t), F.max("_k").alias("_k")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    ranges = cut_lineage(ranges.filter(F.col("_before") < F.col("_k")))
    full = F.col("_before") + F.col("n") <= F.col("_k")
    edge = ranges.filter(~full).select(run, "_at", (F.col("_k") - F.col("_before")).alias("_left"))  # a row a run
    so_far = F.sum("_t").over(Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    last = rows.join(F.broadcast(edge), [run, "_at"]).withColumn("_cum", so_far)
    taken = F.greatest(F.least(F.col("_left") - (F.col("_cum") - t), t), F.lit(0.0))
    both = ranges.filter(full).select(run, "n", "c", "v").unionByName(last.groupBy(run).agg(*sums(taken)))
    return both.groupBy(run).agg(*[F.sum(x).alias(x) for x in ("n", "c", "v")])


def stratified_rerank_bootstrap(
    pool: DataFrame, *, family: str, unit: str, tie: str, arms: dict[str, str], catastrophic: str, eligible: str, issue_fraction: float, replicates: int, seed: str
) -> DataFrame:
    """Stratified bootstrap with a new ranking inside every replicate and arm.

    A drawn unit carries its multiplicity in every replicate, so copies are never written out and a unit travels once for
    all replicates, which share one order per arm; ``within_quota`` finds how many of its copies fall inside the quota.
    """
    scores = list(dict.fromkeys(arms.values()))
    cols = list(dict.fromkeys([tie, catastrophic, eligible, *scores]))
    idx = cut_lineage(indexed_units(pool.select(family, unit, *[c for c in cols if c not in (family, unit)]), [family], unit).select(
        family, "_i", "_n", *[c for c in cols if c != family]))
    counts = [F.count(F.when(F.col("replicate") == r, 1)).alias(f"_t{r}") for r in range(replicates)]
    times = drawn_slots(idx, [family], replicates, seed).groupBy(family, "_i").agg(*counts)
    met = null_safe_join(times, idx.drop("_n"), [family, "_i"]).filter(F.col(eligible))
    drawn = cut_lineage(met.select(*scores, *[c for c in (tie,) if c not in scores], F.col(catastrophic).cast("double").alias("_c"), *[f"_t{r}" for r in range(replicates)]))
    row = drawn.agg(*[F.sum(f"_t{r}").alias(f"n{r}") for r in range(replicates)], *[F.sum(F.col(f"_t{r}") * F.col("_c")).alias(f"c{r}") for r in range(replicates)]).first()
    n = [row[f"n{r}"] or 0 for r in range(replicates)]  # one short row: sizes and catastrophic copies of the replicates
    base = pool.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate")).filter(F.get(F.lit(n), F.col("replicate")) > 0)
    of = lambda values: F.get(F.lit(values), F.col("replicate"))
    out = base.withColumns({
        "n_eligible": of(n).cast("bigint"), "random_rate": of([float(row[f"c{r}"] or 0.0) / n[r] if n[r] else 0.0 for r in range(replicates)]),
        "_k": of([math.floor(m * issue_fraction) for m in n]).cast("double")})
    copies = drawn.select(*[c for c in drawn.columns if not c.startswith("_t")], F.posexplode(F.array(*[F.col(f"_t{r}").cast("double") for r in range(replicates)])).alias("replicate", "_t"))
    copies = copies.filter("_t > 0").withColumn("_k", of([float(math.floor(m * issue_fraction)) for m in n]))
    for arm, score in arms.items():
        placed = copies.withColumn("_at", F.struct(*cut_bucket(score, cut_points(pool, score), tie)))
        inside = within_quota(placed, "replicate", [score, tie]).select("replicate", F.col("c").alias("_inside"))
        out = out.join(F.broadcast(inside), "replicate", "left").withColumn(f"_rate_{arm}", div(F.coalesce("_inside", F.lit(0.0)), "_k")).drop("_inside")
    defined = (F.col("random_rate") > 0) & (F.col("_k") > 0)
    out = out.withColumn("defined", defined)
    for arm in arms:
        out = out.withColumn(f"reduction_{arm}", F.when(defined, 1.0 - div(f"_rate_{arm}", "random_rate")))
    first, second = list(arms)[:2]
    return out.withColumn("increment", F.col(f"reduction_{second}") - F.col(f"reduction_{first}")).drop("_k", *[f"_rate_{a}" for a in arms])


def replicate_summary(reps: DataFrame, columns: dict[str, tuple[str, float]]) -> DataFrame:
    """Percentiles over replicates, withheld entirely when any replicate is undefined."""
    agg = reps.agg(F.count(F.lit(1)).alias("n_replicates"), F.count(F.when(~F.col("defined"), 1)).alias("n_undefined"),
                   *[F.percentile(c, p).alias(n) for n, (c, p) in columns.items()])
    ok = F.col("n_undefined") == 0
    return agg.select("n_replicates", "n_undefined", *[F.when(ok, F.col(n)).alias(n) for n in columns], F.when(ok, "ok").otherwise("inconclusive").alias("status"))


def binomial_tail(n: Column, k: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, 1/2); evaluated on aggregated counts only, one call per group."""
    @F.pandas_udf("double")
    def tail(n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([1.0 if b >= a else beta_cdf(float(a - b), float(b + 1), 0.5) for a, b in zip(n, k)])

    return tail(n.cast("bigint"), k.cast("bigint"))


def sign_counts(deltas: DataFrame, by: Sequence[str], delta: str, tolerance: float) -> DataFrame:
    d = F.col(delta)
    return deltas.groupBy(*by).agg(F.count(F.when(d < -tolerance, 1)).alias("n_negative"), F.count(F.when(d > tolerance, 1)).alias("n_positive"), F.count(F.when(F.abs(d) <= tolerance, 1)).alias("n_zero"))


def exact_sign_test(deltas: DataFrame, by: Sequence[str], delta: str, *, tolerance: float = 1e-12) -> DataFrame:
    """Exact two-sided sign test after removing numerical zeros."""
    c = sign_counts(deltas, by, delta, tolerance)
    n = F.col("n_negative") + F.col("n_positive")
    p = F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * binomial_tail(n, F.least("n_negative", "n_positive"))))
    return c.withColumn("two_sided_p", p)


def sign_diagnostics(deltas: DataFrame, by: Sequence[str], delta: str, *, tolerance: float = 1e-12) -> DataFrame:
    """One-sided superiority and two-sided sign probabilities with a tie tolerance."""
    c = sign_counts(deltas, by, delta, tolerance)
    n = F.col("n_negative") + F.col("n_positive")
    upper = F.when(n == 0, F.lit(1.0)).otherwise(binomial_tail(n, F.col("n_positive")))
    lower = F.when(n == 0, F.lit(1.0)).otherwise(binomial_tail(n, F.col("n_negative")))
    return c.withColumns({"superiority_p": upper, "two_sided_p": F.least(F.lit(1.0), 2.0 * F.least(upper, lower))})


#: Half of the units of a sign-flip test may have so many sign patterns: 2 ** 20 sums of eight bytes.
MAX_HALF = 20


def _extreme_patterns(deltas: pd.Series) -> pd.Series:
    """Sign patterns of each list of deltas whose sum is at least as far from zero as the observed one.

    Both halves are summed under all their patterns; for every sum of one half, those of the other half that reach the
    observed distance are counted in its sorted sums."""
    found = []
    for values in deltas:
        d = np.asarray(values, float)
        halves = []
        for part in (d[: len(d) // 2], d[len(d) // 2 :]):
            sums = np.zeros(1)
            for v in part:
                sums = np.concatenate([sums + v, sums - v])
            halves.append(np.sort(sums))
        edge = abs(d.sum()) * (1 - 1e-12) - 1e-14 * np.abs(d).sum()
        above = len(halves[1]) - np.searchsorted(halves[1], edge - halves[0], side="left")
        below = np.searchsorted(halves[1], -edge - halves[0], side="right")
        both = np.minimum(above + below, len(halves[1]))  # an edge of zero or less counts a pattern on either side
        found.append(int(both.sum()))
    return pd.Series(found, dtype="int64")


def exact_sign_flip(deltas: DataFrame, by: Sequence[str], delta: str, *, cap: int = 20, tolerance: float = 1e-12) -> DataFrame:
    """Exact sign-flip test of the mean for groups of at most ``cap`` nonzero units; a null group is a group.

    The units of a group are one short array (at most twice MAX_HALF), and its 2**n patterns are never written out: they meet
    in the middle, as sums of two halves. Larger groups get a status instead of a value. Deltas that are null, NaN or infinite
    are left out and counted.
    """
    if cap > 2 * MAX_HALF:
        raise ValueError(f"cap is at most {2 * MAX_HALF}")
    used = is_finite(delta) & (F.abs(F.col(delta)) > tolerance)
    size = deltas.groupBy(*by).agg(F.count(F.when(used, 1)).alias("n_nonzero"), F.count(F.when(~is_finite(delta), 1)).alias("n_not_finite"))
    small = null_safe_join(deltas.filter(used), size.filter(F.col("n_nonzero") <= cap).select(*by), list(by), "left_semi")
    packed = small.groupBy(*by).agg(F.sort_array(F.collect_list(F.col(delta).cast("double"))).alias("_d"))
    patterns = F.pow(F.lit(2.0), F.size("_d")).cast("bigint")
    extreme = F.pandas_udf(_extreme_patterns, "bigint")("_d")
    judged = packed.select(*by, patterns.alias("n_patterns"), extreme.alias("_extreme"))
    joined = null_safe_join(size, judged, list(by), "left")
    return joined.select(*by, "n_nonzero", "n_not_finite", F.coalesce("n_patterns", F.when(F.col("n_nonzero") == 0, 1)).alias("n_patterns"),
                         F.when(F.col("n_nonzero") == 0, F.lit(1.0)).otherwise(F.col("_extreme") / F.col("n_patterns")).alias("two_sided_p"),
                         F.when(F.col("n_nonzero") > cap, "above_exact_cap").otherwise("exact").alias("status"))


def leave_one_out(units: DataFrame, by: Sequence[str], unit: str, delta: str, *, tolerance: float = 1e-12) -> DataFrame:
    """Mean without each unit in closed form, and whether the direction flips. Null groups are one group."""
    total = units.groupBy(*by).agg(F.sum(delta).alias("_s"), F.count(F.lit(1)).alias("_n"))
    direction = lambda m: F.when(m < -tolerance, -1).when(m > tolerance, 1).otherwise(0)
    joined = null_safe_join(units, total, list(by)).withColumn("full_mean", F.col("_s") / F.col("_n")).withColumn("loo_mean", div(F.col("_s") - F.col(delta), F.col("_n") - 1))
    return joined.select(*by, unit, "full_mean", "loo_mean", (F.col("loo_mean") - F.col("full_mean")).alias("change"),
                         direction(F.col("loo_mean")).alias("direction"), (direction(F.col("loo_mean")) != direction(F.col("full_mean"))).alias("flipped"))


def margin_sensitivity(units: DataFrame, by: Sequence[str], delta: str, margins: Sequence[float], *, tolerance: float = 1e-12) -> DataFrame:
    rows = units.select(*by, delta, F.explode(F.array(*[F.lit(float(m)) for m in margins])).alias("margin"))
    edge, d = F.greatest(F.col("margin"), F.lit(tolerance)), F.col(delta)
    return rows.groupBy(*by, "margin").agg(F.count(F.when(d < -edge, 1)).alias("n_better"), F.count(F.when(d > edge, 1)).alias("n_worse"), F.count(F.when(F.abs(d) <= edge, 1)).alias("n_equivalent"))


#: Subsets that are written out; a pool with more is refused before any score is gathered.
MAX_PARTITIONS = 2_000_000


def unranked(number: Column, n: int, choose: int) -> Column:
    """Places (ascending, from zero) of the number-th subset of `choose` of n places, in the order of their bit masks.

    Walking down from the last place, a place belongs to the subset when the subsets without it are used up."""
    pascal = F.lit([[math.comb(p, k) for k in range(choose + 1)] for p in range(n)])
    start = F.struct(number.cast("bigint").alias("left"), F.lit(choose).alias("k"), F.array().cast("array<int>").alias("places"))

    def step(state: Column, place: Column) -> Column:
        without = F.get(F.get(pascal, place), state["k"]).cast("bigint")
        taken = (state["k"] > 0) & (without <= state["left"])
        return F.when(taken, F.struct((state["left"] - without).alias("left"), (state["k"] - 1).alias("k"), F.concat(F.array(place), state["places"]).alias("places"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1)), start, step, lambda state: state["places"])


def _unit_row(scores: DataFrame, unit: str, route: str, score: str) -> DataFrame:
    return scores.agg(F.sort_array(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(route).alias("r"), F.col(score).alias("s")))).alias("_u"))


def _multipliers(chosen: DataFrame, keys: Sequence[str], coverage: float) -> DataFrame:
    """Conformal multiplier of each route from the chosen units `_c`; all routes of `_u` are reported."""
    routes = F.array_distinct(F.transform("_u", lambda x: x["r"]))
    per = chosen.select(*keys, "_u", F.explode(routes).alias("route"), "_c").withColumn(
        "_s", F.array_sort(F.transform(F.filter("_c", lambda x: x["r"].eqNullSafe(F.col("route"))), lambda x: x["s"])))
    n = F.size("_s")
    rank = F.ceil((n + 1) * F.lit(coverage)).cast("int")
    return per.select(*keys, "_u", "route", n.alias("n_calibration"), rank.alias("rank"), F.when((n > 0) & (rank <= n), F.try_element_at("_s", rank)).alias("multiplier"))


def partition_sensitivity(scores: DataFrame, *, unit: str, route: str, score: str, choose: int, coverage: float, max_partitions: int = MAX_PARTITIONS) -> DataFrame:
    """All C(n, k) calibration subsets of a unit pool: the conformal multiplier of each subset and route.

    The subsets are the numbers 0 to C(n, k) - 1, unranked where they are used, so only their count is bounded
    (``max_partitions``), not n. ``mask`` has the bit of every chosen unit, in the order of units, where n is at most 62.
    """
    n = scores.count()
    total = math.comb(n, choose)
    if total > max_partitions:
        raise ValueError(f"too many partitions: {total} of {n} units, more than {max_partitions}")
    numbers = scores.sparkSession.range(total).withColumnRenamed("id", "number")
    chosen = attach_one_row(numbers, _unit_row(scores, unit, route, score)).withColumn("_p", unranked(F.col("number"), n, choose))
    bits = F.aggregate("_p", F.lit(0).cast("bigint"), lambda m, p: m + F.pow(F.lit(2.0), p).cast("bigint"))
    mask = bits if n <= 62 else F.lit(None).cast("bigint")
    chosen = chosen.select("number", mask.alias("mask"), "_u", F.transform("_p", lambda p: F.get("_u", p)).alias("_c"))
    return _multipliers(chosen, ["number", "mask"], coverage).drop("_u")


def leave_one_calibration_out(scores: DataFrame, *, unit: str, route: str, score: str, coverage: float) -> DataFrame:
    """Every calibration unit left out once: the multiplier of each route from the others, how far it moved from that of all
    units, and whether it covers the unit that was left out (null for the other routes or without a multiplier)."""
    n = scores.count()
    row = _unit_row(scores, unit, route, score)
    whole = _multipliers(row.select("_u", F.col("_u").alias("_c")), [], coverage).select(F.col("route").alias("_route"), F.col("multiplier").alias("_all"))
    each = attach_one_row(scores.sparkSession.range(n).withColumnRenamed("id", "number"), row).withColumn("_out", F.get("_u", F.col("number").cast("int")))
    others = each.withColumn("_c", F.filter("_u", lambda x, i: i != F.col("number").cast("int"))).withColumns({"removed": F.col("_out.u"), "_r": F.col("_out.r"), "_s0": F.col("_out.s")})
    moved = _multipliers(others, ["removed", "_r", "_s0"], coverage).drop("_u")
    joined = moved.join(F.broadcast(whole), F.col("route").eqNullSafe(F.col("_route")))  # one row a route
    own = F.col("route").eqNullSafe(F.col("_r")) & F.col("multiplier").isNotNull()
    return joined.select("removed", "route", "n_calibration", "rank", "multiplier", (F.col("multiplier") - F.col("_all")).alias("change"), F.when(own, F.col("_s0") <= F.col("multiplier")).alias("covers_removed"))


def partition_summary(parts: DataFrame) -> DataFrame:
    m = F.col("multiplier")
    return parts.groupBy("route").agg(
        F.count(F.lit(1)).alias("n_partitions"), F.count(m).alias("n_finite"), F.min("n_calibration").alias("min_calibration"), F.max("n_calibration").alias("max_calibration"),
        F.min(m).alias("multiplier_min"), F.percentile(m, 0.25).alias("multiplier_q25"), F.median(m).alias("multiplier_median"), F.percentile(m, 0.75).alias("multiplier_q75"), F.max(m).alias("multiplier_max"))


def _whole_protocols(cells: DataFrame, protocol: str, slots: int, prediction: str, outcome: str, null_prediction: str) -> DataFrame:
    """Protocols of exactly ``slots`` cells (its replicates), counted before they are packed in one short array ``_c``."""
    whole = cells.groupBy(protocol).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == slots).select(protocol)
    return cells.join(whole, protocol, "left_semi").groupBy(protocol).agg(F.sort_array(F.collect_list(F.struct(F.col("cell"), F.col(prediction).alias("p"), F.col(null_prediction).alias("z"), F.col(outcome).alias("y")))).alias("_c"))


def _assignments(slots: int) -> list[list[int]]:
    return [list(p) for p in permutations(range(slots))]


def _assigned_metrics(slots: int) -> list[Column]:
    """Metrics of both models when cell i of ``_c`` takes the outcome of cell ``_p[i]``."""
    def mape(field: str) -> Column:
        errs = F.zip_with("_c", "_p", lambda c, j: F.abs(c[field] - F.get(F.col("_c"), j)["y"]) / F.get(F.col("_c"), j)["y"])
        return F.aggregate(errs, F.lit(0.0), lambda s, v: s + v) / slots

    return [mape("p").alias("source_mape"), mape("z").alias("null_mape")]


def assignment_support(cells: DataFrame, protocol: str, *, slots: int, prediction: str, outcome: str, null_prediction: str) -> DataFrame:
    """All slots! assignments of outcomes to cells inside each protocol: metrics of both models per assignment.

    ``excluded_protocols`` reports the protocols that do not hold exactly ``slots`` cells.
    """
    packed = _whole_protocols(cells, protocol, slots, prediction, outcome, null_prediction)
    perms = F.array(*[F.array(*[F.lit(i) for i in p]) for p in _assignments(slots)])
    rows = packed.select(protocol, "_c", F.posexplode(perms).alias("assignment", "_p"))
    return rows.select(protocol, "assignment", *_assigned_metrics(slots)).withColumn("improved", F.col("source_mape") < F.col("null_mape"))


def excluded_protocols(cells: DataFrame, protocol: str, *, slots: int) -> DataFrame:
    """Protocols (null included) that ``assignment_support`` leaves out, with their number of cells."""
    sizes = cells.groupBy(protocol).agg(F.count(F.lit(1)).alias("n_cells"))
    return sizes.filter((F.col("n_cells") != slots) | F.col(protocol).isNull())


def assignment_bounds(support: DataFrame, protocol: str) -> DataFrame:
    """Exact support of every protocol: observed (assignment 0), best and worst."""
    d = F.col("source_mape") - F.col("null_mape")
    return support.groupBy(protocol).agg(
        F.max(F.when(F.col("assignment") == 0, d)).alias("observed_delta"), F.min(d).alias("best_delta"), F.max(d).alias("worst_delta"),
        F.bool_or("improved").alias("can_improve"), F.bool_and("improved").alias("always_improves"))


def joint_assignments(
    cells: DataFrame, protocol: str, *, slots: int, prediction: str, outcome: str, null_prediction: str, draws_: int, seed: str, minimum_gain: float, minimum_protocols: int
) -> DataFrame:
    """Joint random assignments: one hash draw per (draw, protocol), means over protocols, gate verdict.

    A drawn assignment is judged inside the row of its protocol, so the support is neither written out nor joined.
    """
    packed = _whole_protocols(cells, protocol, slots, prediction, outcome, null_prediction)
    drawn = packed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws_ - 1))))
    number = hash_draw(F.lit(math.factorial(slots)), seed, F.col("draw").cast("string"), F.col(protocol).cast("string")).cast("int")
    judged = drawn.withColumn("_p", F.get(F.lit(_assignments(slots)), number)).select("draw", *_assigned_metrics(slots))
    agg = judged.groupBy("draw").agg(
        F.avg(F.col("source_mape") - F.col("null_mape")).alias("delta_mape"), (1.0 - F.avg("source_mape") / F.avg("null_mape")).alias("improvement"),
        F.count(F.when(F.col("source_mape") < F.col("null_mape"), 1)).alias("n_improved"))
    return agg.withColumn("gate_passed", (F.col("improvement") >= minimum_gain) & (F.col("n_improved") >= minimum_protocols))


def permutation_control(
    pool: DataFrame, *, family: str, tie: str, base_score: str, block: Sequence[str], weights: Sequence[float], catastrophic: str, issue_fraction: float, permutations_: int, seed: str
) -> DataFrame:
    """Negative control: within each family, recipients in hash order take the covariate block of donors in
    permuted-hash order; scores are recomputed as base + w . block and the quota is cut again."""
    ids = pool.select(family, tie, base_score, catastrophic, *block)
    recipients = grouped_rank(ids, [family], hash_bucket(tie, 3), [tie], "_pos").select(family, "_pos", tie, base_score, catastrophic)
    perm = ids.select(family, tie, *block).withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(permutations_ - 1)))).withColumn(
        "_h", hash_text(seed, F.col("permutation").cast("string"), F.col(family), F.col(tie))).select(
        family, "permutation", *block, hash_bucket("_h", 3).alias("_range"), F.unhex("_h").alias("_h"))
    donors = grouped_rank(perm, [family, "permutation"], F.col("_range"), ["_h"], "_pos").select(family, "permutation", "_pos", F.struct(*block).alias("_block"))
    # a recipient meets the donors of all permutations in one row
    wide = donors.groupBy(family, "_pos").agg(*[F.max(F.when(F.col("permutation") == k, F.col("_block"))).alias(f"_b{k}") for k in range(permutations_)])

    def score(values: Column) -> Column:
        out = F.col(base_score)
        for b, w in zip(block, weights):
            out = out + F.lit(float(w)) * values[b]
        return out

    scores = F.array(*[score(F.col(f"_b{k}")) for k in range(permutations_)])
    joined = cut_lineage(wide.join(recipients, [family, "_pos"]).select(F.col(tie).alias("_tie"), F.col(catastrophic).cast("double").alias("_c"), scores.alias("_s")))
    # Quantised scores make natural order buckets; equal scores are split by the tie hash.
    cuts = cut_points(ids.withColumn("_s", score(F.struct(*block))), "_s")
    n = pool.agg(F.floor(F.count(F.lit(1)) * F.lit(issue_fraction)).cast("double").alias("_k"), F.avg(F.col(catastrophic).cast("double")).alias("pool_rate")).first()
    rows = joined.select("_tie", "_c", F.posexplode("_s").alias("permutation", "_score")).withColumns({"_t": F.lit(1.0), "_k": F.lit(n["_k"])})
    cut = within_quota(rows.withColumn("_at", F.struct(*cut_bucket("_score", cuts, "_tie"))), "permutation", ["_score", "_tie"])
    return cut.select("permutation", F.col("n").cast("bigint").alias("n_issued"), div("c", "v").alias("issued_rate"), F.lit(n["pool_rate"]).cast("double").alias("pool_rate")).withColumn(
        "risk_reduction", 1.0 - div("issued_rate", "pool_rate"))
