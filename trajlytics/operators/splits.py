"""Leakage-free splits, folds, identity mapping and domain support (survey rows C1-C18)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.functions.columns import attach_one_row, hash_text, is_finite
from trajlytics.plans.joins import asof_join, join_report
from trajlytics.plans.scan import grouped_rank, hash_bucket, null_safe_join, running
from trajlytics.session import cut_lineage


def ranked_groups(df: DataFrame, groups: Sequence[str], seed: int) -> DataFrame:
    """Distinct groups with their one-based rank by seeded hash and the number of groups."""
    hashed = df.select(*groups).distinct().withColumn(
        "_h", hash_text(seed, *[F.col(g).cast("string") for g in groups]))
    ranked = grouped_rank(hashed, [], hash_bucket("_h"), ["_h", *groups], "_rank")
    return attach_one_row(ranked.drop("_h"), hashed.agg(F.count(F.lit(1)).alias("_groups")))


def stable_group_split(
    df: DataFrame, groups: Sequence[str], *, validation_fraction: float = 0.2, test_fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Whole groups to test, validation, train by hash rank; independent of row order."""
    if validation_fraction + test_fraction >= 1:
        raise ValueError("validation and test fractions must leave room for training")

    def share(f: float) -> Column:
        return F.greatest(F.lit(1), F.floor(F.col("_groups") * F.lit(f))) if f else F.lit(0)

    n_test, n_val = share(test_fraction), share(validation_fraction)
    split = (
        F.when(F.col("_rank") <= n_test, "test")
        .when(F.col("_rank") <= n_test + n_val, "validation")
        .otherwise("train")
    )
    assigned = ranked_groups(df, groups, seed).select(*groups, split.alias("split"))
    return null_safe_join(df, assigned, groups)


def explicit_holdout_split(df: DataFrame, column: str, test: Sequence, validation: Sequence = ()) -> DataFrame:
    if set(test) & set(validation):
        raise ValueError("a value cannot be both validation and test")
    return df.withColumn(
        "split",
        F.when(F.col(column).isin(list(test)), "test")
        .when(F.col(column).isin(list(validation)), "validation")
        .otherwise("train"),
    )


def isolation_violations(df: DataFrame, groups: Sequence[str], split: str = "split") -> DataFrame:
    """Groups that occur in more than one split."""
    return df.groupBy(*groups).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def summarize_split(df: DataFrame, groups: Sequence[str], split: str = "split") -> DataFrame:
    counts = df.groupBy(split, *groups).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(split).agg(F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"))


def stable_group_folds(df: DataFrame, group: str, *, n_splits: int = 5, seed: int = 42) -> DataFrame:
    folds = ranked_groups(df, [group], seed).select(
        group, F.pmod(F.col("_rank") - 1, F.lit(n_splits)).alias("fold"))
    return null_safe_join(df, folds, [group])


def condition_profile(obs: DataFrame) -> DataFrame:
    return obs.select("condition_id", "temperature_c", "storage_soc_fraction").distinct()


def scenario_folds(profile: DataFrame, *, fixed: Sequence = (), fixed_name: str = "fixed_holdout") -> DataFrame:
    """Target conditions of each fold: leave one condition out, leave one temperature out, fixed.

    Training rows are *not* written out: they are all conditions outside the fold, so downstream
    sums use total minus held-out instead of a copy of the data per fold.
    """
    parts = [
        profile.select(F.lit("leave_one_condition_out").alias("scenario"),
                       F.col("condition_id").cast("string").alias("fold_id"), "condition_id"),
        profile.select(F.lit("leave_one_temperature_out").alias("scenario"),
                       F.col("temperature_c").cast("string").alias("fold_id"), "condition_id"),
    ]
    if fixed:
        parts.append(profile.filter(F.col("condition_id").isin(list(fixed))).select(
            F.lit("fixed_condition_holdout").alias("scenario"), F.lit(fixed_name).alias("fold_id"), "condition_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fold_statistics(df: DataFrame, entity: str, index: str, value: str, landmarks: Sequence[int]) -> DataFrame:
    """Leave-one-entity-out folds at every landmark: the target's prefix and the others' history.

    One aggregate per entity plus one grand total; history = total minus own, so work is linear
    in the rows however many entities are held out.
    """
    marks = [F.struct(F.lit(int(p)).alias("prefix_cycle"),
                      F.count(F.when(F.col(index) <= p, 1)).alias("prefix_rows"),
                      F.sum(F.when(F.col(index) <= p, F.col(value))).alias("prefix_sum")) for p in landmarks]
    own = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"), F.array(*marks).alias("_marks"))
    total = own.agg(F.sum("_n").alias("_tn"), F.sum("_s").alias("_ts"), F.count(F.lit(1)).alias("_te"))
    return (
        attach_one_row(own, total)
        .select(F.col(entity).alias("held_out"), "_n", "_s", "_tn", "_ts", "_te", F.explode("_marks").alias("m"))
        .select("held_out", "m.prefix_cycle", "m.prefix_rows", "m.prefix_sum",
                (F.col("_te") - 1).alias("history_entities"),
                (F.col("_tn") - F.col("_n")).alias("history_rows"),
                (F.col("_ts") - F.col("_s")).alias("history_sum"))
    )


def fold_table(df: DataFrame, folds: Sequence[tuple], entity: str, index: str) -> DataFrame:
    """Rows of a declared list of folds: prefix of the target, history of all others.

    The output itself holds every row once per fold; for statistics of all entities at once use
    ``fold_statistics``, which does not copy rows.
    """
    entries = F.array(*[F.struct(F.lit(h).alias("held_out"), F.lit(int(p)).alias("prefix_cycle")) for h, p in folds])
    own = F.col(entity) == F.col("held_out")
    return (
        df.select("*", F.explode(entries).alias("_f")).select("*", "_f.*").drop("_f")
        .filter(~own | (F.col(index) <= F.col("prefix_cycle")))
        .withColumn("row_role", F.when(own, "target_prefix").otherwise("training_history"))
    )


def nested_reference_partition(
    df: DataFrame, *, domain: str, entity: str, max_k: int, repeats: int, seed: int
) -> DataFrame:
    """Per (domain, repeat): hash order of entities; the first ``max_k`` are references, the rest
    are the common query. Entities of a domain too small for one query have the role too_small."""
    ids = df.select(domain, entity).distinct()
    rep = ids.withColumn("repeat_index", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn(
        "_h", hash_text(seed, F.col(domain).cast("string"), F.col("repeat_index").cast("string"), F.col(entity).cast("string")))
    ranked = running(
        rep, [domain, "repeat_index"], hash_bucket("_h", 3), ["_h", entity],
        {"reference_rank": ("count", F.lit(1)), "_n": ("total_sum", F.lit(1))},
    )
    role = F.when(F.col("_n") <= max_k, "too_small").when(F.col("reference_rank") <= max_k, "reference").otherwise("query")
    return ranked.select(domain, "repeat_index", entity, "reference_rank", role.alias("role"))


def k_shot_support(df: DataFrame, *, domain: str, entity: str, ks: Sequence[int], min_query: int, min_domains: int) -> DataFrame:
    sizes = df.groupBy(domain).agg(F.countDistinct(entity).alias("_n"))
    fits = F.col("_n") >= F.col("k") + min_query
    return (
        sizes.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in sorted(ks)])))
        .groupBy("k")
        .agg(
            F.count(F.when(fits, 1)).alias("eligible_domains"),
            F.coalesce(F.sum(F.when(fits, F.col("_n"))), F.lit(0)).alias("eligible_cells"),
            F.coalesce(F.sum(F.when(fits, F.col("_n") - F.col("k"))), F.lit(0)).alias("query_cells"),
            F.count(F.when(~fits, 1)).alias("excluded_domains"),
        )
        .withColumn("status", F.when(F.col("eligible_domains") >= min_domains, "passed").otherwise("failed"))
    )


def domain_size_histogram(df: DataFrame, *, domain: str, entity: str) -> DataFrame:
    return (
        df.groupBy(domain).agg(F.countDistinct(entity).alias("domain_size"))
        .groupBy("domain_size").agg(F.count(F.lit(1)).alias("n_domains"))
    )


def crosswalk_join(source: DataFrame, crosswalk: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Many-to-one identity join and its report (unmatched and repeated crosswalk keys)."""
    report = join_report(source, crosswalk, on).filter("issue <> 'duplicate_left'")
    return source.join(crosswalk, list(on)), report


def authoritative_labels(metadata: DataFrame, labels: DataFrame, key: str, fallback: dict[str, str], reason: Column) -> DataFrame:
    """Left join of labels; ``fallback`` maps a label column to the metadata column that fills it."""
    joined = metadata.join(labels.withColumn("official_cohort", F.lit(True)), key, "left")
    official = F.coalesce("official_cohort", F.lit(False))
    out = joined.withColumn("official_cohort", official)
    for target, source in fallback.items():
        out = out.withColumn(target, F.coalesce(F.col(target), F.col(source)))
    return out.withColumn("exclusion_reason", F.when(~official, reason))


def composite_key(*cols: str | Column) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def metadata_audit(metadata: DataFrame, by: Sequence[str], label: str, source_label: str) -> DataFrame:
    delta = F.col(label) - F.col(source_label)
    return metadata.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.countDistinct("protocol_id").alias("n_protocols"),
        F.min(label).alias("life_min"), F.max(label).alias("life_max"),
        F.count(F.when(delta != 0, 1)).alias("n_label_differences"),
        F.max(F.abs(delta)).alias("max_label_difference"),
    )


def file_pairs(files: DataFrame, path: str, pattern: str, kinds: Sequence[str]) -> DataFrame:
    """Stems by regex group 1, kind by group 2: which kinds exist, which are missing."""
    parsed = files.select(
        F.regexp_extract(path, pattern, 1).alias("stem"), F.regexp_extract(path, pattern, 2).alias("kind"))
    flags = [F.max((F.col("kind") == k).cast("int")).alias(f"_{k}") for k in kinds]
    agg = parsed.filter("stem <> ''").groupBy("stem").agg(F.count(F.lit(1)).alias("n_files"), *flags)
    missing = F.array_compact(F.array(*[F.when(F.col(f"_{k}") == 0, F.lit(k)) for k in kinds]))
    return agg.select("stem", "n_files", F.array_join(missing, ";").alias("missing"), (F.size(missing) == 0).alias("complete"))


def support_classes(profile: DataFrame) -> DataFrame:
    """Leave-one-condition-out support of every condition against all the others' stress range.

    Range without the own condition comes from the two extreme levels and their counts. An unknown stress is in no range and
    at no seen level; its condition stays.
    """
    out = profile
    for c, short in [("temperature_c", "t"), ("storage_soc_fraction", "s")]:
        levels = profile.groupBy(c).agg(F.count(F.lit(1)).alias(f"_n{short}"))
        ends = levels.agg(F.min(c).alias("_a"), F.max(c).alias("_b"))
        wide = attach_one_row(levels, ends).agg(
            F.max("_a").alias(f"_{short}lo"), F.max("_b").alias(f"_{short}hi"),
            F.min(F.when(F.col(c) > F.col("_a"), F.col(c))).alias(f"_{short}lo2"),
            F.max(F.when(F.col(c) < F.col("_b"), F.col(c))).alias(f"_{short}hi2"),
        )
        out = attach_one_row(null_safe_join(out, levels, [c]), wide)
        seen = (F.col(f"_n{short}") > 1) & F.col(c).isNotNull()
        lo = F.when((F.col(c) > F.col(f"_{short}lo")) | seen, F.col(f"_{short}lo")).otherwise(F.col(f"_{short}lo2"))
        hi = F.when((F.col(c) < F.col(f"_{short}hi")) | seen, F.col(f"_{short}hi")).otherwise(F.col(f"_{short}hi2"))
        name = "temperature" if short == "t" else "soc"
        out = out.withColumn(f"{name}_in_range", F.coalesce(F.col(c).between(lo, hi), F.lit(False))).withColumn(
            f"{name}_level_seen", seen)
    t, s = F.col("temperature_in_range"), F.col("soc_in_range")
    cls = (
        F.when(t & s, "stress_covariate_interpolation").when(t, "soc_range_extrapolation")
        .when(s, "temperature_range_extrapolation").otherwise("temperature_and_soc_range_extrapolation")
    )
    return out.select("condition_id", "temperature_c", "storage_soc_fraction", "temperature_in_range", "soc_in_range",
                      "temperature_level_seen", "soc_level_seen", cls.alias("support_class"))


def _hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull vertices of 2-D points."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def turn(a, b, p):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(list(pts)) + chain(list(pts[::-1])))


#: Partial hulls are merged so many at a time, from at most so many.
HULL_FAN, HULL_PARTS = 8, 512


def hull_vertices(points: DataFrame, x: str, y: str) -> DataFrame:
    """Convex hull (x, y, pos counter-clockwise) as a tree: a hull per partition, then hulls of HULL_FAN partial hulls at a time.

    Only vertices are shuffled. Points with a coordinate that is null, NaN or infinite take no part."""
    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.empty((0, 2))
        for b in batches:
            kept = _hull(np.vstack([kept, b[["x", "y"]].to_numpy(dtype=float)]))
        if len(kept):
            yield pd.DataFrame({"x": kept[:, 0], "y": kept[:, 1]})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        kept = _hull(group[["x", "y"]].to_numpy(dtype=float))
        return pd.DataFrame({"part": int(group["part"].iloc[0]) // HULL_FAN, "x": kept[:, 0], "y": kept[:, 1], "pos": np.arange(len(kept))})

    usable = points.filter(is_finite(x) & is_finite(y)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    found = usable.mapInPandas(local, "x double, y double").withColumn("part", F.spark_partition_id() % HULL_PARTS)
    parts = HULL_PARTS
    while parts > 1:
        parts = -(-parts // HULL_FAN)
        found = found.withColumn("_group", F.floor(F.col("part") / HULL_FAN)).groupBy("_group").applyInPandas(merged, "part long, x double, y double, pos long")
    return found.select("x", "y", "pos")


def _bisect(values: Column, at: Column) -> Column:
    """Number of entries of a rising array that are at most `at`, by halving."""
    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
        left = F.get(values, middle) > at
        inside = span["lo"] < span["hi"]
        return F.struct(F.when(inside & ~left, middle + 1).otherwise(span["lo"]).alias("lo"), F.when(inside & left, middle).otherwise(span["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi")), halve, lambda span: span["lo"])


def in_convex_hull(targets: DataFrame, points: DataFrame, x: str, y: str, tol: float = 1e-10) -> DataFrame:
    """Membership of each target in the hull of ``points``: the hull travels as one row of two chains (below and above, rising in
    x), and a target is held against the one edge of each chain that stands over its x. Targets with an unknown coordinate, and
    all targets where no point is usable, are outside."""
    ring = hull_vertices(points, x, y)
    vertex = F.struct("x", "y")
    ends = ring.agg(F.min(vertex).alias("_first"), F.max(vertex).alias("_last"))
    side = attach_one_row(ring, ends)
    turn = (F.col("_last.x") - F.col("_first.x")) * (F.col("y") - F.col("_first.y")) - (F.col("_last.y") - F.col("_first.y")) * (F.col("x") - F.col("_first.x"))
    chains = side.agg(
        F.sort_array(F.collect_list(F.when(turn <= 0, vertex))).alias("_below"), F.sort_array(F.collect_list(F.when(turn >= 0, vertex))).alias("_above"),
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")

    def beyond(chain: str) -> Column:
        """Cross product of the edge over the target with the target: zero on it, positive above it."""
        n = F.size(chain)
        k = F.greatest(F.least(_bisect(F.transform(chain, lambda v: v["x"]), px), n - 1), F.lit(1))
        a, b = F.get(chain, k - 1), F.get(chain, k)
        return (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])

    flat = F.size("_below") < 2
    box = (px >= F.col("_x0") - tol) & (px <= F.col("_x1") + tol) & (py >= F.col("_y0") - tol) & (py <= F.col("_y1") + tol)
    inside = box & F.when(flat, True).otherwise((beyond("_below") >= -tol) & (beyond("_above") <= tol))
    return attach_one_row(targets, chains).withColumn("in_hull", F.coalesce(inside, F.lit(False))).drop("_below", "_above", "_x0", "_x1", "_y0", "_y1")


def local_slice_reference(
    targets: DataFrame, references: DataFrame, *, point_margin: float, step_margin: float
) -> DataFrame:
    """Expected prefix of each target from the nearest references on the same stress slice.

    Both tables: temperature_c, storage_soc_fraction, prefix array<double>; targets also
    request_id; references are unique per coordinate. Mode: exact, then interpolation along SOC
    at equal temperature, then along temperature at equal SOC. Neighbours are as-of lookups.
    """
    key = lambda c: F.round(F.col(c) * 1e9).cast("bigint")
    # both tables are read by every lookup below: the request list and the reference grid are written once
    targets, references = cut_lineage(targets), cut_lineage(references)
    ref = references.select(key("temperature_c").alias("_kt"), key("storage_soc_fraction").alias("_ks"),
                            F.col("temperature_c").alias("_t0"), F.col("storage_soc_fraction").alias("_s0"),
                            F.col("prefix").alias("_p"))
    out = targets.withColumns({"_kt": key("temperature_c"), "_ks": key("storage_soc_fraction")})
    prefix_at = ref.select("_kt", "_ks", "_p")
    out = out.join(prefix_at.withColumnRenamed("_p", "_exact"), ["_kt", "_ks"], "left")
    # Neighbour coordinates are looked up on (id, coordinates) only; prefixes follow by equality joins.
    slim = out.select("request_id", "_kt", "_ks")
    for slice_key, axis, level, tag in [("_kt", "_ks", "_s0", "s"), ("_ks", "_kt", "_t0", "t")]:
        for side, sign in [("lo", 1), ("hi", -1)]:
            known = ref.select(slice_key, (F.col(axis) * sign).alias("_axis"), F.col(level).alias(f"_{tag}{side}"), F.col(axis).alias("_hit"))
            hit = asof_join(
                slim.select("request_id", slice_key, (F.col(axis) * sign).alias("_a")), known, keys=[slice_key], left_on="_a", right_on="_axis",
                values=[f"_{tag}{side}", "_hit"], bucket=F.floor(F.col("_t") / 10**9), strict=True)
            near = hit.join(prefix_at.withColumnsRenamed({axis: "_hit", "_p": f"_{tag}{side}p"}), [slice_key, "_hit"], "left")
            out = out.join(near.select("request_id", f"_{tag}{side}", f"_{tag}{side}p"), "request_id", "left")

    def between(tag: str, at: str) -> Column:
        w = (F.col(at) - F.col(f"_{tag}lo")) / (F.col(f"_{tag}hi") - F.col(f"_{tag}lo"))
        return F.when(
            F.col(f"_{tag}lo").isNotNull() & F.col(f"_{tag}hi").isNotNull(),
            F.zip_with(f"_{tag}lop", f"_{tag}hip", lambda a, b: a + w * (b - a)))

    by_soc, by_temp = between("s", "storage_soc_fraction"), between("t", "temperature_c")
    expected = F.coalesce(F.col("_exact"), by_soc, by_temp)
    mode = (
        F.when(F.col("_exact").isNotNull(), "exact_reference_condition")
        .when(by_soc.isNotNull(), "same_temperature_soc_interpolation")
        .when(by_temp.isNotNull(), "same_soc_temperature_interpolation").otherwise("unavailable")
    )
    resid = F.zip_with("prefix", "_e", lambda a, b: a - b)
    scored = out.withColumn("_e", expected).withColumn("reference_mode", mode).withColumn("_r", resid)
    steps = F.zip_with(F.slice("_r", F.lit(2), F.size("_r")), F.expr("slice(_r, 1, greatest(size(_r) - 1, 0))"), lambda b, a: F.abs(b - a))
    scored = scored.withColumns({
        "max_point_deviation": F.array_max(F.transform("_r", lambda v: F.abs(v))),
        "max_step_deviation": F.array_max(steps),
    })
    ok = (F.col("max_point_deviation") <= point_margin + 1e-12) & (F.col("max_step_deviation") <= step_margin + 1e-12)
    return scored.select("request_id", "reference_mode", "max_point_deviation", "max_step_deviation",
                         F.coalesce(ok, F.lit(False)).alias("prefix_supported"))
