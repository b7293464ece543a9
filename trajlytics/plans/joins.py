"""Joins with declared cardinality, as-of lookups and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlytics.plans.scan import running


class CardinalityError(ValueError):
    """Raised when a join side breaks its declared cardinality."""


def duplicate_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def join_report(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row per key that breaks a one-to-one match: its issue and row counts on both sides.

    Both sides are reduced to key counts first, so a hot key is one row by the time of the join.
    """
    on = list(on)
    lc = left.groupBy(*on).agg(F.count(F.lit(1)).alias("left_rows"))
    rc = right.groupBy(*on).agg(F.count(F.lit(1)).alias("right_rows"))
    both = lc.join(rc, on, "full_outer").na.fill(0, ["left_rows", "right_rows"])
    issue = (
        F.when(F.col("right_rows") == 0, "missing_right")
        .when(F.col("left_rows") == 0, "missing_left")
        .when((F.col("left_rows") > 1) & (F.col("right_rows") > 1), "duplicate_both")
        .when(F.col("right_rows") > 1, "duplicate_right")
        .when(F.col("left_rows") > 1, "duplicate_left")
    )
    return both.withColumn("issue", issue).filter("issue is not null")


def checked_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    how: str = "inner",
    validate: str = "m:1",
    require_match: bool = False,
) -> DataFrame:
    """Join that fails instead of multiplying rows.

    The check rides in the join itself: the "one" sides are grouped to one row per key and the
    group size is asserted when the row is produced, so no extra action runs.
    """
    on = list(on)

    def single(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in on]
        grouped = df.groupBy(*on).agg(
            F.count(F.lit(1)).alias("_rows"),
            F.any_value(F.struct(*rest) if rest else F.lit(1)).alias("_row"),
        )
        ok = F.when(F.col("_rows") == 1, F.col("_row")).otherwise(
            F.raise_error(F.lit(f"{side} side of a {validate} join repeats a key"))
        )
        kept = grouped.withColumn("_row", ok)
        return kept.select(*on, *[F.col("_row")[c].alias(c) for c in rest])

    one_left, one_right = validate.split(":")
    lhs = single(left, "left") if one_left == "1" else left
    rhs = single(right, "right") if one_right == "1" else right
    if not require_match:
        return lhs.join(rhs, on, how)
    joined = lhs.join(rhs.withColumn("_hit", F.lit(True)), on, "left")
    hit = F.when(F.col("_hit"), F.lit(True)).otherwise(
        F.raise_error(F.lit("unmatched key in a join that requires a match")).cast("boolean")
    )
    return joined.filter(hit).drop("_hit")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str],
    left_on: str,
    right_on: str,
    values: Sequence[str],
    bucket,
    strict: bool = False,
) -> DataFrame:
    """For each left row the values of the last right row at or before (``strict``: before) it.

    Both sides are stacked and scanned once in order; there is no inequality join. ``bucket``
    maps the order column (given as ``_t``) to a non-decreasing bucket.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(v) for v in values])
    side = 0 if strict else 2
    lhs = left.select(
        *keys, F.col(left_on).alias("_t"), F.lit(side if strict else 2).alias("_side"),
        F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(payload).schema[0].dataType).alias("_right"),
    )
    rhs = right.select(
        *keys, F.col(right_on).alias("_t"), F.lit(1).alias("_side"),
        F.lit(None).cast(lhs.schema["_left"].dataType).alias("_left"), payload.alias("_right"),
    )
    scanned = running(lhs.unionByName(rhs), keys, bucket, ["_t", "_side"], {"_hit": ("last", "_right")})
    return scanned.filter(F.col("_left").isNotNull()).select(
        "_left.*", *[F.col("_hit")[v].alias(v) for v in values]
    )
