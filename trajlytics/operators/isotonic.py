"""Isotonic calibration by pooling adjacent violators in range partitions (survey row F11).

Pooling two neighbours whose means are in the wrong order is right in any sequence, so every partition pools what it holds and
passes its blocks on. A pass over other cut points pools across the old ones; passes end when the last block of each partition
is not above the first one of the next. Neither the levels nor the blocks ever meet in one place, only two blocks a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlytics.functions.columns import clip, is_finite
from trajlytics.plans.joins import asof_join
from trajlytics.plans.scan import previous, value_bucket
from trajlytics.session import cut_lineage

#: Blocks a partition holds while it pools.
PARTITION_BLOCKS = 200_000
MAX_PASSES = 64


def _pooled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks (lo, hi, w, s) of a partition in order of lo: neighbours with falling means are one block."""
    stack: list[list[float]] = []
    for b in batches:
        for lo, hi, w, s in zip(b["lo"], b["hi"], b["w"], b["s"]):
            block = [lo, hi, w, s]
            while stack and stack[-1][3] * block[2] >= block[3] * stack[-1][2]:  # mean before >= mean here
                left = stack.pop()
                block = [left[0], block[1], left[2] + block[2], left[3] + block[3]]
            stack.append(block)
    if stack:
        yield pd.DataFrame(stack, columns=["lo", "hi", "w", "s"])


def isotonic_blocks(df: DataFrame, score: str, label: str, weight: str | None = None, *, partition_blocks: int = PARTITION_BLOCKS) -> DataFrame:
    """Blocks of the non-decreasing fit of label on score: lo and hi (scores), weight and mean, in rising order.

    Rows with a score or label that is null, NaN or infinite take no part; equal scores are one level. An empty table has no
    blocks.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    used = df.filter(is_finite(score) & is_finite(label)).select(F.col(score).cast("double").alias("lo"), w.alias("w"), (w * F.col(label).cast("double")).alias("s"))
    blocks = cut_lineage(used.groupBy("lo").agg(F.col("lo").alias("hi"), F.sum("w").alias("w"), F.sum("s").alias("s")))
    for k in range(MAX_PASSES):
        parts = -(-blocks.count() // partition_blocks)
        parts = parts + k % 2 if parts > 1 else 1  # every second pass has other cut points
        dealt = blocks.repartitionByRange(parts, "lo").sortWithinPartitions("lo")
        pooled = dealt.mapInPandas(_pooled, "lo double, hi double, w double, s double")
        blocks = cut_lineage(pooled.withColumn("part", F.spark_partition_id()))
        if parts == 1:
            break
        mean = F.struct("w", "s")
        edges = blocks.groupBy("part").agg(F.min("lo").alias("lo"), F.min_by(mean, "lo").alias("first"), F.max_by(mean, "lo").alias("last")).orderBy("lo").collect()  # a row a partition
        if all(a["last"]["s"] * b["first"]["w"] < b["first"]["s"] * a["last"]["w"] for a, b in zip(edges, edges[1:])):
            break
        blocks = blocks.drop("part")
    else:
        raise RuntimeError(f"blocks did not settle in {MAX_PASSES} passes")
    return blocks.select("lo", "hi", F.col("w").alias("weight"), (F.col("s") / F.col("w")).alias("mean"))


def calibrated(df: DataFrame, blocks: DataFrame, score: str, name: str = "calibrated_probability", *, bounds: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """df with the fitted value of its scores: the mean of the block that holds it, straight lines between blocks, constant
    beyond the first and last one, clipped to the bounds; null where the score is null, NaN or infinite."""
    after = previous(blocks, [], value_bucket(-F.col("lo")), [-F.col("lo")], {"next_lo": "lo", "next_mean": "mean"})
    scores = df.select(F.col(score).cast("double").alias("_score")).filter(is_finite("_score")).distinct()
    first = blocks.agg(F.min_by("mean", "lo").alias("_first"))
    met = asof_join(scores, after, keys=[], left_on="_score", right_on="lo", values=["hi", "mean", "next_lo", "next_mean"], bucket=value_bucket("_t"))
    share = (F.col("_score") - F.col("hi")) / (F.col("next_lo") - F.col("hi"))
    between = F.col("mean") + share * (F.col("next_mean") - F.col("mean"))
    value = F.when((F.col("_score") <= F.col("hi")) | F.col("next_lo").isNull(), F.col("mean")).otherwise(between)
    valued = met.withColumn("_first", first.select("_first").scalar())
    found = valued.select("_score", clip(F.coalesce(value, "_first"), *bounds).alias(name))
    return df.join(found, F.col(score).cast("double") == F.col("_score"), "left").drop("_score")


def isotonic_probability(df: DataFrame, score: str, label: str, *, partition_blocks: int = PARTITION_BLOCKS) -> DataFrame:
    """Isotonic calibration of a score on its own rows."""
    return calibrated(df, isotonic_blocks(df, score, label, partition_blocks=partition_blocks), score)
