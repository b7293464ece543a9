"""Two-pass external shuffle: records are scattered into memory-sized buckets by seeded hashes, each bucket gets a
Fisher-Yates shuffle, and the shards are written."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from trajlytics.llm.common import set_aside

ADDED = ("shard", "grown_shard", "bucket", "in_bucket", "size")
BUCKET_BYTES = 32 << 20


def key_shard(key: Column, n_shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard whose seeded hash of the key is largest (ties: the higher number).
    Key and shard count alone decide, and one more shard takes rows only into itself."""
    bids = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(k)).alias("bid"), F.lit(k).alias("shard")) for k in range(n_shards)]
    return (F.greatest(*bids) if n_shards > 1 else bids[0])["shard"]


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shuffle_to_shards(
    docs: DataFrame, path: str, n_shards: int = 24, seed: int = 17, bucket_bytes: int = BUCKET_BYTES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write all columns of docs as Parquet under path/shard=N in a uniformly random order and return what was written,
    with shard, slot (gapless from 0 within a shard) and grown_shard (the shard if there were one more).

    Pass one scatters by (shard, bucket): the number of buckets follows the bytes of each shard, so a bucket fits a task's
    memory at any size, and a row number salts the bucket hash, so an id that fills a third of the rows spreads over
    its shard's buckets. Pass two permutes each bucket with a generator seeded by (seed, bucket). Only one row per
    shard reaches the driver. Null ids count as one key; null and empty texts keep their rows; an empty table writes
    nothing and returns no rows; input columns named like an added one come back as <name>_in.
    """
    spark = docs.sparkSession
    docs = set_aside(docs, (*ADDED, "slot", "__salt"))
    own = docs.columns
    sized = docs.withColumns(
        {
            "shard": key_shard(docs[id_col], n_shards, seed),
            "grown_shard": key_shard(docs[id_col], n_shards + 1, seed),
            "size": record_size(docs[text_col]),
            "__salt": F.monotonically_increasing_id(),
        }
    )
    totals = {r["shard"]: r["total"] for r in sized.groupBy("shard").agg(F.sum("size").alias("total")).collect()}
    counts = [max(1, -(-totals.get(k, 0) // bucket_bytes)) for k in range(n_shards)]
    firsts = [sum(counts[:k]) for k in range(n_shards)]
    n_buckets = F.element_at(F.array(*map(F.lit, counts)), F.col("shard") + 1)
    first = F.element_at(F.array(*map(F.lit, firsts)), F.col("shard") + 1)
    scattered = sized.withColumn("bucket", (first + F.pmod(F.xxhash64(id_col, "__salt", F.lit(seed)), n_buckets)).cast("int"))
    extra = {"shard": IntegerType(), "grown_shard": IntegerType(), "size": LongType(), "bucket": IntegerType(), "in_bucket": LongType()}
    schema = StructType([*docs.schema.fields, *[StructField(n, t) for n, t in extra.items()]])

    def fisher_yates(bucket: pa.Table) -> pa.Table:
        number = bucket.column("bucket")[0].as_py()
        bucket = bucket.take(pc.sort_indices(bucket, [("__salt", "ascending")]))  # whatever order the shuffle delivered
        order = np.random.default_rng([seed, number]).permutation(bucket.num_rows)
        shuffled = bucket.take(pa.array(order)).append_column("in_bucket", pa.array(np.arange(bucket.num_rows, dtype="int64")))
        return shuffled.select([f.name for f in schema.fields])

    scattered.groupBy("bucket").applyInArrow(fisher_yates, schema).write.partitionBy("shard").parquet(path)
    written = spark.read.schema(schema).parquet(path)
    sizes = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("shard").alias("__s"), F.col("bucket").alias("__b"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__start")
    )
    joined = written.join(starts, (F.col("shard") == F.col("__s")) & (F.col("bucket") == F.col("__b")))
    return joined.select(*own, "shard", (F.col("__start") + F.col("in_bucket")).alias("slot"), "grown_shard", "size")
