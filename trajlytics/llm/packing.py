"""Conflict-constrained best-fit packing: bins are ordered by residual space and carry bitmaps of the sources they are closed
to and of the duplicate clusters they hold; the search goes from the piece's size to the next larger residual until the
tightest compatible bin is found.

Only sizes, sources and clusters are shuffled, never texts. Pieces are dealt to blocks of bounded size by a salted hash, and
each block is packed on its own, so a source or cluster with a third of all rows is spread over all blocks.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.llm.common import n_words, staged

CAPACITY = 2048
PER_SOURCE = 2
BLOCK = 8192
PACKED = "bin_id long, doc_id long, piece int, first_token long, n_tokens int, bin_offset int, source string, cluster long"


def normal_hash(text: Column) -> Column:
    """Exact-copy cluster of a text: 64-bit hash of its words, letter case and blanks aside."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+", " ")))


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """sized (doc_id, tokens, source, cluster) cut into pieces of at most capacity tokens; every row has a last piece."""
    last = F.greatest(F.ceil(F.col("tokens") / capacity).cast("int") - 1, F.lit(0))
    cut = sized.withColumns({"last": last, "salt": F.monotonically_increasing_id()})
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), "last")))
    first = F.col("piece").cast("long") * capacity
    size = F.least(F.col("tokens") - first, F.lit(capacity)).cast("int")
    return cut.select("doc_id", "piece", first.alias("first_token"), size.alias("n_tokens"), "source", "cluster", "salt")


def best_fit(sizes: Iterable[int], sources: Iterable[int], clusters: Iterable[int], capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, taken in the given order; sources and clusters are small numbers from 0."""
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has residual r
    closed: list[int] = []  # bitmap of sources, by bin
    holds: list[int] = []  # bitmap of clusters, by bin
    from_source: dict[tuple[int, int], int] = {}
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        source_bit, cluster_bit = 1 << source, 1 << cluster
        residual, chosen = size, -1
        successors = open_ >> size
        while successors and chosen < 0:
            step = (successors & -successors).bit_length() - 1
            residual += step
            for place, b in enumerate(by_residual[residual]):
                if not (closed[b] & source_bit or holds[b] & cluster_bit):
                    chosen = b
                    del by_residual[residual][place]
                    if not by_residual[residual]:
                        open_ ^= 1 << residual
                    break
            successors >>= step + 1
            residual += 1
        if chosen < 0:
            chosen, residual = len(closed), capacity
            closed.append(0)
            holds.append(0)
        else:
            residual -= 1
        holds[chosen] |= cluster_bit
        count = from_source[chosen, source] = from_source.get((chosen, source), 0) + 1
        if count >= per_source:
            closed[chosen] |= source_bit
        bins.append(chosen)
        offsets.append(capacity - residual)
        left = residual - size
        if left:
            by_residual[left].append(chosen)
            open_ |= 1 << left
    return bins, offsets


def pack_sizes(sized: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, block: int = BLOCK) -> DataFrame:
    """Pack rows of (doc_id, tokens, source, cluster): no bin holds two pieces of one cluster, more than per_source pieces of
    one source, or more than capacity tokens. Pieces of one document belong to one cluster."""
    cut = staged(pieces(sized, capacity), "pieces")
    n_blocks = max(1, -(-cut.count() // block))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(n_blocks)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        table = table.sort_by([("n_tokens", "descending"), ("cluster", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("salt", "ascending")])
        codes = {}
        for c in ("source", "cluster"):
            indices = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1)
            codes[c] = np.unique(indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].tolist()
        bins, offsets = best_fit(table.column("n_tokens").to_pylist(), codes["source"], codes["cluster"], capacity, per_source)
        columns = {c: table.column(c) for c in ("doc_id", "piece", "first_token", "n_tokens", "source", "cluster")}
        columns["bin_id"] = pa.array((np.int64(number) << 32) + np.array(bins, np.int64))
        columns["bin_offset"] = pa.array(offsets, pa.int32())
        return pa.table({name: columns[name] for name in (f.split()[0] for f in PACKED.split(", "))})

    return dealt.groupBy("block").applyInArrow(pack, PACKED)


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None,
) -> DataFrame:
    """One row per piece of every document: its bin, the place in the bin and the tokens it covers.

    A document has one token per word and one that ends it, so null and empty texts are pieces of one token. Longer
    documents are cut every capacity tokens. Copies of a text (or equal values of cluster) never share a bin; a null source
    counts as one source. Ties go to the smaller cluster, doc_id, piece; repeated rows are copies. An empty table gives no rows.
    """
    sized = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (n_words(docs[text_col]) + 1).alias("tokens"),
        docs[source_col].cast("string").alias("source"),
        (normal_hash(docs[text_col]) if cluster is None else cluster.cast("long")).alias("cluster"),
    )
    return pack_sizes(sized, capacity, per_source, block)


def packed_texts(packed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bin_id and the words of each bin in order, joined by spaces, for documents with unique ids."""
    flat = F.trim(F.regexp_replace(docs[text_col], "[\\x20\\x09-\\x0D]+", " "))
    texts = docs.select(docs[id_col].cast("long").alias("__id"), F.split(flat, " ").alias("__words"))
    joined = packed.join(texts, F.col("doc_id") == F.col("__id"), "left")
    part = F.array_join(F.slice(F.coalesce("__words", F.array().cast("array<string>")), F.col("first_token").cast("int") + 1, F.col("n_tokens")), " ")
    parts = joined.groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("bin_offset", part.alias("part")))).alias("parts"))
    return parts.select("bin_id", F.array_join(F.col("parts.part"), "\n").alias("text"))
