"""Near copies for the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts meet in equal min-hash bands of their shingles. Inside a band the pivot tables of `simhash` discard pairs whose
five-word fingerprints are over MAX_BITS apart; what survives is joined to candidate classes, in which the exact Jaccard
similarity decides each link. Block keys as in `simhash.links` do not serve here: pairs of similarity 0.8 are about ten bits
apart, and at the radius that holds them a choice of bit blocks is a few bits long and separates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlytics.llm.common import small_side, staged
from trajlytics.llm.simhash import components, in_tiles, links_in_keys, majority, shingle_digests

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
MAX_BITS = 20
#: A candidate class with more texts than this is verified in pairs of chunks, each pair a task of its own.
CHUNK = 512
#: Shingles, or shared shingles, worked on at once.
SLICE = 1 << 12
PRINTS = "doc_id long, text_hash long, node long, fp long, bands array<long>"


def multipliers() -> np.ndarray:
    return np.random.default_rng(21).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One key for each band of ROWS minima."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(hashes), SLICE):
            least = np.minimum(least, (hashes[None, a : a + SLICE] * factors).min(axis=1))
        mixed = (least ^ (least >> np.uint64(32))) * factors[:, 0]
        return (mixed ^ (mixed >> np.uint64(29))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, hash of the text, node (hash of its lower-cased words), five-word fingerprint and band keys.
    Texts without words are copies of each other and have no bands."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers()
        for batch in batches:
            nodes, prints, keys = [], [], []
            for t in batch.column(2):
                tokens = (t.as_py() or b"").lower().split()
                digests = shingle_digests(tokens, SHINGLE)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(tokens)) - (1 << 63))
                prints.append(majority(digests))
                keys.append(band_keys(np.frombuffer(digests, ">u8").astype(np.uint64), factors).tolist() if tokens else [])
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            made = [pa.array(v, t) for v, t in zip((nodes, prints, keys), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "text_hash", "node", "fp", "bands"])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].cast("binary").alias("text"))
    return picked.mapInArrow(rows, PRINTS)


def verified(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first set of each one's class; sets are linked where their exact Jaccard similarity reaches the bound."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    owner = owner[np.argsort(shingle, kind="stable")]
    times = np.bincount(shingle)
    first = np.cumsum(times) - times
    root, edges = np.full(n, -1), np.cumsum(sizes)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed], waiting = seed, [seed]
        while waiting:
            k = waiting.pop()
            own = shingle[edges[k] - sizes[k] : edges[k]]
            shared = np.zeros(n, np.int64)
            for a in range(0, len(own), SLICE):
                part = own[a : a + SLICE]
                t = times[part]
                shared += np.bincount(owner[np.repeat(first[part] - np.cumsum(t) + t, t) + np.arange(t.sum())], minlength=n)
            near = np.flatnonzero((shared >= similarity * (sizes + sizes[k] - shared)) & (root < 0))
            root[near] = seed
            waiting += near.tolist()
    return root


def shingle_sets(texts: DataFrame) -> DataFrame:
    """root, node and the distinct five-word shingles of each text (root, node, text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.frombuffer(shingle_digests(t.as_py().lower().split(), SHINGLE), np.int64)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["root", "node", "shingles"])

    return texts.select("root", "node", "text").mapInArrow(hashed, "root long, node long, shingles array<long>")


def verified_links(sets: DataFrame, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) of texts (root, node, shingles) of one candidate class whose components are those of all similar pairs."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(held: dict[int, np.ndarray]) -> pa.RecordBatch:
            nodes = np.array([*held], np.int64)
            root = verified([*held.values()], similarity)
            away = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[root[away]])], ["a", "b"])

        place, held = None, {}  # a tile may go on in the next batch
        for batch in batches:
            for *here, node, shingles in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                if here != place:
                    if len(held) > 1:
                        yield linked(held)
                    place, held = here, {}
                held[node] = shingles.values.to_numpy()
        if len(held) > 1:
            yield linked(held)

    place = ["root", "t0", "t1"]
    dealt = in_tiles(sets, ["root"], "node", chunk).repartition(*place).sortWithinPartitions(*place).select(*place, "node", "shingles")
    return dealt.mapInArrow(link, "a long, b long").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component of near copies: the smallest doc_id (null last, ties by text hash, repeated
    rows once). Copies but for letter case and blanks are near copies of any length, and so are texts without words, null or
    empty. An empty table gives no rows; columns come back as they were, whatever their names."""
    columns = docs.columns
    inside = docs.select(
        *[docs[c].alias(f"__c{k}") for k, c in enumerate(columns)],
        F.struct(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash")).alias("__key"),
    )  # a struct is equal to itself where the id is null
    text = F.col(f"__c{columns.index(text_col)}")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_hash"))
    prints = sketches(docs, id_col, text_col).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"), *[F.first(c).alias(c) for c in ("node", "fp", "bands")])
    prints = staged(prints, "prints")
    nodes = staged(prints.groupBy("node").agg(F.min(rank).alias("lead"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    keyed = nodes.select("fp", "node", F.posexplode("bands").alias("mask", "key")).withColumn("mask", F.col("mask").cast("short"))
    rooted = components(links_in_keys(keyed, MAX_BITS))
    classes = rooted.union(rooted.select("root", "root").distinct())  # a root is a member too
    lead = F.struct("lead.doc_id", "lead.text_hash").alias("__lead")
    members = staged(nodes.join(classes.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node")).select("root", "node", lead), "members")
    texts = inside.select("__key", text.cast("binary").alias("text")).join(small_side(members), F.col("__key") == F.col("__lead"))
    named = components(verified_links(staged(shingle_sets(texts), "sets"))).withColumnRenamed("node", "__node")
    owned = nodes.select("node", "lead").join(named, F.col("node") == F.col("__node"), "left").select("node", "lead", F.coalesce("root", "node").alias("root"))
    first = owned.groupBy("root").agg(F.min("lead").alias("first"))
    kept = owned.join(first, "root").select(F.col("node").alias("__node"), F.struct("first.doc_id", "first.text_hash").alias("first"))
    mine = F.struct("doc_id", "text_hash")
    # what is not simply kept: rows of a later document, and a key of several rows, of which one stays
    dropped = prints.join(kept, F.col("node") == F.col("__node")).where((mine != F.col("first")) | (F.col("rows") > 1))
    dropped = staged(dropped.select(mine.alias("__lead"), (mine == F.col("first")).alias("__once")), "dropped")
    marked = inside.join(small_side(dropped), F.col("__key") == F.col("__lead"), "left")
    once = marked.where("__once").dropDuplicates(["__key"])
    named_back = [F.col(f"__c{k}").alias(c) for k, c in enumerate(columns)]
    return marked.where("__once is null").select(*named_back).union(once.select(*named_back))
