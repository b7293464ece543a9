"""SimHash near-dedup with pivot distance tables: Hamming distances to many reference fingerprints are computed once per
fingerprint; pairs whose coordinates differ by more than the threshold anywhere are discarded, survivors are verified.

Two fingerprints within r bits agree on all but r of any r + s disjoint bit blocks, so they meet in at least one choice of s
blocks. Those choices are the shuffle keys; inside a key the pivot table does the work. Equal fingerprints are one node, and
a task emits a spanning forest of what it links, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.llm.common import staged

MAX_BITS = 4
N_PIVOTS = 16
#: A key with more distinct fingerprints than this is split into pairs of chunks, each pair a task of its own.
CHUNK = 4096


def fingerprint(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the lower-cased words of a UTF-8 text: majority of the bits of the shingles' XXH64."""
    return majority(shingle_digests(data.lower().split(), shingle, seed))


def shingle_digests(tokens: list[bytes], shingle: int, seed: int = 42) -> bytes:
    """XXH64 of each shingle, or of all tokens where there are no more than one shingle takes; nothing for no tokens."""
    if not tokens:
        return b""
    body = b" ".join(tokens)
    if len(tokens) <= shingle:
        return xxhash.xxh64_digest(body, seed)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_digest
    return b"".join([digest(body[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)])


def majority(digests: bytes) -> int:
    """Signed number of the bits that more than half of the 64-bit digests have; zero for none."""
    n = len(digests) // 8
    counts = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and a hash that tells texts with equal doc_ids apart; one row per input row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or b"", shingle) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), batch.column(1)], ["doc_id", "fp", "text_hash"])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].cast("binary").alias("text"))
    return picked.mapInArrow(rows, "doc_id long, fp long, text_hash long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(n_blocks: int, max_bits: int) -> list[int]:
    """Masks of every choice of n_blocks - max_bits bit blocks, as signed numbers."""
    edges = [round(64 * k / n_blocks) for k in range(n_blocks + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [signed(sum(choice)) for choice in itertools.combinations(blocks, n_blocks - max_bits)]


def blocks_for(n: int, max_bits: int) -> int:
    """Number of blocks at which n spread-out fingerprints have few neighbours in a key. Any number finds the same links."""
    for n_blocks in range(max_bits + 2, max_bits + 7):
        if n <= 8 << round(64 * (n_blocks - max_bits) / n_blocks):
            return n_blocks
    return max_bits + 7


def pivots(n_pivots: int = N_PIVOTS) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 64, n_pivots, dtype=np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference, one row per reference."""
    return np.stack([np.bitwise_count(fps ^ p) for p in refs]).astype(np.int8)


def local_roots(keys: np.ndarray, fps: np.ndarray, max_bits: int, refs: np.ndarray) -> np.ndarray:
    """For rows sorted by key: the first row of each row's linked component inside its key.

    Pairs are visited by their distance in the sort order, so memory stays proportional to the rows."""
    table = pivot_table(fps, refs)
    root = np.arange(len(fps))
    left = np.arange(len(fps))
    for shift in range(1, len(fps)):
        left = left[left < len(fps) - shift]
        left = left[keys[left] == keys[left + shift]]
        if not len(left):
            break
        a = left
        for distances in table:
            a = a[np.abs(distances[a] - distances[a + shift]) <= max_bits]
        a = a[np.bitwise_count(fps[a] ^ fps[a + shift]) <= max_bits]
        b = a + shift
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def links(nodes: DataFrame, max_bits: int = MAX_BITS, n_blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs of distinct fingerprints within max_bits."""
    n_blocks = n_blocks or blocks_for(nodes.count(), max_bits)
    masks = block_masks(n_blocks, max_bits)
    keyed = nodes.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).cast("short").alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                    for k, m in enumerate(masks)
                ]
            )
        ).alias("m"),
    ).select("fp", "m.mask", "m.key")
    return links_in_keys(keyed, max_bits, chunk)


def in_tiles(rows: DataFrame, key: list[str], by: str, chunk: int) -> DataFrame:
    """rows with chunk numbers t0 and t1: those of a key with more than chunk rows are dealt by a hash of a column into
    chunks, and come once for each pair of chunks that holds theirs."""
    crowded = staged(
        rows.groupBy(*key).count().where(F.col("count") > chunk)
        .select(*key, F.ceil(F.col("count") / chunk).cast("int").alias("chunks")),
        "crowded",
    )
    if crowded.isEmpty():
        return rows.withColumns({"t0": F.lit(0), "t1": F.lit(0)})
    own = F.pmod(F.xxhash64(by), F.col("chunks")).cast("int")
    return (
        rows.join(crowded, key, "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(*rows.columns, F.least("own", "other").alias("t0"), F.greatest("own", "other").alias("t1"))
    )


def links_in_keys(keyed: DataFrame, max_bits: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) whose connected components are those of all pairs within max_bits that share (mask, key). They name
    fingerprints (fp), or nodes where keyed has a column node."""
    names = ["node"] if "node" in keyed.columns else []
    tiled = in_tiles(keyed, ["mask", "key"], "fp", chunk)
    place = ["mask", "key", "t0", "t1"]
    refs = pivots()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, fps, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            root = local_roots(keys, fps.view(np.uint64), max_bits, refs)
            away = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(ids[away]), pa.array(ids[root[away]])], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows of a key that goes on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.zeros(batch.num_rows, [("m", "i8"), ("k", "i8"), ("t", "i8")])
            keys["m"], keys["k"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys["t"] = batch.column(2).to_numpy().astype("i8") << 32 | batch.column(3).to_numpy()
            fps, ids = batch.column(4).to_numpy(), batch.column(4 + len(names)).to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            if cut:
                yield linked([*held, (keys[:cut], fps[:cut], ids[:cut])])
                held = []
            held.append((keys[cut:], fps[cut:], ids[cut:]))
        if held:
            yield linked(held)

    dealt = tiled.repartition(*place).sortWithinPartitions(*place).select(*place, "fp", *names)
    return dealt.mapInArrow(link, "a long, b long").distinct()


#: A node is a hub if it has over HUB links and over one in HUB_SHARE of all links, so there are at most 2 * HUB_SHARE hubs.
HUB, HUB_SHARE = 1024, 100_000


def beside_least(pairs: DataFrame, least: DataFrame, n_pairs: int, hub: int = HUB) -> DataFrame:
    """pairs (a, b) with the row of least (n, m, n_links) of their a. The pairs of a hub are dealt over as many places as it
    has times the bound, and its one row of least is copied to each."""
    bound = max(hub, n_pairs // HUB_SHARE)
    if (least.agg(F.max("n_links")).first()[0] or 0) <= bound:
        return pairs.join(least, F.col("a") == F.col("n"))
    hubs = staged(least.where(F.col("n_links") > bound).select(F.col("n").alias("hub"), F.ceil(F.col("n_links") / bound).cast("int").alias("places")), "hubs")
    known = F.broadcast(hubs)
    dealt = pairs.join(known, F.col("a") == F.col("hub"), "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("places")), F.lit(0)).cast("int").alias("place"))
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("places"), F.lit(1)) - 1))
    spread = least.join(known, F.col("n") == F.col("hub"), "left").select("n", "m", copies.alias("at"))
    return dealt.join(spread, (F.col("a") == F.col("n")) & (F.col("place") == F.col("at")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node and the smallest node of its connected component, by alternating large-star and small-star rounds, each written
    to the shared folder. Rounds stop when nothing changes; their number grows with the logarithm of the nodes."""
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, n_edges = None, edges.count()
    link_count = F.count(F.lit(1)).alias("n_links")
    for _ in range(max_rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"), link_count)
        large = beside_least(both, least, 2 * n_edges).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("n")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        n_edges, mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n_edges, mark) == before:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        before = (n_edges, mark)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, root (a fingerprint that names the component) and the smallest doc_id of the component."""
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("lead")), "nodes")
    rooted = components(links(nodes.select("fp"), max_bits))
    named = nodes.join(rooted, F.col("fp") == F.col("node"), "left").select("fp", "lead", F.coalesce("root", "fp").alias("root"))
    named = staged(named, "named")
    leads = named.groupBy("root").agg(F.min("lead").alias("component_id"))
    return named.join(leads, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    Null and empty texts have fingerprint zero and link like any other. A null doc_id keeps its row and never names a
    component that has another id. Rows that share a doc_id are separate documents; an empty table gives no rows.
    """
    prints = staged(fingerprints(docs, shingle, id_col, text_col), "prints")
    named = classes(prints, max_bits).select(F.col("fp").alias("node"), "component_id")
    return prints.join(named, F.col("fp") == F.col("node")).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

