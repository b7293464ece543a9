"""Exact k-nearest-neighbour join on short feature vectors.

References are dealt into the leaves of a tree of median cuts, built from a bounded sample; each leaf keeps the exact box of its
references. The distance from a query to a box bounds from below what the leaf can hold, also under weights of the query's own,
so a query visits leaves nearest first: one, then a few more, then only those that can still beat its k-th distance so far.
Leaves of more than ``block`` references are split by hash, and so are the queries of a popular leaf. A block emits k rows per
query; no pair table is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlytics.session import cut_lineage

#: Bound of the tree that travels to all tasks, and of the sample it is cut from.
MAX_LEAVES, SAMPLE_PER_LEAF = 8192, 32
#: Leaves visited before the k-th distance decides: in the first round, in the second.
FIRST_VISITS = (1, 4)
#: Numbers that a slice of a distance table may have.
SLICE = 1 << 21
#: Queries that meet a block in one task, at most (four times the block where that is less).
CHUNK = 16384
#: Runs that a row of a distance table is cut into to bound its k-th value.
RUNS = 256


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in col])


class MedianTree:
    """A complete binary tree of cuts at medians of a sample, each along the widest feature."""

    def __init__(self, sample: np.ndarray, n_leaves: int) -> None:
        self.depth = max(0, n_leaves - 1).bit_length()
        size = (1 << self.depth) - 1
        self.axis, self.cut = np.zeros(size, int), np.zeros(size)
        parts = {0: np.arange(len(sample))}
        for node in range(size):
            rows = parts.pop(node)
            if len(rows):
                spread = np.ptp(sample[rows], axis=0)
                self.axis[node] = spread.argmax()
                self.cut[node] = np.median(sample[rows, self.axis[node]])
            left = sample[rows, self.axis[node]] <= self.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = rows[left], rows[~left]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.cut[node])
        return (node - ((1 << self.depth) - 1)).astype("int32")


def box_distances(x: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least distance of each query to each leaf's box; infinite for an empty leaf."""
    total = np.zeros((len(x), len(low)))
    for f in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, f] - x[:, f, None], x[:, f, None] - high[None, :, f]), 0.0)
        total += np.where(np.isfinite(gap), w[:, f, None] * gap, np.inf) ** 2
    return np.sqrt(total / x.shape[1])


def plain_distances(q: np.ndarray, w: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.sqrt(np.mean((w * (r - q)) ** 2, axis=1))


def closest(Q: np.ndarray, W: np.ndarray, own: np.ndarray, R: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, row of the reference and distance of the k nearest references of each query; equal distances keep the
    order of the references.

    A matrix product gives w^2 (r^2 - 2 r q + q^2) for a whole slice, up to rounding. It only tells which references may be among
    the k nearest: those within the rounding of a k-th value or more, whose distances are then taken plainly.
    """
    dims, found = R.shape[1], []
    both = np.concatenate([R * R, R], axis=1).T
    runs = np.unique(np.linspace(0, len(R), min(len(R), max(k, RUNS)), endpoint=False).astype(int))
    step, piece = max(1, SLICE // len(R)), max(1, SLICE // dims)
    for a in range(0, len(Q), step):
        w2, x = W[a : a + step] ** 2, Q[a : a + step]
        size = (w2 * x * x).sum(1)
        d = np.concatenate([w2, -2.0 * w2 * x], axis=1) @ both + size[:, None]
        odd = None
        if not np.isfinite(d.sum()):  # too large or not a number: only the plain distance can tell
            odd = ~np.isfinite(d)
            d[odd] = np.inf
        d[np.nonzero(own[a : a + step, None] == ids[None, :])] = np.inf
        kth = np.full(len(d), np.inf)
        if len(runs) >= k:  # k runs have a value of this size or less
            kth = np.partition(np.minimum.reduceat(d, runs, axis=1), k - 1, axis=1)[:, k - 1]
        hit = d <= (kth + 64 * (dims + 4) * np.finfo(float).eps * (np.abs(kth) + size))[:, None]
        q, c = np.nonzero(hit if odd is None else hit | odd)
        other = own[a + q] != ids[c]
        q, c = a + q[other], c[other]
        dist = np.concatenate([plain_distances(Q[q[i : i + piece]], W[q[i : i + piece]], R[c[i : i + piece]]) for i in range(0, len(q), piece)] or [np.zeros(0)])
        fine = np.isfinite(dist)
        q, c, dist = q[fine], c[fine], dist[fine]
        order = np.lexsort((c, dist, q))
        q, c, dist = q[order], c[order], dist[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((q[first], c[first], dist[first]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def knn_join(
    queries: DataFrame, refs: DataFrame, k: int, *, by: Sequence[str] = (), block: int = 2048, max_leaves: int = MAX_LEAVES, visits: Sequence[int] = FIRST_VISITS, margin: float = 1e-7
) -> DataFrame:
    """(query_id, *by, ref_id, distance, rank): root-mean-square distance, ties by reference id, self excluded.

    queries: query_id, vec [, w] [, by]; refs: ref_id, vec. ``w`` holds per-query feature weights, so that
    distance^2 = mean((w (q - r))^2); without it all weights are one. ``by`` names further columns of a query's key, so one
    entity may ask several times (under other weights) in one join.
    """
    by = list(by)
    kinds = dict(queries.dtypes)
    id_type = dict(refs.dtypes)["ref_id"]
    key_schema = ", ".join([f"query_id {id_type}", *[f"{c} {kinds[c]}" for c in by]])
    keys = ["query_id", *by]
    if "w" not in queries.columns:
        queries = queries.withColumn("w", F.transform("vec", lambda _: F.lit(1.0)))
    n_refs = refs.count()
    if not n_refs:
        raise ValueError("no reference rows")
    n_leaves = min(max_leaves, 1 << max(0, -(-n_refs // block) - 1).bit_length())
    if n_leaves == 1:
        home = {"leaf": F.lit(0), "seen": F.lit(1), "n_blocks": F.lit(1)}
        return _best(_blocks(queries.select(*keys, "vec", "w").withColumns(home), refs.select("ref_id", "vec").withColumn("leaf", F.lit(0)), k, keys, key_schema, id_type, block), k, keys).drop("seen")
    sample = refs.orderBy(F.sha2(F.col("ref_id").cast("string"), 256)).limit(SAMPLE_PER_LEAF * n_leaves).select("vec").collect()
    tree = MedianTree(_stack(pd.Series([r["vec"] for r in sample])), n_leaves)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"ref_id": b["ref_id"], "vec": b["vec"], "leaf": tree.leaf(_stack(b["vec"]))})

    placed = cut_lineage(refs.select("ref_id", "vec").mapInPandas(assign, f"ref_id {id_type}, vec array<double>, leaf int"))
    dims = range(len(sample[0]["vec"]))
    edges = [f(F.get("vec", F.lit(i))).alias(f"{n}{i}") for n, f in (("a", F.min), ("b", F.max)) for i in dims]
    stats = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *edges).collect()  # max_leaves rows at most
    count = np.zeros(1 << tree.depth, int)
    low, high = np.full((len(count), len(dims)), np.inf), np.full((len(count), len(dims)), -np.inf)
    for r in stats:
        count[r["leaf"]] = r["n"]
        low[r["leaf"]], high[r["leaf"]] = [r[f"a{i}"] for i in dims], [r[f"b{i}"] for i in dims]
    step = max(1, SLICE // len(count))

    def visit(n: int | None):
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for a in range(0, len(whole), step):
                    b = whole.iloc[a : a + step]
                    near = box_distances(_stack(b["vec"]), _stack(b["w"]), low, high)
                    order = near.argsort(axis=1, kind="stable")
                    lower = np.take_along_axis(near, order, 1)
                    place = np.arange(near.shape[1])[None, :]
                    seen, bound = b["seen"].to_numpy()[:, None], b["bound"].to_numpy()[:, None]
                    hit = (place >= seen) & np.isfinite(lower) & (lower <= bound + margin)
                    if n is not None:
                        held = np.take_along_axis(np.broadcast_to(count, near.shape), order, 1).cumsum(1)
                        enough = np.maximum(n, (held < k + 1).sum(1) + 1)[:, None]  # the query may be one of the references
                        hit &= place < seen + enough
                    q, at = np.nonzero(hit)
                    out = {c: b[c].to_numpy()[q] for c in [*keys, "vec", "w"]}
                    leaf = order[q, at]
                    yield pd.DataFrame({**out, "leaf": leaf.astype("int32"), "seen": (seen[:, 0] + hit.sum(1))[q].astype("int32"), "n_blocks": (-(-count[leaf] // block)).astype("int32")})

        return rows

    schema = f"{key_schema}, vec array<double>, w array<double>, leaf int, seen int, n_blocks int"
    asking = queries.select(*keys, "vec", "w").withColumns({"seen": F.lit(0), "bound": F.lit(float("inf"))})
    best = None
    for n in (*visits, None):
        wide = asking.mapInPandas(visit(n), schema)
        found = _blocks(wide, placed, k, keys, key_schema, id_type, block)
        best = cut_lineage(_best(found if best is None else found.unionByName(best.drop("rank")), k, keys))
        if n is None:
            break
        # visited leaves are the nearest ones in order, so their number is all that a query remembers
        reach = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_d"), F.max("seen").alias("_seen"))
        bound = F.when(F.col("_n") >= k, F.col("_d")).otherwise(F.lit(float("inf")))
        asking = asking.drop("seen", "bound").join(reach, keys, "left").select(*keys, "vec", "w", F.coalesce("_seen", F.lit(0)).cast("int").alias("seen"), F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
    return best.drop("seen")


def _best(found: DataFrame, k: int, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("distance", "ref_id")
    rows = found.withColumn("seen", F.max("seen").over(Window.partitionBy(*keys))) if "seen" in found.columns else found
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks(left: DataFrame, placed: DataFrame, k: int, keys: list[str], key_schema: str, id_type: str, block: int) -> DataFrame:
    """k best per query inside every (leaf, part): queries meet each block of the leaves they visit."""
    chunks = left.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / min(4 * block, CHUNK)).cast("int").alias("n_chunks"))  # a row a leaf
    chunks = F.broadcast(cut_lineage(chunks))
    sizes = F.broadcast(placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks")))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    asked = left.join(chunks, "leaf").withColumn("chunk", slot(keys[0], "n_chunks")).withColumn("part", every("n_blocks"))
    held = placed.join(sizes, "leaf").join(chunks, "leaf").withColumn("part", slot("ref_id", "n_blocks")).withColumn("chunk", every("n_chunks"))
    schema = f"{key_schema}, ref_id {id_type}, distance double, seen int"
    names = [*keys, "ref_id", "distance", "seen"]

    def nearest(qs: pd.DataFrame, rs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(rs):
            return pd.DataFrame({n: [] for n in names})
        rs = rs.sort_values("ref_id", kind="stable")  # equal distances then stand in the order of the ids
        R, ids = _stack(rs["ref_vec"]), rs["ref_id"].to_numpy()
        Q, W, own = _stack(qs["vec"]), _stack(qs["w"]), qs["query_id"].to_numpy()
        at, near, dist = closest(Q, W, own, R, ids, k)
        out = {c: qs[c].to_numpy()[at] for c in keys}
        return pd.DataFrame({**out, "ref_id": ids[near], "distance": dist, "seen": qs["seen"].to_numpy()[at]})

    place = ["leaf", "part", "chunk"]
    cogrouped = asked.select(*keys, "vec", "w", "seen", *place).groupBy(*place).cogroup(held.select("ref_id", F.col("vec").alias("ref_vec"), *place).groupBy(*place))
    return cogrouped.applyInPandas(nearest, schema)
