"""Source divergence audit: how far the word use of each (lang, source) group is from the other sources and from its language.

The kept terms of a language are dealt into segments of about SEGMENT term ids. Over a segment, the counts of a group are the
leaves of a binary tree whose nodes are hash-consed: equal subtrees, of one group or of several, are one node. Two groups are
compared by walking both trees at once; a pair of nodes that is met again is not walked again, its multiplicity grows, so every
distinct pair of counts is priced once. Spark sums the segments. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlytics.llm.common import staged

#: A term is a run of letters A to Z (lower-cased) and of characters outside ASCII.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
MIN_DOCS, SMOOTHING, SCALE, TOP_TERMS = 30, 5, 10**9, 50
SEGMENT = 1024
#: Groups of a language that meet in one task: pairs of blocks of so many.
BLOCK = 64
#: Distinct (group, term) counts that a task holds before it passes them on.
HELD = 400_000
COUNTS = "lang string, source string, term string, n long, docs long"
SHARES = "lang string, source string, item string, value long"


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with the term) of each group; one row with a null term per
    group, also of those without terms. Null text, lang and source count as ''. Tasks add up what they read before the shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, within) in groups.items():
                n = len(times)
                terms = pa.array([*times, None], pa.binary()).cast(pa.string())
                numbers = [pa.array([*times.values(), 0], pa.int64()), pa.array([*map(within.__getitem__, times), 0], pa.int64())]
                names = [pa.repeat(pa.scalar(name, pa.string()), n + 1) for name in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, terms, *numbers], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            for k, (lang, source, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                times, within = groups.setdefault((lang, source), (Counter(), Counter()))
                terms = text.as_py().translate(LETTERS).split()
                times.update(terms)
                within.update(set(terms))
                if k % 32 == 0 and sum(len(t) for t, _ in groups.values()) > HELD:
                    yield from passed_on()
        yield from passed_on()

    read = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    return read.mapInArrow(rows, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms)), in decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(38,0)")
    over = wide(F.lit(SCALE)) * (wide(n) + SMOOTHING)
    return F.lit(1) + F.call_function("div", over, wide(total) + wide(terms) * SMOOTHING)


def whole_shares(counts: np.ndarray, total: int, terms: int, smoothing: int) -> np.ndarray:
    """`share` of an array of counts; Python's whole numbers where 64 bits do not hold the product. Absent terms (-1) are 0."""
    top = counts + smoothing
    if len(top) and int(top.max()) >= (1 << 63) // SCALE:
        top = top.astype(object)
    found = 1 + SCALE * top // (total + smoothing * terms)
    return np.where(counts < 0, 0, found).astype(np.int64)


def consed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Segment trees of the rows of counts (a power of two wide): root of each row, count of each leaf node, and per level, from
    the leaves up, the left and right child of each distinct node."""
    leaves, at = np.unique(counts, return_inverse=True)
    at, levels = at.reshape(counts.shape), []
    while at.shape[1] > 1:
        width = int(at.max()) + 1
        pairs, up = np.unique(at[:, 0::2] * width + at[:, 1::2], return_inverse=True)
        levels.append((pairs // width, pairs % width))
        at = up.reshape(len(at), -1)
    return at[:, 0], leaves, levels


def tree_distances(first: np.ndarray, others: np.ndarray, levels: list, first_shares: np.ndarray, other_shares: np.ndarray) -> np.ndarray:
    """Sum of the absolute differences of shares between one tree and each of the others, walked together from the roots.

    `first` and `others` are roots; a row of shares holds the share of each leaf node. Met pairs (tree, node, node) carry how
    often they are met, so the walk is over distinct pairs."""
    tree, a, b, times = np.arange(len(others)), np.broadcast_to(first, len(others)), others, np.ones(len(others), np.int64)
    for left, right in reversed(levels):
        tree, times = np.concatenate([tree, tree]), np.concatenate([times, times])
        a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
        width = int(max(a.max(), b.max())) + 1
        met, back = np.unique((tree * width + a) * width + b, return_inverse=True)
        total = np.zeros(len(met), np.int64)
        np.add.at(total, back, times)
        tree, a, b, times = met // (width * width), met // width % width, met % width, total
    sums = np.zeros(len(others), np.int64)
    np.add.at(sums, tree, times * np.abs(first_shares[a] - other_shares[tree, b]))
    return sums


def segment_distances(table: pa.Table) -> pa.Table:
    """Rows of SHARES for the pairs of groups of one segment tile, both ways round."""
    rows = table.to_pylist()
    width = 1 << max(0, rows[0]["width"] - 1).bit_length()
    counts = np.full((len(rows), width), -1, np.int64)
    counts[:, : rows[0]["width"]] = 0
    for k, row in enumerate(rows):
        for cell in row["cells"] or ():
            counts[k, cell["tid"]] = cell["n"]
    roots, leaves, levels = consed(counts)
    shares = np.stack([whole_shares(leaves, r["total"], r["terms"], SMOOTHING) for r in rows])
    block = np.array([r["block"] for r in rows])
    place = np.array([r["place"] for r in rows])
    out: list[tuple[str, str, str, int]] = []
    for k in np.flatnonzero(block == rows[0]["t0"]):
        rest = np.flatnonzero((block == rows[0]["t1"]) & (place > place[k]))
        if len(rest):
            found = tree_distances(roots[k], roots[rest], levels, shares[k], shares[rest]).tolist()
            for j, value in zip(rest.tolist(), found, strict=True):
                a, b = rows[k]["source"], rows[j]["source"]
                out += [(rows[k]["lang"], a, b, value), (rows[k]["lang"], b, a, value)]
    columns = list(zip(*out, strict=True)) or [()] * 4
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("lang", "source", "item", "value"), columns, kinds, strict=True)})


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Terms of a language in at least min_docs of its documents: their count, segment and number in it (frequent first)."""
    named = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    named = staged(named.select("lang", "term", "lang_n"), "terms")
    sizes = staged(named.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SEGMENT).alias("parts")), "sizes")  # so small that its terms stay where they are
    dealt = named.join(sizes, "lang").withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")))
    inside = Window.partitionBy("lang", "part")
    numbered = dealt.repartition("lang", "part").withColumns({"tid": F.row_number().over(inside.orderBy(F.desc("lang_n"), "term")) - 1, "width": F.count(F.lit(1)).over(inside)})
    return staged(numbered.drop("parts"), "kept")


def all_groups(counts: DataFrame, cells: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per group: total (its count of kept terms), terms (kept terms of its language), lang_total, and its place among
    the sources of the language."""
    groups = counts.where("term is null").select("lang", "source")
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    known = groups.join(sums, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["total", "terms"])
    whole = Window.partitionBy("lang")
    return known.withColumns({"lang_total": F.sum("total").over(whole), "place": F.row_number().over(whole.orderBy("source")) - 1, "groups": F.count(F.lit(1)).over(whole)})


def pair_distances(groups: DataFrame, cells: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language), value."""
    sparse = cells.groupBy("lang", "source", "part").agg(F.collect_list(F.struct("tid", "n")).alias("cells"))  # at most a segment
    widths = kept.groupBy("lang", "part").agg(F.first("width").alias("width"))
    parts = F.greatest(F.ceil(F.col("terms") / SEGMENT), F.lit(1))
    spread = groups.withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)), "block": F.floor(F.col("place") / BLOCK).cast("int")})
    known = spread.join(widths, ["lang", "part"], "left").join(sparse, ["lang", "source", "part"], "left")
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("groups") - 1) / BLOCK).cast("int")))
    tiled = known.withColumn("other", other).select(
        "lang", "source", "part", "place", "block", F.least("block", "other").alias("t0"), F.greatest("block", "other").alias("t1"),
        "total", "terms", F.coalesce("width", F.lit(0)).alias("width"), "cells",
    )
    found = tiled.groupBy("lang", "part", "t0", "t1").applyInArrow(segment_distances, SHARES)
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    placed = rows.withColumn("rank", F.row_number().over(by))
    placed = placed.where(F.col("rank") <= top) if top else placed
    return placed.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: part 'pair' has the distance to each other source of the language, part 'term' the
    top terms that the group uses more than its language.

    Repeated rows count as often as they occur. A language without kept terms has pairs of distance 0, an empty table no rows;
    equal values are ranked by item, bytewise. Columns other than text, lang and source are not read.
    """
    counts = staged(term_counts(docs), "counts")
    kept = kept_terms(counts, min_docs)
    cells = staged(counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "cells")
    groups = staged(all_groups(counts, cells, kept), "groups")
    known = cells.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    over = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = known.select("lang", "source", F.col("term").alias("item"), over.alias("value")).where("value > 0")
    return ranked(pair_distances(groups, cells, kept), "pair").unionByName(ranked(terms, "term", top))
