"""Benchmark decontamination by the q-gram lemma: shared character q-grams are counted in overlapping diagonal bands, regions
that reach the bound of the edit budget are retained, and a banded alignment verifies them.

An item of m characters within k edits of a region shares at least m - q + 1 - k * q of its q-grams with it, and their diagonals
(place in the text minus place in the item) span at most k + 1 values, which lie inside one of the bands of 2 * (k + 1)
diagonals laid every k + 1. So the filter loses nothing, and the alignment needs no diagonal outside the band.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlytics.llm.common import id_and_text, staged

Q = 8
EDIT_SHARE = 0.1
#: Characters of benchmark items in one index; a larger benchmark is matched block by block, each against all documents.
BLOCK_CHARS = 2_000_000
#: Characters of documents worked on at once; texts over twice this are searched in overlapping segments.
PIECE_CHARS = 1 << 20
#: q-gram hits counted at once, and cells of an alignment table.
HITS, CELLS = 1 << 21, 1 << 21
MATCHES = "doc_id long, item_id long, edits int, start_pos long, end_pos long"
BASE = np.uint64(0x9E3779B97F4A7C15)


def lower_table() -> np.ndarray:
    """Code point to lower case where that is one code point, blanks to a space."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for code in range(1 << 16):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if c.isspace():
            table[code] = 32
        elif len(low := c.lower()) == 1 and ord(low) < 1 << 16:
            table[code] = ord(low)
    return table


def normal(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with runs of blanks as one space, and the place of each in the input."""
    small = codes < len(table)
    low = np.where(small, table[np.where(small, codes, 0)], codes)
    blank = low == 32
    keep = np.ones(len(low), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    places = np.flatnonzero(keep)
    return low[places], places


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of every q-gram (q a power of two), by doubling."""
    h = codes.astype(np.uint64)
    factor, size = BASE, 1
    with np.errstate(over="ignore"):
        while size < q:
            h = h[:-size] + h[size:] * factor if len(h) > size else h[:0]
            factor, size = factor * factor, 2 * size
        h = h * BASE
        return h ^ (h >> np.uint64(29))


@dataclass
class Index:
    """q-grams of one block of benchmark items."""

    q: int
    ids: list = field(default_factory=list)
    codes: list[np.ndarray] = field(default_factory=list)

    def add(self, item_id: int, codes: np.ndarray) -> None:
        self.ids.append(item_id)
        self.codes.append(codes)

    def close(self, edit_share: float) -> Index:
        q, n = self.q, len(self.ids)
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.edits = np.minimum((self.length * edit_share).astype(np.int64), (self.length - q) // q)
        self.bound = self.length - q + 1 - self.edits * q
        self.flat, self.offset = np.concatenate(self.codes), np.cumsum(self.length) - self.length
        grams = [gram_hashes(c, q) for c in self.codes]
        hashes = np.concatenate(grams)
        item = np.repeat(np.arange(n), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.grams, self.first, self.times = np.unique(hashes[order], return_index=True, return_counts=True)
        bits = max(16, int(np.ceil(np.log2(64 * len(self.grams)))))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.grams >> self.shift] = True
        self.codes = []
        return self


def band_counts(at: np.ndarray, which: np.ndarray, offset: int, span: int, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Distinct item * span + band of all hits of the text q-grams (place, row of the index), and their number. A q-gram that
    many items share has as many hits as they are; hits are counted in slices, and only bands and counts are kept."""
    ends = np.cumsum(index.times[which])
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + HITS, side="right")))
        times = index.times[which[a:b]]
        row = np.repeat(index.first[which[a:b]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        item = index.item[row].astype(np.int64)
        band = (np.repeat(at[a:b], times) - index.place[row] + offset) // (index.edits[item] + 1)
        new, n = np.unique(item * span + band, return_counts=True)
        merged, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n]), len(merged)).astype(np.int64)
        keys, a = merged, b
    return keys, counts


def bands(codes: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(item, first diagonal) of each band with enough shared q-grams."""
    hashes = gram_hashes(codes, index.q)
    at = np.flatnonzero(index.seen[hashes >> index.shift])
    which = np.searchsorted(index.grams, hashes[at])
    which[which == len(index.grams)] = 0
    real = index.grams[which] == hashes[at]
    at, which = at[real], which[real]
    offset = 2 * int(index.length.max())  # keeps diagonals and bands positive
    span = len(codes) + 2 * offset + 2
    keys, counts = band_counts(at, which, offset, span, index)
    both = counts.copy()
    follows = np.flatnonzero(keys[1:] == keys[:-1] + 1)
    both[follows] += counts[follows + 1]
    bound = index.bound[keys // span]
    alone = counts >= bound  # with a band before it that has no hit of its own, but that the alignment may enter
    alone[1:] &= keys[1:] != keys[:-1] + 1
    hot = np.concatenate([keys[both >= bound], keys[alone] - 1])
    item = hot // span
    return item, hot % span * (index.edits[item] + 1) - offset


def align(codes: np.ndarray, item: np.ndarray, first: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits of each candidate inside its band, with start and end of the matched region; all candidates step together.
    A cell holds edits * 2**32 + its starting diagonal, so ties go to the earliest start."""
    one = np.int64(1) << np.int64(32)
    width = 2 * (index.edits[item] + 1)
    most, longest = int(width.max()), int(index.length[item].max())
    begin, final = index.offset[item], index.offset[item] + index.length[item] - 1
    reach = first[:, None] + np.arange(most + longest)
    inside = (reach >= 0) & (reach < len(codes))
    text = np.where(inside, codes[np.clip(reach, 0, len(codes) - 1)], 0)
    diagonal = np.arange(most)
    far = one * (1 << 20)
    cells = np.where(diagonal < width[:, None], diagonal, far).astype(np.int64)
    step = diagonal * one
    best = np.full((len(item), most), far, np.int64)
    for i in range(longest):
        swap = cells + np.where(text[:, i : i + most] == index.flat[np.minimum(begin + i, final)][:, None], 0, one)
        skip = np.full_like(cells, far)
        skip[:, :-1] = cells[:, 1:] + one
        cells = np.minimum(swap, skip)
        cells = np.minimum.accumulate(cells - step, axis=1) + step
        cells = np.where(diagonal < width[:, None], cells, far)
        done = index.length[item] == i + 1
        best[done] = cells[done]
    end = best.argmin(axis=1)
    cell = best[np.arange(len(item)), end]
    return cell // one, first + cell % one, first + end + index.length[item]


def matches(codes: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(item row, edits, start, end) in a normalised text; overlapping matches of one item give the best."""
    if len(codes) < index.q:
        return []
    item, first = bands(codes, index)
    if not len(item):
        return []
    order = np.argsort(index.length[item], kind="stable")  # short and long items are not aligned together
    item, first = item[order], first[order]
    reach = index.length[item] + 2 * (index.edits[item] + 1)
    found: list[tuple[int, int, int, int]] = []
    a = 0
    while a < len(item):
        near = reach[a : a + 512]
        some = slice(a, a + max(1, int((np.arange(1, len(near) + 1) * near <= CELLS).sum())))
        edits, start, end = align(codes, item[some], first[some], index)
        good = edits <= index.edits[item[some]]
        found += zip(item[some][good].tolist(), edits[good].tolist(), start[good].tolist(), end[good].tolist(), strict=True)
        a = some.stop
    return apart(found)


def apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping (item, edits, start, end) of one item, those with the fewest edits (ties: the earliest)."""
    best: list[tuple[int, int, int, int]] = []
    taken: list[tuple[int, int, int]] = []  # (item, start, end), ordered and apart
    for m in sorted(set(found), key=lambda x: (x[1], x[0], x[2])):
        k = bisect.bisect_left(taken, (m[0], m[3], 0))  # those before k start before this one's end
        if k == 0 or taken[k - 1][0] != m[0] or taken[k - 1][2] <= m[2]:
            taken.insert(k, (m[0], m[2], m[3]))
            best.append(m)
    return best


def matches_in_segments(codes: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """matches() over overlapping segments of a long text; a region is never longer than the overlap."""
    if len(codes) <= 2 * PIECE_CHARS:
        return matches(codes, index)
    overlap = int((index.length + index.edits).max()) + 1
    found = []
    for cut in range(0, len(codes), PIECE_CHARS):
        part = matches(codes[cut : cut + PIECE_CHARS + overlap], index)
        found += [(item, edits, start + cut, end + cut) for item, edits, start, end in part]
    return apart(found)


def blocks(items: DataFrame, q: int, edit_share: float, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of bounded size over all items, streamed to the driver one block at a time."""
    table, index, chars = lower_table(), Index(q), 0
    for row in items.select(items[id_col].cast("long"), items[text_col]).dropDuplicates().toLocalIterator():
        codes, _ = normal(code_points((row[1] or "").strip()), table)
        codes = codes[codes != 0]
        if len(codes) < q:
            continue
        if chars and chars + len(codes) > BLOCK_CHARS:
            yield index.close(edit_share)
            index, chars = Index(q), 0
        index.add(row[0], codes)
        chars += len(codes)
    if chars:
        yield index.close(edit_share)


def find_items(
    docs: DataFrame, items: DataFrame, q: int = Q, edit_share: float = EDIT_SHARE,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per region of a document within edit_share * item length edits of a whole item (letter case and runs of
    blanks aside), the best of overlapping ones: doc_id, item_id, edits, start and end in characters of the text.

    Documents pass through one map without a shuffle. Items shorter than q characters, null and empty texts match nothing;
    repeated rows repeat their matches; null ids stay null; empty tables give no rows.
    """
    picked = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    table = lower_table()
    found = spark.createDataFrame([], MATCHES)
    for index in blocks(items, q, edit_share, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast((index, table))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, table = shared.value
            gap = "\0" * (int(index.edits.max()) + 2)  # no alignment gets across

            def work(pieces: list[tuple[int, str]]) -> list[tuple]:
                codes, places = normal(code_points(gap.join(p[1] for p in pieces)), table)
                ends = np.cumsum([len(p[1]) + len(gap) for p in pieces])
                rows = []
                for item, edits, start, end in matches_in_segments(codes, index):
                    # either end of a region may reach into a gap, its middle never does
                    middle = int(places[min((max(0, start) + end) // 2, len(places) - 1)])
                    piece = int(np.searchsorted(ends, middle, side="right"))
                    doc_id, text = pieces[piece]
                    base = int(ends[piece]) - len(text) - len(gap)
                    begin = int(places[max(0, start)]) - base
                    last = int(places[min(end, len(places)) - 1]) + 1 - base
                    rows.append((doc_id, index.ids[item], edits, max(0, begin), min(last, len(text))))
                return rows

            for batch in batches:
                rows: list[tuple] = []
                waiting: list[tuple[int, str]] = []
                size = 0
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    text = text.as_py()
                    if not text:
                        continue
                    waiting.append((doc_id, text))
                    size += len(text)
                    if size >= PIECE_CHARS:
                        rows += work(waiting)
                        waiting, size = [], 0
                if waiting:
                    rows += work(waiting)
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in MATCHES.split(", ")])

        found = found.union(picked.mapInArrow(search, MATCHES))
    return found


def clean_documents(docs: DataFrame, items: DataFrame, q: int = Q, edit_share: float = EDIT_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, in which no item is found. Rows that share a doc_id are told apart by a
    hash of their text. Null and empty texts hold nothing and stay; repeated rows stay or go together; with no items all rows
    stay, and an empty table gives no rows."""
    columns = docs.columns
    inside = docs.select(*[docs[c].alias(f"__c{k}") for k, c in enumerate(columns)], F.xxhash64(docs[id_col], docs[text_col]).alias("__key"))
    keyed = inside.select(F.col("__key").alias("doc_id"), F.col(f"__c{columns.index(text_col)}").alias("text"))
    hit = staged(find_items(keyed, items, q, edit_share).select(F.col("doc_id").alias("__hit")).distinct(), "hits")
    clean = inside.join(hit, F.col("__key") == F.col("__hit"), "left_anti")
    return clean.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(columns)])
