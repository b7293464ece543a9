"""Substring dedup: lines, paragraphs or passages are normalised and hashed, equal digests are grouped over the whole corpus,
the earliest ranked occurrence stays and every other one is removed; spans keep their original offsets.

A passage is the shortest run of whole lines and sentences, from each one on, that has the given number of words. So a repeat
is found however its lines are broken and whatever stands around it, and common headings alone are no repeat."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlytics.llm.common import id_and_text, small_side, staged

UNITS = "doc_id long, unit_no int, start_pos long, end_pos long, n_words int, digest binary"
#: A sentence ends at a line break, or after '.', '!' or '?' before a blank; these pieces tile the text.
SENTENCE = re.compile(r"[^\n]*?(?:[.!?]+[ \t]+|\n|\Z)")
BLANKS = " \t\n\x0b\x0c\r"
PARAGRAPH_GAP = re.compile(r"\n[\x20\t\x0b\x0c\r]*\n\s*")


def split_units(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each line or paragraph, in characters, without the break that follows it."""
    if unit == "line":
        start = 0
        while (end := text.find("\n", start)) >= 0:
            yield start, end
            start = end + 1
        yield start, len(text)
    else:
        start = 0
        for gap in PARAGRAPH_GAP.finditer(text):
            yield start, gap.start()
            start = gap.end()
        yield start, len(text)


def normal_words(text: str) -> list[bytes]:
    """Words with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def passages(text: str, min_words: int) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(number, start, end, words) of the passage from each sentence on; a text with fewer words is one passage."""
    found = []
    for m in SENTENCE.finditer(text):
        tokens = normal_words(m.group())
        if tokens:
            body = m.group()
            found.append((m.end() - len(body.lstrip(BLANKS)), m.start() + len(body.rstrip(BLANKS)), tokens))
    total, last = 0, -1
    for k, (start, _, tokens) in enumerate(found):
        while total < min_words and last + 1 < len(found):
            last += 1
            total += len(found[last][2])
        if total < min_words and k:
            return
        yield k, start, found[last][1], [w for f in found[k : last + 1] for w in f[2]]
        total -= len(tokens)


def units_of(text: str, unit: str, min_words: int) -> Iterator[tuple[int, int, int, list[bytes]]]:
    if unit == "passage":
        yield from passages(text, min_words)
        return
    for k, (start, end) in enumerate(split_units(text, unit)):
        tokens = normal_words(text[start:end])
        if len(tokens) >= min_words:
            yield k, start, end, tokens


def text_units(docs: DataFrame, unit: str = "line", min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit of at least min_words words: place in the text and digest of the normalised unit
    (A-Z lower-cased, runs of ASCII blanks as one space). Null and empty texts have no units."""
    if unit not in ("line", "paragraph", "passage"):
        raise ValueError("unit is 'line', 'paragraph' or 'passage'")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in UNITS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                for k, start, end, tokens in units_of(text, unit, min_words):
                    digest = hashlib.md5(b" ".join(tokens), usedforsecurity=False).digest()
                    for column, value in zip(out, (doc_id, k, start, end, len(tokens), digest), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, UNITS)


def repeated_units(
    docs: DataFrame, unit: str = "line", min_words: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per unit to remove, with the place of the occurrence that stays.

    Rank: doc_id (null last), then offset. A digest that fills a third of the corpus is pre-aggregated before the
    shuffle. The table of repeated digests is written; its occurrences meet it by broadcast where it is small, else by a join
    of its own shuffle, which adaptive execution may split.
    Repeated rows and rows that share a doc_id are one document: the same place is not a duplicate of itself.
    Digests with one occurrence never reach the join's output. Empty tables give no rows.
    """
    units = staged(text_units(docs, unit, max(1, min_words), id_col, text_col), "units")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("start_pos"))
    kept = (
        units.groupBy("digest")
        .agg(F.min(place).alias("keep"), F.max(place).alias("latest"))
        .where(~F.col("keep").eqNullSafe(F.col("latest")))
        .select("digest", "keep")
    )
    kept = small_side(staged(kept, "kept"))
    here = F.struct(F.col("u.doc_id").isNull().alias("last"), F.col("u.doc_id"), F.col("u.start_pos"))
    return (
        units.alias("u")
        .join(kept.alias("k"), F.col("u.digest") == F.col("k.digest"))
        .where(~here.eqNullSafe(F.col("k.keep")))
        .select(
            "u.doc_id", "u.unit_no", "u.start_pos", "u.end_pos", "u.n_words", "u.digest",
            F.col("k.keep.doc_id").alias("keep_doc_id"), F.col("k.keep.start_pos").alias("keep_start_pos"),
        )
    )


def without_units(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed units (and the line break after each) cut from their texts; other columns as they were.

    Units may overlap. A null id meets null ids, a null text stays null, a document without removed units stays as it is."""
    spans = removed.groupBy(F.col("doc_id").alias("__cut_id")).agg(F.array_sort(F.collect_set(F.struct("start_pos", "end_pos"))).alias("__cuts"))
    columns = docs.columns
    inside = docs.select(*[docs[c].alias(f"__c{k}") for k, c in enumerate(columns)], docs[id_col].cast("long").alias("__id"))
    joined = inside.join(spans, F.col("__id").eqNullSafe(F.col("__cut_id")), "left")
    text = F.col(f"__c{columns.index(text_col)}")

    def add(seen: Column, span: Column) -> Column:
        """What is kept so far, and the place from which text is still to be kept."""
        start, end, at = span["start_pos"].cast("int"), span["end_pos"].cast("int"), seen["at"]
        broken = F.when(F.substr(text, end + 1, F.lit(1)) == "\n", end + 1).otherwise(end)
        return F.struct(
            F.when(start > at, F.concat(seen["kept"], F.substr(text, at + 1, start - at))).otherwise(seen["kept"]).alias("kept"),
            F.greatest(at, broken).alias("at"),
        )

    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    cut = F.aggregate("__cuts", start, add, lambda seen: F.concat(seen["kept"], F.substr(text, seen["at"] + 1, F.length(text))))
    clean = F.when(F.col("__cuts").isNull(), text).otherwise(cut)
    return joined.select(*[(clean if c == text_col else F.col(f"__c{k}")).alias(c) for k, c in enumerate(columns)])
